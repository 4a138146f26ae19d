"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams (one to three characters of
lower-cased text, runs of other characters than letters counting as one blank), most
frequent first. The distance of a document to a language adds up, over the document's
profile, how far each n-gram is out of its place in the language's profile; an n-gram that
is missing there is out of place by the profile's length. The nearest language wins.

Profiles of languages are counted over all labelled rows they are given, in tasks first and
then by a sum; only the most frequent n-grams of each language reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vecloom.llm.texts import map_texts, pieces

# N-grams in a profile.
PROFILE = 300
UNKNOWN = "und"
# Below this score the pipeline takes a document for no language.
MIN_SCORE = 0.02


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None, letters: np.ndarray) -> np.ndarray:
    """All n-grams of a text, sorted, as integers; empty if it holds no letter.

    A character takes 21 bits; a shorter n-gram has zeros in front.
    """
    if not text:
        return np.zeros(0, np.int64)
    lower = text.lower().encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(lower, np.uint32).astype(np.int64)
    own = letters[codes]
    if not own.any():
        return np.zeros(0, np.int64)
    codes[~own] = 32
    # One blank for each run of other characters, and one at either end.
    stays = own.copy()
    stays[1:] |= own[:-1]
    words = np.concatenate(([32], codes[stays | (np.arange(len(codes)) == 0)], [32]))
    if words[1] == 32:
        words = words[1:]
    if words[-2] == 32:
        words = words[:-1]
    two = words[:-1] << 21 | words[1:]
    out = np.concatenate((words[words != 32], two, two[:-1] << 21 | words[2:]))
    out.sort()
    return out


def counted(sorted_grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams and their counts."""
    first = np.flatnonzero(np.concatenate(([True], sorted_grams[1:] != sorted_grams[:-1])))
    return sorted_grams[first], np.diff(np.concatenate((first, [len(sorted_grams)])))


def top(different: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    if len(counts) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        different, counts = different[some], counts[some]
    return different[np.argsort(-counts, kind="stable")[:size]]


def train_profiles(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE
) -> dict[str, np.ndarray]:
    """The profile of every non-null language in ``df``, counted over all of its rows."""

    def count(batches):
        letters = letter_table()
        totals: dict[str, list] = {}

        def flushed():
            for lang, parts in totals.items():
                joined, numbers = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(joined, kind="stable")
                joined, numbers = joined[order], numbers[order]
                first = np.flatnonzero(np.concatenate(([True], joined[1:] != joined[:-1])))
                sums = np.add.reduceat(numbers, first)
                for lo in range(0, len(first), 50_000):
                    part = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(first[part])),
                            pa.array(joined[first][part]),
                            pa.array(sums[part].astype(np.int64)),
                        ],
                        names=["lang", "gram", "n"],
                    )
            totals.clear()

        held = 0
        for batch in batches:
            for piece in pieces(batch, 1):
                for lang, text in zip(*(c.to_pylist() for c in piece.columns)):
                    found = grams(text, letters)
                    if len(found):
                        different = counted(found)
                        totals.setdefault(lang, []).append(different)
                        held += len(different[0])
                if held > 1_000_000:
                    yield from flushed()
                    held = 0
        yield from flushed()

    rows = df.filter(F.col(lang_col).isNotNull()).select(lang_col, text_col)
    counts = rows.mapInArrow(count, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A language has far more n-grams than a profile: the first cut keeps the best of each
    # of many parts, so the second ranks a bounded number.
    part = F.pmod(F.col("gram"), F.lit(64))
    order = [F.desc("n"), F.asc("gram")]
    within = Window.partitionBy("lang", part).orderBy(*order)
    best = totals.withColumn("r", F.row_number().over(within)).filter(F.col("r") <= size)
    over = Window.partitionBy("lang").orderBy(*order)
    best = best.withColumn("r", F.row_number().over(over)).filter(F.col("r") <= size)
    found = best.select("lang", "gram", "r").orderBy("lang", "r").toArrow()
    names, codes = found.column("lang").to_pylist(), found.column("gram").to_numpy()
    profiles: dict[str, list] = {}
    for name, code in zip(names, codes):
        profiles.setdefault(name, []).append(code)
    return {name: np.array(codes, np.int64) for name, codes in profiles.items()}


def classifier(profiles: dict[str, np.ndarray], size: int = PROFILE):
    """Factory of kernels from texts to (lang_pred, score)."""
    names = sorted(profiles)
    known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
    # The place of every known n-gram in every profile; beyond the end if it is not there.
    places = np.full((len(known) + 1, len(names)), size, np.int64)
    for column, name in enumerate(names):
        own = profiles[name]
        places[np.searchsorted(known, own), column] = np.arange(len(own))
    missing = len(known)

    def start():
        letters = letter_table()

        def kernel(texts: list):
            langs, scores = [], []
            for text in texts:
                found = grams(text, letters)
                if not len(found) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                own = top(*counted(found), size)
                at = np.searchsorted(known, own)
                at[at == missing] = 0
                at = np.where(known[at] == own, at, missing)
                place = places[at]
                gap = np.abs(place - np.arange(len(own))[:, None])
                gap[place == size] = size
                distance = gap.sum(axis=0)
                best = int(distance.argmin())
                langs.append(names[best])
                scores.append(1.0 - float(distance[best]) / (size * len(own)))
            return [langs, scores]

        return kernel

    return start


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's labels are kept from learning; a null id is not."""
    third = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
    return F.coalesce(third == 1, F.lit(False))


def identify(
    df: DataFrame,
    profiles: dict[str, np.ndarray],
    keep: list[Column],
    text_col: str = "text",
    size: int = PROFILE,
) -> DataFrame:
    """(keep..., lang_pred, score) of every row of ``df``.

    ``score`` is 1 minus the distance as a share of the largest possible. Null texts, texts
    without a letter, and all texts where nothing was learned are ``und`` with score 0.
    Ties go to the first language by code point; repeated rows stay.
    """
    start = classifier(profiles, size)
    return map_texts(df, keep, F.col(text_col), start, "lang_pred string, score double")


def learn(df: DataFrame, id_col: str = "doc_id") -> dict[str, np.ndarray]:
    """Profiles from the rows that are not held out; a row without an id is not used."""
    return train_profiles(df.filter(F.col(id_col).isNotNull() & ~held_out(id_col)))
