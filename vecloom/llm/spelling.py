"""Spelling variants: words one edit apart, found with a bit-sliced position index.

The index holds, for each place of a word and each letter, a bitset over the vocabulary: the
words that have this letter there. A query word is read letter by letter while four
bitsets over all words are kept: those that agree so far with no error, and those with one
letter replaced, left out or put in. A left-out or put-in letter only shifts the place that
is looked up, so a step is a few word-parallel operations for the whole vocabulary.

A vocabulary that grows with the corpus is dealt to many indexes. Two words one edit apart
share their first half or, if the edit lies there, their last one; so each half is a key, keys
are hashed to parts of a bounded number of words, and every part is an index that all of its
words query. A part that is still too large, because many words share a half, is cut into blocks,
and each pair of blocks is an index with its queries. No pair of words is formed but the near ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.session import materialise

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A run whose check sum is a multiple of this loses a letter.
DAMAGE = 97
# Words of an index, and code points of them together, that a part aims at and a block may hold.
PART_WORDS, BLOCK_WORDS = 2048, 4096
BLOCK_POINTS = 1 << 20


# -- Words -----------------------------------------------------------------------------------


def lower_ascii(text: Column) -> Column:
    """Only A-Z in lower case; a text without other letters takes the short way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def damaged(prefix: Column, run: Column) -> Column:
    """The run, without one letter if the check sum of prefix and run says so."""
    check = F.crc32(F.concat(prefix, run).cast("binary"))
    place = (check % F.char_length(run)).cast("int")
    without = F.concat(
        run.substr(F.lit(1), place), run.substr(place + F.lit(2), F.char_length(run))
    )
    return F.when(check % DAMAGE == 0, without).otherwise(run)


def count_words(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_points: int = 5,
    least_count: int = 3,
) -> DataFrame:
    """(word, n) of all words of at least ``least_points`` code points and ``least_count``
    occurrences in all texts. Null and empty texts have none, a null id counts as an empty one,
    and repeated rows count again."""
    prefix = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    runs = df.select(
        prefix.alias("prefix"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"),
    )
    # A damaged run is shorter by one, so shorter runs never make a word.
    long = runs.where(F.char_length("run") >= least_points)
    words = long.select("prefix", lower_ascii(F.col("run")).alias("run")).select(
        damaged(F.col("prefix"), F.col("run")).alias("word")
    )
    counted = words.where(F.char_length("word") >= least_points).groupBy("word")
    return counted.agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# -- The index -------------------------------------------------------------------------------


def slice_at(letters: np.ndarray, size: int) -> np.ndarray:
    """The bitsets of one place: [letter, word bits], from the letter of each word there."""
    bits = np.packbits(letters[None, :] == np.arange(size)[:, None], axis=1, bitorder="little")
    padded = np.zeros((size, -(-bits.shape[1] // 8) * 8), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return padded.view(np.uint64)


def mask(chosen: np.ndarray) -> np.ndarray:
    return slice_at(np.where(chosen, 0, 1), 1)[0]


def one_error(stock: np.ndarray, lengths: np.ndarray, asked: np.ndarray, size: int):
    """Bitsets over the words ``stock`` that are exactly one edit from each of ``asked``.

    ``stock`` is [word, place] of letters below ``size``, letter 0 past a word's end, with two
    such places at least; ``asked`` is [query, place] of queries of one length.
    """
    count, length = asked.shape
    blank = np.zeros((size, -(-len(stock) // 64)), np.uint64)
    exact = np.repeat(mask(np.ones(len(stock), bool))[None, :], count, axis=0)
    swapped, fewer, more = (np.zeros_like(exact) for _ in range(3))
    last, here, after = blank, blank, slice_at(stock[:, 0], size)
    for place in range(length):
        last, here = here, after
        after = slice_at(stock[:, place + 1], size) if place + 1 < stock.shape[1] else blank
        letter = asked[:, place]
        same = here[letter]
        fewer &= last[letter]
        fewer |= exact
        more |= exact
        more &= after[letter]
        swapped &= same
        swapped |= exact & ~same
        exact &= same
    # What is left of the index's words must be as long as the kind of error says.
    swapped &= mask(lengths == length)
    fewer &= mask(lengths == length - 1)
    more |= exact
    more &= mask(lengths == length + 1)
    return swapped | fewer | more


def set_bits(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of all set bits."""
    row, word = np.nonzero(sets)
    bits = np.unpackbits(sets[row, word][:, None].view(np.uint8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    return row[at], word[at] * 64 + bit


def near_pairs(
    words: list[str], asks: np.ndarray, stands: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, near) places in ``words`` one edit apart, from the words that ask to those that
    stand in the index, with the letters and lengths of all words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max()) + 2
    points = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
    alphabet, letters = np.unique(np.append(points, np.uint32(0)), return_inverse=True)
    letters = letters[:-1].reshape(points.shape)
    stock = np.flatnonzero(stands)
    pairs = []
    for length in np.unique(lengths[asks]):
        own = np.flatnonzero(asks & (lengths == length))
        near = one_error(letters[stock], lengths[stock], letters[own, :length], len(alphabet))
        query, found = set_bits(near)
        pairs.append((own[query], stock[found]))
    query, found = (np.concatenate(p) for p in zip(*pairs)) if pairs else (stock[:0],) * 2
    return query, found, letters, lengths


def part_kernel(key, table):
    """(word, n_near, near_n, near) of the words that ask in one part or pair of blocks: how
    many near words this part tells of, and the most frequent one."""
    m, side = key[0].as_py(), key[1].as_py()
    table = table.combine_chunks()
    table = table.take(pc.sort_indices(table.column("word")))
    asks, stands = (table.column(c).to_numpy() for c in ("asks", "stands"))
    n = table.column("n").to_numpy()
    query, near, letters, lengths = near_pairs(table.column("word").to_pylist(), asks, stands)
    # A pair belongs to the class of its shorter word, and to its first halves if they agree.
    head = (letters[query, : m // 2] == letters[near, : m // 2]).all(axis=1)
    own = (np.minimum(lengths[query], lengths[near]) == m) & (head == (side == 0))
    query, near = query[own], near[own]
    # Words come sorted, so places order ties by code point.
    order = np.lexsort((near, -n[near], query))
    query, near = query[order], near[order]
    asked, first, count = np.unique(query, return_index=True, return_counts=True)
    word = table.column("word")
    best = pa.array(near[first])
    return pa.table(
        {
            "word": word.take(pa.array(asked)),
            "n_near": pa.array(count.astype(np.int64)),
            "near_n": table.column("n").take(best),
            "near": word.take(best),
        }
    )


def near_words(
    words: DataFrame, part_words: int = PART_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(word, n_near, near_n, near) for each of the different ``words(word, n)`` that has near
    words: how many, and the most frequent one (ties: first by code point) with its count."""
    length = F.char_length("word")
    classes = words.select(
        "word", "n", F.explode(F.array(length, length - 1)).alias("m")
    ).where("m > 0")
    keyed = classes.select(
        "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    )
    half = F.floor(F.col("m") / 2).cast("int")
    key = F.when(F.col("side") == 0, F.col("word").substr(F.lit(1), half)).otherwise(
        F.expr("right(word, m - cast(floor(m / 2) as int))")
    )
    keyed = keyed.withColumn("hash", F.xxhash64(key))

    def at_most(count: int) -> Column:
        return F.greatest(F.lit(1), F.least(F.lit(count), F.lit(BLOCK_POINTS) / F.col("m")))

    # Parts follow the number of words of a class, of which there is one for each length; a class
    # without shorter words has no pairs.
    sizes = classes.groupBy("m").agg(F.count("*").alias("rows"), F.min(length).alias("least"))
    parts = sizes.where("least = m").select(
        "m", F.ceil(F.col("rows") / at_most(part_words)).alias("parts")
    )
    dealt = keyed.join(F.broadcast(parts), "m").select(
        "m", "side", F.pmod("hash", "parts").alias("part"), "word", "n"
    )
    shape = ["m", "side", "part"]
    counts = dealt.groupBy(*shape).agg(F.count("*").alias("rows")).select(
        *shape, F.ceil(F.col("rows") / at_most(block_words)).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int")
    placed = dealt.join(counts, shape).withColumn("own", own)

    def place(a, b, asks, stands) -> Column:
        return F.struct(
            a.alias("a"), b.alias("b"), asks.alias("asks"), stands.alias("stands")
        )

    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    yes, no = F.lit(True), F.lit(False)
    asking = F.transform(every, lambda i: place(F.col("own"), i, yes, i == F.col("own")))
    others = F.filter(every, lambda i: i != F.col("own"))
    standing = F.transform(others, lambda i: place(i, F.col("own"), no, yes))
    spread = placed.select(*shape, "word", "n", F.explode(F.concat(asking, standing)).alias("x"))
    spread = spread.select(*shape, "x.a", "x.b", "word", "n", "x.asks", "x.stands")
    found = spread.groupBy(*shape, "a", "b").applyInArrow(
        part_kernel, "word string, n_near long, near_n long, near string"
    )
    best = F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select(
        "word", "n_near", (-F.col("x.down")).alias("near_n"), "x.near"
    )


# -- Groups ----------------------------------------------------------------------------------


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where the steps of ``forms(word, form)`` end. Every round doubles the steps
    taken, so there are as many rounds as the logarithm of the longest chain; each is written."""
    steps = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = steps.join(further, steps["root"] == further["at"], "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")
        )
        moved = materialise(moved, "forms")
        steps = moved.select("word", "root")
        if moved.where("on").isEmpty():
            return steps


def group_variants(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_points: int = 5,
    least_count: int = 3,
    ratio: int = 2,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    ``form`` is the near word of largest n (ties: first by code point) if that is at least
    ``ratio`` (above 1) times the word's own, else null; ``root`` is where forms lead. Null and
    empty texts have no words; an empty table gives no rows; see ``count_words`` for null ids.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variant")
    words = materialise(count_words(df, id_col, text_col, least_points, least_count), "words")
    near = materialise(near_words(words), "near-words")
    known = words.join(near, "word", "left")
    taken = F.col("near_n") >= ratio * F.col("n")
    formed = known.select(
        "word",
        F.when(taken, F.col("near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("near_n")).alias("form_n"),
    )
    formed = materialise(formed, "formed")
    roots = last_forms(formed.where(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
