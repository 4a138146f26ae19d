"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. What speaks for either are measures of the line itself
and of its two neighbours, cut into bins with a weight each, and which labels follow one
another. Forward and backward messages give the probability that a line is good, given
all lines of the text; a document's quality is the mean of its lines' probabilities,
weighted by their lengths.

With two labels a message is one number, the log odds of good against bad, so a pass over a
text costs some operations a line and keeps a few numbers for each.

Only whole documents are labelled: the lines of a training document carry its label. The model is
fitted on a bounded sample of labelled rows (``TRAIN_ROWS``); all other steps see every text whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.texts import map_texts

# Labelled rows that the model is fitted on at most, and lines of a row that still teaches.
TRAIN_ROWS = 6_000
TRAIN_LINES = 500
# From this score on a document is predicted to be good.
GOOD = 0.7
# Bins of a measure, and lines that are measured at once.
BINS = 16
BLOCK_LINES = 1 << 14

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
HIGH = bytes(range(128, 256))
STOPS = b".,;:'\"-()"
STRESS = b"!?"
SYMBOLS = bytes(
    c for c in range(33, 127) if c not in LETTERS and c not in DIGITS and c not in STOPS + STRESS
)

# -- Measures of lines -----------------------------------------------------------------------

MEASURES = 15
NO_WORDS: frozenset = frozenset()
BLANK = (0.0,) * MEASURES


def lines_of(text: bytes) -> Iterator[bytes]:
    """The lines of a text; an empty one is one empty line."""
    start, stop = 0, text.find(b"\n")
    while stop >= 0:
        yield text[start:stop]
        start = stop + 1
        stop = text.find(b"\n", start)
    yield text[start:]


def measure(line: bytes, before: frozenset, seen: set) -> tuple[tuple, frozenset]:
    """The measures of a line, from its words, those of the line before and the lines so
    far; and its words."""
    words = line.split()
    if not words:
        return BLANK, NO_WORDS
    kinds = frozenset(words)
    size, count = len(line), len(words)
    sizes = [*map(len, words)]
    letters = size - len(line.translate(None, LETTERS))
    high = size - len(line.translate(None, HIGH))
    repeated = line in seen
    seen.add(line)
    return (
        1.0,
        log1p(size),
        (size - len(line.translate(None, UPPER))) / (letters or 1),
        (letters + high) / size,
        (size - len(line.translate(None, DIGITS))) / size,
        (size - len(line.translate(None, SYMBOLS))) / size,
        (size - len(line.translate(None, STRESS))) / size,
        (size - len(line.translate(None, STOPS))) / size,
        high / size,
        count / size,
        sum(map((4).__gt__, sizes)) / count,
        log1p(max(sizes)),
        len(kinds) / count,
        len(kinds & before) / len(kinds),
        float(repeated),
    ), kinds


def measured(text: bytes | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(measures, lengths) of a text's lines, in blocks."""

    def block():
        x = np.frombuffer(values, np.float32).reshape(-1, MEASURES)
        return x, np.frombuffer(sizes, np.int64)

    values, sizes = array("f"), array("q")
    before, seen = NO_WORDS, set()
    for line in lines_of(text or b""):
        own, before = measure(line, before, seen)
        values.extend(own)
        sizes.append(len(line))
        if len(sizes) == BLOCK_LINES:
            yield block()
            values, sizes = array("f"), array("q")
    if sizes:
        yield block()


# -- The field -------------------------------------------------------------------------------


@dataclass
class Field:
    """``cuts``: the bins of each measure. ``weights`` [3, measure, bin]: what a bin of the
    line itself, of the line before and of the line after adds to the log odds of good;
    ``ends``: what a missing line before or after adds. ``steps`` [label, next label]."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    ends: np.ndarray
    steps: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        codes = [np.searchsorted(cut, x[:, f]) for f, cut in enumerate(self.cuts)]
        return np.stack(codes, axis=1).astype(np.uint8)

    def votes(self, codes: np.ndarray) -> np.ndarray:
        """[3, line]: what each line adds for itself, for the next line and for the last one."""
        place = np.arange(MEASURES)
        return np.stack([w[place, codes].sum(axis=1) for w in self.weights])

    def marginals(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The probability of good, and the length, of each line of a text."""
        blocks = [(self.votes(self.bins(x)), sizes) for x, sizes in measured(text)]
        votes = np.concatenate([v for v, _ in blocks], axis=1)
        sizes = np.concatenate([s for _, s in blocks])
        own = votes[0]
        own[1:] += votes[1, :-1]
        own[:-1] += votes[2, 1:]
        own[0] += self.ends[0]
        own[-1] += self.ends[1]
        return 1.0 / (1.0 + np.exp(-np.clip(messages(own, self.steps), -500, 500))), sizes

    def quality(self, text: bytes | None) -> float:
        """The mean probability, weighted by length; of a text of empty lines, their mean."""
        good, sizes = self.marginals(text)
        return float(np.average(good, weights=sizes if sizes.any() else None))


def both(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    return x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))


def messages(own: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Log odds of good for every line of one text, given all its lines."""
    (bb, bg), (gb, gg) = steps.tolist()
    out = array("d", own.tobytes())
    odds = 0.0
    for i, vote in enumerate(own.tolist()):
        odds = vote + (both(bg, odds + gg) - both(bb, odds + gb) if i else 0.0)
        out[i] = odds
    back = 0.0
    for i in range(len(own) - 1, 0, -1):
        ahead = back + own[i]
        back = both(gb, ahead + gg) - both(bb, ahead + bg)
        out[i - 1] += back
    return np.frombuffer(out, np.float64)


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Bins of each measure: zero, and quantiles of what is above."""
    cuts = []
    for column in x.T:
        above = column[column > 0]
        shares = np.linspace(0, 1, BINS)[1:-1]
        inner = np.quantile(above, shares) if len(above) else np.zeros(0)
        cuts.append(np.unique(np.append(inner, 0.0))[: BINS - 1])
    return cuts


def odds_step(odds: np.ndarray, steps: np.ndarray, back: bool) -> np.ndarray:
    """The message that follows from log odds, over many texts at once."""
    (bb, bg), (gb, gg) = steps
    if back:
        bg, gb = gb, bg
    return np.logaddexp(bg, odds + gg) - np.logaddexp(bb, odds + gb)


def fit_field(
    texts: list[np.ndarray], labels: np.ndarray, rounds: int = 150, rate: float = 0.1,
    ridge: float = 1e-4,
) -> Field:
    """The field that makes the labels of the training lines likeliest, with a ridge; by
    gradient ascent with a running step size for each weight.

    ``texts`` holds the measures of each text's lines, ``labels`` the label of each text.
    """
    # Longest first, so the texts that have a line at a place come first.
    order = np.argsort([-len(t) for t in texts], kind="stable")
    texts, labels = [texts[i] for i in order], labels[order]
    sizes = np.array([len(t) for t in texts])
    x = np.concatenate(texts)
    field = Field(cuts_of(x), np.zeros((3, MEASURES, BINS)), np.zeros(2), np.zeros((2, 2)))
    codes = field.bins(x) + np.arange(MEASURES) * BINS
    starts = np.cumsum(sizes) - sizes
    lasts = starts + sizes - 1
    y = np.repeat(labels, sizes).astype(np.float64)
    inner = np.ones(len(x), bool)
    inner[starts] = False
    after = np.flatnonzero(inner)
    before = after - 1
    active = [int(np.searchsorted(-sizes, -place)) for place in range(sizes[0] + 1)]
    flat = np.zeros(3 * MEASURES * BINS + 2 + 4)
    mean, spread = np.zeros_like(flat), np.zeros_like(flat)
    cells = MEASURES * BINS

    def parts(z: np.ndarray):
        return z[: 3 * cells].reshape(3, cells), z[3 * cells : 3 * cells + 2], z[-4:].reshape(2, 2)

    for turn in range(1, rounds + 1):
        weights, ends, steps = parts(flat)
        own = weights[0][codes].sum(axis=1)
        own[after] += weights[1][codes[before]].sum(axis=1)
        own[before] += weights[2][codes[after]].sum(axis=1)
        own[starts] += ends[0]
        own[lasts] += ends[1]
        ahead, back = own.copy(), np.zeros_like(own)
        for place in range(1, sizes[0]):
            at = starts[: active[place]] + place
            ahead[at] += odds_step(ahead[at - 1], steps, False)
        for place in range(sizes[0] - 1, 0, -1):
            at = starts[: active[place]] + place
            back[at - 1] = odds_step(back[at] + own[at], steps, True)
        gap = y - 1.0 / (1.0 + np.exp(-np.clip(ahead + back, -500, 500)))
        slope = np.zeros_like(flat)
        to_weights, to_ends, to_steps = parts(slope)
        for f in range(MEASURES):
            to_weights[0] += np.bincount(codes[:, f], gap, cells)
            to_weights[1] += np.bincount(codes[before, f], gap[after], cells)
            to_weights[2] += np.bincount(codes[after, f], gap[before], cells)
        to_ends[:] = gap[starts].sum(), gap[lasts].sum()
        if len(after):
            # Joint probabilities of two lines that follow one another.
            left, right = ahead[before], back[after] + own[after]
            joint = np.stack([
                steps[a, b] + a * left + b * right for a in (0, 1) for b in (0, 1)
            ])
            joint = np.exp(joint - joint.max(axis=0))
            expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
            same = np.array([[np.sum(y[after] == 0), 0], [0, np.sum(y[after] == 1)]])
            to_steps[:] = same - expected
        slope = slope / len(x) - ridge * flat
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope**2
        scaled = mean / (1 - 0.9**turn) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
        flat = flat + rate * scaled
    weights, ends, steps = parts(flat)
    return Field(field.cuts, weights.reshape(3, MEASURES, BINS), ends, steps)


def constant_field(share: float) -> Field:
    """Where only one label, or none, was learned: every line is good with that share."""
    share = min(max(share, 0.01), 0.99)
    weights = np.zeros((3, MEASURES, BINS))
    field = Field([np.zeros(0)] * MEASURES, weights, np.zeros(2), np.zeros((2, 2)))
    weights[0, 0, 0] = np.log(share / (1 - share))
    return field


# -- Documents -------------------------------------------------------------------------------


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is kept from learning; that of a null id is not."""
    fourth = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    return F.coalesce(fourth == 2, F.lit(False))


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> Field:
    """The field of the labelled rows of ``df`` that are not held out.

    The ``train_rows`` labelled ids of least hash teach, by one text each: that of least hash, if
    the id repeats. An id with several labels has the one that most of them say, good if they
    are even. Null ids, null labels and texts of more than TRAIN_LINES lines teach nothing. One
    label alone gives every line its share; no label at all gives one half.
    """
    given = F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
    known = labels.where(given & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(
        (F.avg(F.col(label_col)) >= 0.5).cast("int").alias("__good")
    )
    ids = df.select(F.col(id_col).alias("__id"))
    taken = known.join(ids, "__id", "left_semi")
    taken = taken.orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    # At most train_rows rows of an id and a label, and one text for each of them.
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    rows = rows.join(F.broadcast(taken), "__id").groupBy("__id", "__good")
    rows = rows.agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))

    def kernel(texts: list):
        out = []
        for text in texts:
            short = (text or b"").count(b"\n") < TRAIN_LINES
            out.append(b"".join(x.tobytes() for x, _ in measured(text)) if short else None)
        return [out]

    keep = [F.col("__id"), F.col("__good")]
    made = map_texts(rows, keep, F.col("__text"), lambda: kernel, "x binary")
    table = made.where(F.col("x").isNotNull()).orderBy(F.xxhash64("__id"), "__id", "x").toArrow()
    good = table.column("__good").to_numpy()
    if not 0 < good.sum() < len(good):
        return constant_field(float(good.mean()) if len(good) else 0.5)
    flat = (np.frombuffer(x, np.float32) for x in table.column("x").to_pylist())
    texts = [x.reshape(-1, MEASURES) for x in flat]
    return fit_field(texts, good)


def score(
    df: DataFrame, field: Field, keep: list[Column], text_col: str = "text", good: float = GOOD
) -> DataFrame:
    """(keep..., score, predicted) of every row: the quality of its whole text.

    Null and empty texts are one empty line. Repeated rows stay; an empty table gives none. Memory
    and time follow the longest text's length, with some 50 bytes for each of its lines.
    """

    def kernel(texts: list):
        scores = [field.quality(t) for t in texts]
        return [scores, [int(s >= good) for s in scores]]

    text = F.col(text_col).cast("binary")
    return map_texts(df, keep, text, lambda: kernel, "score double, predicted int")


def line_marginals(
    df: DataFrame, field: Field, keep: list[Column], text_col: str = "text"
) -> DataFrame:
    """(keep..., good array): the probability that each line of the whole text is good."""

    def kernel(texts: list):
        return [[field.marginals(t)[0] for t in texts]]

    return map_texts(df, keep, F.col(text_col).cast("binary"), lambda: kernel, "good array<double>")
