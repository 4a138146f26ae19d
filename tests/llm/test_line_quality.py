"""The line field against brute force over all label sequences, and held-out accuracy."""

import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import line_quality

SF = "/root/testdata/sf0.01"


def enumerated(own, steps):
    """Probability of good for each line, summed over all labellings."""
    total, good = 0.0, np.zeros(len(own))
    for labels in itertools.product((0, 1), repeat=len(own)):
        weight = math.exp(
            sum(v for v, y in zip(own, labels) if y)
            + sum(steps[a][b] for a, b in zip(labels, labels[1:]))
        )
        total += weight
        good += weight * np.array(labels)
    return good / total


@pytest.mark.parametrize("lines", [1, 2, 3, 7])
def test_messages_match_enumeration(lines):
    rng = np.random.default_rng(lines)
    own, steps = rng.normal(0, 2, lines), rng.normal(0, 1, (2, 2))
    got = 1 / (1 + np.exp(-line_quality.messages(own, steps)))
    assert np.allclose(got, enumerated(own, steps))


def random_field(seed):
    rng = np.random.default_rng(seed)
    cuts = [np.sort(rng.random(rng.integers(0, line_quality.BINS)) * 3) for _ in range(15)]
    weights = rng.normal(0, 0.3, (3, line_quality.MEASURES, line_quality.BINS))
    return line_quality.Field(cuts, weights, rng.normal(0, 1, 2), rng.normal(0, 1, (2, 2)))


def plain_quality(field, text):
    """Score of a text from the definition."""
    before, seen, bins = frozenset(), set(), []
    lines = (text or b"").split(b"\n")
    for line in lines:
        x, before = line_quality.measure(line, before, seen)
        x = np.array(x, np.float32)
        bins.append([sum(c < v for c in cut) for cut, v in zip(field.cuts, x)])
    own = []
    for i in range(len(lines)):
        vote = 0.0
        for kind, j in ((0, i), (1, i - 1), (2, i + 1)):
            if 0 <= j < len(lines):
                vote += sum(field.weights[kind, f, b] for f, b in enumerate(bins[j]))
        vote += field.ends[0] if i == 0 else 0.0
        vote += field.ends[1] if i == len(lines) - 1 else 0.0
        own.append(vote)
    good = enumerated(own, field.steps.tolist())
    sizes = [len(line) for line in lines]
    return np.average(good, weights=sizes if sum(sizes) else None)


def test_scores_match_the_definition(monkeypatch):
    texts = [
        None, b"", b"\n\n", b"one line", b"A b c.\nA b c.\n\n12 34 $$", b"x" * 5000 + b"\ny",
        "É à ü\nÉ à ü é".encode(), b"THE!! END!!\nthe end\n | a | b |\n\t \nthe the the\n",
    ]
    for seed, text in enumerate(texts):
        field = random_field(seed)
        expected = plain_quality(field, text)
        for lines in (1 << 14, 2):
            monkeypatch.setattr(line_quality, "BLOCK_LINES", lines)
            assert field.quality(text) == pytest.approx(expected, abs=1e-9)


def test_fit_learns_from_neighbours():
    """A line that says nothing by itself takes the label of the lines beside it."""
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(400):
        x = np.zeros((rng.integers(2, 9), line_quality.MEASURES), np.float32)
        x[:, 0] = 1
        x[rng.integers(len(x)), 5] = 1 + i % 2
        texts.append(x)
        labels.append(i % 2)
    field = line_quality.fit_field(texts, np.array(labels))
    for x, label in zip(texts, labels):
        votes = field.votes(field.bins(x))
        own = votes[0]
        own[1:] += votes[1, :-1]
        own[:-1] += votes[2, 1:]
        own[0] += field.ends[0]
        own[-1] += field.ends[1]
        good = 1 / (1 + np.exp(-line_quality.messages(own, field.steps)))
        assert ((good > 0.5) == label).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    field = line_quality.fit(docs, labels)
    keep = [F.col("doc_id"), line_quality.held_out().alias("held_out")]
    got = line_quality.score(docs, field, keep)
    rows = got.join(labels, "doc_id", "left").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    # Labels of held-out rows teach nothing.
    turned = labels.withColumn("quality", F.when(line_quality.held_out(), 0).otherwise(F.col("quality")))
    again = line_quality.fit(docs, turned)
    assert np.array_equal(again.weights, field.weights)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "\n" * 70_000), (4, "fine line\n" * 100_000), (5, "w " * 500_000),
        (6, "same"), (6, "same"), (None, "no id"), (7, "a\r\nb"), (8, "日本 語\nÜber"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.withColumn("score", F.lit("x")).withColumn("predicted", F.lit("x")).withColumn("x", F.lit(0))
    marks = [(i, i % 2) for i in (1, 2, 5, 6, 7, 8)] + [(6, 0), (6, None), (None, 1), (99, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    field = line_quality.fit(clash, labels.withColumn("text", F.lit("x")))
    got = line_quality.score(clash, field, [F.col("doc_id")]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert by_id[1] == by_id[2] and len(by_id[6]) == 1
    assert line_quality.score(df.where("doc_id = 99"), field, [F.col("doc_id")]).count() == 0
    one = line_quality.fit(df, labels.where("quality = 1"))
    none = line_quality.fit(df, labels.where("quality > 9"))
    assert one.quality(b"text") == pytest.approx(0.99) and none.quality(b"") == 0.5
    lines = {r.doc_id: r.good for r in line_quality.line_marginals(df, none, [F.col("doc_id")]).collect()}
    assert len(lines[3]) == 70_001 and lines[7] == [0.5, 0.5]
