"""Hybrid lexical search against a plain version."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vecloom.llm import lexical

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UP = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UP))


def brute(docs, items, k=10):
    """Sorted (item, rank, doc, score); documents are (id, text), items (id, text)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    full = sum(bool(c) for _, c in counted)
    total = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            score = 0
            for t in set(terms(text)):
                if tf := c[t]:
                    w = math.floor(1000 * math.log((2 * full + 2) / (2 * df[t] + 1)))
                    m = 100 - 90 + (90 * c.total() * full) // total
                    score += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        best = sorted(scored, key=lambda s: s[:2] + (s[2] or 0,))[:k]
        out += [(item, rank, s[2], s[3]) for rank, s in enumerate(best, 1)]
    return sorted(out, key=repr)


def found(docs, items, k=10):
    rows = lexical.search(docs, items, k).collect()
    return sorted(((r.item_id, r["rank"], r.id, r.score) for r in rows), key=repr)


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = brute([tuple(r) for r in docs.select("doc_id", "text").collect()],
                     [tuple(r) for r in items.select("item_id", "text").collect()])
    assert found(docs, items) == expected


def test_short_and_long_lists_over_many_blocks(spark, monkeypatch):
    """Frequent words, rare ones, ties, copies, and several shards and blocks of queries."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    share = 1.0 / np.arange(1, 301)
    docs = []
    for i in rng.permutation(3000).tolist():
        picked = rng.choice(words, rng.integers(0, 40), p=share / share.sum())
        docs.append((i // 2 if i % 5 == 0 else i, " ".join(picked)))
    items = [(j, " ".join(rng.choice(words, 12, p=share / share.sum()))) for j in range(25)]
    monkeypatch.setattr(lexical, "SHARD_DOCS", 700)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 400)
    left, right = frames(spark, docs, items)
    assert found(left.coalesce(2), right, 7) == brute(docs, items, 7)


def test_blocks_are_skipped():
    """Blocks whose bounds do not reach the k-th score are not read."""
    n = 64 * lexical.BLOCK
    docs = np.arange(n)
    tfs = np.where(docs < 32, 50, 1)
    shard = {
        "sizes": np.full(n, 10), "docs": docs, "tfs": tfs,
        "terms": np.array([0]), "lengths": np.array([n]),
    }
    lists = lexical.Lists(shard, np.array([1000]), n, 10 * n)
    reads = []
    whole = lists.docs

    class Spy:
        def __getitem__(self, at):
            reads.append(at)
            return whole[at]

    lists.skips(0)
    lists.docs = Spy()
    best = lists.search([0], 10)
    assert sorted(-d for _, d in best) == list(range(10)) and len(reads) == 1


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, "--- !!"), (4, "Straße ÜBER Über"), (5, "the cat"), (5, "the cat"),
        (None, "the cat"), (6, "THE\x00cat\x7fsat"), (7, "word " * 400_000 + "cat"), (8, "x1 1x"),
        (9, "z" * 3_000_000), (10, "日本 語"),
    ]
    items = [
        (1, "the cat sat"), (1, "the cat sat"), (None, "über"), (2, None), (3, ""), (4, "nowhere"),
        (5, "cat cat CAT"), (6, "日本"), (7, "z" * 3_000_000), (8, "word " * 100),
    ]
    left, right = frames(spark, docs, items)
    clash = left.withColumn("id", F.lit("x")).withColumn("score", F.lit(1)).withColumn("ids", F.lit(1))
    also = right.withColumn("query", F.lit("x")).withColumn("rank", F.lit(1))
    assert found(clash, also) == brute(docs, items)
    none = left.where("doc_id = 99")
    assert found(none, right) == [] == found(left, right.where("item_id = 99"))
    assert found(left.where("doc_id = 1"), right) == []


def test_sizes_beyond_64_bits():
    shard = {"sizes": np.array([10, 1 << 40]), "docs": np.array([0, 1]), "tfs": np.array([1, 3]),
             "terms": np.array([0]), "lengths": np.array([2])}
    full, total = 1 << 30, 1 << 50
    lists = lexical.Lists(shard, np.array([7]), full, total)
    expected = [7 * (10**9 * tf // (1000 * tf + 8 * (10 + 90 * n * full // total)))
                for n, tf in ((10, 1), (1 << 40, 3))]
    assert lists.impacts.tolist() == expected
