"""SimHash components against comparing all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from vecloom.llm import simhash
from vecloom.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, max_bits=2):
    """component id of each (id, fingerprint)."""
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if bin(a ^ b).count("1") <= max_bits:
                parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f, least.get(root(f))) for i, f in rows), key=repr)


def check(df):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
    got = simhash.near_duplicates(df).collect()
    ours = sorted(((r.id, r.fingerprint % (1 << 64), r.component_id) for r in got), key=repr)
    assert ours == brute_components(rows)


def test_given_documents(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (None, " \n"), (5, "One two"), (6, "one TWO"), (6, "one TWO")]
    rows += [(None, "É é É"), (8, "é é é"), (9, "a" * 200_000)]
    for i in range(60):
        words = list(base)
        words[rng.randrange(300)] = f"x{i % 7}"
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df.withColumn("fingerprint", F.lit("clash")).withColumn("id", F.lit(1)))
    assert simhash.near_duplicates(df.filter("doc_id = -1")).count() == 0


@pytest.mark.parametrize("hot", [1, 500])
def test_links_lose_no_pair(spark, monkeypatch, hot):
    """Planted fingerprints at 0 to 4 bits from each other; keys split from two members on."""
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    rng = random.Random(hot)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            f = base
            for b in rng.sample(range(64), rng.randint(0, 3)):
                f ^= 1 << b
            prints.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    df = spark.createDataFrame([(f,) for f in signed], "fingerprint long")
    for segments in (3, 5, 8):
        got = {(r.a, r.b) for r in simhash.links(df, 2, segments).collect()}
        wanted = {
            (a, b)
            for a in signed
            for b in signed
            if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 2
        }
        assert got == wanted


def test_keep_one_leaves_one_of_each_group(spark):
    rows = [
        (3, "alpha beta gamma delta", "s"), (1, "Alpha beta gamma delta", "t"),
        (2, "quite another text here", None), (2, "quite another text here", None),
        (None, "alone in the world now", "s"), (7, None, "s"), (8, "", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, None, 7], key=repr)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)]
    edges += [(5, 5), (2000, 2001), (2001, 2000), (2000, 2001)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    found = {r.node: r.component for r in got}
    assert len(got) == len(found) == 61 + 40 + 2
    assert all(found[i] == 0 for i in range(61))
    assert all(found[1000 + i] == 1000 for i in range(40))
    assert found[2001] == 2000
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).count() == 0


def test_keep_one_prefers_rows_with_ids(spark):
    rows = [(None, "same text here", "a", None), (5, "same text here", None, "a"), (9, "same text here", "a", None),
            (None, "other words here", "x", None), (None, "other words here", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = simhash.keep_one(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "other words here"), (5, "same text here")]
