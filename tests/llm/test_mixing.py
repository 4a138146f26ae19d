"""Water-filling and the seeded take against a plain version."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vecloom.llm import mixing

SF = "/root/testdata/sf0.01"


def plain_targets(sizes, share=1.5, epochs=2, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, level, out = set(names), share * sum(sizes.values()), {}
    while True:
        total = sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] / total > epochs * sizes[s]]
        if not over:
            return out | {s: level * weight[s] / total for s in left}
        for s in over:
            out[s] = float(epochs * sizes[s])
            left.remove(s)
        level = share * sum(sizes.values()) - sum(out.values())
        if not left:
            return out


def plain_mix(rows):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), t or "") for i, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n, _ in sized:
        sizes[s] += n
    targets, out = plain_targets(sizes), []
    for source, total in sizes.items():
        def order(r):
            name = hashlib.md5(r[3].encode()).hexdigest() if r[0] is None else str(r[0])
            return hashlib.md5(f"42:{name}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2]

        goal, before = int(targets[source] + 0.5), 0
        wholes = goal // total if total else 0
        for i, _, n, _ in sorted((r for r in sized if r[1] == source), key=order):
            part = max(0, min(n, goal - wholes * total - before))
            before += n
            out.append((i, n, total, round(targets[source], 4), wholes * n + part))
    return sorted(out, key=repr)


def mixed(df):
    rows = mixing.mix_documents(df).collect()
    return sorted(
        ((r.doc_id, r["size"], r.source_size, round(r.target, 4), r.taken) for r in rows), key=repr
    )


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixed(df)
    assert got == plain_mix([(r.doc_id, r.text, r.source) for r in df.collect()])
    assert mixed(df.repartition(5)) == got


@pytest.mark.parametrize("slice_rows", [3, 5_000])
def test_odd_rows(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rows = [(i, "w " * (i % 9), f"s{i % 4}") for i in range(80)]
    rows += [(None, "a b", None), (None, "a b", None), (7, "x y z", "s1"), (7, "x y z", "s1")]
    rows += [(900, None, "void"), (901, "", "void"), (902, "long " * 30_000, "s2"), (903, "é", "Z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed(df.withColumn("size", F.lit("clash")).withColumn("weight", F.lit(1)))
    assert got == plain_mix(rows)
    assert all(taken <= 2 * size for _, size, _, _, taken in got)
    assert mixed(df.filter("doc_id = -1")) == []


def test_rows_without_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 10)
    seen = []
    write = mixing.materialise
    monkeypatch.setattr(
        mixing, "materialise", lambda df, name: seen.append((name, write(df, name))) or seen[-1][1]
    )
    rows = [(None, f"a {i} " + "b " * (i % 3), "s") for i in range(400)]
    rows += [(None, None, "s")] * 400 + [(i, "c d", "s") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixed(df) == plain_mix(rows)
    high = F.substring("__hash", 1, 1)
    counts = dict(seen)["sized"].groupBy(high.alias("h")).count().collect()
    assert len(counts) == 16 and max(r["count"] for r in counts) < 200


def test_levels_clamp_in_several_rounds(spark):
    sizes = {"a": 10, "b": 400, "c": 30, "d": 5000, "e": 1, None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    plan = mixing.water_fill(mixing.weighed(df)).collect()
    wanted = plain_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in plan} == wanted


def test_repeats_are_whole_and_near_the_target(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns
    text = {r.doc_id: r.text for r in df.collect()}
    words, longest = defaultdict(int), defaultdict(int)
    for r in out.collect():
        assert r.text == text[r.doc_id]
        words[r.source] += len(r.text.split())
        longest[r.source] = max(longest[r.source], len(r.text.split()))
    for r in mixing.mix_documents(df).join(df.select("doc_id", "source"), "doc_id").collect():
        assert abs(words[r.source] - r.target) <= longest[r.source]


def test_repeats_of_odd_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, None, "s"), (None, "c d", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.repeat_documents(df).collect()
    assert {r.doc_id for r in out} <= {1, None} and len(out) <= 6
    assert mixing.repeat_documents(df.filter("doc_id = 9")).count() == 0


def test_rows_that_differ_by_the_place_of_a_null(spark):
    rows = [(1, "x", "web", None)] * 2 + [(1, "x", None, "web")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.repeat_documents(df, share=2.0).collect()
    assert sorted((r.lang or "", r.source or "") for r in out) == [("", "web")] * 6 + [("web", "")] * 4
