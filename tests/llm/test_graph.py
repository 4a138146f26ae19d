"""Graph search against comparing with every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import graph_index

SF = "/root/testdata/sf0.1"


def brute(rows, k):
    """Best (id, score) of every query id divisible by 20, over (id, vector) rows."""
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[(i, tuple(v))] = np.array(v, np.float64)
    out = {}
    for (q, _), asked in good.items():
        if q % 20:
            continue
        found = [
            (-float(v @ asked), i) for (i, _), v in good.items() if i != q and len(v) == len(asked)
        ]
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def searched(df, k, **options):
    out = {}
    for r in graph_index.nearest(df, F.col("vec_id") % 20 == 0, k, **options).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("shard_rows", [300, 8192])
def test_recall(spark, shard_rows):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    wanted = brute([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got = searched(df, 20, shard_rows=shard_rows)
    assert got.keys() == wanted.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) / 20 for q in wanted]
    assert np.mean(hits) >= 0.95
    for q, found in got.items():
        assert len(found) == 20
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)


def test_copies_lengths_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(6) * (1 + i % 5))]) for i in range(300)]
    same = [float(x) for x in np.float32(rng.standard_normal(6))]
    rows += [(1000 + i, same) for i in range(120)]
    rows += [(1000, same), (20, rows[20][1])]
    rows += [
        (2000, None), (2020, [0.0] * 6), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, same),
        (2060, [float("nan")] + [1.0] * 5), (2080, [float("inf")] + [1.0] * 5), (2100, [1.0, 2.0]),
        (2101, [2.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    wanted = brute(rows, 20)
    got = searched(df.withColumn("id", F.lit("clash")), 20, shard_rows=150, ef=200)
    assert got.keys() == wanted.keys()
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in wanted[q]], q
        assert np.allclose([s for _, s in found], [s for _, s in wanted[q]])


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert searched(df, 20) == {0: [(1, 0.5)]}
    assert searched(df.filter("vec_id < 0"), 20) == {}
    assert searched(df.filter("vec_id = 0"), 20) == {}
