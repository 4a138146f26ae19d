import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import reports
from vecloom.operators.reports import exact_percentiles, latency_summary, scaling_factor, throughput


def test_percentiles(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", 5.0)] * 1500 + [("hot", float(x)) for x in rng.random(3000) * 10]
    rows += [("small", float(x)) for x in rng.random(7)] + [("one", 2.5)]
    frame = spark.createDataFrame(rows, "name string, ms double")
    qs = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]
    got = exact_percentiles(frame, "name", "ms", qs).collect()
    assert len(got) == 18
    for r in got:
        sample = [v for n, v in rows if n == r["name"]]
        assert r["value"] == pytest.approx(np.percentile(sample, 100 * r["q"]), abs=1e-9)


def test_a_null_group_is_a_group(spark):
    rows = [(None, 1.0), (None, 2.0), (None, 3.0), ("a", None), ("b", 7.0)]
    frame = spark.createDataFrame(rows, "d string, ms double")
    got = {r["d"]: (r["p50"], r["p95"], r["p99"]) for r in latency_summary(frame, "d", "ms").collect()}
    assert got == {None: (2.0, 2.9, 2.98), "a": (None, None, None), "b": (7.0, 7.0, 7.0)}


def test_latency_summary(spark):
    frame = spark.createDataFrame([("a", float(x)) for x in range(101)], "d string, ms double")
    row = latency_summary(frame, "d", "ms").first()
    assert (row["mean"], row["p50"], row["p95"], row["p99"]) == (50.0, 50.0, 95.0, 99.0)
    assert (row["min"], row["max"]) == (0.0, 100.0)


def test_throughput_of_no_time(spark):
    frame = spark.createDataFrame([(10.0, 2.0), (10.0, 0.0)], "n double, t double")
    assert [r[0] for r in frame.select(throughput(F.col("n"), F.col("t"))).collect()] == [5.0, 0.0]


def test_scaling(spark):
    rows = [(1000, 1.6), (5000, 2.8), (5000, 3.0), (10000, 3.52)]
    frame = spark.createDataFrame(rows, "n int, ms double")
    got = {r["n"]: round(r["factor"], 2) for r in scaling_factor(frame, "n", "ms").collect()}
    assert got == {1000: 1.0, 5000: 1.81, 10000: 2.2}


def test_rounding_goes_by_the_stored_value(spark):
    values = [36.785, 34.785, 0.125, 0.375, 2.675, 1.005, -0.125, -36.785, 0.0, 1e15, 12.345]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 6):
        got = [r[0] for r in frame.select(reports.rounded(F.col("v"), digits)).collect()]
        assert got == [np.round(v, digits) for v in values]
    assert reports.rounded(F.lit(1.0), 2) is not None


def test_percentiles_over_many_rounds(spark, monkeypatch):
    """Wide, narrow and heavy-tailed groups, a value of a third of all rows, infinite ends."""
    monkeypatch.setattr(reports, "BUCKETS", 8)
    monkeypatch.setattr(reports, "RANKED", 20)
    rng = np.random.default_rng(1)
    groups = {
        "tail": np.exp(rng.normal(0, 12, 600)),
        "hot": np.append(np.full(400, 3.25), rng.random(500)),
        "close": 1.0 + np.arange(300) * 2.0**-52,
        "ends": np.array([-np.inf] * 30 + [-1.7e308, 1.7e308, 0.0, 5e-324] * 20 + [np.inf] * 30),
        "one": np.array([7.0]),
        None: rng.normal(0, 1, 200),
    }
    rows = [(n, float(v)) for n, values in groups.items() for v in values]
    frame = spark.createDataFrame(rows, "name string, ms double").repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0]
    got = {(r["name"], r["q"]): r["value"] for r in exact_percentiles(frame, "name", "ms", qs).collect()}
    assert len(got) == len(groups) * len(qs)
    for (name, q), value in got.items():
        ordered = np.sort(groups[name])
        pos = q * (len(ordered) - 1)
        low, high = ordered[int(np.floor(pos))], ordered[int(np.ceil(pos))]
        want = low if low == high else low + (high - low) * (pos - np.floor(pos))
        assert value == pytest.approx(want, rel=1e-12), (name, q)
    nan = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 2.0)], "name string, ms double")
    assert exact_percentiles(nan, "name", "ms", [0.5]).first()["value"] == 2.0
    assert exact_percentiles(nan.limit(0), "name", "ms", [0.5]).count() == 0
