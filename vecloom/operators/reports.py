"""Latency, throughput and comparison reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.session import materialise


def throughput(amount: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, amount / seconds).otherwise(F.lit(0.0))


def rounded(value: Column, digits: int) -> Column:
    """The nearest number of so many decimals to the stored binary value, ties to even: a mean
    that prints as 36.785 but is stored a little below it becomes 36.78."""
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale


# Buckets that an interval is cut into, and values that are ranked one by one.
BUCKETS, RANKED = 1024, 4096


def exact_percentiles(
    df: DataFrame, group_col: str, value_col: str, quantiles: list[float]
) -> DataFrame:
    """(group, q, value): exact percentiles with linear interpolation, for groups of any size
    and a null group like any other. Infinite values and NaN rank as Spark orders them.

    Every wanted rank lies in an interval of values, at first the whole group's. A round counts
    the values of each interval by bucket, and the bucket that holds the rank, with its least
    and largest value, is the next interval. It ends when an interval has one value or few
    rows, which alone are ranked. So no values but those are shuffled, only counts, and a value
    that fills a third of the table is a count of one bucket.
    """
    rows = df.where(F.col(value_col).isNotNull()).select(
        F.col(group_col).alias("grp"), F.col(value_col).cast("double").alias("val")
    )
    whole = rows.groupBy("grp").agg(
        F.count("*").alias("inside"), F.min("val").alias("lo"), F.max("val").alias("hi")
    )
    wanted = F.array(*[F.lit(float(q)) for q in quantiles])
    ranks = whole.select("*", F.explode(wanted).alias("q")).withColumn(
        "pos", F.col("q") * (F.col("inside") - 1)
    )
    ranks = ranks.select(
        "grp", "q", "pos", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("rank"),
        "lo", "hi", "inside", F.lit(0).cast("long").alias("below"),
    )
    # A row for each group and wanted rank.
    ranks = materialise(ranks, "ranks")
    wide = (F.col("inside") > RANKED) & (F.col("lo") < F.col("hi"))
    while not ranks.where(wide).isEmpty():
        ranks = materialise(narrowed(rows, ranks, wide), "ranks")
    few = ranks.where(F.col("lo") < F.col("hi"))
    interval = few.select(F.col("grp").alias("g"), "lo", "hi").distinct()
    order = Window.partitionBy("g", "lo", "hi").orderBy("val")
    # At most RANKED rows of an interval.
    ranked = within(rows, interval).withColumn("place", F.row_number().over(order) - 1)
    same = F.col("grp").eqNullSafe(F.col("og")) & (F.col("lo") == F.col("olo")) & (F.col("hi") == F.col("ohi"))
    found = few.join(
        ranked.select(F.col("g").alias("og"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"), "place", "val"),
        same & (F.col("rank") - F.col("below") == F.col("place")),
    )
    one = ranks.where(~(F.col("lo") < F.col("hi")))
    hits = found.select("grp", "q", "pos", "val").unionByName(
        one.select("grp", "q", "pos", F.col("lo").alias("val"))
    )
    low = F.min("val")
    part = F.first("pos") - F.floor(F.first("pos"))
    return hits.groupBy(F.col("grp").alias(group_col), "q").agg(
        F.when(F.max("val") > low, low + (F.max("val") - low) * part).otherwise(low).alias("value")
    )


def within(rows: DataFrame, interval: DataFrame) -> DataFrame:
    """Rows (grp, val) in the intervals (g, lo, hi) of their groups."""
    inside = F.col("val").between(F.col("lo"), F.col("hi"))
    return rows.join(interval, F.col("grp").eqNullSafe(F.col("g")) & inside).drop("grp")


def narrowed(rows: DataFrame, ranks: DataFrame, wide: Column) -> DataFrame:
    """The ranks with the wide intervals replaced by the bucket that holds the rank. The ends
    have buckets of their own, so that every interval loses two different values at least."""
    interval = ranks.where(wide).select(F.col("grp").alias("g"), "lo", "hi", "below").distinct()
    # Halves keep the width of the largest interval finite.
    low = F.greatest(F.col("lo"), F.lit(-1.7976931348623157e308)) / 2
    width = F.least(F.col("hi"), F.lit(1.7976931348623157e308)) / 2 - low
    place = F.floor((F.col("val") / 2 - low) / width * BUCKETS)
    bucket = (
        F.when(F.col("val") == F.col("lo"), -1)
        .when(F.col("val") == F.col("hi"), BUCKETS)
        .when(width > 0, F.greatest(F.lit(0), F.least(place, F.lit(BUCKETS - 1))))
        .otherwise(0)
    )
    key = ["g", "lo", "hi"]
    counts = within(rows, interval).groupBy(*key, "below", bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.min("val").alias("least"), F.max("val").alias("most")
    )
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each bucket.
    starts = counts.select(
        *[F.col(c).alias(f"o{c}") for c in key], "n", "least", "most",
        (F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start"),
    )
    same = F.col("grp").eqNullSafe(F.col("og")) & (F.col("lo") == F.col("olo")) & (F.col("hi") == F.col("ohi"))
    holds = (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n"))
    next_ = ranks.where(wide).join(starts, same & holds).select(
        "grp", "q", "pos", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"),
        F.col("n").alias("inside"), F.col("start").alias("below"),
    )
    return ranks.where(~wide).unionByName(next_)


TAILS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_summary(
    df: DataFrame,
    group_col: str,
    value_col: str,
    digits: int = 2,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Mean, p50, p95, p99, min and max of a sample per group, rounded, and any ``extra``
    aggregates of the same rows."""
    extra = extra or {}
    basic = [
        F.avg(value_col).alias("mean"),
        F.min(value_col).alias("min"),
        F.max(value_col).alias("max"),
        *[c.alias(name) for name, c in extra.items()],
    ]
    found = exact_percentiles(df, group_col, value_col, list(TAILS.values()))
    tails = found.groupBy(F.col(group_col).alias("__group")).agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for name, q in TAILS.items()]
    )
    summary = df.groupBy(group_col).agg(*basic)
    summary = summary.join(tails, F.col(group_col).eqNullSafe(F.col("__group")), "left")
    return summary.select(
        group_col,
        *[rounded(F.col(c), digits).alias(c) for c in ("mean", "p50", "p95", "p99", "min", "max")],
        *extra,
    )


def scaling_factor(df: DataFrame, size_col: str, latency_col: str) -> DataFrame:
    """Mean latency per table size, and its ratio to that of the smallest size.

    The window runs over the aggregate, which has one row per size.
    """
    means = df.groupBy(F.col(size_col).alias("n")).agg(F.avg(latency_col).alias("avg_ms"))
    return means.withColumn(
        "factor", F.col("avg_ms") / F.first("avg_ms").over(Window.orderBy("n"))
    )


def bench_report(
    runs: DataFrame, dataset_col: str, latency_col: str, seconds_col: str | None = None
) -> DataFrame:
    """One comparison row per dataset: size, time, throughput, median and tail latency."""
    seconds = F.sum(seconds_col) if seconds_col else F.sum(latency_col) / 1000.0
    volume = {"n": F.count("*"), "seconds": seconds}
    return latency_summary(runs, dataset_col, latency_col, extra=volume).select(
        F.col(dataset_col).alias("dataset"),
        "n",
        rounded(F.col("seconds"), 1).alias("time_s"),
        rounded(throughput(F.col("n"), F.col("seconds")), 1).alias("per_s"),
        F.col("mean").alias("query_mean_ms"),
        F.col("p50").alias("query_p50_ms"),
        F.col("p95").alias("query_p95_ms"),
        F.col("p99").alias("query_p99_ms"),
    )


def bench_record(report: DataFrame, ingest: DataFrame, samples: DataFrame) -> DataFrame:
    """The full record of a comparison: ``bench_report`` rows with what ingest counted
    (dataset, num_images, dataset_size_mb, indexed, errors, ingest_time_s, db_size_mb) and
    one sample query (dataset, sample_query, sample_results). One row per dataset."""
    rate = throughput(F.col("indexed"), F.col("ingest_time_s"))
    joined = report.drop("n", "time_s", "per_s").join(ingest, "dataset").join(samples, "dataset")
    return joined.select(
        "dataset",
        "num_images",
        "dataset_size_mb",
        "indexed",
        "errors",
        "ingest_time_s",
        rounded(rate, 1).alias("ingest_throughput_ips"),
        "db_size_mb",
        "query_mean_ms",
        "query_p50_ms",
        "query_p95_ms",
        "query_p99_ms",
        "sample_query",
        "sample_results",
    )


def sample_results(found: DataFrame, qid_col: str = "qid") -> DataFrame:
    """(qid, sample_results): the few rows found for each query as a nested list by rank."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "id", "distance")))
    nested = F.transform(ranked, lambda r: F.struct(r["id"].alias("id"), r["distance"].alias("distance")))
    return found.groupBy(qid_col).agg(nested.alias("sample_results"))
