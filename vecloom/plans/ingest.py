"""Batch ingest: list, skip what is known, decode, embed, append, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.encoders import Encoder
from vecloom.session import materialise
from vecloom.sources.files import decode_files, list_images
from vecloom.sources.tables import (
    METADATA,
    append_vectors,
    hadoop_path,
    has_metadata,
    read_table,
    table_exists,
)

FILES_PER_TASK = 2048


def new_ids(listing: DataFrame, known: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of the listing whose id is not in the table. Ids alone are compared."""
    return listing.join(known.select(id_col), id_col, "left_anti")


def ingest_counters(
    rows: DataFrame, known: Column, failed: Column, batch_size: int = 256
) -> DataFrame:
    """One row of totals over a listing with a known and a failed mark per file.

    Batches are those the indexed rows fill, whatever Spark's partitions are.
    """
    indexed = F.count_if(~known & ~failed)
    return rows.agg(
        indexed.alias("total_indexed"),
        F.count_if(~known & failed).alias("total_errors"),
        F.ceil(indexed / F.lit(batch_size)).alias("total_batches"),
        F.count_if(known).alias("total_skipped"),
    )


def spread(files: DataFrame, count: int, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """Paths evenly over tasks: one folder may hold any share of the files, and a path is
    far smaller than the work behind it."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(count, cores), min(-(-count // files_per_task), 100_000), 1)
    return files.repartition(tasks, "id")


def index_files(
    spark: SparkSession,
    root: str,
    table_path: str,
    encoder: Encoder,
    batch_size: int = 256,
    incremental: bool = True,
    files_per_task: int = FILES_PER_TASK,
) -> DataFrame:
    """Ingest the images below a folder into a vector table; returns the totals.

    Only paths are shuffled. The listing is kept as a snapshot, and file contents are
    read, decoded and embedded in one pass whose counts are observed as it writes. Files
    that fail are not stored, so the next run tries them again.
    """
    listing = materialise(list_images(spark, root), "listing")
    listed = listing.count()
    exists = table_exists(spark, table_path)
    fresh, keep = listing, METADATA
    if exists:
        table = read_table(spark, table_path)
        keep = METADATA if has_metadata(table) else []
        if incremental:
            fresh = materialise(new_ids(listing, table), "fresh")
    waiting = fresh.count()
    done = Observation()
    decoded = decode_files(spread(fresh, waiting, files_per_task), encoder, batch_size).observe(
        done,
        F.count_if(F.col("error").isNull()).alias("indexed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    good = decoded.where("error IS NULL").select("id", "vector", *keep)
    indexed = errors = 0
    if waiting:
        append_vectors(good, table_path)
        indexed, errors = done.get["indexed"], done.get["errors"]
        if not exists and not indexed:
            # Every file failed, so the table that this run made is empty.
            fs, made = hadoop_path(spark, table_path)
            fs.delete(made, True)
    return spark.createDataFrame(
        [(indexed, errors, -(-indexed // batch_size), listed - waiting)],
        "total_indexed long, total_errors long, total_batches long, total_skipped long",
    )
