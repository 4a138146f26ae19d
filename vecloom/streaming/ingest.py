"""Continuous ingest: new image files are picked up once each as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecloom.functions.encoders import Encoder
from vecloom.functions.paths import suffix
from vecloom.plans.ingest import new_ids, spread
from vecloom.session import materialise
from vecloom.sources.files import IMAGE_SUFFIXES, decode_files, stream_files
from vecloom.sources.tables import (
    METADATA,
    append_vectors,
    has_metadata,
    path_exists,
    read_table,
    table_exists,
)


def stream_ingest(
    spark: SparkSession,
    root: str,
    table_path: str,
    rejects_path: str,
    checkpoint: str,
    encoder: Encoder,
    batch_size: int = 256,
) -> StreamingQuery:
    """Start an ingest of all files not seen before; it ends when it has caught up.

    Empty files, and folders that cannot be read, are rejects like files that cannot be
    decoded. A batch that is run again adds nothing twice: known ids, and rejects of other
    batches that have not changed since, are skipped, and rejects are written under the number of
    their batch.
    """
    files = stream_files(spark, root)
    images = files.where(suffix(F.col("id")).isin(IMAGE_SUFFIXES) | F.col("error").isNotNull())

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        exists = table_exists(session, table_path)
        keep = METADATA
        if exists:
            table = read_table(session, table_path)
            keep = METADATA if has_metadata(table) else []
            batch = new_ids(batch, table)
        if path_exists(session, rejects_path):
            batch = not_rejected(batch, session.read.parquet(rejects_path), number)
        batch = materialise(batch, "stream-files")
        decoded = materialise(
            decode_files(spread(batch, batch.count()), encoder, batch_size), "stream-batch"
        )
        good = decoded.where("error IS NULL").select("id", "vector", *keep)
        if not good.isEmpty():
            append_vectors(good, table_path)
        rejects = decoded.where("error IS NOT NULL")
        rejects = rejects.select("id", "file_size", "file_mtime", "error")
        rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch={number}")

    return (
        images.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def not_rejected(batch: DataFrame, rejects: DataFrame, number: int) -> DataFrame:
    """Files that no other batch has rejected as they are now."""
    known = rejects.where(F.col("batch") != number).select(
        F.col("id").alias("known"), F.col("file_mtime").alias("then")
    )
    changed = F.coalesce(F.abs(F.col("file_mtime") - F.col("then")) > 1e-3, F.lit(False))
    return batch.join(known, (F.col("id") == F.col("known")) & ~changed, "left_anti")


def retry_rejects(
    spark: SparkSession, rejects_path: str, table_path: str, encoder: Encoder, batch_size: int = 256
) -> int:
    """Try rejected files again in a batch job; returns the number added."""
    rejects = spark.read.parquet(rejects_path).select("id", "file_size", "file_mtime").distinct()
    if table_exists(spark, table_path):
        rejects = new_ids(rejects, read_table(spark, table_path))
    rejects = materialise(rejects, "retry-files")
    decoded = decode_files(spread(rejects, rejects.count()), encoder, batch_size)
    good = materialise(decoded.where("error IS NULL").drop("error"), "retried")
    added = good.count()
    if added:
        append_vectors(good, table_path)
    return added
