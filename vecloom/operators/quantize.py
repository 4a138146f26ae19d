"""Half-precision rewrite of a vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vectors import half_decode, half_encode
from vecloom.sources.tables import read_table, rewrite_table, table_bytes


def to_half(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    return df.withColumn(vector_col, half_encode(F.col(vector_col)))


def from_half(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Float vectors of a table whether or not it has been rewritten."""
    if df.schema[vector_col].dataType.simpleString() != "binary":
        return df
    return df.withColumn(vector_col, half_decode(F.col(vector_col)))


def quantize_table(spark: SparkSession, path: str) -> DataFrame:
    """Rewrite a table at half precision, other columns kept: a one-row report. A table that
    is at half precision already is left as it is. Rows appended meanwhile are kept."""
    before = table_bytes(spark, path)
    stored = read_table(spark, path)
    kind, saved = "float16", "0%"
    if stored.schema["vector"].dataType.simpleString() == "binary":
        rows = stored.count()
    else:
        kind, saved = "float32", "~50%"
        rows = rewrite_table(spark, path, to_half)
    return spark.createDataFrame(
        [(rows, kind, "float16", saved, before, table_bytes(spark, path))],
        "rows long, dtype_before string, dtype_after string, estimated_reduction string, "
        "bytes_before long, bytes_after long",
    )
