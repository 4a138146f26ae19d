"""Path and name expressions, all built-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def last_two_parts(path: Column) -> Column:
    """``class/file`` for a path with a slash, the path itself otherwise."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    start = F.greatest(F.size(parts) - 1, F.lit(1))
    return F.when(path.contains("/"), F.array_join(F.slice(parts, start, 2), "/")).otherwise(path)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; a dot-file or a trailing dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def numbered_class(label: Column) -> Column:
    return F.format_string("class_%03d", label)


def export_name(index: Column, split: str | None = None) -> Column:
    """``train_00042.jpg``, or ``00042.jpg`` where there is a single set."""
    pattern = f"{split}_%05d.jpg" if split else "%05d.jpg"
    return F.format_string(pattern, index)


def attach_class_name(df: DataFrame, label_col: str, names: list[str]) -> DataFrame:
    """Add ``class_name``; a label outside the list becomes ``unlabeled``.

    The name list is a literal of the caller, so the broadcast side cannot grow.
    """
    spark = df.sparkSession
    lookup = spark.createDataFrame(list(enumerate(names)), f"{label_col} int, name string")
    joined = df.join(F.broadcast(lookup), label_col, "left")
    return joined.withColumn("class_name", F.coalesce("name", F.lit("unlabeled"))).drop("name")
