"""Vector tables: schema checks, scan, append, rewrite, stats and sinks.

A table is a folder of batches, ``batch=<id>``, each written once by one job. Numbered commits
say which batches make a version, so a version is all there or not at all: what a writer leaves
behind when it is cut off is named by no commit. A reader keeps the version it has
looked up. Appends and rewrites that meet take the next number in turn, and neither loses
the other's rows. A plain folder of Parquet files is a table as well; its files are the batch ``.``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import half_encode
from vecloom.sources import commits
from vecloom.sources.commits import hadoop_path

METADATA = ["width", "height", "file_size", "file_mtime"]

VECTOR_FIELDS = [
    T.StructField("id", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
]
METADATA_FIELDS = [
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("file_mtime", T.DoubleType()),
]
# Unique per written row, so that rows with equal ids stay apart in joins.
ROW_KEY = T.StructField("row_key", T.StringType())

# Vector elements hardly repeat: a dictionary costs a third of the write and saves nothing.
PLAIN_VECTORS = {"parquet.enable.dictionary#vector.list.element": "false"}

FULL_SCHEMA = T.StructType(VECTOR_FIELDS + METADATA_FIELDS + [ROW_KEY])
VECTORS_ONLY_SCHEMA = T.StructType(VECTOR_FIELDS + [ROW_KEY])


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a text names a file, on whatever file system; most texts name nothing."""
    if not path or "\n" in path:
        return False
    try:
        fs, p = hadoop_path(spark, path)
        return fs.isFile(p)
    except Py4JJavaError:
        return False


def has_metadata(df: DataFrame) -> bool:
    return "width" in df.columns


# -- Versions ----------------------------------------------------------------------------------

PLAIN = "."


@dataclass(frozen=True)
class Version:
    """A state of a table: its commit number (-1 before the first), batches and columns."""

    number: int
    batches: tuple[str, ...]
    schema: T.StructType


def plain_files(spark: SparkSession, path: str) -> str | None:
    """What to read of a file, or of a folder's Parquet data outside of batches; None if there
    is none. Folders of its own, such as partitions, belong to a table without batches."""
    fs, folder = hadoop_path(spark, path)
    if not fs.exists(folder):
        return None
    if fs.isFile(folder):
        return path
    entries = [(e.getPath().getName(), e.isDirectory()) for e in fs.listStatus(folder)]
    own = [(name, nested) for name, nested in entries if not name.startswith(("_", "."))]
    if any(nested and not name.startswith("batch=") for name, nested in own):
        return path
    return f"{path}/*.parquet" if any(not nested for _, nested in own) else None


def current(spark: SparkSession, path: str) -> Version | None:
    """The last version of a table, or None if there is no table."""
    found = commits.latest(spark, path)
    if found:
        number, content = found
        return Version(number, tuple(content["batches"]), T.StructType.fromJson(content["schema"]))
    if plain_files(spark, path):
        return Version(-1, (PLAIN,), read_batches(spark, path, [PLAIN]).schema)
    return None


def read_batches(
    spark: SparkSession, path: str, batches: list[str], schema: T.StructType | None = None
) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(
        *[plain_files(spark, path) if b == PLAIN else f"{path}/batch={b}" for b in batches]
    )


def read_version(spark: SparkSession, path: str, version: Version) -> DataFrame:
    return read_batches(spark, path, list(version.batches), version.schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last version. Later commits do not change what this frame reads."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"table not found: {path}")
    return read_version(spark, path, version)


def table_exists(spark: SparkSession, path: str) -> bool:
    return current(spark, path) is not None


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files that the last version reads."""
    version = current(spark, path)
    total = 0
    for batch in version.batches if version else ():
        own = plain_files(spark, path) if batch == PLAIN else f"{path}/batch={batch}"
        fs, folder = hadoop_path(spark, own)
        total += sum(fs.getContentSummary(e.getPath()).getLength() for e in fs.globStatus(folder))
    return total


def write_batch(df: DataFrame, path: str) -> str:
    """Write rows as a batch that no version names yet."""
    name = uuid.uuid4().hex
    df.write.options(**PLAIN_VECTORS).parquet(f"{path}/batch={name}")
    return name


def discard(spark: SparkSession, path: str, batch: str) -> None:
    fs, folder = hadoop_path(spark, f"{path}/batch={batch}")
    fs.delete(folder, True)


def commit(spark: SparkSession, path: str, number: int, batches, schema: T.StructType) -> bool:
    content = {"batches": list(batches), "schema": schema.jsonValue()}
    return commits.publish(spark, path, number, content)


def remove_unused(spark: SparkSession, path: str, older_than_s: float = 7 * 86_400) -> list[str]:
    """Delete batches that the last version does not name and that were written at least
    ``older_than_s`` ago; returns them. Younger ones may belong to a writer at work or be
    read by a reader of an earlier version."""
    version = current(spark, path)
    if version is None or version.number < 0:
        return []
    fs, folder = hadoop_path(spark, path)
    before = (time.time() - older_than_s) * 1000
    removed = []
    for entry in fs.listStatus(folder):
        name = entry.getPath().getName().removeprefix("batch=")
        is_batch = entry.isDirectory() and entry.getPath().getName().startswith("batch=")
        if is_batch and name not in version.batches and entry.getModificationTime() < before:
            discard(spark, path, name)
            removed.append(name)
    return removed


# -- Reading and writing -----------------------------------------------------------------------


def scan_vectors(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Ids and vectors of a table; further columns only where asked for."""
    return read_table(spark, path).select("id", "vector", *columns)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the target's columns. Columns the target lacks are dropped; a column it
    has and the rows lack, or a different type, is an error. Nullability is ignored, and
    vectors for a half-precision table are encoded."""
    for field in schema.fields:
        if field.name == "row_key" and "row_key" not in df.columns:
            df = df.withColumn("row_key", F.expr("uuid()"))
        if field.name not in df.columns:
            raise ValueError(f"rows have no column {field.name!r} required by the table")
        if field.name == "vector" and field.dataType.simpleString() == "binary":
            if df.schema["vector"].dataType.simpleString() != "binary":
                df = df.withColumn("vector", half_encode(F.col("vector")))
        given = df.schema[field.name].dataType.simpleString()
        if given != field.dataType.simpleString():
            raise ValueError(
                f"column {field.name!r} is {given}, the table has {field.dataType.simpleString()}"
            )
    return df.select(*[f.name for f in schema.fields])


def append_vectors(df: DataFrame, path: str) -> None:
    """Append rows, creating the table on first use. Duplicate ids are kept.

    A new table takes the metadata columns if the rows have them; an existing one
    decides the columns itself.
    """
    spark = df.sparkSession
    while True:
        version = current(spark, path)
        schema = version.schema if version else new_schema(df)
        batch = write_batch(conform(df, schema), path)
        while True:
            number, batches = (version.number, version.batches) if version else (-1, ())
            if commit(spark, path, number + 1, (*batches, batch), schema):
                return
            # Another writer was first. Unless it changed the columns, the batch still fits.
            version = current(spark, path)
            if version.schema != schema:
                discard(spark, path, batch)
                break


def new_schema(df: DataFrame) -> T.StructType:
    with_metadata = all(c in df.columns for c in METADATA)
    wanted = FULL_SCHEMA if with_metadata else VECTORS_ONLY_SCHEMA
    return T.StructType([T.StructField("id", df.schema["id"].dataType)] + wanted.fields[1:])


def rewrite_table(
    spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]
) -> int:
    """Replace the rows of a table by ``change`` of them, one for one; returns their number.

    The copy is complete and counted before it is committed. Rows that others append
    meanwhile are changed as well and committed with it; if others rewrite the table, the
    work starts again from their version. ``change`` must give the same columns each time.
    """
    while True:
        base = seen = current(spark, path)
        if base is None:
            raise FileNotFoundError(f"table not found: {path}")
        made, rows, todo = [], 0, base.batches
        # Once for the whole table, then for what is appended before the commit comes through.
        while set(base.batches) <= set(seen.batches) and seen.schema == base.schema:
            if todo:
                given = read_batches(spark, path, list(todo), base.schema)
                changed = change(given)
                made.append(write_batch(changed, path))
                after = read_batches(spark, path, made[-1:]).count()
                before = given.count()
                if after != before:
                    for name in made:
                        discard(spark, path, name)
                    raise ValueError(f"staged copy has {after} rows, the table has {before}")
                rows += after
            if commit(spark, path, seen.number + 1, made, changed.schema):
                return rows
            done, seen = seen.batches, current(spark, path)
            todo = tuple(b for b in seen.batches if b not in done)
        for name in made:
            discard(spark, path, name)


def replace_table(df: DataFrame, path: str) -> int:
    """Swap the rows of a table for as many others; returns their number. If the table
    changes before they are committed, nothing is swapped."""
    spark = df.sparkSession
    base = current(spark, path)
    batch = write_batch(df, path)
    before = read_version(spark, path, base).count()
    after = read_batches(spark, path, [batch]).count()
    if after == before and commit(spark, path, base.number + 1, [batch], df.schema):
        return after
    discard(spark, path, batch)
    if after != before:
        raise ValueError(f"staged copy has {after} rows, the table has {before}")
    raise OSError(f"{path} was changed by another writer")


def table_stats(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(table, row_count, error): a missing table is an error row, not an exception."""
    name = name or path.rstrip("/").rsplit("/", 1)[-1]
    if not table_exists(spark, path):
        return spark.createDataFrame(
            [(name, None, f"table not found: {path}")], "table string, row_count long, error string"
        )
    return read_table(spark, path).agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("table"), "row_count", F.lit(None).cast("string").alias("error")
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_by_class(df: DataFrame, path: str, class_col: str = "class_name") -> None:
    """One directory per class. The rebalance hint cuts a hot class over several tasks and
    joins the small ones, so neither files nor tasks grow out of hand."""
    df.hint("rebalance", class_col).write.mode("overwrite").partitionBy(class_col).parquet(path)
