"""Session helpers: the shared scratch folder, materialised stages, size checks."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Most bytes of driver-collected data that may be shipped to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# A usual input split.
SPLIT_BYTES = 128 * 1024 * 1024


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is missing and the session is
    local; on a cluster a machine-local folder would be invisible to other executors.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="vecloom-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/vecloom-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared scratch folder and read it back.

    This cuts the lineage with files that outlive any executor, and gives the next
    stage real size statistics to plan with.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def take_bounded(df: DataFrame, max_rows: int) -> pa.Table | None:
    """Bring ``df`` to the driver if it has at most ``max_rows`` rows, else None."""
    return df.toArrow() if df.count() <= max_rows else None


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"table has no column {missing}; it has {df.columns}")


def even_scan(scan: DataFrame) -> DataFrame:
    """A plain scan ahead of costly per-row work. One whose files would fill few of the
    cores, such as a small table in one file, is spread over them; its size is checked, and
    a larger one is left alone."""
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = scan.inputFiles()
    if 2 * len(files) > cores:
        return scan
    size = 0
    for name in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return scan.repartition(cores) if size < cores * SPLIT_BYTES else scan
