"""Numbered commits: what a folder consists of, from one version to the next.

A commit is a small JSON file ``_commits/<number>.json`` below the folder. It is written
under another name first and renamed to its number only if that number is free, so of two
writers that want the same number one fails and looks again; readers see a whole commit or
none. What a commit names is never changed afterwards: writers add new folders of data and
name them in the next commit. This needs a store whose rename refuses an existing target.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def commit_path(path: str, number: int) -> str:
    return f"{path}/_commits/{number:020d}.json"


def last_number(spark: SparkSession, path: str) -> int | None:
    fs, folder = hadoop_path(spark, f"{path}/_commits")
    # A single file is a table without commits; some stores refuse to look below a file.
    if fs.isFile(folder.getParent()) or not fs.exists(folder):
        return None
    names = [entry.getPath().getName() for entry in fs.listStatus(folder)]
    numbers = [int(name[:-5]) for name in names if name[:-5].isdigit() and name.endswith(".json")]
    return max(numbers, default=None)


def read_commit(spark: SparkSession, path: str, number: int) -> dict:
    fs, file = hadoop_path(spark, commit_path(path, number))
    stream = fs.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """Number and content of the last commit, if there is one."""
    number = last_number(spark, path)
    return None if number is None else (number, read_commit(spark, path, number))


def publish(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Make ``content`` commit ``number``; False if another writer has taken the number."""
    fs, draft = hadoop_path(spark, f"{path}/_commits/.{uuid.uuid4().hex}")
    _, target = hadoop_path(spark, commit_path(path, number))
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        draft.toUri(), spark._jsc.hadoopConfiguration()
    )
    try:
        context.rename(context.makeQualified(draft), context.makeQualified(target), options)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True
