import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("vecloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_table(spark):
    """Seeded vectors as (id, vector) rows; returns the frame and the matrix."""

    def make(vectors, ids=None):
        vectors = np.asarray(vectors, np.float32)
        ids = ids if ids is not None else [f"/img_{i:05d}.jpg" for i in range(len(vectors))]
        rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors)]
        kind = "long" if ids and isinstance(ids[0], int) else "string"
        return spark.createDataFrame(rows, f"id {kind}, vector array<float>")

    return make


@pytest.fixture(scope="session")
def random_vectors():
    def make(n, dim=32, seed=42, positive=True):
        rng = np.random.default_rng(seed)
        v = rng.random((n, dim)) if positive else rng.standard_normal((n, dim))
        return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)

    return make


def brute_distance(vectors):
    v = np.asarray(vectors, np.float64)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    size[size == 0] = 1.0
    v = v / size
    return 1.0 - v @ v.T


@pytest.fixture(scope="session")
def distances():
    return brute_distance
