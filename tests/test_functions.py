import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import paths, vectors
from vecloom.functions.encoders import embed, hashed_words
from vecloom.sources.synthetic import synthetic_vectors


def test_paths(spark):
    given = ["/data/cat/x.JPG", "plain.tar.gz", "/d/.jpg", "/a", "/d/name.", "a/b"]
    frame = spark.createDataFrame([(g,) for g in given], "p string")
    p = F.col("p")
    rows = frame.select(
        paths.base_name(p).alias("b"), paths.last_two_parts(p).alias("l"), paths.suffix(p).alias("s")
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("x.JPG", "cat/x.JPG", ".jpg"),
        ("plain.tar.gz", "plain.tar.gz", ".gz"),
        (".jpg", "d/.jpg", ""),
        ("a", "a", ""),
        ("name.", "d/name.", ""),
        ("b", "a/b", ""),
    ]


def test_vector_expressions(spark):
    frame = spark.createDataFrame(
        [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>"
    )
    a, b = F.col("a"), F.col("b")
    row, zero = frame.select(
        vectors.cosine_distance(a, b).alias("d"),
        vectors.l2_normalize(a).alias("u"),
        vectors.squared_distance(a, b).alias("s"),
    ).collect()
    assert row["d"] == pytest.approx(0.04) and row["u"] == pytest.approx([0.6, 0.8])
    assert row["s"] == pytest.approx(2.0)
    assert zero["d"] == 1.0 and zero["u"] == [0.0, 0.0]


def test_half_codec(spark, make_table, random_vectors):
    v = random_vectors(12, 5)
    frame = make_table(v).select("id", vectors.half_encode(F.col("vector")).alias("h"))
    rows = frame.select("id", "h", vectors.half_decode(F.col("h")).alias("v")).orderBy("id").collect()
    for r, want in zip(rows, v):
        assert bytes(r["h"]) == want.astype("<f2").tobytes()
        assert np.array_equal(np.array(r["v"], np.float32), want.astype(np.float16))


def test_encoder(spark):
    frame = spark.createDataFrame([("a b  a",), ("",)], "t string")
    one, empty = [r["v"] for r in frame.select(embed(F.col("t"), hashed_words(8)).alias("v")).collect()]
    assert np.linalg.norm(one) == pytest.approx(1, abs=1e-6)
    assert sorted(round(x, 4) for x in one if x)[-1] in (0.8944, 1.0)
    assert set(empty) == {0.0}


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    few = synthetic_vectors(spark.range(0, 50, 1, 2), 16).orderBy("id").collect()
    many = synthetic_vectors(spark.range(0, 50, 1, 7), 16).orderBy("id").collect()
    assert few == many
    v = np.array([r["vector"] for r in few])
    assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-6)
    assert (1 - v @ v.T + np.eye(50)).min() > 0.01


def test_labels(spark):
    frame = spark.createDataFrame([(0,), (1,), (7,), (-1,)], "label int")
    rows = paths.attach_class_name(frame, "label", ["cat", "dog"]).collect()
    assert {r["label"]: r["class_name"] for r in rows} == {
        0: "cat", 1: "dog", 7: "unlabeled", -1: "unlabeled",
    }


def test_a_null_text_has_a_null_vector(spark):
    rows = [(1, "some words"), (2, None), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = {r.id: r.v for r in df.select("id", embed(df["text"], hashed_words(8)).alias("v")).collect()}
    assert got[2] is None and got[4] is None and len(got[1]) == len(got[3]) == 8
    none = df.where("text IS NULL").select(embed(df["text"], hashed_words(8)).alias("v"))
    assert [r.v for r in none.collect()] == [None, None]
