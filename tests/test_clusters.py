import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators.clusters import (
    cluster_groups,
    cluster_preview,
    cluster_rows,
    cluster_stats,
    fit_centroids,
    fit_minibatch,
    lloyd_rounds,
)


def test_every_row_gets_one_of_k_clusters(make_table, random_vectors):
    placed = cluster_rows(make_table(random_vectors(100, 32)), 5, starts=2)
    rows = placed.collect()
    assert len(rows) == 100 and len({r["id"] for r in rows}) == 100
    assert {r["cluster"] for r in rows} == set(range(5))
    stats = cluster_stats(placed, 5).first()
    assert stats["n_clusters"] == 5 and stats["n_images"] == 100 and stats["inertia"] > 0


def test_single_cluster(make_table, random_vectors):
    v = random_vectors(20, 8, 1)
    placed = cluster_rows(make_table(v), 1)
    assert [r["count"] for r in placed.groupBy("cluster").count().collect()] == [20]
    want = ((v - v.mean(axis=0)) ** 2).sum()
    assert cluster_stats(placed, 1).first()["inertia"] == pytest.approx(want, rel=1e-5)


def test_more_clusters_than_rows(make_table, random_vectors):
    with pytest.raises(ValueError, match="n_clusters"):
        fit_centroids(make_table(random_vectors(4, 8)), 5)


def test_every_row_moves_the_centroids(make_table):
    """Rows far out are few; a fit on a sample would miss them."""
    v = np.concatenate([np.zeros((300, 3)), np.full((2, 3), 50.0)]).astype(np.float32)
    centres = fit_centroids(make_table(v), 2, starts=1)
    assert sorted(np.round(centres[:, 0])) == [0, 50]


def test_rounds_from_given_centroids(make_table):
    v = np.array([[0, 0], [0, 2], [9, 9], [11, 9]], np.float32)
    centres = lloyd_rounds(make_table(v), np.array([[1.0, 1], [8, 8], [99, 99]]), 2)
    assert centres.tolist() == [[0, 1], [10, 9], [99, 99]]


def test_groups_come_in_bounded_parts(spark):
    frame = spark.range(1000).select(
        F.col("id"), F.when(F.col("id") < 700, 0).otherwise(1).alias("cluster")
    )
    parts = cluster_groups(frame, part_rows=100).collect()
    assert {(r["cluster"], r["n"]) for r in parts} == {(0, 700), (1, 300)}
    assert max(len(r["ids"]) for r in parts) < 160
    assert all(r["ids"] == sorted(r["ids"]) for r in parts)
    assert sorted(i for r in parts for i in r["ids"]) == list(range(1000))


def test_preview_counts_the_rest(spark):
    frame = spark.range(10).select(F.col("id"), (F.col("id") % 2).alias("cluster"))
    rows = cluster_preview(frame, 3).collect()
    assert [(r["cluster"], r["id"]) for r in rows] == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]
    assert {r["more"] for r in rows} == {2}


@pytest.mark.parametrize("n, batch_rows", [(3000, 150), (300, 4096)])
def test_minibatches_come_near_the_full_fit(make_table, n, batch_rows):
    """Groups of unequal size, a third of all rows in one; batches of a part and of the whole."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 12)) * 3
    group = np.append(np.zeros(n // 3, int), rng.integers(0, 8, n - n // 3))
    v = centres[group] + rng.standard_normal((n, 12))
    frame = make_table(v, list(range(n)))
    full, some = (
        cluster_stats(cluster_rows(frame, 8, **o), 8).first()["inertia"]
        for o in ({}, {"minibatch": True, "batch_rows": batch_rows})
    )
    assert some <= 1.02 * full


def test_minibatches_of_odd_tables(spark, make_table, random_vectors):
    frame = make_table(random_vectors(6, 4))
    assert fit_minibatch(frame, 6, batches=3).shape == (6, 4)
    assert fit_minibatch(frame.unionByName(frame.withColumn("vector", F.lit(None).cast("array<float>"))), 1).shape == (1, 4)
    same = make_table(np.ones((50, 3)))
    assert np.allclose(fit_minibatch(same, 2, batches=2), 1)
    with pytest.raises(ValueError, match="between 1 and"):
        fit_minibatch(frame, 7)
    again = [fit_minibatch(frame, 3, batches=4) for _ in range(2)]
    assert np.allclose(*again)
