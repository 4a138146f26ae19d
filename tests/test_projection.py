import numpy as np
import pytest

from pyspark.sql import functions as F

from vecloom.operators.layout import bandwidths, trustworthiness, weighted_edges
from vecloom.operators.neighbours import neighbour_graph
from vecloom.operators.projection import layout, pca_reduce, project, reduce_dimensions


def test_pca_is_centred_and_keeps_variance(make_table, random_vectors):
    v = random_vectors(60, 10)
    reduced = np.array([r["reduced"] for r in pca_reduce(make_table(v), 3).collect()])
    assert np.abs(reduced.mean(axis=0)).max() < 1e-9
    centred = v - v.mean(axis=0)
    spectrum = np.linalg.svd(centred, compute_uv=False)[:3] ** 2
    assert np.allclose((reduced**2).sum(axis=0), spectrum, rtol=1e-4)


def test_default_width(make_table, random_vectors):
    reduced = pca_reduce(make_table(random_vectors(15, 32))).first()["reduced"]
    assert len(reduced) == 14


def test_map_has_one_point_per_row(make_table, random_vectors):
    points = project(make_table(random_vectors(15, 32, 7)), 2)
    assert points.columns == ["id", "x", "y"]
    assert {r["id"] for r in points.collect()} == {f"/img_{i:05d}.jpg" for i in range(15)}
    assert project(make_table(random_vectors(20, 32)), 3).columns == ["id", "x", "y", "z"]


@pytest.mark.parametrize("n", [1, 2])
def test_very_small_tables(make_table, random_vectors, n):
    assert layout(make_table(random_vectors(n, 5)), 2).count() == n


def test_layout_keeps_neighbours(make_table):
    rng = np.random.default_rng(0)
    group = np.repeat(np.arange(6), 20)
    v = rng.standard_normal((6, 24))[group] + 0.35 * rng.standard_normal((120, 24))
    frame = make_table(v, list(range(120)))

    def kept(points):
        rows = sorted(points.collect(), key=lambda r: r["id"])
        y = np.array([[r["x"], r["y"]] for r in rows])
        gap = ((y[:, None] - y[None]) ** 2).sum(axis=2)
        np.fill_diagonal(gap, np.inf)
        return np.mean(group[np.argsort(gap, axis=1)[:, :10]] == group[:, None])

    flat, moved = kept(project(frame, 2)), kept(layout(frame, 2, neighbours=10))
    assert moved > flat
    assert moved > 0.9


def brute_trust(v, y, k):
    """Trustworthiness of a map from its definition, ranks by cosine distance."""
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = np.round(1 - unit @ unit.T, 9)
    gap = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    np.fill_diagonal(gap, np.inf)
    n, cost = len(v), 0
    for i in range(n):
        for j in np.argsort(gap[i], kind="stable")[:k]:
            cost += max(0, np.sum(far[i] < far[i, j]) + 1 - k)
    return 1 - 2 * cost / (n * k * (2 * n - 3 * k - 1))


@pytest.mark.parametrize("method, block_rows, least", [("tsne", 4096, 0.95), ("umap", 100, 0.85)])
def test_layout_is_trustworthy(make_table, method, block_rows, least):
    """A curved band that no linear map keeps apart, in one block and in many."""
    rng = np.random.default_rng(2)
    t = rng.uniform(0, 6, 400)
    bent = np.stack([np.cos(t * f) for f in range(1, 7)] + [np.sin(t * f) for f in range(1, 7)], axis=1)
    v = (bent + 0.05 * rng.standard_normal(bent.shape)).astype(np.float32)
    frame = make_table(v, list(range(400)))
    trust = {}
    for name, placed in (
        ("linear", project(frame, 2)),
        ("moved", layout(frame, 2, neighbours=12, method=method, block_rows=block_rows)),
    ):
        rows = sorted(placed.collect(), key=lambda r: r["id"])
        y = np.array([[r["x"], r["y"]] for r in rows])
        trust[name] = trustworthiness(frame, placed, "id >= 0", 8).first()
        assert trust[name]["trust"] == pytest.approx(brute_trust(v, y, 8), abs=2e-3)
        assert (trust[name]["n_rows"], trust[name]["n_asked"]) == (400, 400)
    assert trust["moved"]["trust"] > least > trust["linear"]["trust"] + 0.05


def test_trust_is_asked_of_many_rows(make_table, random_vectors):
    """More rows than are sent to the tasks at a time, in several blocks or in one."""
    v = random_vectors(600, 8, 5, positive=False)
    frame = make_table(v, list(range(600)))
    linear = project(frame, 2)
    rows = sorted(linear.collect(), key=lambda r: r["id"])
    y = np.array([[r["x"], r["y"]] for r in rows])
    wanted = (600, 600, pytest.approx(brute_trust(v, y, 5), abs=1e-6))
    for block_rows in (4096, 130):
        assert tuple(trustworthiness(frame, linear, "id >= 0", 5, block_rows=block_rows).first()) == wanted
    many = random_vectors(4_500, 3, 6, positive=False)
    frame = make_table(many, list(range(4_500)))
    got = trustworthiness(frame, project(frame, 3), "id >= 0")
    assert got.select("n_rows", "n_asked", F.col("trust") > 0.99).first() == (4_500, 4_500, True)


def test_bandwidths_reach_the_wanted_count():
    rng = np.random.default_rng(3)
    gaps = np.sort(rng.gamma(2, 1, (200, 15)) * rng.uniform(0.01, 50, (200, 1)), axis=1)
    gaps[3] = gaps[3, 0]
    gaps[4, 2:] = np.inf
    gaps[5] = 0
    w = bandwidths(gaps, np.log2(15), "umap")
    plain = [i for i in range(200) if i not in (3, 4, 5)]
    assert np.allclose(w[plain].sum(axis=1), np.log2(15), atol=1e-6)
    assert np.allclose(w[:, 0], 1) and (np.diff(w, axis=1) <= 1e-12).all()
    assert (w[4, 2:] == 0).all() and (w[3] == 1).all() and (w[5] == 1).all()
    p = bandwidths(gaps, 5.0, "tsne")
    p = p[plain] / p[plain].sum(axis=1, keepdims=True)
    entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
    assert np.allclose(np.exp(entropy), 5.0, atol=1e-6)


def test_edges_are_a_symmetric_union(spark, make_table):
    v = np.random.default_rng(4).standard_normal((60, 8))
    graph = neighbour_graph(make_table(v, list(range(60))), 6)
    rows = sorted(graph.collect(), key=lambda r: (r["qid"], r["rank"]))
    gaps = np.sqrt(2 * np.array([r["distance"] for r in rows]).reshape(60, 6))
    one = np.zeros((60, 60))
    for r, w in zip(rows, bandwidths(gaps, np.log2(6), "umap").reshape(-1)):
        one[r["qid"], r["id"]] = w
    union = one + one.T - one * one.T
    got = np.zeros((60, 60))
    for r in weighted_edges(graph, 6, "umap").collect():
        got[r["u"], r["v"]] = r["w"]
    assert np.allclose(got, union, atol=1e-9) and np.array_equal(got, got.T)


def test_a_third_of_all_points_in_one_place(make_table):
    """Copies share one place at the start; their box is cut into blocks."""
    v = np.random.default_rng(5).standard_normal((300, 6))
    v[:100] = v[0]
    points = layout(make_table(v, list(range(300))), 2, rounds=2, neighbours=6, block_rows=40)
    rows = points.collect()
    assert sorted(r["id"] for r in rows) == list(range(300))
    assert np.isfinite([[r["x"], r["y"]] for r in rows]).all()


def test_unknown_method(make_table, random_vectors):
    with pytest.raises(ValueError, match="unknown reduction method"):
        reduce_dimensions(make_table(random_vectors(5, 5)), "mds")


def test_three_axes(make_table, random_vectors):
    points = reduce_dimensions(make_table(random_vectors(20, 12)), "tsne", 3, rounds=2)
    assert points.columns == ["id", "x", "y", "z"] and points.count() == 20
