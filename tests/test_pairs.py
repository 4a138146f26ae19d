import numpy as np
import pytest

from pyspark.sql import functions as F

from vecloom.operators.pairs import (
    duplicate_pairs,
    duplicate_pairs_hashed,
    hash_plan,
    part_candidates,
)
from vecloom.operators.parts import part_sizes, spread_parts


def expected(vectors, threshold, distances):
    d = distances(vectors)
    i, j = np.nonzero(np.triu(d < threshold, 1))
    return {(int(a), int(b)): d[a, b] for a, b in zip(i, j)}


def found(frame):
    rows = frame.collect()
    pairs = {(r["id_a"], r["id_b"]): r["distance"] for r in rows}
    assert len(pairs) == len(rows), "a pair came twice"
    steps = [r["distance"] for r in rows]
    assert steps == sorted(steps)
    return pairs


def clustered(n, dim, groups, noise, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return centres[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, dim))


@pytest.mark.parametrize("block_rows", [4096, 37, 10])
@pytest.mark.parametrize("threshold", [0.01, 0.2, 1.2])
def test_exact_join_matches_brute_force(make_table, distances, block_rows, threshold):
    v = clustered(240, 12, 20, 0.15).astype(np.float32)
    v[5] = 0.0
    v[6] = v[7]
    frame = make_table(v, list(range(len(v))))
    ours = found(duplicate_pairs(frame, threshold, block_rows=block_rows))
    want = expected(v, threshold, distances)
    assert set(ours) == set(want)
    assert all(abs(ours[p] - want[p]) < 1e-6 for p in want)


def test_third_of_the_rows_are_copies(make_table, distances):
    v = clustered(300, 8, 30, 0.05, seed=3).astype(np.float32)
    v[:100] = v[0]
    frame = make_table(v, list(range(len(v))))
    want = expected(v, 0.02, distances)
    assert set(found(duplicate_pairs(frame, 0.02, block_rows=16))) == set(want)
    hashed = found(
        duplicate_pairs_hashed(frame, 0.02, recall=0.99999, block_rows=16, bucket_rows=40)
    )
    assert set(hashed) <= set(want)
    assert len(hashed) >= 0.99 * len(want)


def test_scaled_copy_pairs_and_turned_row_does_not(make_table):
    """Cosine ignores length: a tripled vector is a copy, a perpendicular one is far."""
    rows = [[3.0, -1.0, 0.5, 2.0], [9.0, -3.0, 1.5, 6.0], [1.0, 3.0, 0.0, 0.0]]
    got = found(duplicate_pairs(make_table(rows, ["left", "left x3", "turned"]), 0.02))
    assert list(got) == [("left", "left x3")]
    assert got["left", "left x3"] == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("threshold,pairs", [(0.9999, 0), (1.0001, 66)])
def test_axes_pair_only_beyond_a_right_angle(make_table, threshold, pairs):
    assert duplicate_pairs(make_table(np.eye(12)), threshold).count() == pairs


def test_repeated_ids_are_kept(spark):
    rows = [("x", "k1", [1.0, 0.0]), ("x", "k2", [1.0, 0.0]), ("y", "k3", [1.0, 0.01])]
    frame = spark.createDataFrame(rows, "id string, row_key string, vector array<float>")
    got = duplicate_pairs(frame, 0.05, key_col="row_key").collect()
    assert sorted((r["id_a"], r["id_b"]) for r in got) == [("x", "x"), ("x", "y"), ("x", "y")]


@pytest.mark.parametrize("block_rows", [4096, 25])
def test_first_pairs(make_table, random_vectors, block_rows):
    v = random_vectors(120, 6, 5)
    v[40:60] = v[0]
    frame = make_table(v)
    everything = duplicate_pairs(frame, 0.3, block_rows=block_rows).collect()
    first = duplicate_pairs(frame, 0.3, limit=15, block_rows=block_rows).collect()
    assert first == everything[:15]


def test_hash_plan_reaches_the_recall():
    for n in (1_000, 10**6, 10**9):
        bits, tables = hash_plan(n, 0.05, 0.99, 1024)
        agree = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - agree) ** tables >= 0.99


def test_no_rows(make_table):
    assert duplicate_pairs(make_table(np.empty((0, 4)), []), 0.1).count() == 0


def test_hot_copies_with_small_blocks(make_table, distances):
    """Groups of copies larger than a block, near one another, and a limit over them."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((90, 6)).astype(np.float32)
    v[0:40] = v[0]
    v[40:60] = v[0] + 0.01
    order = rng.permutation(90)
    frame = make_table(v[order], list(range(90)))
    want = expected(v[order], 0.01, distances)
    assert len(want) > 60 * 59 // 2 - 1
    everything = duplicate_pairs(frame, 0.01, block_rows=9)
    assert set(found(everything)) == set(want)
    first = duplicate_pairs(frame, 0.01, limit=30, block_rows=9).collect()
    assert first == everything.limit(30).collect()


def test_repeated_ids_of_copies(spark):
    rows = [("x", f"k{i}", [1.0, 0.0]) for i in range(5)] + [("y", "k9", [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "id string, row_key string, vector array<float>")
    got = duplicate_pairs(frame, 0.05, key_col="row_key", block_rows=2).collect()
    assert len({(r["key_a"], r["key_b"]) for r in got}) == len(got) == 10


@pytest.mark.parametrize("hashed", [False, True])
def test_star_holds_the_same_pairs(make_table, distances, hashed):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((90, 6)).astype(np.float32)
    v[0:40] = v[0]
    v[40:60] = v[0] + 0.01
    v[80] = v[81] = 0.0
    frame = make_table(v, list(range(90)))
    find = duplicate_pairs_hashed if hashed else duplicate_pairs
    star = found(find(frame, 0.01, star=True))
    assert len(star) < 90
    copies = {i: {i} for i in range(90)}
    for (a, b), d in star.items():
        if np.array_equal(v[a], v[b]):
            copies[a].add(b)
    every = {p for a in copies for p in ((x, y) for x in copies[a] for y in copies[a] if x < y)}
    for a, b in star:
        if not np.array_equal(v[a], v[b]):
            every |= {(min(x, y), max(x, y)) for x in copies[a] for y in copies[b]}
    assert every == set(expected(v, 0.01, distances))


@pytest.mark.parametrize("block_rows", [4096, 25])
def test_parts_of_wide_vectors_lose_no_pair(make_table, distances, block_rows):
    """Groups at all distances around the threshold, a third of all rows in one of them."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((30, 37))
    group = rng.integers(0, 30, 300)
    group[:100] = 0
    v = (centres[group] + rng.uniform(0, 0.5, (300, 1)) * rng.standard_normal((300, 37))).astype(np.float32)
    frame = make_table(v, list(range(300)))
    ours = found(duplicate_pairs(frame, 0.1, block_rows=block_rows))
    want = expected(v, 0.1, distances)
    assert set(ours) == set(want) and len(want) > 500
    assert part_sizes(37) == [10, 9, 9, 9]


def test_few_pairs_are_candidates_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr(
        "vec_id AS row", "embedding AS vector"
    )
    n = rows.count()
    assert part_candidates(rows, 64, 0.05, 4096).count() < 0.01 * n * (n - 1) / 2
    # What is compared in the axes of a part, against whole vectors of every pair.
    homes = F.count_if("home")
    met = spread_parts(rows, 64, 0.1**0.5).groupBy("cell").agg(
        (homes * (homes - 1) / 2 + homes * F.count_if(~F.col("home"))).alias("pairs")
    )
    assert met.agg(F.sum("pairs")).first()[0] * 8 / 64 < 0.2 * n * (n - 1) / 2


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_pairs_are_settled_where_they_meet(make_table, distances, monkeypatch, spread):
    """No list of candidates is joined to vectors again; rows all about one direction, where
    few axes tell nothing apart, are compared by whole vectors."""

    def never(*args):
        raise AssertionError("candidates were listed")

    monkeypatch.setattr("vecloom.operators.pairs.checked", never)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1, 48)) + spread * rng.standard_normal((700, 48))
    v[300:330] = v[300] + 0.05 * spread * rng.standard_normal((30, 48))
    v[5], v[6] = 0.0, 3 * v[7]
    v = v.astype(np.float32)
    frame = make_table(v, list(range(700)))
    threshold = 0.0004 if spread < 1 else 0.05
    ours = found(duplicate_pairs(frame, threshold, block_rows=130))
    want = expected(v, threshold, distances)
    assert set(ours) == set(want) and len(want) > 400
    assert all(abs(ours[p] - want[p]) < 1e-6 for p in want)


def test_parts_on_request(make_table, distances):
    v = clustered(200, 24, 20, 0.1, seed=5).astype(np.float32)
    ours = found(duplicate_pairs(make_table(v, list(range(200))), 0.05, by_parts=True, block_rows=30))
    assert set(ours) == set(expected(v, 0.05, distances))
