import numpy as np
import pytest

from vecloom.operators.search import preview_sample, search_batch, search_topk


def test_stored_vector_is_its_own_nearest(make_table, random_vectors):
    v = random_vectors(100, 8)
    best = search_topk(make_table(v), v[17], 5).collect()
    assert best[0]["id"] == "/img_00017.jpg" and abs(best[0]["distance"]) < 1e-6
    assert [r["rank"] for r in best] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("k, rows", [(1, 1), (3, 3), (10, 10), (80, 50)])
def test_k(make_table, random_vectors, k, rows):
    v = random_vectors(50, 8, seed=123)
    assert search_topk(make_table(v), v[0], k).count() == rows


def test_matches_brute_force_with_copies(make_table, random_vectors, distances):
    """A third of the rows are copies of the query: ties are settled by id."""
    v = random_vectors(300, 16)
    v[::3] = v[0]
    frame = make_table(v).repartition(5)
    best = [r["id"] for r in search_topk(frame, v[0], 120).collect()]
    order = sorted(range(300), key=lambda i: (round(distances(v)[0, i], 9), i))
    assert best == [f"/img_{i:05d}.jpg" for i in order[:120]]


def test_filter_comes_before_the_search(spark, make_table, random_vectors):
    v = random_vectors(60, 8)
    frame = make_table(v).selectExpr("*", "cast(substr(id, 6, 5) as int) AS width")
    best = search_topk(frame, v[3], 4, where="width >= 50")
    assert best.count() == 4
    assert all(int(r["id"][5:10]) >= 50 for r in best.collect())


def test_filter_needs_its_columns(make_table, random_vectors):
    with pytest.raises(Exception, match="width"):
        search_topk(make_table(random_vectors(5, 8)), np.ones(8), 2, where="width > 1").collect()


def test_zero_and_null_vectors(spark):
    rows = [("a", [0.0, 0.0]), ("b", [2.0, 0.0]), ("c", None), ("d", [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "id string, vector array<float>")
    best = search_topk(frame, [1.0, 0.0], 5).collect()
    assert [(r["id"], r["distance"]) for r in best] == [("b", 0.0), ("a", 1.0), ("d", 2.0)]


def test_batch_paths_agree(spark, make_table, random_vectors):
    v = random_vectors(200, 12, positive=False)
    frame = make_table(v)
    queries = make_table(v[:9], [f"q{i}" for i in range(9)]).toDF("qid", "qv")
    shipped = search_batch(frame, queries, 7).orderBy("qid", "rank").collect()
    joined = search_batch(frame, queries, 7, max_broadcast_queries=3)
    joined = joined.orderBy("qid", "rank").select("qid", "id", "distance", "rank").collect()
    assert len(shipped) == 63
    assert shipped == joined


def test_batch_without_queries(make_table, random_vectors):
    frame = make_table(random_vectors(5, 4))
    queries = make_table(np.empty((0, 4)), []).toDF("qid", "qv")
    assert search_batch(frame, queries, 3).count() == 0


def test_filter_reaches_the_scan(spark, make_table, random_vectors, tmp_path):
    frame = make_table(random_vectors(20, 4)).selectExpr("*", "1 AS width", "2 AS height")
    frame.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = search_topk(stored, np.ones(4), 3, "width > 0")._jdf.queryExecution().toString()
    assert "GreaterThan(width,0)" in plan
    scan = [line for line in plan.splitlines() if "ReadSchema" in line][-1]
    assert "height" not in scan.split("ReadSchema")[1]


def test_preview(make_table, random_vectors):
    frame = make_table(random_vectors(100, 4)).coalesce(1)
    got = preview_sample(frame, 8, seed=1).collect()
    assert len(got) == 8
    assert preview_sample(frame.limit(3), 8).count() == 3
