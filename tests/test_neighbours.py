import numpy as np
import pytest

from vecloom.functions.vectors import unit_rows
from vecloom.operators import cells, neighbours
from vecloom.operators.neighbours import nearest_join, neighbour_graph
from vecloom.operators.search import search_batch


@pytest.mark.parametrize("block_rows", [4096, 40, 15])
def test_graph_matches_brute_force(make_table, distances, block_rows):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 8))
    v = (centres[rng.integers(0, 12, 180)] + 0.2 * rng.standard_normal((180, 8))).astype(np.float32)
    v[:60] = v[0]  # a third are copies
    v[70] = 0.0
    d = np.round(distances(v), 9)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in neighbour_graph(make_table(v, list(range(180))), 6, block_rows=block_rows).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["distance"]))
    for q in range(180):
        ours = [round(x[2], 6) for x in sorted(got[q])]
        want = sorted(d[q])[:6]
        assert np.allclose(ours, want, atol=2e-6)
        if q < 60:  # copies tie at zero and are settled by id
            assert [x[1] for x in sorted(got[q])] == [i for i in range(8) if i != q][:6]


def test_join_of_two_tables(make_table, random_vectors):
    corpus, queries = random_vectors(150, 6, 2, False), random_vectors(40, 6, 3, False)
    c = make_table(corpus)
    q = make_table(queries, [f"q{i}" for i in range(40)]).toDF("qid", "qv")
    got = nearest_join(q, c, 4, block_rows=20).collect()
    assert len(got) == 160
    d = 1 - queries.astype(float) @ corpus.T.astype(float)
    for r in got:
        row = d[int(r["qid"][1:])]
        assert r["distance"] == pytest.approx(sorted(row)[r["rank"] - 1], abs=1e-5)


def test_fewer_rows_than_k(make_table, random_vectors):
    assert neighbour_graph(make_table(random_vectors(4, 5)), 10).count() == 12


@pytest.mark.parametrize("side", [4096, 0])
def test_both_sides_agree_on_repeated_ids_and_queries(spark, side):
    """A query set that is shipped and one that is joined give the same rows."""
    corpus = [("x", [1.0, 0.0]), ("x", [1.0, 0.0]), ("y", [1.0, 0.1]), ("z", [0.0, 1.0]), ("z", None)]
    asked = [("q", [1.0, 0.0]), ("q", [1.0, 0.0]), ("r", [0.0, 2.0]), ("s", None)]
    c = spark.createDataFrame(corpus, "id string, vector array<float>")
    q = spark.createDataFrame(asked, "qid string, qv array<float>")
    got = search_batch(c, q, 3, max_broadcast_queries=side).collect()
    lists = sorted((r["qid"], r["rank"], r["id"]) for r in got)
    twice = [("q", 1, "x"), ("q", 2, "x"), ("q", 3, "y")]
    assert lists == sorted(twice * 2 + [("r", 1, "z"), ("r", 2, "y"), ("r", 3, "x")])


def test_graph_keeps_rows_of_equal_ids_apart(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.05]), ("b", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    got = sorted((r["qid"], r["rank"], r["id"]) for r in neighbour_graph(df, 1).collect())
    assert got == [("a", 1, "a"), ("a", 1, "a"), ("b", 1, "a")]


def test_copies_in_many_cells_leave_in_bounded_batches(make_table, monkeypatch):
    """A batch whose rows all reach every cell is not multiplied into one larger batch."""
    v = np.random.default_rng(8).standard_normal((500, 16)).astype(np.float32)
    frame = make_table(v, list(range(500)))
    monkeypatch.setattr(cells, "SENT_BYTES", 8 * 16 * 50, raising=False)
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: run)
    batch = frame.toArrow().combine_chunks().to_batches()[0]
    run = cells.assign_cells(frame, unit_rows(v[:40], np.float32), radius=2.0)
    sizes = [b.num_rows for b in run(iter([batch]))]
    assert sum(sizes) == 500 * 40 and max(sizes) <= 50


def test_graph_by_pairs_of_blocks_is_exact(make_table, distances, monkeypatch):
    """Rows that reach many cells meet in blocks: copies, ties and a zero vector among them."""
    asked = []
    blocked = neighbours.block_graph
    monkeypatch.setattr(
        neighbours, "block_graph", lambda *args: asked.append(args[1]) or blocked(*args)
    )
    rng = np.random.default_rng(9)
    v = rng.integers(-1, 2, (900, 12)).astype(np.float32)
    v[:300] = rng.standard_normal((300, 12))
    v[300:320] = v[0]
    v[400] = 0
    d = np.round(distances(v), 11)
    graph = neighbour_graph(make_table(v, list(range(900))), 6, block_rows=50)
    got = {(r["qid"], r["rank"]): r["id"] for r in graph.collect()}
    for i in range(900):
        order = [j for j in np.lexsort((np.arange(900), d[i])) if j != i][:6]
        assert [got[i, r] for r in range(1, 7)] == order
    assert len(asked) == 1


def recall(graph, d, k):
    """Mean share of each row's list that is as near as its k nearest, and the list's size."""
    got = {}
    for r in graph.collect():
        got.setdefault(r["qid"], []).append(r["distance"])
    hits = [np.sum(np.array(x) <= np.sort(d[q])[k - 1] + 1e-6) / k for q, x in got.items()]
    return np.mean(hits), {len(x) for x in got.values()}, len(got)


def test_descent_finds_most(make_table, distances):
    """Clusters, a hub that is near all rows, and a tenth of copies, from small blocks."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 12))
    v = (centres[rng.integers(0, 20, 1200)] + 0.3 * rng.standard_normal((1200, 12)))
    v[:100] = v[0]
    v[200] = centres.mean(axis=0)
    v = v.astype(np.float32)
    d = np.round(distances(v), 9)
    np.fill_diagonal(d, np.inf)
    frame = make_table(v, list(range(1200)))
    graph = neighbour_graph(frame, 8, exact=False, start_rows=40)
    share, sizes, count = recall(graph, d, 8)
    assert share > 0.95 and sizes == {8} and count == 1200


def test_descent_mends_a_poor_start(make_table, distances):
    """Rows without any low-dimensional structure: rounds raise the recall of the start."""
    v = np.random.default_rng(5).standard_normal((900, 10)).astype(np.float32)
    d = np.round(distances(v), 9)
    np.fill_diagonal(d, np.inf)
    frame = make_table(v, list(range(900)))
    options = dict(exact=False, start_rows=20)
    before = recall(neighbour_graph(frame, 10, most_rounds=0, **options), d, 10)[0]
    after = recall(neighbour_graph(frame, 10, **options), d, 10)[0]
    assert before < 0.4 and after > 0.9


def test_descent_in_one_block_is_exact(make_table):
    v = np.random.default_rng(6).standard_normal((70, 6)).astype(np.float32)
    frame = make_table(v, list(range(70)))
    rows = lambda g: sorted((r["qid"], r["rank"], r["id"], round(r["distance"], 9)) for r in g.collect())
    assert rows(neighbour_graph(frame, 5, exact=False)) == rows(neighbour_graph(frame, 5))
    assert neighbour_graph(frame.limit(1), 5, exact=False).count() == 0
    assert neighbour_graph(frame.limit(3), 5, exact=False).count() == 6
    assert neighbour_graph(frame.limit(0), 5, exact=False).count() == 0


def test_descent_starts_from_large_blocks(make_table, distances):
    """Large blocks alone find what small ones leave to many rounds, in few large partitions."""
    v = np.random.default_rng(7).standard_normal((2_500, 24)).astype(np.float32)
    d = np.round(distances(v), 9)
    np.fill_diagonal(d, np.inf)
    frame = make_table(v, list(range(2_500)))
    share, sizes, count = recall(neighbour_graph(frame, 10, exact=False, most_rounds=0), d, 10)
    assert share == 1 and sizes == {10} and count == 2_500
    cut = neighbour_graph(frame, 10, exact=False, start_rows=900, most_rounds=0)
    assert 0.4 < recall(cut, d, 10)[0] < 1
