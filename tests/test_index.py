import numpy as np
import pytest

from pyspark.sql import functions as F

from vecloom.functions.vectors import unit_rows
from vecloom.operators import ann, probing
from vecloom.operators.search import search_batch, search_topk
from vecloom.sources import commits


@pytest.fixture(scope="module")
def indexed(spark, make_table, random_vectors, tmp_path_factory):
    v = random_vectors(400, 16, 4, positive=False)
    v[:130] = v[0] + 0.01 * random_vectors(130, 16, 5, positive=False)  # a hot cell
    frame = make_table(v).selectExpr("*", "cast(substr(id, 6, 5) as int) AS width")
    path = str(tmp_path_factory.mktemp("ivf") / "index")
    ann.create_index(frame, path, num_partitions=12, num_sub_vectors=8)
    return frame, v, path


def test_all_cells_equal_the_exact_search(spark, indexed):
    frame, v, path = indexed
    for q in (3, 200, 399):
        exact = search_topk(frame, v[q], 10).collect()
        assert ann.search_index(spark, path, v[q], 10, nprobe=12, refine=None).collect() == exact


def test_recall_rises_with_probes(spark, indexed):
    frame, v, path = indexed
    recall = []
    for nprobe in (1, 4, 12):
        hits = 0
        for q in range(200, 205):
            exact = {r["id"] for r in search_topk(frame, v[q], 10).collect()}
            got = ann.search_index(spark, path, v[q], 10, nprobe=nprobe, refine=None)
            hits += len(exact & {r["id"] for r in got.collect()})
        recall.append(hits)
    assert recall[0] <= recall[1] <= recall[2] == 50


def test_codes_find_the_query_itself(spark, indexed):
    _, v, path = indexed
    best = ann.search_index(spark, path, v[250], 5, nprobe=12, refine=8).collect()
    assert best[0]["id"] == "/img_00250.jpg" and len(best) == 5


def test_filter_and_pruning(spark, indexed):
    _, v, path = indexed
    frame = ann.search_index(spark, path, v[250], 5, nprobe=2, where="width > 200", refine=None)
    assert all(int(r["id"][5:10]) > 200 for r in frame.collect())
    plan = frame._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan and "GreaterThan(width,200)" in plan


def test_shortlist_reads_no_vectors(spark, indexed):
    _, v, path = indexed
    index = ann.open_index(spark, path)
    plan = ann.shortlist(index.rows, index.model, v[0], 5, "id")._jdf.queryExecution().toString()
    scan = [line for line in plan.splitlines() if "ReadSchema" in line][-1]
    assert "vector" not in scan.split("ReadSchema")[1]


def code_errors(spark, frame, path):
    """Squared errors of the index's codes by row, worked out from its parts."""
    model = ann.open_index(spark, path).model
    rows = ann.encode_rows(frame, model).orderBy("id").collect()
    unit = unit_rows(np.array([r["vector"] for r in rows]))
    codes = np.array([list(r["codes"]) for r in rows])
    cells = np.array([r["cell"] for r in rows])
    back = model.centroids[cells] + ann.decoded(model.books, codes) @ model.turn.T
    own = ((unit - back) ** 2).sum(axis=1)
    assert np.allclose(own, [r["code_error"] for r in rows], atol=1e-5)
    return own


def test_codes_are_close(spark, indexed):
    frame, v, path = indexed
    assert np.sqrt(code_errors(spark, frame, path)).mean() < 0.1
    turn = ann.open_index(spark, path).model.turn
    assert np.allclose(turn @ turn.T, np.eye(16), atol=1e-9)


def test_rotation_and_residuals_lower_the_error(spark, make_table):
    """Groups of rows that vary along slanted directions: four bytes a row."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((12, 16)) * 3
    slant = np.linspace(1.5, 0.05, 16)[:, None] * np.linalg.qr(rng.standard_normal((16, 16)))[0].T
    x = base[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 16)) @ slant
    frame = make_table(x)
    centroids = ann.fit_cells(frame, 12)
    rest = ann.residuals(frame, centroids, "vector")
    plain = ann.fit_codes(rest, 4, rounds=8)
    turned = ann.fit_codes(rest, 4, rounds=16, rotate=True)
    whole = ann.fit_codes(ann.unit_vectors(frame, "vector"), 4, rounds=8)
    assert turned.error < 0.8 * plain.error and plain.error < 0.6 * whole.error
    assert np.allclose(turned.turn @ turned.turn.T, np.eye(16), atol=1e-9)


def test_sub_vectors_must_divide():
    assert ann.sub_vector_count(512) == 64
    assert ann.sub_vector_count(96) == 96
    with pytest.raises(ValueError, match="divide"):
        ann.sub_vector_count(512, 96)


def test_rows_added_later_are_found(spark, make_table, random_vectors, tmp_path):
    v = random_vectors(120, 8, 11, positive=False)
    frame = make_table(v).selectExpr("*", "id AS row_key")
    path = str(tmp_path / "index")
    ann.create_index(frame.where("id < '/img_00060'"), path, num_partitions=4, num_sub_vectors=4)
    for _ in range(2):
        ann.update_index(frame, path)
        assert ann.open_index(spark, path).rows.count() == 120
    exact = search_topk(frame, v[100], 6).collect()
    assert ann.search_index(spark, path, v[100], 6, nprobe=4, refine=None).collect() == exact


def test_copies_leave_code_books_full(spark, make_table):
    """Groups of a thousand copies, plain and rescaled, and a sub-space that few rows fill."""
    rng = np.random.default_rng(5)
    rare = rng.standard_normal((400, 8))
    hot = np.repeat(rng.standard_normal((4, 8)), 1_100, axis=0)
    hot *= rng.uniform(0.1, 9, (len(hot), 1))
    flat = rng.standard_normal((4_000, 8))
    flat[:, :4] = 0
    frame = make_table(np.concatenate([rare, hot, flat]))
    books = ann.codebook_matrix(ann.train_codebooks(frame, 2))
    assert np.isfinite(books[:, :, 0]).sum(axis=1).tolist() == [256, 256]
    few = make_table(np.concatenate([rare[:3], hot[:2_000]]))
    books = ann.codebook_matrix(ann.train_codebooks(few, 2))
    held = np.isfinite(books[:, :, 0]).sum(axis=1)
    assert (held >= 5).all() and (held < 40).all()
    codes = ann.pq_encode(few.limit(3), books).collect()
    assert len({bytes(r.codes) for r in codes}) == 3


def test_starts_do_not_depend_on_partitions(spark, make_table):
    frame = make_table(np.random.default_rng(6).standard_normal((3_000, 8)))
    unit = frame.select(ann.unit_column("vector").alias("v"))
    one = ann.start_centres(unit.coalesce(1), 2, 42)
    assert one.num_rows == 512 and one.equals(ann.start_centres(unit.repartition(7), 2, 42))


# -- Many queries ------------------------------------------------------------------------------


def asked(spark, v, places, repeat=False):
    rows = [(int(q), [float(x) for x in v[q]]) for q in places]
    return spark.createDataFrame(rows + rows[:1] * repeat, "qid long, qv array<float>")


def listed(frame):
    return sorted((r["qid"], r["rank"], r["id"], r["distance"]) for r in frame.collect())


@pytest.mark.parametrize("block_rows", [4096, 30])
def test_batch_over_all_cells_equals_the_exact_search(spark, indexed, block_rows):
    frame, v, path = indexed
    queries = asked(spark, v, [0, 3, 77, 200, 399], repeat=True)
    exact = listed(search_batch(frame, queries, 7))
    got = probing.search_index_batch(
        spark, path, queries, 7, nprobe=12, refine=None, block_rows=block_rows
    )
    assert listed(got) == exact


def test_batch_recall_of_the_short_list(spark, indexed):
    frame, v, path = indexed
    queries = asked(spark, v, range(130, 400, 9))
    exact = {(q, i) for q, _, i, _ in listed(search_batch(frame, queries, 10))}
    got = probing.search_index_batch(spark, path, queries, 10, nprobe=12, refine=4).collect()
    assert len(got) == len(exact)
    assert len({(r["qid"], r["id"]) for r in got} & exact) >= 0.95 * len(exact)


def test_filter_that_few_rows_pass(spark, indexed):
    """A query gets k rows whenever k match, and all that match if they are fewer."""
    frame, v, path = indexed
    queries = asked(spark, v, [5, 200, 333])
    for where, k, count, refine in (
        ("width % 100 = 7", 3, 3, 10), ("width = 250", 3, 1, None), ("width < 0", 3, 0, 10),
    ):
        got = probing.search_index_batch(spark, path, queries, k, 1, where, refine)
        assert len(listed(got)) == 3 * count
        assert ann.search_index(spark, path, v[333], k, 1, where, refine).count() == count
    exact = listed(search_batch(frame, queries, 10, where="width % 100 = 7"))
    got = probing.search_index_batch(spark, path, queries, 10, 1, "width % 100 = 7")
    assert listed(got) == exact and len(exact) == 12


def test_probed_cells_only(spark, indexed):
    _, v, path = indexed
    index = ann.open_index(spark, path)
    placed = probing.probes(
        asked(spark, v, [250, 251]).selectExpr("qid AS key", "qv AS vector"), index, 0, 2
    )
    cells = [r["cell"] for r in placed.select("cell").distinct().collect()]
    assert placed.count() == 4
    rows = index.rows.where(F.col("cell").isin(cells)).select("cell", "batch", "row", "id", "codes")
    plan = probing.probe_join(placed, rows, index, 5, False, 4096)._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("PartitionFilters: [" in x and "cell" in x for x in scans)
    assert all("vector" not in x.split("ReadSchema")[1] for x in scans)


def test_odd_queries(spark, indexed):
    _, v, path = indexed
    rows = [(1, None), (None, [1.0] * 16), (2, [0.0] * 16)]
    queries = spark.createDataFrame(rows, "qid long, qv array<float>")
    got = probing.search_index_batch(spark, path, queries, 2, nprobe=3).collect()
    assert sorted((r["qid"] or 0, r["rank"]) for r in got) == [(0, 1), (0, 2), (2, 1), (2, 2)]
    assert {r["distance"] for r in got if r["qid"] == 2} == {1.0}
    assert probing.search_index_batch(spark, path, queries.limit(0), 2).count() == 0


# -- Versions ----------------------------------------------------------------------------------


class Cut(Exception):
    pass


def test_a_rebuild_that_is_cut_off_changes_nothing(
    spark, make_table, random_vectors, tmp_path, monkeypatch
):
    path = str(tmp_path / "index")
    v = random_vectors(150, 8, 3, positive=False)
    frame = make_table(v).selectExpr("*", "id AS row_key")
    ann.create_index(frame, path, num_partitions=5, num_sub_vectors=4)
    before = ann.search_index(spark, path, v[9], 5, nprobe=5).collect()
    reader = ann.open_index(spark, path)
    other = make_table(-v).selectExpr("*", "id AS row_key")

    def cut(*args, **more):
        raise Cut

    for module, name in ((ann, "write_rows"), (commits, "publish")):
        with monkeypatch.context() as patch:
            patch.setattr(module, name, cut)
            with pytest.raises(Cut):
                ann.create_index(other, path, num_partitions=3, num_sub_vectors=4)
        assert ann.search_index(spark, path, v[9], 5, nprobe=5).collect() == before
    ann.create_index(other, path, num_partitions=3, num_sub_vectors=4)
    assert len(ann.open_index(spark, path).model.centroids) == 3
    assert ann.search_index(spark, path, -v[9], 1, nprobe=3).first()["id"] == "/img_00009.jpg"
    # A search that began before reads its own build to the end.
    assert reader.rows.count() == 150 and len(reader.model.centroids) == 5


def test_updates_that_meet_add_no_row_twice(
    spark, make_table, random_vectors, tmp_path, monkeypatch
):
    path = str(tmp_path / "index")
    frame = make_table(random_vectors(90, 8, 3)).selectExpr("*", "id AS row_key")
    ann.create_index(frame.where("id < '/img_00050'"), path, num_partitions=4, num_sub_vectors=4)
    publish, others = commits.publish, [1]

    def slow(session, folder, number, content):
        if others:
            others.pop()
            ann.update_index(frame.where("id < '/img_00070'"), path)
        return publish(session, folder, number, content)

    monkeypatch.setattr(commits, "publish", slow)
    ann.update_index(frame, path)
    index = ann.open_index(spark, path)
    assert index.rows.count() == 90 and index.rows.select("id").distinct().count() == 90
    report = ann.index_report(spark, path).orderBy("batch").collect()
    assert [r["rows"] for r in report] == [50, 20, 20]
    assert all(0 <= r["error"] < 0.5 and r["fitted_error"] >= 0 for r in report)
