import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators.quantize import from_half, quantize_table
from vecloom.plans.engine import VectorEngine
from vecloom.functions.encoders import hashed_words
from vecloom.sources import commits, tables


def facts(frame):
    return frame.select(
        "*",
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
        F.lit(1000).cast("long").alias("file_size"),
        F.lit(1.5).alias("file_mtime"),
    )


def test_append_keeps_repeated_ids(spark, make_table, random_vectors, tmp_path):
    path = str(tmp_path / "t")
    frame = make_table(random_vectors(10, 4))
    tables.append_vectors(frame, path)
    tables.append_vectors(frame, path)
    stored = tables.read_table(spark, path)
    assert stored.count() == 20 and stored.select("row_key").distinct().count() == 20


def test_target_without_metadata_drops_it(spark, make_table, random_vectors, tmp_path):
    path = str(tmp_path / "t")
    frame = make_table(random_vectors(3, 4))
    tables.append_vectors(frame, path)
    tables.append_vectors(facts(frame), path)
    assert not tables.has_metadata(tables.read_table(spark, path))
    assert tables.read_table(spark, path).count() == 6


def test_target_with_metadata_wants_it(spark, make_table, random_vectors, tmp_path):
    path = str(tmp_path / "t")
    frame = make_table(random_vectors(3, 4))
    tables.append_vectors(facts(frame), path)
    assert tables.has_metadata(tables.read_table(spark, path))
    with pytest.raises(ValueError, match="width"):
        tables.append_vectors(frame, path)
    with pytest.raises(ValueError, match="file_size"):
        tables.append_vectors(facts(frame).withColumn("file_size", F.lit("x")), path)


def test_stats(spark, make_table, random_vectors, tmp_path):
    tables.append_vectors(make_table(random_vectors(7, 4)), str(tmp_path / "t"))
    assert tables.table_stats(spark, str(tmp_path / "t")).first()["row_count"] == 7
    missing = tables.table_stats(spark, str(tmp_path / "nonexistent")).first()
    assert missing["row_count"] is None and "nonexistent" in missing["error"]


def test_quantize(spark, make_table, random_vectors, tmp_path):
    path = str(tmp_path / "t")
    v = random_vectors(50, 32)
    tables.append_vectors(facts(make_table(v)), path)
    report = quantize_table(spark, path).first()
    assert report["rows"] == 50 and report["dtype_after"] == "float16"
    assert report["bytes_after"] < report["bytes_before"]
    stored = tables.read_table(spark, path)
    assert set(tables.METADATA) <= set(stored.columns)
    back = {r["id"]: r["vector"] for r in from_half(stored).collect()}
    for i, row in enumerate(v):
        assert np.array_equal(np.array(back[f"/img_{i:05d}.jpg"]), row.astype(np.float16))
    assert not list(tmp_path.glob("*__*"))


def test_quantize_keeps_nulls_and_runs_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, [0.5, -1.0, 3.25, 0.0]), (2, None), (3, [1.0, 2.0, 3.0, 4.0]), (4, None)]
    spark.createDataFrame(rows, "id long, vector array<float>").coalesce(1).write.parquet(path)
    for kind in ("float32", "float16"):
        report = quantize_table(spark, path).first()
        assert (report["rows"], report["dtype_before"]) == (4, kind)
        assert {r["id"]: r["vector"] for r in from_half(tables.read_table(spark, path)).collect()} == dict(rows)


@pytest.mark.parametrize("odd", [[1.0, 2.0], [1.0, 2.0, 3.0, None]])
def test_quantize_refuses_odd_vectors(spark, tmp_path, odd):
    path = str(tmp_path / "t")
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, odd), (3, [1.0, 2.0, 3.0, 4.0])]
    spark.createDataFrame(rows, "id long, vector array<float>").coalesce(1).write.parquet(path)
    with pytest.raises(Exception, match="same dimension|null components"):
        quantize_table(spark, path)
    assert tables.read_table(spark, path).count() == 3


def test_appends_that_meet_are_both_kept(spark, make_table, random_vectors, tmp_path, monkeypatch):
    """Another append, and a change of the columns, come in before the commit."""
    path = str(tmp_path / "t")
    tables.append_vectors(make_table(random_vectors(5, 4)), path)
    publish, others = commits.publish, [
        lambda: tables.append_vectors(make_table(random_vectors(3, 4)), path),
        lambda: quantize_table(spark, path),
    ]

    def slow(session, folder, number, content):
        if others:
            others.pop(0)()
        return publish(session, folder, number, content)

    monkeypatch.setattr(commits, "publish", slow)
    tables.append_vectors(make_table(random_vectors(2, 4)), path)
    stored = tables.read_table(spark, path)
    assert stored.count() == 10 and dict(stored.dtypes)["vector"] == "binary"
    assert len(from_half(stored).collect()) == 10


def test_rows_appended_during_a_rewrite_are_kept(
    spark, make_table, random_vectors, tmp_path, monkeypatch
):
    path = str(tmp_path / "t")
    tables.append_vectors(make_table(random_vectors(5, 4)), path)
    before = tables.read_table(spark, path)
    publish, others = commits.publish, [2, 3]

    def slow(session, folder, number, content):
        if others:
            n = others.pop()
            monkeypatch.setattr(commits, "publish", publish)
            tables.append_vectors(make_table(random_vectors(n, 4)), path)
            monkeypatch.setattr(commits, "publish", slow)
        return publish(session, folder, number, content)

    monkeypatch.setattr(commits, "publish", slow)
    assert quantize_table(spark, path).first()["rows"] == 10
    stored = from_half(tables.read_table(spark, path))
    assert stored.count() == 10 and stored.select("row_key").distinct().count() == 10
    # A frame of an earlier version reads that version.
    assert before.count() == 5 and dict(before.dtypes)["vector"] == "array<float>"


def test_rewrites_that_meet_start_again(spark, make_table, random_vectors, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.append_vectors(make_table(random_vectors(5, 4)), path)
    publish, others = commits.publish, [1]

    def raised(df):
        return df.withColumn("id", F.concat("id", F.lit("+")))

    def slow(session, folder, number, content):
        if others:
            others.pop()
            tables.rewrite_table(spark, path, raised)
        return publish(session, folder, number, content)

    monkeypatch.setattr(commits, "publish", slow)
    tables.rewrite_table(spark, path, raised)
    ids = {r["id"] for r in tables.read_table(spark, path).collect()}
    assert ids == {f"/img_{i:05d}.jpg++" for i in range(5)}


class Cut(Exception):
    pass


@pytest.mark.parametrize("step", ["write_batch", "read_batches", "commit"])
def test_a_writer_cut_off_changes_nothing(
    spark, make_table, random_vectors, tmp_path, monkeypatch, step
):
    """Cut before the copy, before it is counted, and between its files and the commit."""
    path = str(tmp_path / "t")
    tables.append_vectors(make_table(random_vectors(6, 4)), path)
    real = getattr(tables, step)

    def cut(*args, **more):
        if step == "write_batch":
            real(*args, **more)
        if step == "read_batches" and args[2] == list(tables.current(spark, path).batches):
            return real(*args, **more)
        raise Cut

    monkeypatch.setattr(tables, step, cut)
    with pytest.raises(Cut):
        quantize_table(spark, path)
    if step != "read_batches":
        with pytest.raises(Cut):
            tables.append_vectors(make_table(random_vectors(2, 4)), path)
    monkeypatch.undo()
    stored = tables.read_table(spark, path)
    assert stored.count() == 6 and dict(stored.dtypes)["vector"] == "array<float>"
    assert tables.table_stats(spark, path).first()["row_count"] == 6
    tables.append_vectors(make_table(random_vectors(2, 4)), path)
    assert tables.read_table(spark, path).count() == 8
    left = {p.name[6:] for p in (tmp_path / "t").glob("batch=*")} - set(
        tables.current(spark, path).batches
    )
    assert left and set(tables.remove_unused(spark, path, -60)) == left
    assert tables.read_table(spark, path).count() == 8


def test_first_writer_cut_off_makes_no_table(spark, make_table, random_vectors, tmp_path, monkeypatch):
    path = str(tmp_path / "t")

    def cut(*args):
        raise Cut

    monkeypatch.setattr(tables, "commit", cut)
    with pytest.raises(Cut):
        tables.append_vectors(make_table(random_vectors(2, 4)), path)
    monkeypatch.undo()
    assert not tables.table_exists(spark, path)
    assert tables.table_stats(spark, path).first()["error"]
    tables.append_vectors(make_table(random_vectors(3, 4)), path)
    assert tables.read_table(spark, path).count() == 3


def test_a_number_is_given_once(spark, tmp_path):
    path = str(tmp_path / "c")
    assert commits.latest(spark, path) is None
    assert commits.publish(spark, path, 0, {"a": 1})
    assert not commits.publish(spark, path, 0, {"a": 2})
    assert commits.publish(spark, path, 1, {"a": 3})
    assert commits.latest(spark, path) == (1, {"a": 3})
    assert len(list((tmp_path / "c" / "_commits").glob("*.json"))) == 2
    assert commits.read_commit(spark, path, 0) == {"a": 1}


def test_replace_refuses_a_changed_table(spark, make_table, random_vectors, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    frame = make_table(random_vectors(4, 4))
    tables.append_vectors(frame, path)
    assert tables.replace_table(tables.read_table(spark, path), path) == 4
    publish = commits.publish

    def slow(session, folder, number, content):
        monkeypatch.setattr(commits, "publish", publish)
        tables.append_vectors(frame, path)
        return publish(session, folder, number, content)

    monkeypatch.setattr(commits, "publish", slow)
    with pytest.raises(OSError, match="another writer"):
        tables.replace_table(tables.read_table(spark, path), path)
    assert tables.read_table(spark, path).count() == 8


def test_plain_files_are_a_table(spark, make_table, random_vectors, tmp_path):
    path = str(tmp_path / "t")
    make_table(random_vectors(4, 4)).write.parquet(path)
    tables.append_vectors(make_table(random_vectors(3, 4)), path)
    assert tables.read_table(spark, path).count() == 7
    assert quantize_table(spark, path).first()["rows"] == 7
    assert from_half(tables.read_table(spark, path)).count() == 7


def test_failed_replace_keeps_the_table(spark, make_table, random_vectors, tmp_path):
    path = str(tmp_path / "t")
    tables.append_vectors(make_table(random_vectors(9, 4)), path)
    with pytest.raises(ValueError, match="staged copy"):
        tables.replace_table(tables.read_table(spark, path).limit(4), path)
    assert tables.read_table(spark, path).count() == 9


def test_json_and_export(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "class_name string, n int")
    tables.write_json(frame, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    tables.export_by_class(frame, str(tmp_path / "e"))
    assert {p.name for p in (tmp_path / "e").glob("class_name=*")} == {
        "class_name=a", "class_name=b",
    }


def test_engine(spark, make_table, random_vectors, tmp_path):
    engine = VectorEngine(spark, str(tmp_path), text_encoder=hashed_words(16))
    v = random_vectors(40, 16)
    v[9] = v[8]
    assert engine.table_stats().first()["error"]
    engine.append(facts(make_table(v)))
    assert engine.table_stats().first()["row_count"] == 40
    assert engine.filter_columns() == tables.METADATA
    assert engine.search(v[4], 3, where="width > 100").first()["id"] == "/img_00004.jpg"
    assert engine.search("some words", 2).count() == 2
    pair = engine.find_duplicates(0.0001).select("id_a", "id_b").first()
    assert tuple(pair) == ("/img_00008.jpg", "/img_00009.jpg")
    assert engine.find_duplicates(0.0001, exact=False).count() == 1
    engine.create_index(num_partitions=4)
    assert engine.search(v[4], 3, nprobe=4).first()["id"] == "/img_00004.jpg"
    assert engine.cluster(3, starts=1).count() == 40
    assert engine.reduce_dimensions("pca").count() == 40
    engine.quantize_table()
    assert engine.search(v[4], 3).first()["id"] == "/img_00004.jpg"
    later = random_vectors(1, 16, 77)
    engine.append(facts(make_table(later, ["/later.jpg"])))
    assert engine.search(later[0], 1, nprobe=4).first()["id"] == "/later.jpg"
    engine.append(facts(make_table(v)))
    assert engine.table_stats().first()["row_count"] == 81
    assert engine.cluster_stats(3, starts=1).first()["n_images"] == 81
    assert engine.preview(n=5).count() == 5
