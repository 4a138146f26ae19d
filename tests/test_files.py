import struct
import zlib

import pytest
from pyarrow import fs

from vecloom.functions.encoders import hashed_bytes
from vecloom.plans.engine import VectorEngine
from vecloom.plans.ingest import index_files
from vecloom.sources import files
from vecloom.sources.files import (
    Directories,
    FileTreeReader,
    entries,
    header_size,
    image_metadata,
    list_images,
    split_tree,
    tree_usage,
)
from vecloom.sources.tables import read_table
from vecloom.streaming.ingest import retry_rejects, stream_ingest


def png(width, height, shade=0):
    def chunk(kind, body):
        return (
            struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        )

    rows = b"".join(b"\0" + bytes([shade]) * width for _ in range(height))
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(rows))
        + chunk(b"IEND", b"")
    )


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "images"
    (root / "sub dir").mkdir(parents=True)
    (root / "a.png").write_bytes(png(4, 3))
    (root / "b.PNG").write_bytes(png(7, 2, 9))
    (root / "sub dir" / "c+é.png").write_bytes(png(5, 5, 200))
    (root / "broken.jpg").write_bytes(b"\xff\xd8 not an image")
    (root / "empty.jpeg").touch()
    (root / "notes.txt").write_text("x")
    (root / ".png").touch()
    return root


def test_listing(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"img_{i}.jpg").touch()
    (tmp_path / "readme.txt").touch()
    (tmp_path / "subdir").mkdir()
    for i in range(5):
        (tmp_path / "subdir" / f"sub_{i}.png").touch()
    rows = list_images(spark, str(tmp_path)).collect()
    assert len(rows) == 15 and {r["file_size"] for r in rows} == {0}
    assert not any(r["id"].endswith(".txt") for r in rows)
    assert list_images(spark, str(tmp_path), [".txt"]).count() == 1
    with pytest.raises(FileNotFoundError):
        list_images(spark, str(tmp_path / "missing"))


def test_many_directories(spark, tmp_path):
    for i in range(40):
        deep = tmp_path / f"d{i % 8}" / f"e{i}"
        deep.mkdir(parents=True)
        (deep / "x.gif").touch()
    assert len(split_tree(str(tmp_path), 16)) > 8
    assert list_images(spark, str(tmp_path)).count() == 40


def test_metadata_and_rejects(spark, tree):
    rows = {r["id"].rsplit("/", 1)[1]: r for r in image_metadata(spark, str(tree)).collect()}
    assert set(rows) == {"a.png", "b.PNG", "c+é.png", "broken.jpg", "empty.jpeg"}
    assert (rows["a.png"]["width"], rows["a.png"]["height"]) == (4, 3)
    assert rows["c+é.png"]["file_size"] == len(png(5, 5, 200))
    assert rows["a.png"]["file_mtime"] == pytest.approx((tree / "a.png").stat().st_mtime)
    assert rows["broken.jpg"]["error"] and rows["empty.jpeg"]["error"]


def test_a_uri_and_a_mount_give_the_same_rows(spark, tree):
    """The root as a path and as a URI, and a store that is not the local one."""
    facts = lambda f: sorted((r["id"], r["file_size"], r["file_mtime"], r["error"]) for r in f.collect())
    plain = facts(list_images(spark, str(tree)))
    assert plain == facts(list_images(spark, f"file://{tree}")) and len(plain) == 5
    assert any(size == 0 for _, size, _, _ in plain)
    store = fs.SubTreeFileSystem(str(tree), fs.LocalFileSystem())
    folders, files, error = entries(store, "")
    assert error is None and {p for p, *_ in files} == {p.name for p in tree.iterdir() if p.is_file()}
    assert set(folders) == {p.name for p in tree.iterdir() if p.is_dir()}


def test_a_folder_that_cannot_be_read_is_a_row(tree, tmp_path):
    reader = FileTreeReader(str(tree), 4)
    gone = str(tmp_path / "gone")
    rows = [r for b in reader.read(Directories([gone, str(tree)], True)) for r in b.to_pylist()]
    bad = [r for r in rows if r["error"]]
    assert [(r["id"], r["file_size"]) for r in bad] == [(gone, -1)] and len(rows) > 5
    (tree / "loop").symlink_to(tree)
    (tree / "dangling.png").symlink_to(tmp_path / "nothing")
    rows = [r for b in reader.read(Directories([str(tree)], True)) for r in b.to_pylist()]
    assert {r["file_size"] for r in rows if r["id"].endswith("dangling.png")} == {-1}
    assert not any("loop" in r["id"] for r in rows)


def test_an_unreadable_folder_counts_as_an_error(spark, tree, tmp_path, monkeypatch):
    listing = spark.createDataFrame(
        [(str(tree / "gone"), -1, None, "PermissionError: gone")], files.LISTING_SCHEMA
    )
    whole = list_images(spark, str(tree)).unionByName(listing)
    monkeypatch.setattr("vecloom.plans.ingest.list_images", lambda *_: whole)
    row = index_files(spark, str(tree), str(tmp_path / "v"), hashed_bytes(16), 2).first()
    assert (row["total_indexed"], row["total_errors"]) == (3, 3)


def test_headers():
    gif = b"GIF89a" + struct.pack("<HH", 11, 12) + b"\0" * 8
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -20) + b"\0" * 8
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    jpeg = b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HH", 21, 34) + b"\0" * 10 + b"\xff\xd9"
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 15, 0)
    tiff += struct.pack("<HHII", 257, 4, 1, 16)
    assert header_size(gif) == (11, 12)
    assert header_size(bmp) == (30, 20)
    assert header_size(webp) == (100, 50)
    assert header_size(jpeg) == (34, 21)
    assert header_size(tiff) == (15, 16)
    with pytest.raises(ValueError):
        header_size(png(3, 3)[:-6])


def test_usage(spark, tree):
    row = tree_usage(spark, str(tree)).first()
    assert row["files"] == 5
    total = sum(p.stat().st_size for p in tree.rglob("*") if p.is_file())
    assert row["size_mb"] == pytest.approx(total / 2**20)


def test_ingest_and_increment(spark, tree, tmp_path):
    table = str(tmp_path / "vectors")
    run = lambda **kw: tuple(index_files(spark, str(tree), table, hashed_bytes(16), 2, **kw).first())
    assert run() == (3, 2, 2, 0)
    stored = read_table(spark, table)
    assert stored.count() == 3
    norms = stored.selectExpr("aggregate(vector, 0D, (s, x) -> s + x * x) AS n").collect()
    assert all(r["n"] == pytest.approx(1, abs=1e-5) for r in norms)
    (tree / "new.png").write_bytes(png(2, 2))
    assert run() == (1, 2, 1, 3)
    assert run(incremental=False) == (4, 2, 2, 0)
    assert read_table(spark, table).count() == 8


def test_search_by_image(spark, tree, tmp_path):
    engine = VectorEngine(spark, str(tmp_path / "db"), image_encoder=hashed_bytes(16))
    assert engine.index(str(tree)).first()["total_indexed"] == 3
    best = engine.search(str(tree / "b.PNG"), 1, where="width = 7 OR height = 5").first()
    assert best["id"] == str(tree / "b.PNG") and best["distance"] == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError, match="encoder"):
        engine.search("words without a text encoder")


def test_nothing_readable_creates_no_table(spark, tmp_path):
    root = tmp_path / "images"
    root.mkdir()
    (root / "x.jpg").touch()
    row = index_files(spark, str(root), str(tmp_path / "t"), hashed_bytes(4)).first()
    assert tuple(row) == (0, 1, 0, 0)
    assert not (tmp_path / "t").exists()


def test_stream(spark, tree, tmp_path):
    table, rejects, state = (str(tmp_path / n) for n in ("vectors", "rejects", "state"))

    def run():
        stream_ingest(spark, str(tree), table, rejects, state, hashed_bytes(16)).awaitTermination()

    run()
    first = read_table(spark, table)
    assert first.count() == 3
    assert {r["width"] for r in first.collect()} == {4, 7, 5}
    (tree / "late.png").write_bytes(png(6, 6))
    run()
    assert read_table(spark, table).count() == 4
    assert read_table(spark, table).select("id").distinct().count() == 4
    broken = {str(tree / "broken.jpg"), str(tree / "empty.jpeg")}
    assert sorted(r["id"] for r in spark.read.parquet(rejects).collect()) == sorted(broken)
    (tree / "broken.jpg").write_bytes(png(8, 8))
    assert retry_rejects(spark, rejects, table, hashed_bytes(16)) == 1
    assert retry_rejects(spark, rejects, table, hashed_bytes(16)) == 0
    assert read_table(spark, table).count() == 5
    stored = {r["id"]: r["file_size"] for r in read_table(spark, table).collect()}
    assert stored[str(tree / "broken.jpg")] == len(png(8, 8))
