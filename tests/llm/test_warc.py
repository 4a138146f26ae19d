"""WARC packages: round trips, damaged and foreign files, and the rows of the query."""

import base64
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vecloom.llm import warc
from vecloom.session import scratch_path

SF = "/root/testdata/sf0.01"


def plain(rows, min_bytes=0):
    groups = {}
    for page_id, html in rows:
        data = (html or "").encode()
        groups.setdefault(data, []).append(page_id)
    out = []
    for data, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            first = min(known) if known and len(data) >= min_bytes else None
            revisit = first is not None and i != first
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            kind = "revisit" if revisit else "response"
            out.append((i, len(data), digest, kind, first if revisit else None))
    return sorted(out, key=repr)


def trip(df, **options):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in warc.round_trip(df, **options).select(*names).collect()), key=repr)


def test_given_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    assert trip(df) == plain([(r.page_id, r.html) for r in df.collect()])
    back = {r.page_id: r for r in warc.round_trip(df).collect()}
    for r in df.collect():
        assert back[r.page_id].url == r.url
        assert back[r.page_id].payload.decode() == r.html


def test_odd_rows(spark):
    rows = [
        (5, "http://a/?x=1%20y\r\nz", "same"), (3, "u", "same"), (9, None, "same"), (3, "u", "same"),
        (None, "n", "same"), (1, "", None), (2, "e", ""), (None, "lone", "only null"),
        (None, "lone", "only null"), (7, "h", "\r\n\r\nWARC/1.1\r\n"), (8, "big", "é" * 300_000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(0))
    bare = [(i, h) for i, _, h in rows]
    assert trip(df) == plain(bare)
    assert trip(df, min_bytes=5) == plain(bare, 5)
    urls = {r.url for r in warc.round_trip(df).collect()}
    assert urls == {u or "" for _, u, _ in rows}
    assert trip(df.filter("page_id = -1")) == []


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files_and_ranges_split(spark, zip64):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    made = warc.write_packages(
        warc.classify(df), scratch_path(spark, "warc"), package_bytes=50_000, zip64=zip64
    )
    assert made.count() > 1
    back = warc.read_packages(made, range_records=3)
    assert back.count() == df.count() == made.agg(F.sum("records")).first()[0]
    for r in made.collect():
        system, path = warc.open_at(r.uri)
        with zipfile.ZipFile(path) as z:
            assert z.namelist() == [warc.RECORDS, warc.INDEX] and z.testzip() is None
            assert len(z.read(warc.INDEX).splitlines()) == r.records
        with system.open_input_file(path) as source:
            members = warc.central_directory(source, source.size())
            start = warc.stored_start(source, members[warc.RECORDS])
            assert warc.read_range(source, start, 2) == b"\x1f\x8b"


class Wide(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_zip64_directory(monkeypatch):
    """A directory whose counts and offsets all stand in the ZIP64 records."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    source = Wide()
    with zipfile.ZipFile(source, "w", zipfile.ZIP_STORED) as z:
        for i in range(4):
            with z.open(f"member{i}", "w", force_zip64=True) as m:
                m.write(bytes([65 + i]) * 50)
    members = warc.central_directory(source, source.size())
    assert list(members) == [f"member{i}" for i in range(4)]
    for i, m in enumerate(members.values()):
        assert m["size"] == 50
        assert warc.read_range(source, warc.stored_start(source, m), 50) == bytes([65 + i]) * 50


def test_archive_comment_and_damage():
    source = Wide()
    with zipfile.ZipFile(source, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", "a" * 1000)
        z.comment = b"a comment with PK\x05\x06 inside"
    members = warc.central_directory(source, source.size())
    with pytest.raises(ValueError, match="stored"):
        warc.stored_start(source, members["packed"])
    with pytest.raises(ValueError, match="no end"):
        cut = Wide(source.getvalue()[:-5])
        warc.central_directory(cut, cut.size())
    with pytest.raises(ValueError):
        warc.parse_record(__import__("gzip").compress(b"HTTP/1.1 200\r\n\r\n"))


def archive(ids, lines, name):
    """Bytes of an archive and index lines of its records."""
    data, out = b"", []
    for i in ids:
        payload = f"page {i}".encode()
        record = warc.make_record(i, f"u{i}", payload, warc.digest_of(payload), None)
        out.append(json.dumps({"offset": len(data), "length": len(record)} | ({"filename": name} if lines else {})))
        data += record
    return data, "\n".join(out)


def test_members_are_found_in_the_directory(spark, tmp_path):
    """Two archives and two indexes under other names, one archive without an index, one
    package with a single unnamed archive, and one without records."""
    first, one = archive(range(0, 7), True, "a.warc.gz")
    second, two = archive(range(7, 12), True, "deep/b.warc.gz")
    third, _ = archive(range(12, 400), True, "c.warc.gz")
    fourth, four = archive(range(400, 403), False, "")
    packages = {
        "many": [("archive/a.warc.gz", first), ("archive/deep/b.warc.gz", second), ("archive/c.warc.gz", third),
                 ("indexes/x.jsonl", one), ("indexes/y.jsonl", two + "\n\n"), ("datapackage.json", b"{}"), ("archive/", b"")],
        "single": [("archive/only.warc.gz", fourth), ("indexes/own.cdxj", four)],
        "none": [("pages/pages.jsonl", b"{}")],
    }
    for name, members in packages.items():
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_STORED) as z:
            for member, data in members:
                z.writestr(member, data)
    uris = spark.createDataFrame([(str(tmp_path / n),) for n in packages], "uri string")
    back = warc.read_packages(uris, range_records=3).collect()
    assert sorted(r.page_id for r in back) == list(range(403))
    assert all(bytes(r.payload) == f"page {r.page_id}".encode() for r in back)


@pytest.mark.parametrize("damage", ["missing", "beyond", "deflated", "cut"])
def test_damaged_packages_are_errors(tmp_path, damage):
    data, lines = archive(range(4), True, "a.warc.gz")
    if damage == "missing":
        lines = lines.replace("a.warc.gz", "b.warc.gz")
    if damage == "beyond":
        lines = lines.replace('"offset": 0', '"offset": 100000')
    if damage == "cut":
        data, lines = data[:-9], ""
    path = str(tmp_path / "p")
    kind = zipfile.ZIP_DEFLATED if damage == "deflated" else zipfile.ZIP_STORED
    with zipfile.ZipFile(path, "w", kind) as z:
        z.writestr("archive/a.warc.gz", data * (50 if damage == "deflated" else 1))
        z.writestr("indexes/a.jsonl", lines)
    with pytest.raises(ValueError):
        for place in warc.record_ranges(path, 2):
            list(warc.read_records(path, *place))
