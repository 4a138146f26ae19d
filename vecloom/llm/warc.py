"""WARC records in ZIP packages: writing them, and reading records by range.

A package is a ZIP file with two stored (uncompressed) members: the records, each a gzip
member of its own, and an index with one JSON line a record (offset, length, target).
Reading parses the end-of-directory record, the ZIP64 record where there is one and the central
directory, which tells the members: every one below ``archive/`` holds records, every one below
``indexes/`` says where records lie, by the ``filename`` of their archive. From then on ranges of the
package are read, first of the indexes, then of the archives, without extracting anything. An archive
that no index names is read from end to end.

Packages are opened through Arrow's file systems by URI, so the shared folder may be a local
mount or an object store. A task writes to names of its own attempt, and only the packages
named in the written manifest count, so a lost or repeated task leaves no trace in results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.texts import pieces
from vecloom.session import materialise, scratch_path

ARCHIVES, INDEXES = "archive/", "indexes/"
# What the writer calls its members.
RECORDS = f"{ARCHIVES}records.warc.gz"
INDEX = f"{INDEXES}records.jsonl"
# Payload bytes of a package, and records that one task reads of it.
PACKAGE_BYTES = 64 << 20
RANGE_RECORDS = 2000
# Bytes that one range read may span.
RANGE_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def open_at(uri: str):
    """File system and path of a URI or an absolute local path."""
    uri = uri if "://" in uri else uri.replace("file:", "", 1)
    return files.FileSystem.from_uri(uri)


# -- Records -------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def header_value(text: str | None) -> str:
    """A value that fits in one header line; percent signs keep what does not."""
    text = text or ""
    return "".join(f"%{ord(c):02X}" if c in "\r\n%" else c for c in text)


def make_record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """A response, or a revisit of page ``first``, as one gzip member."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    body = http if first is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return gzip.compress(head + body + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member."""
    return record_of(zlib.decompress(member, wbits=31))


def record_of(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return {
        "headers": headers,
        "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]),
        "payload": payload,
    }


# -- Packages ------------------------------------------------------------------------------


class PackageWriter:
    """A package under way: records go straight into its first member."""

    def __init__(self, uri: str, zip64: bool = False):
        self.uri, self.zip64 = uri, zip64
        system, path = open_at(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        # The size is not known yet, so the member is written in the ZIP64 form.
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.lines: list[str] = []
        self.offset = self.payload_bytes = 0

    def add(self, page_id, url, payload: bytes, digest: str, first) -> None:
        record = make_record(page_id, url, payload, digest, first)
        name = RECORDS.removeprefix(ARCHIVES)
        entry = {"offset": self.offset, "length": len(record), "url": url, "filename": name}
        self.lines.append(json.dumps(entry))
        self.member.write(record)
        self.offset += len(record)
        self.payload_bytes += len(payload)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=self.zip64) as index:
            index.write("".join(f"{line}\n" for line in self.lines).encode())
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines)


def read_range(source, start: int, length: int) -> bytes:
    source.seek(start)
    found = source.read(length)
    if len(found) != length:
        raise ValueError("the package is cut short")
    return found


def directory_place(source, size: int) -> tuple[int, int, int]:
    """(start, length, entries) of the central directory, from the end of the file."""
    tail_size = min(size, 22 + 65535)
    tail = read_range(source, size - tail_size, tail_size)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != tail_size:
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    entries, length, start = struct.unpack("<H2I", tail[at + 10 : at + 20])
    if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read_range(source, size - tail_size + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        wide = read_range(source, struct.unpack("<Q", locator[8:16])[0], 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of a central directory")
        entries, length, start = struct.unpack("<3Q", wide[32:56])
    return start, length, entries


def central_directory(source, size: int) -> dict[str, dict]:
    """Members by name: method, size, compressed size and local header offset."""
    start, length, entries = directory_place(source, size)
    data, at, members = read_range(source, start, length), 0, {}
    for _ in range(entries):
        fixed = struct.unpack("<4s6H3I5H2I", data[at : at + 46])
        if fixed[0] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, packed, full, header = fixed[4], fixed[8], fixed[9], fixed[16]
        names, extras, comments = fixed[10:13]
        name = data[at + 46 : at + 46 + names].decode()
        extra = data[at + 46 + names : at + 46 + names + extras]
        # The ZIP64 field holds, in this order, only the values that did not fit.
        wide, place = [], 0
        while place + 4 <= len(extra):
            kind, long = struct.unpack("<2H", extra[place : place + 4])
            if kind == 1:
                wide = list(struct.unpack(f"<{long // 8}Q", extra[place + 4 :][: long // 8 * 8]))
            place += 4 + long
        full = wide.pop(0) if full == 0xFFFFFFFF else full
        packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
        header = wide.pop(0) if header == 0xFFFFFFFF else header
        members[name] = {"method": method, "size": full, "packed": packed, "header": header}
        at += 46 + names + extras + comments
    return members


def stored_start(source, member: dict) -> int:
    """Where the bytes of a stored member begin in the package."""
    if member["method"] != 0 or member["packed"] != member["size"]:
        raise ValueError("only stored members can be read by range")
    local = read_range(source, member["header"], 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    names, extras = struct.unpack("<2H", local[26:30])
    return member["header"] + 30 + names + extras


def members_below(members: dict[str, dict], folder: str) -> list[str]:
    return sorted(n for n in members if n.startswith(folder) and not n.endswith("/"))


def index_lines(source, member: dict) -> list[bytes]:
    return [x for x in read_range(source, stored_start(source, member), member["size"]).splitlines() if x]


def archive_of(entry: dict, archives: list[str]) -> str:
    """The member that an index entry points to; without a name, the only archive there is."""
    if "filename" in entry:
        return ARCHIVES + entry["filename"].removeprefix(ARCHIVES)
    if len(archives) != 1:
        raise ValueError("an index entry does not name its archive")
    return archives[0]


def record_ranges(uri: str, range_records: int):
    """(member, start, records) of a package: ranges of its indexes, and whole archives, with
    -1 for records, that no index names."""
    system, path = open_at(uri)
    with system.open_input_file(path) as source:
        members = central_directory(source, source.size())
        archives, named = members_below(members, ARCHIVES), set()
        for name in members_below(members, INDEXES):
            lines = index_lines(source, members[name])
            named |= {archive_of(json.loads(line), archives) for line in lines}
            for start in range(0, len(lines), range_records):
                yield name, start, min(range_records, len(lines) - start)
        if named - set(archives):
            raise ValueError(f"an index names archives that are not there: {named - set(archives)}")
        for name in archives:
            if name not in named:
                yield name, 0, -1


def read_records(uri: str, name: str = INDEX, start: int = 0, count: int | None = None):
    """Parsed records of a package by range reads: those of ``count`` lines of an index from
    ``start`` on, or all of an archive."""
    system, path = open_at(uri)
    with system.open_input_file(path) as source:
        members = central_directory(source, source.size())
        if name.startswith(ARCHIVES):
            yield from scanned(source, members[name])
            return
        archives = members_below(members, ARCHIVES)
        lines = index_lines(source, members[name])[start : None if count is None else start + count]
        entries = [json.loads(line) for line in lines]
        wanted = [(archive_of(e, archives), e["offset"], e["offset"] + e["length"]) for e in entries]
        at = 0
        while at < len(wanted):
            archive, first, end = wanted[at]
            till = at + 1
            while till < len(wanted) and wanted[till][0] == archive and wanted[till][1] == end and (
                wanted[till][2] - first <= RANGE_BYTES
            ):
                end = wanted[till][2]
                till += 1
            if archive not in members or end > members[archive]["size"]:
                raise ValueError("an index entry lies beyond the archives")
            span = read_range(source, stored_start(source, members[archive]) + first, end - first)
            for _, a, b in wanted[at:till]:
                yield parse_record(span[a - first : b - first])
            at = till


def scanned(source, member: dict):
    """The records of an archive, one gzip member after another, read in bounded ranges."""
    start, left = stored_start(source, member), member["size"]
    data, held, reader = b"", b"", zlib.decompressobj(wbits=31)
    while left or held:
        if not held:
            held = read_range(source, start, min(left, RANGE_BYTES))
            start, left = start + len(held), left - len(held)
        data += reader.decompress(held)
        held = reader.unused_data
        if reader.eof:
            yield record_of(data)
            data, reader = b"", zlib.decompressobj(wbits=31)
    if data:
        raise ValueError("the last record is cut short")


# -- In Spark ------------------------------------------------------------------------------


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, first): ``first`` is the page a record revisits, or null.

    Payloads are told apart by SHA-1. Of equal payloads of at least ``min_bytes`` bytes the
    smallest page_id is the response; rows that repeat it are responses too. Null ids are
    never the smallest unless all are null, and then all are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # Only the payloads that occur more than once need their first one. They are written, so
    # that their size is known: few of them are broadcast and no payload moves; with many, a
    # very frequent one is a skewed key that adaptive execution splits.
    shared = materialise(
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "least"),
        "payloads",
    )
    first = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", first.alias("first"))


def write_packages(
    rows: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False
) -> DataFrame:
    """Write (page_id, url, payload, first) as packages; returns (uri, records), written."""

    def write(batches):
        writer = None
        for batch in batches:
            for piece in pieces(batch, 2):
                for page_id, url, payload, first in zip(*(c.to_pylist() for c in piece.columns)):
                    if writer is None:
                        writer = PackageWriter(f"{folder}/{uuid.uuid4().hex}.wacz", zip64)
                    writer.add(page_id, url, payload, digest_of(payload), first)
                    if writer.payload_bytes >= package_bytes:
                        yield manifest([writer.close()])
                        writer = None
        if writer is not None:
            yield manifest([writer.close()])

    def manifest(made):
        uris, counts = zip(*made)
        return pa.RecordBatch.from_arrays(
            [pa.array(uris), pa.array(counts, pa.int64())], names=["uri", "records"]
        )

    ordered = rows.select("page_id", "url", "payload", "first")
    return materialise(ordered.mapInArrow(write, "uri string, records long"), "packages")


def read_packages(packages: DataFrame, range_records: int = RANGE_RECORDS) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every
    record of packages(uri); a package is read by many tasks, a range of records each, as its
    own directory and indexes tell.

    A response whose payload does not have its digest is an error. The payload of a revisit
    is null, and its size that of the payload it refers to.
    """
    def locate(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                found = [(uri, *x) for x in record_ranges(uri, range_records)]
                if found:
                    columns = [pa.array(x) for x in zip(*found)]
                    yield pa.RecordBatch.from_arrays(columns, names=["uri", "member", "start", "count"])

    cores = packages.sparkSession.sparkContext.defaultParallelism
    uris = packages.select("uri").repartition(max(cores, packages.count() // 16), "uri")
    ranges = materialise(
        uris.mapInArrow(locate, "uri string, member string, start long, count long"), "ranges"
    )
    ranges = ranges.repartition(max(cores, ranges.count() // 4), "uri", "member", "start")

    def number(urn: str | None):
        inner = urn[len("<urn:page:") : -1] if urn else ""
        return int(inner) if inner else None

    fields = (
        "page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, payload binary"
    )
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in fields.split(", ")]

    def read(batches):
        for batch in batches:
            for place in zip(*(c.to_pylist() for c in batch.columns)):
                uri, (rows, held) = place[0], ([], 0)
                for record in read_records(*place):
                    head, payload = record["headers"], record["payload"]
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and digest_of(payload) != digest:
                        raise ValueError(f"payload and digest differ in {uri}")
                    url = "".join(
                        part if i == 0 else chr(int(part[:2], 16)) + part[2:]
                        for i, part in enumerate(head["WARC-Target-URI"].split("%"))
                    )
                    rows.append(
                        (
                            number(head["WARC-Record-ID"]),
                            url,
                            int(record["http"]["Content-Length"]),
                            digest,
                            kind,
                            number(head.get("WARC-Refers-To")),
                            payload if kind == "response" else None,
                        )
                    )
                    held += len(payload)
                    if held >= RANGE_BYTES:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return ranges.mapInArrow(read, fields)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html), and read the packages back.

    A null or empty html is an empty payload, a null url an empty target. An empty table
    makes no package and no row; other columns are not read.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_packages(write_packages(classify(pages, min_bytes), folder))
