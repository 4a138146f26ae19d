"""File trees as tables, and reading image files inside tasks.

Spark's own image and binary-file sources keep every file status on the driver and leave
out empty files. Here the driver only splits the tree into directories; tasks list them
and open the files, so neither the listing nor any file content passes through it. Mounts and
stores are listed by the same code, through Arrow's file systems.
"""

import io
import os
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

from vecloom.functions.paths import suffix
from vecloom.functions.vectors import as_lists, unit_rows

# Suffixes taken as images on ingest, and the shorter set of tree reports.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".tif", ".webp"]
REPORT_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff", ".gif"]

LISTING_SCHEMA = "id string, file_size long, file_mtime double, error string"
# Files of a batch of the listing, and folders of a partition at most.
LISTED_ROWS, FOLDERS = 10_000, 256


# A stream lists again what was changed within so many seconds before its last offset.
OVERLAP_S = 3600.0


@dataclass
class Directories(InputPartition):
    """Some directories; ``deep`` says whether to descend into them. Only files changed after
    ``since`` and not after ``until`` are wanted, where these are given."""

    paths: list
    deep: bool
    since: float | None = None
    until: float | None = None

    def wants(self, changed: float | None) -> bool:
        return self.until is None or changed is None or self.since < changed <= self.until


def store_of(root: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a folder, its path there, and what stands before paths in ids: a
    mount's files are named by plain paths, all others by the URIs that they were asked by."""
    if "://" not in root or root.startswith("file://"):
        return fs.LocalFileSystem(), str(Path(root.removeprefix("file://"))), ""
    store, path = fs.FileSystem.from_uri(root)
    return store, path.rstrip("/"), root[: root.rindex(path)] if path in root else ""


def entries(store: fs.FileSystem, directory: str):
    """(subdirectories, files, error) of a directory; files are (path, size, time). Links to
    directories are not followed."""
    try:
        found = store.get_file_info(fs.FileSelector(directory, recursive=False))
    except OSError as problem:
        return [], [], f"{type(problem).__name__}: {problem}"
    folders, files, local = [], [], isinstance(store, fs.LocalFileSystem)
    for info in found:
        if info.type == fs.FileType.Directory:
            if not (local and os.path.islink(info.path)):
                folders.append(info.path)
        elif info.type == fs.FileType.File:
            changed = None if info.mtime_ns is None else info.mtime_ns / 1e9
            files.append((info.path, info.size, changed))
        else:  # gone by now
            files.append((info.path, -1, None))
    if local:
        # Arrow leaves out links that lead nowhere.
        names = {os.path.join(directory, name) for name in os.listdir(directory)}
        files += [(path, -1, None) for path in sorted(names - {info.path for info in found})]
    return folders, files, None


def split_tree(root: str, wanted: int, per_partition: int = FOLDERS) -> list:
    """Partitions of a tree: descend level by level until there are enough directories."""
    store, path, _ = store_of(root)
    shallow, deep = [], [path]
    while deep and len(deep) < wanted:
        shallow += deep
        deep = [folder for directory in deep for folder in entries(store, directory)[0]]
    size = max(1, min(per_partition, -(-len(deep) // wanted)))
    return [
        Directories(group[i : i + step], is_deep)
        for group, is_deep, step in ((shallow, False, 1), (deep, True, size))
        for i in range(0, len(group), step)
    ]


def listed(files: list, prefix: str) -> pa.RecordBatch:
    """Rows of (path, size, time, error)."""
    paths, sizes, times, errors = zip(*files)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([prefix + p for p in paths], pa.string()),
            pa.array(sizes, pa.int64()),
            pa.array(times, pa.float64()),
            pa.array(errors, pa.string()),
        ],
        ["id", "file_size", "file_mtime", "error"],
    )


class FileTreeReader(DataSourceReader):
    def __init__(self, root: str, wanted: int):
        self.root, self.wanted = root, wanted

    def partitions(self):
        return split_tree(self.root, self.wanted)

    def read(self, partition):
        store, _, prefix = store_of(self.root)
        waiting = list(partition.paths)
        while waiting:
            directory = waiting.pop()
            folders, files, error = entries(store, directory)
            files = [f for f in files if partition.wants(f[2])]
            if error:
                yield listed([(directory, -1, None, error)], prefix)
            if partition.deep:
                waiting += folders
            for lo in range(0, len(files), LISTED_ROWS):
                yield listed([(*f, None) for f in files[lo : lo + LISTED_ROWS]], prefix)


class FileTreeStream(DataSourceStreamReader):
    """Offsets are times: a batch holds the files changed between two of them. Since a file may
    show up a while after its time, a batch begins OVERLAP_S earlier, and its user leaves out
    what it knows."""

    def __init__(self, root: str, wanted: int):
        self.tree = FileTreeReader(root, wanted)

    def initialOffset(self):
        return {"until": 0.0}

    def latestOffset(self):
        return {"until": time.time()}

    def partitions(self, start, end):
        since, until = start["until"] - OVERLAP_S, end["until"]
        return [Directories(p.paths, p.deep, since, until) for p in self.tree.partitions()]

    def read(self, partition):
        return self.tree.read(partition)


class FileTree(DataSource):
    """``format("filetree")``: every file below ``path``, empty ones included, as a batch or a
    stream."""

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return LISTING_SCHEMA

    def reader(self, schema):
        return FileTreeReader(self.options["path"], int(self.options.get("partitions", "64")))

    def streamReader(self, schema):
        return FileTreeStream(self.options["path"], int(self.options.get("partitions", "64")))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(id, file_size, file_mtime, error) of every file below a folder, on a shared mount or in
    a store that a URI names; tasks list it in the same way. Empty files are rows, and a
    folder that cannot be read is a row with an error in place of its files."""
    store, path, _ = store_of(root)
    if store.get_file_info(path).type != fs.FileType.Directory:
        raise FileNotFoundError(f"directory not found: {root}")
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("path", root).load()


def stream_files(spark: SparkSession, root: str) -> DataFrame:
    """The rows of ``list_files`` as a stream: files that are there, then those that change."""
    spark.dataSource.register(FileTree)
    return spark.readStream.format("filetree").option("path", root).load()


def list_images(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """The files with one of the suffixes, and the folders that could not be read."""
    chosen = suffix(F.col("id")).isin(suffixes or IMAGE_SUFFIXES)
    return list_files(spark, root).where(chosen | F.col("error").isNotNull())


def tree_usage(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """(files, size_mb): files with one of the suffixes, and the size of all files."""
    chosen = suffix(F.col("id")).isin(suffixes or REPORT_SUFFIXES)
    return list_files(spark, root).agg(
        F.count_if(chosen & F.col("error").isNull()).alias("files"),
        (F.coalesce(F.sum(F.greatest("file_size", F.lit(0))), F.lit(0)) / 1048576).alias("size_mb"),
    )


def read_file(path: str) -> tuple[bytes, float]:
    """Contents and time of a file as it is now, whatever a listing said before."""
    if "://" in path:
        store, inner = fs.FileSystem.from_uri(path)
        changed = store.get_file_info(inner).mtime_ns
        with store.open_input_stream(inner) as stream:
            return stream.read(), None if changed is None else changed / 1e9
    with open(path.removeprefix("file:"), "rb") as stream:
        return stream.read(), os.fstat(stream.fileno()).st_mtime


def image_size(data: bytes) -> tuple[int, int]:
    """(width, height), or an error for anything that is not a whole image.

    Uses Pillow where the executors have it, which decodes the picture; otherwise the
    file's own header and end mark are read.
    """
    try:
        from PIL import Image
    except ImportError:
        return header_size(data)
    return Image.open(io.BytesIO(data)).convert("RGB").size


def header_size(data: bytes) -> tuple[int, int]:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at, size = 8, None
        while at + 12 <= len(data):
            length, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + length]
            check = data[at + 8 + length : at + 12 + length]
            if len(check) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", check)[0]:
                break
            if kind == b"IHDR":
                size = struct.unpack(">II", body[:8])
            if kind == b"IEND" and size:
                return size
            at += 12 + length
        raise ValueError("broken PNG")
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                if b"\xff\xd9" not in data[at:]:
                    break
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + length
        raise ValueError("broken JPEG")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) > 13:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) > 26:
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        return webp_size(data)
    if data[:4] in (b"II*\x00", b"MM\x00*"):
        return tiff_size(data)
    raise ValueError("not an image")


def webp_size(data: bytes) -> tuple[int, int]:
    kind = data[12:16]
    if kind == b"VP8 ":
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF
    if kind == b"VP8L":
        bits = struct.unpack("<I", data[21:25])[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X":
        return (
            int.from_bytes(data[24:27], "little") + 1,
            int.from_bytes(data[27:30], "little") + 1,
        )
    raise ValueError("broken WebP")


def tiff_size(data: bytes) -> tuple[int, int]:
    order = "<" if data[:2] == b"II" else ">"
    start = struct.unpack(order + "I", data[4:8])[0]
    count = struct.unpack(order + "H", data[start : start + 2])[0]
    found = {}
    for i in range(count):
        field = data[start + 2 + 12 * i : start + 14 + 12 * i]
        tag, kind = struct.unpack(order + "HH", field[:4])
        if tag in (256, 257):
            short = kind == 3
            value = field[8:10] if short else field[8:12]
            found[tag] = struct.unpack(order + ("H" if short else "I"), value)[0]
    return found[256], found[257]


# Rows of a decoded file; ``error`` is null for a good one.
DECODED = "id string, width int, height int, file_size long, file_mtime double, error string"


# File contents held for one call of the encoder.
ENCODE_BYTES = 64 * 1024 * 1024


def decode_files(listing: DataFrame, encoder=None, batch_size: int = 256) -> DataFrame:
    """Open, measure and, with an encoder, embed the files of a listing.

    A file that cannot be read or decoded is a row with an ``error``; it never stops a
    batch. Size and time are those of the file when it was opened. Paths go in and vectors come out: file contents stay inside the task, no more
    than ``batch_size`` files or 64 MiB of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder() if encoder else None
        for batch in batches:
            sizes, errors, waiting, held, vectors = [], [], [], 0, []
            lengths, times = batch.column(1).to_pylist(), batch.column(2).to_pylist()

            def flush():
                if waiting:
                    vectors.append(unit_rows(np.asarray(encode(waiting)), np.float32))
                    waiting.clear()

            for row, path in enumerate(batch.column(0).to_pylist()):
                try:
                    data, times[row] = read_file(path)
                    lengths[row] = len(data)
                    sizes.append(image_size(data))
                    errors.append(None)
                except Exception as problem:  # any broken file is a row
                    sizes.append((None, None))
                    errors.append(f"{type(problem).__name__}: {problem}")
                    continue
                if encode:
                    waiting.append(data)
                    held += len(data)
                    if len(waiting) >= batch_size or held >= ENCODE_BYTES:
                        flush()
                        held = 0
            columns = [
                batch.column(0),
                pa.array([w for w, _ in sizes], pa.int32()),
                pa.array([h for _, h in sizes], pa.int32()),
                pa.array(lengths, pa.int64()),
                pa.array(times, pa.float64()),
                pa.array(errors, pa.string()),
            ]
            names = ["id", "width", "height", "file_size", "file_mtime", "error"]
            if encode:
                flush()
                columns.append(placed_vectors(vectors, errors))
                names.append("vector")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = DECODED + (", vector array<float>" if encoder else "")
    return listing.select("id", "file_size", "file_mtime").mapInArrow(run, schema)


def placed_vectors(vectors: list, errors: list) -> pa.Array:
    """Vectors of the good files in their places, null for the rest."""
    if not vectors:
        return pa.nulls(len(errors), pa.list_(pa.float32()))
    place = np.cumsum([e is None for e in errors]) - 1
    rows = [int(p) if e is None else None for p, e in zip(place, errors)]
    return as_lists(np.concatenate(vectors)).take(pa.array(rows, pa.int64()))


def image_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Width, height, size and time of every image below a folder; rejects carry an error."""
    return decode_files(list_images(spark, root))
