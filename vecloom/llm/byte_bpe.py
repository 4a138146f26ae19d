"""Byte-level BPE encoding and decoding with padded matrices.

A text is cut by the tokenizer's pattern, and each match is encoded by itself. The
different matches of a piece of the table are put into matrices by length, one row of byte
ids each, padded with -1. In every round each row merges its leftmost pair of least rank;
ranks come from a hashed table of id pairs, and the row is compacted by one place. Rows
without a pair are done and leave the matrix.

Results for null, empty and very long texts: null counts as empty, an empty text has no
ids, and a match over ``MATRIX_BYTES`` bytes (a run of letters or blanks) is merged with a
heap and a linked list, since a matrix row would cost the square of its length.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.merges import merge_parts
from vecloom.llm.texts import map_texts

# Longest match that is merged in a matrix.
MATRIX_BYTES = 512
# Encoded matches kept by a task, beyond which it starts afresh, and the longest that is kept:
# at most some 80 MB together.
CACHE_SIZE, CACHE_CHARS = 200_000, 48
# Texts of characters below this have a pattern of plain classes, which is faster.
PLAIN_BELOW = 0x250


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file in tiktoken's format."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class PairTable:
    """Open-addressing hash table from (left id, right id) to the merged token's id.

    Parts are held as ranks, so the value is the pair's rank too. Looked up for whole
    matrices at once; the number of probes is that of the longest chain.
    """

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        values = np.array(merged, np.int32)
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        self.probes = 0
        place = self._home(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            self.probes += 1
            at = place[waiting]
            free = self.keys[at] == -1
            # Of several keys for one free slot the first takes it.
            _, first = np.unique(at[free], return_index=True)
            taken = waiting[free][first]
            self.keys[place[taken]] = keys[taken]
            self.values[place[taken]] = values[taken]
            waiting = waiting[self.keys[at] != keys[waiting]]
            place[waiting] = (place[waiting] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * FACTOR) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs of ids; NONE where there is none or an id is negative."""
        shape = left.shape
        left, right = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        keys = left << 32 | right
        at = self._home(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out.reshape(shape)


NONE = np.iinfo(np.int32).max
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def merge_matrix(ids: np.ndarray, lengths: np.ndarray, table: PairTable) -> None:
    """Merge the rows of ``ids`` in place; ``lengths`` becomes the number of ids in each."""
    alive = np.flatnonzero(lengths > 1)
    work, size = ids[alive], lengths[alive].copy()
    ranks = table(work[:, :-1], work[:, 1:])
    while len(alive):
        place = ranks.argmin(axis=1)
        row = np.arange(len(alive))
        best = ranks[row, place]
        done = best == NONE
        if done.any():
            ended = alive[done]
            ids[ended, : work.shape[1]] = work[done]
            lengths[ended] = size[done]
            stay = ~done
            alive, work, size, ranks = alive[stay], work[stay], size[stay], ranks[stay]
            place, best, row = place[stay], best[stay], np.arange(int(stay.sum()))
            if not len(alive):
                return
        # Compaction: what stands to the right of the pair moves one place to the left.
        width = work.shape[1]
        source = np.arange(width - 1)[None, :]
        source = source + (source > place[:, None])
        kept = np.take_along_axis(work, source, axis=1)
        kept[row, place] = best
        moved = np.take_along_axis(ranks, np.minimum(source, width - 2), axis=1)[:, : width - 2]
        size -= 1
        work = kept
        width -= 1
        ids[alive, width] = -1
        if width == 1:
            ids[alive, :1] = work
            lengths[alive] = 1
            return
        moved = moved[:, : width - 1]
        # Only the pairs on either side of the merged one have changed.
        has = place < width - 1
        at, p = row[has], place[has]
        moved[at, p] = table(work[at, p], work[at, p + 1])
        has = place > 0
        at, p = row[has], place[has]
        moved[at, p - 1] = table(work[at, p - 1], work[at, p])
        ranks = moved


def encode_pieces(pieces: list[bytes], ranks: dict[bytes, int], table: PairTable) -> list[bytes]:
    """Ids of each piece as little-endian 32-bit integers."""
    out: list[bytes | None] = [None] * len(pieces)
    by_length: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = ranks.get(piece)
        if whole is not None:
            out[i] = whole.to_bytes(4, "little")
        elif len(piece) > MATRIX_BYTES:
            single = [piece[k : k + 1] for k in range(len(piece))]
            found = [ranks[x] for x in merge_parts(single, ranks)]
            out[i] = np.array(found, "<u4").tobytes()
        else:
            # Buckets of at most a quarter of padding.
            step = max(2, 1 << len(piece).bit_length() >> 3)
            by_length.setdefault(-(-len(piece) // step) * step, []).append(i)
    single_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
    for width, members in by_length.items():
        for lo in range(0, len(members), 1 << 22 >> width.bit_length()):
            part = members[lo : lo + (1 << 22 >> width.bit_length())]
            own = [pieces[i] for i in part]
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            inside = np.arange(width)[None, :] < lengths[:, None]
            ids = np.full((len(own), width), -1, np.int32)
            ids[inside] = single_byte[np.frombuffer(b"".join(own), np.uint8)]
            merge_matrix(ids, lengths, table)
            inside = np.arange(width)[None, :] < lengths[:, None]
            flat = ids[inside].astype("<u4").tobytes()
            ends = (np.cumsum(lengths) * 4).tolist()
            start = 0
            for i, end in zip(part, ends):
                out[i] = flat[start:end]
                start = end
    return out


def plain_pattern(pattern: str) -> re.Pattern:
    """The pattern with its letter, number and blank classes written out below
    ``PLAIN_BELOW``; it finds the same matches in texts of those characters alone."""
    classes = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        test = regex.compile(name)
        classes[name] = "".join(
            re.escape(chr(c)) for c in range(PLAIN_BELOW) if test.match(chr(c))
        )
    letters, numbers, blanks = (classes[k] for k in (r"\p{L}", r"\p{N}", r"\s"))
    written = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]")
    for name, chars in classes.items():
        written = written.replace(name, f"[{chars}]")
    return re.compile(written.replace(r"\S", f"[^{blanks}]"))


def cutter(pattern: str):
    """Function from a text to the list of its matches."""
    full = regex.compile(pattern).findall
    plain = plain_pattern(pattern).findall
    beyond = re.compile(f"[^\x00-{chr(PLAIN_BELOW - 1)}]").search
    return lambda text: full(text) if beyond(text) else plain(text)


def encoder(ranks: dict[bytes, int], pattern: str):
    """Factory of kernels: (n_tokens, ids_sha256, decoded_sha256) and the ids if wanted."""
    table = PairTable(ranks)

    def start(with_ids: bool):
        cut = cutter(pattern)
        token = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            token[rank] = piece
        long: dict[str, bytes] = {}

        class Cache(dict):
            def __missing__(self, match: str) -> bytes:
                return long[match]

        cache = Cache()

        def kernel(texts: list):
            found = [cut(text) if text else [] for text in texts]
            if len(cache) > CACHE_SIZE:
                cache.clear()
            long.clear()
            fresh = list(set().union(*found).difference(cache))
            for match, ids in zip(fresh, encode_pieces([x.encode() for x in fresh], ranks, table)):
                (cache if len(match) <= CACHE_CHARS else long)[match] = ids
            counts, digests, decoded, all_ids = [], [], [], []
            for parts in found:
                ids = b"".join(map(cache.__getitem__, parts))
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                numbers = np.frombuffer(ids, "<u4").tolist()
                text = b"".join(map(token.__getitem__, numbers))
                decoded.append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    all_ids.append(numbers)
            return [counts, digests, decoded] + [all_ids] * with_ids

        return kernel

    return start


def encode(
    df: DataFrame,
    path: str,
    pattern: str,
    keep: list[str] = ("doc_id",),
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(keep..., n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text.

    ``path`` names a rank file readable on the driver, ``pattern`` the regular expression
    that cuts texts. A match of more than CACHE_CHARS characters is encoded anew in each
    piece of rows; memory follows the longest text. Nulls and empty texts have no ids; repeated rows stay; an empty table
    gives none; other columns are not read.
    """
    start = encoder(load_ranks(path), pattern)
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<long>" if with_ids else ""
    )
    keep = [F.col(c) for c in keep]
    return map_texts(df, keep, F.col(text_col), lambda: start(with_ids), fields)


def decode(df: DataFrame, path: str, ids: Column, keep: list[str] = ("doc_id",)) -> DataFrame:
    """(keep..., decoded binary): the bytes that the ids stand for; null ids give none."""
    ranks = load_ranks(path)
    token = {rank: piece for piece, rank in ranks.items()}

    def bytes_of(column):
        import pyarrow as pa

        rows = column.to_pylist()
        return pa.array([b"".join(map(token.__getitem__, x or ())) for x in rows], pa.binary())

    return df.select(*keep, F.arrow_udf(bytes_of, "binary")(ids).alias("decoded"))
