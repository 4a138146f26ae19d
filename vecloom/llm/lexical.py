"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time evaluation.

Documents are dealt to shards, each an inverted index of its own with documents in the order
of their ids. A query is run over a shard in two steps. Its short lists are summed term at a
time into accumulators. The accumulators then count as one list with known bounds, and are
read document at a time together with the long lists: a block of documents, for which the
bounds of all lists together do not beat the k-th best score so far, is skipped in every list, and
a block is left as soon as what the other lists hold cannot lift any of its documents.

Shards hold only terms that are asked for. Collection statistics are summed over all shards
ahead of the search. Queries come in blocks of bounded size, each of which meets every
document; what a shard returns is at most k rows a query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.texts import pieces
from vecloom.session import materialise

# Letters, digits and everything beyond ASCII make terms; A-Z become lower-case.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
# Bytes of a text that are cut into terms at once.
SLICE_BYTES = 1 << 20
# A shard closes at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 20
# Documents of a block, and the share of a shard's documents up to which a list is short.
BLOCK = 128
SHORT = 1 / 16
# Search tasks of one shard each at most.
MOST_TASKS = 10_000
# Bytes of query text that are searched for at once.
QUERY_BYTES = 16 << 20


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, in slices that end between terms."""
    if not text:
        return
    plain, start = text.translate(TABLE), 0
    while start < len(plain):
        stop = plain.find(b" ", start + SLICE_BYTES)
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop


# -- Shards ----------------------------------------------------------------------------------


def shards(df: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Inverted indexes of the texts of ``df``, one row a shard:

    (shard, ids, sizes, terms, lengths, docs, tfs). Documents are ordered by id, nulls last;
    ``sizes`` counts all their terms. The lists of the vocabulary's ``terms`` follow one another
    in ``docs`` and ``tfs``.
    """
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
            *T.StructType.fromDDL(
                "sizes array<long>, terms array<int>, lengths array<int>, docs array<int>, tfs array<int>"
            ).fields,
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shipped.value.get
        ids, sizes, parts, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            known = pa.chunked_array(ids).combine_chunks()
            order = pc.sort_indices(known, null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc, term, tf = (np.concatenate(p) for p in zip(*parts))
            doc = place[doc]
            sort = np.lexsort((doc, term))
            terms, lengths = np.unique(term, return_counts=True)
            whole = [
                np.array(sizes, np.int64)[order],
                *(x.astype(np.int32) for x in (terms, lengths, doc[sort], tf[sort])),
            ]
            lists = [
                pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                for x in (known.take(pa.array(order)), *map(pa.array, whole))
            ]
            return pa.RecordBatch.from_arrays(lists, schema.names)

        for batch in batches:
            for piece in pieces(batch, 1):
                found: list[dict[int, int]] = []
                for text in piece.column(1).to_pylist():
                    size, counts = 0, {}  # term: occurrences
                    for terms in terms_of(text):
                        size += len(terms)
                        for c in map(code, terms):
                            if c is not None:
                                counts[c] = counts.get(c, 0) + 1
                    found.append(counts)
                    sizes.append(size)
                number = np.fromiter(map(len, found), np.int64, len(found))
                first = len(sizes) - len(found)
                parts.append(
                    (
                        np.repeat(np.arange(first, len(sizes)), number),
                        np.fromiter(chain.from_iterable(found), np.int64, number.sum()),
                        np.fromiter(
                            chain.from_iterable(c.values() for c in found), np.int64, number.sum()
                        ),
                    )
                )
                ids.append(piece.column(0))
                held += int(number.sum())
                if len(sizes) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                    yield closed()
                    ids, sizes, parts, held = [], [], [], 0
        if sizes:
            yield closed()

    made = rows.mapInArrow(run, schema)
    return materialise(made.withColumn("shard", F.monotonically_increasing_id()), "shards")


def collection(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents by term."""
    whole = index.select(
        F.size(F.filter("sizes", lambda n: n > 0)).alias("full"),
        F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n).alias("terms"),
    )
    full, terms = whole.agg(F.sum("full"), F.sum("terms")).first()
    lists = index.select(F.explode(F.arrays_zip("terms", "lengths")).alias("x"))
    # A row for each term asked for, of which a block of queries has a bounded number.
    table = lists.groupBy("x.terms").agg(F.sum("x.lengths").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return full or 0, terms or 0, df


# -- Search in a shard -----------------------------------------------------------------------


class Lists:
    """The posting lists of a shard with the scores that they give."""

    def __init__(self, shard: dict, weights: np.ndarray, full: int, terms: int):
        sizes, self.docs, tf = shard["sizes"], shard["docs"], shard["tfs"].astype(np.int64)
        self.count = len(sizes)
        self.blocks = -(-self.count // BLOCK)
        if len(sizes) and 90 * int(sizes.max()) * full >= 1 << 63:
            norm = np.array([10 + 90 * int(n) * full // terms for n in sizes], np.int64)
        else:
            norm = 10 + 90 * sizes * full // max(terms, 1)
        self.impacts = np.repeat(weights[shard["terms"]], shard["lengths"]) * (
            1_000_000_000 * tf // (1000 * tf + 8 * norm[self.docs])
        )
        ends = np.cumsum(shard["lengths"], dtype=np.int64)
        begins = (ends - shard["lengths"]).tolist()
        self.spans = dict(zip(shard["terms"].tolist(), zip(begins, ends.tolist())))
        self.known: dict = {}

    def skips(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each block of documents begins in the list of a term, and its best score."""
        if term not in self.known:
            lo, hi = self.spans[term]
            edges = lo + np.searchsorted(self.docs[lo:hi], np.arange(self.blocks + 1) * BLOCK)
            best = np.zeros(self.blocks, np.int64)
            some = np.flatnonzero(edges[:-1] < edges[1:])
            best[some] = np.maximum.reduceat(self.impacts[:hi], edges[some])
            self.known[term] = edges, best
        return self.known[term]

    def search(self, terms: list[int], k: int) -> list[tuple[int, int]]:
        """The k best (score, -document) of the documents with a score above 0."""
        own = sorted((t for t in terms if t in self.spans), key=lambda t: self.length(t))
        short = [t for t in own if self.length(t) <= SHORT * self.count]
        long = own[len(short) :]
        # Term at a time: short lists are summed.
        sums = np.zeros(self.blocks * BLOCK, np.int64)
        for t in short:
            lo, hi = self.spans[t]
            sums[self.docs[lo:hi]] += self.impacts[lo:hi]
        # Document at a time: the sums are one list among the long ones, with its bounds.
        sums = sums.reshape(self.blocks, BLOCK)
        skips = [self.skips(t) for t in long]
        tops = np.array([sums.max(axis=1), *(best for _, best in skips)])
        bounds = tops.sum(axis=0)
        heap: list[tuple[int, int]] = []
        least = 0
        for block in np.flatnonzero(bounds > 0).tolist():
            rest = int(bounds[block])
            if rest <= least:
                continue
            scores = sums[block].copy()
            rest -= int(tops[0, block])
            # The lists that can add most come first, so the rest falls fast.
            for i in np.argsort(-tops[1:, block], kind="stable").tolist():
                if rest == 0 or int(scores.max()) + rest <= least:
                    break
                lo, hi = skips[i][0][block : block + 2]
                scores[self.docs[lo:hi] - block * BLOCK] += self.impacts[lo:hi]
                rest -= int(tops[1 + i, block])
            # Later documents have larger ids, so equal scores do not displace.
            for at in np.flatnonzero(scores > least).tolist():
                score = int(scores[at])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -(block * BLOCK + at)))
                elif score > heap[0][0]:
                    heapq.heapreplace(heap, (score, -(block * BLOCK + at)))
                if len(heap) == k:
                    least = heap[0][0]
        return heap

    def length(self, term: int) -> int:
        lo, hi = self.spans[term]
        return hi - lo


def shard_kernel(shipped, k: int):
    """Task function: the k best documents of a shard for each query."""

    def run(table):
        asked, weights, full, terms = shipped.value
        row = table.slice(0, 1).combine_chunks()
        flat = {c: row.column(c).chunk(0).flatten() for c in row.column_names if c != "shard"}
        ids = flat.pop("ids")
        lists = Lists({c: x.to_numpy() for c, x in flat.items()}, weights, full, terms)
        query, place, score = [], [], []
        for number, own in asked:
            for points, at in lists.search(own, k):
                query.append(number)
                place.append(-at)
                score.append(points)
        return pa.table(
            {
                "query": pa.array(query, pa.int64()),
                "id": ids.take(pa.array(place, pa.int64())),
                "score": pa.array(score, pa.int64()),
            }
        )

    return run


# -- Search ----------------------------------------------------------------------------------


def query_blocks(queries: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The queries (query, text) in blocks of bounded size."""
    block, held = [], 0
    for number, text in queries.toLocalIterator():
        if held and held + len(text) > QUERY_BYTES:
            yield block
            block, held = [], 0
        block.append((number, bytes(text)))
        held += len(text) + 64
    if block:
        yield block


def result_schema(id_type: T.DataType) -> T.StructType:
    kinds = {"query": T.LongType(), "id": id_type, "score": T.LongType()}
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def search_block(
    df: DataFrame, queries: list[tuple[int, bytes]], k: int, id_col: str, text_col: str
) -> DataFrame:
    """The k best (query, id, score) of every shard for the queries of a block."""
    spark = df.sparkSession
    vocabulary: dict[bytes, int] = {}
    asked = []
    for number, text in queries:
        own = dict.fromkeys(t for part in terms_of(text) for t in part)
        asked.append((number, [vocabulary.setdefault(t, len(vocabulary)) for t in own]))
    index = shards(df, vocabulary, id_col, text_col)
    full, terms, df_of = collection(index, len(vocabulary))
    weights = [math.floor(1000 * math.log((2 * full + 2) / (2 * int(n) + 1))) for n in df_of]
    shipped = spark.sparkContext.broadcast((asked, np.array(weights, np.int64), full, terms))
    schema = result_schema(index.schema["ids"].dataType.elementType)
    # A shard a task, however few bytes it is; of very many, some.
    count = index.count()
    tasks = max(1, min(count, max(MOST_TASKS, count // 16)))
    dealt = index.repartition(tasks, "shard")
    return dealt.groupBy("shard").applyInArrow(shard_kernel(shipped, k), schema)


def search(
    df: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_col: str = "item_id",
    query_text_col: str = "text",
) -> DataFrame:
    """(query_col, rank, id, score): the k documents of highest score above 0 for each query.

    Equal scores are ranked by id, nulls last. Every row of either table counts for itself, so
    ids may repeat; null and empty texts have no terms, and a query without terms, or of terms
    that no document has, gives no rows, as does an empty table.
    """
    spark = df.sparkSession
    given = queries.where(F.col(query_text_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("query"),
        F.col(query_col).alias("name"),
        F.col(query_text_col).cast("binary").alias("asked"),
    )
    given = materialise(given, "queries")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = None
    for block in query_blocks(given.select("query", "asked")):
        part = search_block(df, block, k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], result_schema(df.schema[id_col].dataType))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(given, "query").select(F.col("name").alias(query_col), "rank", "id", "score")
