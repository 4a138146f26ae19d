"""SimHash near-duplicates with pigeonring filtering.

Each text gets a 64-bit fingerprint. Two fingerprints at most ``max_bits`` apart are linked,
and links make components. Candidates come from the pigeonring principle: the fingerprint
is a ring of segments, and for every linked pair there is a segment from which, however far
one walks around the ring, the differences met stay within the same share of ``max_bits`` as
the walk has of the ring. The first steps of such a walk leave no room for any difference,
so their bits are an equi-join key; the further steps prune candidates before the full
distance is taken.

Equal fingerprints are one node from the start, so copies cost one row each and no pairs. A
key that many different fingerprints share is refined: the rest of the ring has at most
``max_bits`` differences too, so one of ``max_bits + 1`` parts of it must be equal, and is
added to the key. Refined keys hold every pair that the plain key holds.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.components import components
from vecloom.llm.texts import ROW_KEY, map_texts, with_row_key
from vecloom.session import materialise

BITS = 64
SEGMENTS = 5
# A key of more different fingerprints is refined.
HOT_KEY = 500


def fingerprint_kernel(shingle: int, seed: int):
    """Kernel from text bytes to signed 64-bit fingerprints."""

    def kernel(texts: list):
        digest = xxhash.xxh64_intdigest
        out = np.zeros(len(texts), np.int64)
        for row, text in enumerate(texts):
            words = text.lower().split() if text else ()
            if not words:
                continue
            if len(words) <= shingle:
                hashes = [digest(b" ".join(words), seed)]
            else:
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
                stops = ends[shingle - 1 :].tolist()
                hashes = [digest(joined[a:b], seed) for a, b in zip(starts, stops)]
            out[row] = majority(np.array(hashes, np.uint64))
        return [out.tolist()]

    return kernel


def majority(hashes: np.ndarray) -> np.int64:
    """Bits set in over half of the hashes; counted in parts, so that memory is bounded."""
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return np.packbits(bits).view(">u8")[0].astype(np.uint64).view(np.int64)


def fingerprints(
    df: DataFrame, keep: list[Column], text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """(keep..., fingerprint long): lower-cases A-Z, hashes word shingles with XXH64.

    Fewer words than a shingle make one shingle; null and empty texts have fingerprint 0.
    """
    text = F.col(text_col).cast("binary")
    kernel = fingerprint_kernel(shingle, seed)
    return map_texts(df, keep, text, lambda: kernel, "fingerprint long")


# -- The ring ----------------------------------------------------------------------------


def ring_masks(segments: int, start: int, length: int) -> int:
    """Mask of ``length`` segments of the ring from ``start``, as a signed integer."""
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    mask = 0
    for step in range(length):
        s = (start + step) % segments
        mask |= (1 << edges[s + 1]) - (1 << edges[s])
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def equal_steps(segments: int, max_bits: int) -> int:
    """Steps of a walk whose budget is below one difference; no walk if there is none."""
    steps = (segments - 1) // max_bits if max_bits else segments
    if not steps:
        raise ValueError("more segments than differing bits are needed")
    return steps


def rest_parts(segments: int, start: int, steps: int, parts: int) -> list[int]:
    """The bits beyond the first steps of a walk, in ``parts`` masks."""
    rest = ring_masks(segments, (start + steps) % segments, segments - steps) % (1 << BITS)
    places = [i for i in range(BITS) if rest >> i & 1]
    cuts = [round(i * len(places) / parts) for i in range(parts + 1)]
    masks = [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def literals(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def links(nodes: DataFrame, max_bits: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): pairs of the different fingerprints ``nodes.fingerprint``, a < b, that differ
    in at most ``max_bits`` bits. A pair may come more than once."""
    steps = equal_steps(segments, max_bits)
    starts = [ring_masks(segments, s, steps) for s in range(segments)]
    fp = F.col("fingerprint")
    keyed = nodes.select(fp, F.posexplode(literals(starts)).alias("start", "mask")).select(
        "fingerprint", F.col("start").cast("int"), fp.bitwiseAND(F.col("mask")).alias("key")
    )
    shared = keyed.groupBy("start", "key").agg(F.count("*").alias("members"))
    shared = shared.filter("members > 1")
    # Hot keys are split by one of the parts of the rest that must be equal too. Walks of
    # a split key are numbered from 1, those of a plain key have the one part 0.
    parts = [rest_parts(segments, s, steps, max_bits + 1) for s in range(segments)]
    by_start = F.array(*[literals(p) for p in parts])[F.col("start")]
    entries = F.when(
        F.col("members") > HOT_KEY,
        F.transform(
            by_start, lambda m, i: F.struct((i + 1).alias("part"), fp.bitwiseAND(m).alias("more"))
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("more"))))
    rows = keyed.join(shared, ["start", "key"]).select(
        "fingerprint", "start", "key", F.explode(entries).alias("e")
    )
    rows = rows.select("fingerprint", "start", "key", "e.part", "e.more")
    on = ["start", "key", "part", "more"]
    left = rows.withColumnRenamed("fingerprint", "a")
    right = rows.withColumnRenamed("fingerprint", "b")
    gap = F.col("a").bitwiseXOR(F.col("b"))
    near = F.col("a") < F.col("b")
    for length in range(steps + 1, segments):
        walk = literals([ring_masks(segments, s, length) for s in range(segments)])
        met = F.bit_count(gap.bitwiseAND(walk[F.col("l.start")]))
        near = near & (met <= length * max_bits // segments)
    near = near & (F.bit_count(gap) <= max_bits)
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    return left.alias("l").join(right.alias("r"), same & near).select("a", "b")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
    segments: int = SEGMENTS,
) -> DataFrame:
    """(id, fingerprint long, component_id): one row per row of ``df``.

    ``component_id`` is the smallest id reachable over links, the own one included. Null ids
    take part and are never the smallest unless all are null. Empty and null texts share
    fingerprint 0, which is linked like any other. Repeated rows stay; an empty table gives
    none.
    """
    rows = materialise(
        fingerprints(df, [F.col(id_col).alias("id")], text_col, shingle), "fingerprints"
    )
    nodes = materialise(rows.groupBy("fingerprint").agg(F.min("id").alias("id")), "nodes")
    found = materialise(links(nodes, max_bits, segments).distinct(), "links")
    members = components(found)
    # The least id of a component, for each of its fingerprints.
    placed = members.join(nodes, members["node"] == nodes["fingerprint"]).drop("node")
    least = placed.groupBy("component").agg(F.min("id").alias("least"))
    named = placed.join(least, "component").select(
        F.col("fingerprint").alias("node"), "least"
    )
    alone = nodes.select("fingerprint", F.col("id").alias("own"))
    ids = alone.join(named, alone["fingerprint"] == named["node"], "left").select(
        "fingerprint", F.coalesce("least", "own").alias("component_id")
    )
    # Written, so that the join below is of two plain tables: a fingerprint of very many rows
    # is then a skewed key that adaptive execution splits.
    ids = materialise(ids, "component-ids")
    return rows.join(ids, "fingerprint").select("id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The columns of ``docs``, one document of each component: the one of smallest id.

    Null ids come after all others. Rows that repeat an id within a component count as one
    document, of which the row of least key stays; a component without ids keeps its row of
    least key.
    """
    marked = with_row_key(docs)
    id_ = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *ROW_KEY)
    facts = near_duplicates(
        marked.select(id_.alias("id"), "text"), shingle=shingle, max_bits=max_bits, id_col="id"
    )
    stays = facts.filter(F.col("id") == F.col("component_id"))
    stays = stays.select(*[F.col(f"id.{c}") for c in ROW_KEY]).distinct()
    return marked.join(stays, ROW_KEY).dropDuplicates(ROW_KEY).select(*docs.columns)
