"""Near-duplicate pairs: every unordered pair closer than a threshold, each once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import (
    as_binary,
    as_matrix,
    cosine_distance,
    cosine_distances,
    fixed_width,
    screen_margin,
    unit_rows,
)
from vecloom.operators import blocks
from vecloom.operators.cells import assign_cells, choose_anchors
from vecloom.operators.copies import Copies, collapse, expand_pairs, stars
from vecloom.operators.parts import part_kernel, rotation, spread_parts
from vecloom.session import materialise

# Rows of a block compared at a time inside a task, by vectors and by sketches.
STRIP_ROWS = 1024
SCREEN_ROWS = 256
SKETCH_BITS = 256
# Up to this distance a few axes of turned vectors tell most pairs apart.
PART_THRESHOLD = 0.1
# Rows of a tile that few axes are compared in, and the share of its pairs that may pass before
# the whole vectors of the tile are compared.
TILE_LEFT, TILE_RIGHT, MOST_PASSING = 256, 1024, 0.005
# Blocks of a join without cells: this many, or as many as keep each within the bytes.
MOST_BLOCKS, BLOCK_BYTES = 16, 16 * 1024 * 1024


def pair_schema(df: DataFrame) -> T.StructType:
    id_type, key_type = df.schema["id"].dataType, df.schema["key"].dataType
    return T.StructType(
        [
            T.StructField("id_a", id_type),
            T.StructField("key_a", key_type),
            T.StructField("id_b", id_type),
            T.StructField("key_b", key_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def whole_matches(threshold: float):
    """Function from the unit rows of two blocks to tiles of (i, j, distance) below the
    threshold, by inner products of whole vectors."""

    def matches(left, right, same):
        slack = screen_margin(left.shape[1])
        right32 = right.astype(np.float32)
        for lo in range(0, len(left), STRIP_ROWS):
            strip = left[lo : lo + STRIP_ROWS]
            close = strip.astype(np.float32) @ right32.T > 1.0 - threshold - slack
            if same:
                close &= np.arange(len(right))[None, :] > (lo + np.arange(len(strip)))[:, None]
            i, j = np.nonzero(close)
            distance = cosine_distances(strip, i, right, j)
            below = distance < threshold
            yield i[below] + lo, j[below], distance[below]

    return matches


def axis_matches(threshold: float):
    """As ``whole_matches``, for small thresholds: the squared distance in some axes of randomly
    turned vectors is no more than that of whole ones, so a pair that is too far there is too
    far. A tile in which many pairs pass is compared by whole vectors."""

    def matches(left, right, same):
        dim = left.shape[1]
        axes = min(dim, max(8, dim // 4))
        turn, slack = rotation(dim)[:, :axes], screen_margin(dim)
        a = (left @ turn).astype(np.float32)
        b = (right @ turn).astype(np.float32)
        # (x - y)^2 <= 2t as x.y - y^2 / 2 >= x^2 / 2 - t, with room for rounding.
        least = (a.astype(np.float64) ** 2).sum(axis=1) / 2 - threshold - 4 * slack
        a = np.concatenate([a, np.full((len(a), 1), -1, np.float32)], axis=1)
        b = np.concatenate([b, (b**2).sum(axis=1, keepdims=True) / 2], axis=1)
        left32, right32 = left.astype(np.float32), right.astype(np.float32)
        for lo in range(0, len(left), TILE_LEFT):
            rows, low = a[lo : lo + TILE_LEFT], least[lo : lo + TILE_LEFT, None].astype(np.float32)
            for at in range(0, len(right), TILE_RIGHT):
                if same and at + TILE_RIGHT <= lo:
                    continue
                close = rows @ b[at : at + TILE_RIGHT].T >= low
                if np.count_nonzero(close) > MOST_PASSING * close.size:
                    whole = left32[lo : lo + TILE_LEFT] @ right32[at : at + TILE_RIGHT].T
                    close &= whole > 1.0 - threshold - slack
                i, j = np.divmod(np.flatnonzero(close), close.shape[1])
                i, j = i + lo, j + at
                if same:
                    i, j = i[j > i], j[j > i]
                distance = cosine_distances(left, i, right, j)
                below = distance < threshold
                if below.any():
                    yield i[below], j[below], distance[below]

    return matches


def pair_kernel(threshold: float, limit: int | None):
    """Task function: all pairs of two blocks below the threshold.

    Input columns: id, key, vector, side.
    """
    matches = (axis_matches if threshold <= PART_THRESHOLD else whole_matches)(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if table.num_rows == 0:
            return
        side = table.column("side").to_numpy()
        vectors = unit_rows(as_matrix(table.column("vector")))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        if same:
            right = left
        ids, keys = table.column("id"), table.column("key")
        for i, j, distance in matches(vectors[left], vectors[right], same):
            i, j = left[i], right[j]
            if not len(i):
                continue
            if limit is not None and len(i) > limit:
                # Ties at the cut are all kept; the final sort settles them by id.
                cut = np.partition(distance, limit - 1)[limit - 1]
                i, j, distance = i[distance <= cut], j[distance <= cut], distance[distance <= cut]
            a, b = pa.array(i), pa.array(j)
            out = pa.table(
                {
                    "id_a": ids.take(a),
                    "key_a": keys.take(a),
                    "id_b": ids.take(b),
                    "key_b": keys.take(b),
                    "distance": distance,
                }
            )
            yield from out.combine_chunks().to_batches(max_chunksize=65_536)

    return run


def oriented(pairs: DataFrame, with_keys: bool) -> DataFrame:
    """Smaller (id, key) first."""
    swap = F.struct("id_a", "key_a") > F.struct("id_b", "key_b")
    columns = []
    for a, b in (("id_a", "id_b"), ("key_a", "key_b")):
        columns += [
            F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a),
            F.when(swap, F.col(a)).otherwise(F.col(b)).alias(b),
        ]
    kept = ["id_a", "id_b", "distance"] + (["key_a", "key_b"] if with_keys else [])
    return pairs.select(*columns, "distance").select(*kept)


def keyed(df: DataFrame, id_col: str, vector_col: str, key_col: str | None) -> DataFrame:
    return df.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.col(key_col or id_col).alias("key"),
        F.col(vector_col).alias("vector"),
    )


def ordered(pairs: DataFrame, limit: int | None) -> DataFrame:
    """Ascending by distance. A global sort reads its input twice, once to find the range
    bounds, so the pairs are written first and the join runs once."""
    order = ["distance", "id_a", "id_b"]
    if limit is not None:
        return pairs.orderBy(*order).limit(limit)
    return materialise(pairs, "pairs").orderBy(*order)


def finished(
    found: DataFrame,
    copies: Copies,
    threshold: float,
    limit: int | None,
    with_keys: bool,
    block_rows: int,
    star: bool,
) -> DataFrame:
    if copies.members is not None and star:
        found = found.unionByName(stars(copies.members, threshold))
    elif copies.members is not None:
        found = expand_pairs(found, copies.members, threshold, limit, block_rows)
    return ordered(oriented(found, with_keys), limit)


def duplicate_pairs(
    df: DataFrame,
    threshold: float = 0.05,
    limit: int | None = None,
    id_col: str = "id",
    vector_col: str = "vector",
    key_col: str | None = None,
    block_rows: int = blocks.BLOCK_ROWS,
    star: bool = False,
    by_parts: bool = False,
) -> DataFrame:
    """Exact near-duplicate self-join: (id_a, id_b, distance), ascending by distance.

    Copies are joined once for all. Other rows meet inside metric cells of whole vectors, and
    up to PART_THRESHOLD, where few axes tell most pairs apart at less cost than a row's
    copies in the cells it visits, in blocks; both lose no pair. With ``by_parts`` such rows meet
    by parts of their vectors instead (see parts.py). ``key_col`` names a unique row key where
    ids may repeat. ``limit`` keeps the first pairs only.

    A group of m equal vectors has m(m-1)/2 pairs. With ``star`` it is given in m - 1: its
    lowest row with each other one. Nothing is lost, since copies share every distance;
    the lowest row alone stands for the group in pairs with other rows.
    """
    n = df.count()
    copies = collapse(keyed(df, id_col, vector_col, key_col))
    if threshold <= PART_THRESHOLD and by_parts:
        found = part_pairs(copies.reps, threshold, block_rows)
    elif threshold <= PART_THRESHOLD:
        found = block_pairs(copies.reps, n, threshold, limit, block_rows)
    else:
        found = cell_pairs(copies.reps, n, threshold, limit, block_rows)
    return finished(found, copies, threshold, limit, key_col is not None, block_rows, star)


def cell_pairs(
    rows: DataFrame, n: int, threshold: float, limit: int | None, block_rows: int
) -> DataFrame:
    """Pairs of about ``n`` rows (id, key, vector) that meet in some metric cell."""
    anchors = choose_anchors(rows, n, block_rows)
    radius = math.sqrt(2.0 * max(threshold, 0.0))
    placed = assign_cells(rows, anchors, radius=radius, later_cells_only=True)
    one = -(-n // block_rows) if len(anchors) <= 1 else None
    grouped = cell_groups(placed, "key", ["id", "key", "vector"], block_rows, one)
    return grouped.applyInArrow(pair_kernel(threshold, limit), pair_schema(rows))


def block_pairs(
    rows: DataFrame, n: int, threshold: float, limit: int | None, block_rows: int
) -> DataFrame:
    """Pairs of about ``n`` rows (id, key, vector), each pair of blocks by a task. Blocks are
    large, since a row is sent once for each block there is."""
    head = rows.select(F.size("vector")).first()
    most = max(1, BLOCK_BYTES // (4 * max(1, head[0] if head else 1)))
    count = min(-(-n // block_rows), max(MOST_BLOCKS, -(-n // most)))
    placed = rows.withColumn("cell", F.lit(0)).withColumn("home", F.lit(True))
    grouped = cell_groups(placed, "key", ["id", "key", "vector"], block_rows, max(1, count))
    return grouped.applyInArrow(pair_kernel(threshold, limit), pair_schema(rows))


def cell_groups(
    placed: DataFrame, key: str, columns: list[str], block_rows: int, one: int | None = None
) -> GroupedData:
    """Rows (cell, home, ...) grouped so that every two rows of a cell of which one is at home
    meet in one group (cell, a, b), on sides 0 and 1, or on side 0 alone where a = b. ``one``
    is the number of blocks of the only cell there is."""
    if one is not None:
        homes, copied = F.lit(max(1, one)), F.lit(0)
    else:
        # One row per anchor.
        sizes = placed.groupBy("cell").agg(
            blocks.blocks_needed(F.count_if("home"), block_rows).alias("homes"),
            blocks.blocks_needed(F.count_if(~F.col("home")), block_rows).alias("copied"),
        )
        # The counts only steer the cutting: a cell they miss still gets one block.
        placed = placed.join(F.broadcast(sizes), "cell", "left")
        homes, copied = (F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("homes", "copied"))
    placed = placed.select(
        "cell", "home", *columns, homes.alias("homes"), copied.alias("copied")
    ).withColumn(
        "own",
        blocks.block_of(key, F.when(F.col("home"), F.col("homes")).otherwise(F.col("copied"))),
    )
    own, homes, copied = F.col("own"), F.col("homes"), F.col("copied")
    at_home = F.concat(
        blocks.triangle_groups(own, homes),
        F.coalesce(blocks.right_groups(own, copied, homes), F.array().cast(blocks.GROUPS)),
    )
    grouped = blocks.spread(
        placed, F.when(F.col("home"), at_home).otherwise(blocks.left_groups(own, homes, homes))
    ).select("cell", "a", "b", "side", *columns)
    return grouped.groupBy("cell", "a", "b")


def part_candidates(coded: DataFrame, dim: int, threshold: float, block_rows: int) -> DataFrame:
    """(row_a, row_b): every pair of coded(row, vector) below the threshold, and a few more."""
    radius = math.sqrt(2.0 * max(threshold, 0.0))
    placed = spread_parts(coded, dim, radius)
    grouped = cell_groups(placed, "row", ["row", "part"], block_rows)
    near = grouped.applyInArrow(part_kernel(dim, radius), "row_a long, row_b long")
    # A pair may be near in several parts.
    return near.distinct()


def part_pairs(rows: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Pairs of rows (id, key, vector) below the threshold, which candidates by parts lead to."""
    coded = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "coded")
    head = coded.select(F.size("vector")).first()
    found = part_candidates(coded, head[0] if head else 1, threshold, block_rows)
    return checked(found, coded, threshold)


def checked(found: DataFrame, coded: DataFrame, threshold: float) -> DataFrame:
    """Candidates (row_a, row_b) with the exact distances of their vectors, below the threshold."""
    for side in ("a", "b"):
        sided = coded.select(
            F.col("row").alias(f"row_{side}"), F.col("id").alias(f"id_{side}"),
            F.col("key").alias(f"key_{side}"), F.col("vector").alias(f"vector_{side}"),
        )
        found = found.join(sided, f"row_{side}")
    distance = F.round(cosine_distance(F.col("vector_a"), F.col("vector_b")), 12) + 0.0
    found = found.withColumn("distance", distance).where(F.col("distance") < threshold)
    return found.select("id_a", "key_a", "id_b", "key_b", "distance")


def hash_plan(n: int, threshold: float, recall: float, bucket_rows: int) -> tuple[int, int]:
    """(bits, tables) of a sign-projection hash for the wanted recall at the threshold."""
    bits = min(30, max(1, math.ceil(math.log2(max(2.0, n / bucket_rows)))))
    agree = (1.0 - math.acos(max(-1.0, 1.0 - threshold)) / math.pi) ** bits
    tables = math.ceil(math.log(1.0 - recall) / math.log(1.0 - agree)) if agree < 1.0 else 1
    return bits, max(1, tables)


def sketch_cut(threshold: float, loss: float) -> int:
    """Most bits in which two sketches may differ: a pair at the threshold differs in more
    with at most the probability ``loss``."""
    p = math.acos(max(-1.0, 1.0 - threshold)) / math.pi
    below, cut = 0.0, -1
    while below < 1.0 - loss and cut < SKETCH_BITS:
        cut += 1
        below += math.comb(SKETCH_BITS, cut) * p**cut * (1.0 - p) ** (SKETCH_BITS - cut)
    return cut


def sign_hashes(df: DataFrame, bits: int, tables: int, seed: int = 42) -> DataFrame:
    """Add ``sigs``, one integer per hash table, and ``sketch``, SKETCH_BITS further bits:
    all of them signs of random projections."""
    names = df.columns
    place = names.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = unit_rows(as_matrix(batch.column(place)))
            if planes is None:
                rng = np.random.default_rng(seed)
                planes = rng.standard_normal((x.shape[1], tables * bits + SKETCH_BITS))
            signs = x @ planes >= 0
            sigs = (signs[:, : tables * bits].reshape(len(x), tables, bits) * weights).sum(axis=2)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(sigs.reshape(-1))
            )
            sketch = as_binary(np.packbits(signs[:, tables * bits :], axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists, sketch], [*names, "sigs", "sketch"]
            )

    more = [T.StructField("sigs", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    return df.mapInArrow(run, T.StructType(df.schema.fields + more))


def screen_kernel(cut: int):
    """Task function: pairs of rows of two blocks whose sketches differ in few bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if table.num_rows == 0:
            return
        side, row = table.column("side").to_numpy(), table.column("row").to_numpy()
        words = fixed_width(table.column("sketch").combine_chunks(), SKETCH_BITS // 8)
        words = np.ascontiguousarray(words).view(np.uint64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        if same:
            right = left
        for lo in range(0, len(left), SCREEN_ROWS):
            strip = words[left[lo : lo + SCREEN_ROWS]]
            differ = np.zeros((len(strip), len(right)), np.uint16)
            for w in range(words.shape[1]):
                differ += np.bitwise_count(strip[:, w, None] ^ words[right, w])
            near = differ <= cut
            if same:
                near &= np.arange(len(right))[None, :] > (lo + np.arange(len(strip)))[:, None]
            i, j = np.nonzero(near)
            x, y = row[left[i + lo]], row[right[j]]
            out = pa.table({"row_a": np.minimum(x, y), "row_b": np.maximum(x, y)})
            yield from out.to_batches(max_chunksize=65_536)

    return run


def duplicate_pairs_hashed(
    df: DataFrame,
    threshold: float = 0.05,
    recall: float = 0.999,
    limit: int | None = None,
    id_col: str = "id",
    vector_col: str = "vector",
    key_col: str | None = None,
    block_rows: int = blocks.BLOCK_ROWS,
    bucket_rows: int = blocks.BLOCK_ROWS,
    star: bool = False,
) -> DataFrame:
    """Near-duplicate self-join by locality-sensitive hashing, for tables too large to
    compare exactly.

    Only row numbers and sketches of 32 bytes are dealt to the buckets of the hash tables;
    vectors are joined to the pairs that pass there. Every pair given is checked exactly; a
    pair at the threshold is found with at least the given probability and closer ones with
    a higher one: half of the loss is allowed to the tables, half to the sketch. A zero
    vector has no direction: at distance 1 from all, it is left out for thresholds up to 1,
    and larger thresholds belong to the exact join.
    """
    if threshold > 1.0:
        return duplicate_pairs(
            df, threshold, limit, id_col, vector_col, key_col, block_rows, star
        )
    n = df.count()
    rows = keyed(df, id_col, vector_col, key_col).where(F.exists("vector", lambda x: x != 0))
    copies = collapse(rows)
    loss = (1.0 - recall) / 2.0
    bits, tables = hash_plan(n, threshold, 1.0 - loss, bucket_rows)
    # Written: row numbers must last, and it is read for buckets and for both joins.
    coded = materialise(
        sign_hashes(copies.reps, bits, tables).withColumn("row", F.monotonically_increasing_id()),
        "coded",
    )
    buckets = coded.select("row", "sketch", F.posexplode("sigs").alias("tag", "code"))
    # Only buckets of more than one block need a count; there are few of them.
    hot = (
        coded.select(F.posexplode("sigs").alias("tag", "code"))
        .groupBy("tag", "code")
        .count()
        .where(F.col("count") > block_rows)
        .select("tag", "code", blocks.blocks_needed(F.col("count"), block_rows).alias("n_blocks"))
    )
    sized = buckets.join(hot, ["tag", "code"], "left").withColumn(
        "n_blocks", F.coalesce("n_blocks", F.lit(1))
    )
    own = blocks.block_of("row", F.col("n_blocks"))
    grouped = blocks.spread(sized, blocks.triangle_groups(own, F.col("n_blocks"))).select(
        "tag", "code", "a", "b", "side", "row", "sketch"
    )
    near = grouped.groupBy("tag", "code", "a", "b").applyInArrow(
        screen_kernel(sketch_cut(threshold, loss)), "row_a long, row_b long"
    )
    found = checked(near.distinct(), coded, threshold)
    return finished(found, copies, threshold, limit, key_col is not None, block_rows, star)
