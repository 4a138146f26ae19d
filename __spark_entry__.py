"""

Every query runs over whole tables of the given data. Sinks write to a fresh folder under
``spark.checkpoint.dir`` and are read back.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import paths, vectors
from vecloom.functions.encoders import embed, hashed_bytes, hashed_words
from vecloom.operators import (
    ann,
    clusters,
    layout,
    neighbours,
    pairs,
    probing,
    projection,
    quantize,
    reports,
    search,
)
from vecloom.plans import ingest
from vecloom.plans.engine import VectorEngine
from vecloom.session import even_scan, scratch_path
from vecloom.sources import files, synthetic, tables
from vecloom.streaming import ingest as streaming

# The pipeline's operators are a part of their own that may be absent, or need a library that is.
# What the rest needs has been imported above, so its own errors are not hidden.
try:
    import corpus_pipeline
    from vecloom.llm import queries as llm
except ModuleNotFoundError:
    llm = None

# Fewer names than labels, so that some rows have none.
CLASS_NAMES = ["red", "orange", "yellow", "green", "blue", "indigo", "violet", "grey"]


# -- Inputs ---------------------------------------------------------------------------


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vector_table(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Image-like columns derived from the id."""
    return vector_table(spark, sf).select(
        F.format_string("/data/img_%06d.jpg", "id").alias("id"),
        "vector",
        (F.lit(320) + (F.col("id") * 37) % 3000).cast("int").alias("width"),
        (F.lit(1000) + (F.col("id") * 7919) % 6000000).alias("file_size"),
    )


def planted(spark: SparkSession, sf: str) -> DataFrame:
    """Every row three times: as it is, scaled, and with its first element moved."""
    base = vector_table(spark, sf).select("id", "vector")
    scaled = base.select(
        (F.col("id") + 1000000).alias("id"),
        F.transform("vector", lambda x: (x * 1.5).cast("float")).alias("vector"),
    )
    moved = base.select(
        (F.col("id") + 2000000).alias("id"),
        F.transform(
            "vector", lambda x, i: F.when(i == 0, (x + 0.2).cast("float")).otherwise(x)
        ).alias("vector"),
    )
    return base.unionByName(scaled).unionByName(moved)


def class_means(df: DataFrame) -> DataFrame:
    """(label, mean): the mean vector per class, combined before the shuffle."""
    return df.groupBy("label").agg(clusters.mean_vector("vector").alias("mean"))


def mean_matrix(df: DataFrame):
    table = class_means(df).orderBy("label").toArrow()
    return vectors.as_matrix(table.column("mean"))


def first_vector(df: DataFrame):
    return df.orderBy("id").select("vector").first()["vector"]


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    texts = even_scan(read(spark, sf, "documents").select("doc_id", "text"))
    return texts.select(
        F.col("doc_id").alias("id"), embed(F.col("text"), hashed_words(64)).alias("vector")
    )


def png(width: int, height: int, shade: int) -> bytes:
    """A grey picture."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        check = zlib.crc32(kind + body)
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", check)

    lines = (b"\0" + bytes([shade]) * width) * height
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", head)
        + chunk(b"IDAT", zlib.compress(lines))
        + chunk(b"IEND", b"")
    )


def picture_tree(spark: SparkSession, sf: str) -> str:
    """A folder with a picture for every row of ``embeddings``, written by tasks: its size
    follows from the id, every tenth is empty, every tenth is cut short, and each class has a
    folder of its own."""
    root = scratch_path(spark, "pictures").removeprefix("file://")

    def write(batches):
        for batch in batches:
            for number, label in zip(*(c.to_pylist() for c in batch.columns)):
                data = png(1 + number % 37, 1 + number % 11, number % 256)
                data = {3: b"", 7: data[:-6]}.get(number % 10, data)
                os.makedirs(f"{root}/class {label}", exist_ok=True)
                with open(f"{root}/class {label}/{number}.png", "wb") as file:
                    file.write(data)
            yield batch

    rows = vector_table(spark, sf).select("id", "label")
    rows.mapInArrow(write, rows.schema).count()
    return root


def number_of(path: str) -> Column:
    return F.regexp_extract(path, r"(\d+)\.png$", 1).cast("long")


# -- Queries --------------------------------------------------------------------------


def q_scan_vectors(spark, sf):
    path = scratch_path(spark, "scan")
    tables.append_vectors(vector_table(spark, sf).select("id", "vector"), path)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return tables.scan_vectors(spark, path).select(
        "id", F.size("vector").alias("dim"), F.round(total, 6).alias("total")
    )


def q_append_vectors(spark, sf):
    path = scratch_path(spark, "append")
    rows = vector_table(spark, sf).select("id", "vector")
    tables.append_vectors(rows, path)
    tables.append_vectors(rows, path)
    return tables.read_table(spark, path).groupBy("id").agg(F.count("*").alias("copies"))


def q_quantize_f16(spark, sf):
    path = scratch_path(spark, "half")
    tables.append_vectors(vector_table(spark, sf).select("id", "vector"), path)
    quantize.quantize_table(spark, path)
    quantize.quantize_table(spark, path)  # the second time nothing is left to do
    stored = tables.read_table(spark, path)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    sizes = stored.select("id", F.length("vector").alias("bytes"))
    decoded = quantize.from_half(stored).select("id", F.round(total, 6).alias("total"))
    return sizes.join(decoded, "id")


def q_search_topk(spark, sf):
    df = vector_table(spark, sf)
    return rounded(search.search_topk(df, first_vector(df), 10))


def q_search_filtered(spark, sf):
    query = first_vector(vector_table(spark, sf))
    where = "width > 1920 AND file_size < 5000000"
    return rounded(search.search_topk(with_metadata(spark, sf), query, 10, where))


def q_filter_guard(spark, sf):
    """What a filter may name in a table with metadata and in one without, and how many rows a
    search with that filter finds; where a column is missing the search is refused."""
    rows = with_metadata(spark, sf)
    facts = rows.withColumn("height", F.lit(480)).withColumn("file_mtime", F.lit(1.5))
    found = []
    engine = VectorEngine(spark, scratch_path(spark, "guard"))
    for name, table in (("full", facts), ("plain", rows.select("id", "vector"))):
        engine.append(table, name)
        columns = engine.filter_columns(name)
        try:
            search.filtered(engine.table(name), None, ["width", "file_size"])
            where = engine.table(name).where("width > 1920 AND file_size < 5000000")
            refused = where.select(F.lit(False).alias("refused"))
        except ValueError:
            refused = engine.table(name).select(F.lit(True).alias("refused"))
        found.append(
            refused.groupBy("refused").agg(F.count("*").alias("n_rows")).select(
                F.lit(name).alias("name"), F.lit(",".join(columns)).alias("columns"), "refused", "n_rows"
            )
        )
    return found[0].unionByName(found[1])


def q_search_batch(spark, sf):
    df = vector_table(spark, sf)
    means = class_means(df).select(F.col("label").alias("qid"), F.col("mean").alias("qv"))
    return rounded(search.search_batch(df, means, 10))


def q_search_json(spark, sf):
    path = scratch_path(spark, "json")
    tables.write_json(q_search_batch(spark, sf), path)
    return spark.read.schema("qid int, id long, distance double, rank int").json(path)


def q_search_text(spark, sf):
    asked = read(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), embed(F.col("text"), hashed_words(64)).alias("qv")
    )
    return rounded(search.search_batch(documents(spark, sf), asked, 5))


def q_embed_documents(spark, sf):
    checksum = F.aggregate(
        F.transform("vector", lambda x, i: x.cast("double") * (i + 1)),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    return documents(spark, sf).select(
        "id",
        F.round(vectors.dot(F.col("vector"), F.col("vector")), 6).alias("sum_sq"),
        F.round(checksum, 6).alias("checksum"),
    )


def q_distinct_ids(spark, sf):
    rows = vector_table(spark, sf).select("id", "vector")
    return search.distinct_ids(rows.unionByName(rows))


def q_cosine_distance(spark, sf):
    df = vector_table(spark, sf)
    means = class_means(df)
    return df.join(means, "label").select(
        "id",
        (F.round(vectors.cosine_distance(F.col("vector"), F.col("mean")), 6) + 0.0).alias(
            "distance"
        ),
    )


def q_l2_normalize(spark, sf):
    unit = planted(spark, sf).select("id", vectors.l2_normalize(F.col("vector")).alias("u"))
    return unit.select(
        "id",
        F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("sum_sq"),
        (F.round(F.element_at("u", 1), 6) + 0.0).alias("first"),
    )


def q_table_stats(spark, sf):
    return tables.table_stats(spark, f"{sf}/embeddings.parquet", "embeddings")


def q_export_by_class(spark, sf):
    path = scratch_path(spark, "export")
    rows = vector_table(spark, sf).select(
        "id",
        paths.numbered_class(F.col("label")).alias("class_name"),
        paths.export_name(F.col("id"), "train").alias("file_name"),
    )
    tables.export_by_class(rows, path)
    return spark.read.parquet(path).select(
        "id", "file_name", F.col("class_name").cast("string").alias("class_name")
    )


def q_list_images(spark, sf):
    listed = files.list_images(spark, picture_tree(spark, sf))
    return listed.select(
        number_of("id").alias("id"),
        paths.last_two_parts(F.col("id")).alias("last_two"),
        (F.col("file_size") == 0).alias("empty"),
    )


def q_image_metadata(spark, sf):
    found = files.image_metadata(spark, picture_tree(spark, sf))
    return found.select(
        number_of("id").alias("id"), "width", "height", F.col("error").isNotNull().alias("failed")
    )


def q_tree_usage(spark, sf):
    return files.tree_usage(spark, picture_tree(spark, sf)).select("files")


def q_index_files(spark, sf):
    """Ingest of a tree, twice: the second run skips what is there and tries the rest again."""
    root, table = picture_tree(spark, sf), scratch_path(spark, "indexed")
    first = ingest.index_files(spark, root, table, hashed_bytes(16))
    again = ingest.index_files(spark, root, table, hashed_bytes(16))
    return first.withColumn("run", F.lit(1)).unionByName(again.withColumn("run", F.lit(2)))


def q_stream_ingest(spark, sf):
    root, table = picture_tree(spark, sf), scratch_path(spark, "streamed")
    rejects, state = scratch_path(spark, "rejects"), scratch_path(spark, "state")
    streaming.stream_ingest(
        spark, root, table, rejects, state, hashed_bytes(16)
    ).awaitTermination()
    return tables.read_table(spark, table).select(number_of("id").alias("id"), "width", "height")


def q_synthetic_vectors(spark, sf):
    ids = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    made = synthetic.synthetic_vectors(ids, 64)
    return made.select(
        "id",
        F.size("vector").alias("dim"),
        F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"),
        F.round(F.element_at("vector", 64).cast("double"), 5).alias("last"),
    )


def q_incremental_new_ids(spark, sf):
    listing = read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    known = read(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return ingest.new_ids(listing, known)


def q_ingest_stats(spark, sf):
    known = read(spark, sf, "labels").select("doc_id").distinct().withColumn("seen", F.lit(True))
    listing = read(spark, sf, "documents").select("doc_id", "n_chars").join(known, "doc_id", "left")
    return ingest.ingest_counters(
        listing, F.col("seen").isNotNull(), F.col("n_chars") < 100, batch_size=256
    )


def q_duplicate_pairs(spark, sf):
    return rounded(pairs.duplicate_pairs(planted(spark, sf), 0.05))


def q_duplicate_pairs_lsh(spark, sf):
    return rounded(pairs.duplicate_pairs_hashed(planted(spark, sf), 0.05, recall=0.999999))


def q_duplicate_top(spark, sf):
    return rounded(pairs.duplicate_pairs(vector_table(spark, sf), 0.6, limit=20))


def q_knn_graph(spark, sf):
    return rounded(neighbours.neighbour_graph(vector_table(spark, sf), 10))


def q_label_lookup(spark, sf):
    rows = vector_table(spark, sf).select("id", "label")
    return paths.attach_class_name(rows, "label", CLASS_NAMES).select("id", "label", "class_name")


def q_class_name(spark, sf):
    return vector_table(spark, sf).select(
        "id",
        paths.numbered_class(F.col("label")).alias("class_name"),
        paths.export_name(F.col("id")).alias("file_name"),
    )


def q_path_parts(spark, sf):
    url = F.col("url")
    return read(spark, sf, "pages").select(
        "page_id",
        paths.base_name(url).alias("base"),
        paths.last_two_parts(url).alias("last_two"),
        paths.suffix(url).alias("suffix"),
    )


def q_cluster_groups(spark, sf):
    groups = clusters.cluster_groups(vector_table(spark, sf), cluster_col="label")
    return groups.select("cluster", "part", "n", F.array_join("ids", ",").alias("ids"))


def q_cluster_preview(spark, sf):
    return clusters.cluster_preview(vector_table(spark, sf), 6, cluster_col="label")


def q_centroid_assign(spark, sf):
    df = vector_table(spark, sf)
    placed = clusters.assign_nearest(df.select("id", "vector"), mean_matrix(df))
    return placed.groupBy("cluster").agg(
        F.count("*").alias("n"), F.round(F.sum("d2"), 6).alias("inertia")
    )


def q_cluster_kmeans(spark, sf):
    df = vector_table(spark, sf).select("id", "vector")
    placed = clusters.cluster_rows(df, 10, starts=3)
    return placed.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("id").alias("n_assigned"),
        F.countDistinct("cluster").alias("n_clusters"),
    )


def q_cluster_minibatch(spark, sf):
    """Groups by mini-batches of an eighth of the rows cost at most a fiftieth more than groups
    fitted on all of them; every row has one."""
    df = vector_table(spark, sf).select("id", "vector")
    batch_rows = max(100, df.count() // 8)
    full, some = (
        clusters.cluster_stats(clusters.cluster_rows(df, 10, **options), 10)
        for options in ({}, {"minibatch": True, "batch_rows": batch_rows})
    )
    cost = full.select("n_images", F.col("inertia").alias("full"))
    # Two single rows.
    return cost.join(some.select("n_images", "inertia"), "n_images").select(
        F.col("n_images").alias("n_rows"), (F.col("inertia") <= 1.02 * F.col("full")).alias("near")
    )


def q_kmeans_rounds(spark, sf):
    """Two rounds from the class means, over all rows."""
    df = vector_table(spark, sf)
    centres = clusters.lloyd_rounds(df, mean_matrix(df), 2)
    placed = clusters.assign_nearest(df.select("id", "vector"), centres)
    return placed.groupBy("cluster").agg(
        F.count("*").alias("n"), F.round(F.sum("d2"), 6).alias("inertia")
    )


def q_latency_summary(spark, sf):
    return reports.latency_summary(read(spark, sf, "events"), "event_type", "value", digits=6)


def q_throughput(spark, sf):
    totals = read(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("seconds")
    )
    rate = reports.throughput(F.col("n"), F.col("seconds"))
    return totals.select("event_type", "n", F.round(rate, 6).alias("per_s"))


def q_bench_report(spark, sf):
    return reports.bench_report(read(spark, sf, "events"), "event_type", "value")


def q_bench_record(spark, sf):
    """Each class as a dataset, its latencies from the events, written as nested JSON."""
    df = vector_table(spark, sf)
    runs = read(spark, sf, "events").select(
        (F.col("event_id") % 10).cast("int").alias("dataset"), "value"
    )
    failed = F.count_if(F.col("id") % 50 == 7)
    ingest = df.groupBy(F.col("label").alias("dataset")).agg(
        F.count("*").alias("num_images"),
        reports.rounded(F.sum(F.size("vector") * 4) / 1e3, 1).alias("dataset_size_mb"),
        (F.count("*") - failed).alias("indexed"),
        failed.alias("errors"),
        (F.count("*") / 100).alias("ingest_time_s"),
        reports.rounded((F.count("*") - failed) * 0.25, 1).alias("db_size_mb"),
    )
    means = class_means(df).select(F.col("label").alias("qid"), F.col("mean").alias("qv"))
    found = rounded(search.search_batch(df, means, 3))
    samples = reports.sample_results(found).select(
        F.col("qid").alias("dataset"),
        F.concat(F.lit("mean of "), "qid").alias("sample_query"),
        "sample_results",
    )
    record = reports.bench_record(reports.bench_report(runs, "dataset", "value"), ingest, samples)
    path = scratch_path(spark, "record")
    tables.write_json(record, path)
    back = spark.read.schema(record.schema).json(path)
    shown = F.transform(
        "sample_results", lambda r: F.concat(r["id"], F.lit("@"), F.format_number(r["distance"], 5))
    )
    return back.withColumn("sample_results", F.array_join(shown, " "))


def q_scaling_factor(spark, sf):
    events = read(spark, sf, "events").select("event_type", "value")
    sizes = events.groupBy("event_type").agg(F.count("*").alias("size"))
    scaled = reports.scaling_factor(events.join(sizes, "event_type"), "size", "value")
    return scaled.select(
        "n", F.round("avg_ms", 6).alias("avg_ms"), F.round("factor", 6).alias("factor")
    )


def q_preview_sample(spark, sf):
    return search.preview_sample(vector_table(spark, sf).select("id", "label"), 8, seed=7)


def q_pca_reduce(spark, sf):
    return projection.pca_reduce(vector_table(spark, sf))


def q_pca_centred_norms(spark, sf):
    """With all components kept PCA is a turn about the mean, so lengths from it stay."""
    turned = projection.pca_reduce(vector_table(spark, sf), 64)
    return turned.select(
        "id", F.round(vectors.dot(F.col("reduced"), F.col("reduced")), 6).alias("sum_sq")
    )


def q_project_2d(spark, sf):
    return projection.project(vector_table(spark, sf), 2)


def q_project_3d(spark, sf):
    return projection.project(vector_table(spark, sf), 3)


def q_layout_2d(spark, sf):
    return projection.layout(vector_table(spark, sf), 2)


def q_ivf_cells(spark, sf):
    df = vector_table(spark, sf).select("id", "vector")
    placed = ann.ivf_cells(df, ann.fit_cells(df, 16))
    return placed.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("id").alias("n_assigned"),
        F.countDistinct("cell").alias("n_cells"),
    )


def q_pq_encode(spark, sf):
    df = vector_table(spark, sf).select("id", "vector")
    books = ann.codebook_matrix(ann.train_codebooks(df, 16))
    return ann.pq_encode(df, books).select("id", F.length("codes").alias("code_bytes"))


def q_ivf_nearest(spark, sf):
    """How many centroids are nearer to a row than the one of its cell: none."""
    df = vector_table(spark, sf).select("id", "vector")
    centroids = ann.fit_cells(df, 16)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    placed = ann.ivf_cells(df, centroids).withColumn("u", vectors.l2_normalize(F.col("vector")))
    gaps = placed.select(
        "id", "cell", F.transform(table, lambda c: vectors.squared_distance(F.col("u"), c)).alias("d")
    )
    nearer = F.filter("d", lambda x: x < F.get("d", F.col("cell")) - 1e-9)
    return gaps.select("id", F.size(nearer).alias("nearer"))


def q_pq_nearest(spark, sf):
    """How many centres of its code books are nearer to a row than its codes say: none."""
    df = vector_table(spark, sf).select("id", "vector")
    books = ann.train_codebooks(df, 16)
    coded = ann.pq_encode(df, ann.codebook_matrix(books)).withColumn(
        "u", vectors.l2_normalize(F.col("vector"))
    )
    pieces = coded.select(
        "id",
        F.posexplode(
            F.expr(
                "transform(sequence(1, 16), i -> struct("
                "cast(conv(hex(substring(codes, i, 1)), 16, 10) AS int) AS code,"
                "slice(u, (i - 1) * 4 + 1, 4) AS piece))"
            )
        ).alias("sub", "p"),
    )
    # At most 256 centres of a few numbers for each sub-space.
    centres = books.groupBy("sub").agg(
        F.sort_array(F.collect_list(F.struct("code", "centre"))).alias("all")
    )
    gaps = pieces.join(centres, "sub").withColumn(
        "d", F.transform("all", lambda c: vectors.squared_distance(F.col("p.piece"), c["centre"]))
    )
    nearer = F.filter("d", lambda x: x < F.get("d", F.col("p.code")) - 1e-6)
    return gaps.groupBy("id").agg(F.sum(F.size(nearer)).alias("nearer"))


def q_search_ivf_appended(spark, sf):
    """An index of half of the rows that takes in the rest finds all of them."""
    df = vector_table(spark, sf).select("id", "vector").withColumn("row_key", F.col("id"))
    path = scratch_path(spark, "ivf-half")
    ann.create_index(df.where("id % 2 = 1"), path, num_partitions=8, num_sub_vectors=16)
    ann.update_index(df, path)
    return rounded(ann.search_index(spark, path, first_vector(df), 10, nprobe=8, refine=None))


def q_preview_check(spark, sf):
    rows = vector_table(spark, sf).select("id", "label")
    shown = search.preview_sample(rows, 8, seed=7)
    return shown.join(rows, ["id", "label"], "left_semi").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("n_ids")
    )


def map_moments(placed: DataFrame, df: DataFrame, axes: list[str]) -> DataFrame:
    """Means and covariances of a linear map, and whether its first axis varies at least as
    much as any column of the vectors."""
    spread = df.select(F.posexplode("vector").alias("i", "v")).groupBy("i").agg(
        F.var_pop(F.col("v").cast("double")).alias("var")
    )
    widest = spread.agg(F.max("var")).first()[0]
    pairs = [(a, b) for k, a in enumerate(axes) for b in axes[k + 1 :]]
    return placed.agg(
        F.count("*").alias("n"),
        *[(F.round(F.avg(a), 6) + 0.0).alias(f"mean_{a}") for a in axes],
        *[(F.round(F.covar_pop(a, b), 6) + 0.0).alias(f"cov_{a}{b}") for a, b in pairs],
        (F.var_pop(axes[0]) >= widest - 1e-9).alias("widest"),
    )


def q_project_2d_moments(spark, sf):
    df = vector_table(spark, sf)
    return map_moments(projection.project(df, 2), df, ["x", "y"])


def q_project_3d_moments(spark, sf):
    df = vector_table(spark, sf)
    return map_moments(projection.project(df, 3), df, ["x", "y", "z"])


def q_layout_ids(spark, sf):
    """Every row has one finite place on the layout."""
    placed = projection.layout(vector_table(spark, sf), 2)
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    return placed.select("id", finite.alias("placed"))


def q_layout_trust(spark, sf):
    """Neighbours on the map against neighbours by distance, asked of one row in twenty: the
    layout keeps them better than the linear map that it starts from."""
    df = vector_table(spark, sf)
    maps = {"moved": projection.layout(df, 2), "linear": projection.project(df, 2)}
    moved, linear = (
        layout.trustworthiness(df, placed, "id % 20 = 0").select(
            "n_rows", "n_asked", F.col("trust").alias(name)
        )
        for name, placed in maps.items()
    )
    # Two single rows.
    return moved.join(linear, ["n_rows", "n_asked"]).select(
        "n_rows", "n_asked", (F.col("moved") > F.col("linear") + 0.02).alias("better")
    )


def q_knn_descent(spark, sf):
    """The share of true neighbours that descent finds, from blocks of 64 rows at the start."""
    df = vector_table(spark, sf)
    exact = neighbours.neighbour_graph(df, 10).select("qid", "id")
    near = neighbours.neighbour_graph(df, 10, exact=False, start_rows=64)
    hits = exact.join(near.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.agg(
        F.countDistinct("qid").alias("n_rows"),
        (F.count("hit") / F.count("*") >= 0.9).alias("recall_reached"),
    )


def q_search_ivf(spark, sf):
    """All cells probed and all rows compared: the same rows as the exact search."""
    df = vector_table(spark, sf).select("id", "vector")
    path = scratch_path(spark, "ivf")
    ann.create_index(df, path, num_partitions=16, num_sub_vectors=16)
    return rounded(ann.search_index(spark, path, first_vector(df), 10, nprobe=16, refine=None))


def index_of_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, str]:
    """The vectors, the queries among them, and the path of an index of 16 cells."""
    df = vector_table(spark, sf)
    path = scratch_path(spark, "ivf-batch")
    ann.create_index(df, path, num_partitions=16, num_sub_vectors=16)
    queries = df.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qv"))
    return df, queries, path


def q_search_ivf_batch(spark, sf):
    """All cells probed by many queries at once, all rows compared: the exact answers."""
    _, queries, path = index_of_rows(spark, sf)
    return rounded(probing.search_index_batch(spark, path, queries, 10, nprobe=16, refine=None))


def q_search_ivf_filtered(spark, sf):
    """One cell to begin with, and a filter that fewer rows pass than are asked for: probing
    goes on until all of them are found, through the codes."""
    _, queries, path = index_of_rows(spark, sf)
    return rounded(probing.search_index_batch(spark, path, queries, 25, 1, where="id % 97 = 5"))


def q_search_ivf_recall(spark, sf):
    """The share of exact answers that three quarters of the cells and a short list by
    16 bytes of codes a row find."""
    df, queries, path = index_of_rows(spark, sf)
    exact = search.search_batch(df, queries, 10).select("qid", "id")
    found = probing.search_index_batch(spark, path, queries, 10, nprobe=12, refine=10)
    hits = exact.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.agg(
        F.countDistinct("qid").alias("n_queries"),
        (F.count("hit") / F.count("*") >= 0.9).alias("recall_reached"),
    )


def q_pq_residual_error(spark, sf):
    """Codes of turned residuals against codes of whole vectors, sixteen bytes a row each: the
    mean squared errors, measured over all rows, compare as they should."""
    df, _, path = index_of_rows(spark, sf)
    model = ann.open_index(spark, path).model
    books = ann.codebook_matrix(ann.train_codebooks(df, 16))
    whole = ann.Model(np.zeros((1, books.shape[0] * books.shape[2])), np.eye(model.turn.shape[0]), books)
    errors = [
        ann.encode_rows(df.select("id", "vector"), m).agg(
            F.count("*").alias("n"), F.avg("code_error").alias("error")
        )
        for m in (model, whole)
    ]
    ours, theirs = (e.select(F.col("n").alias(f"n{i}"), F.col("error").alias(f"e{i}")) for i, e in enumerate(errors))
    both = ours.join(theirs, F.lit(True))  # two single rows
    return both.select(
        F.col("n0").alias("n_rows"), (F.col("n0") == F.col("n1")).alias("same_rows"),
        (F.col("e0") < F.col("e1")).alias("residuals_closer"),
    )


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the ten rows nearest to one vector."""
    return q_search_topk(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        name.removeprefix("q_"): function
        for name, function in globals().items()
        if name.startswith("q_")
    }
    return own | (llm.queries() | {"pipeline": corpus_pipeline.run} if llm else {})


# -- SQL twins ------------------------------------------------------------------------

PLANTED = """
    planted AS (
        SELECT vec_id AS id, embedding AS v FROM embeddings
        UNION ALL
        SELECT vec_id + 1000000, list_transform(embedding, lambda x: (x::double * 1.5)::float)
        FROM embeddings
        UNION ALL
        SELECT vec_id + 2000000, list_prepend((embedding[1]::double + 0.2)::float, embedding[2:])
        FROM embeddings)"""

MEANS = """
    places AS (
        SELECT label, i, avg(embedding[i]::double) AS m
        FROM embeddings, range(1, 65) t(i) GROUP BY label, i),
    means AS (SELECT label, list(m ORDER BY i) AS mean FROM places GROUP BY label)"""

BATCH = f"""
    WITH {MEANS}, d AS (
        SELECT means.label AS qid, e.vec_id AS id,
               round(list_cosine_distance(e.embedding::double[], mean), 12) AS distance
        FROM embeddings e, means),
    r AS (
        SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY distance, id))::int AS rank FROM d)
    SELECT qid, id, round(distance, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 10"""


def topk(source: str, id_expr: str, where: str = "true") -> str:
    return f"""
    WITH q AS (SELECT embedding::double[] AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
    d AS (
        SELECT {id_expr} AS id,
               round(list_cosine_distance(embedding::double[], qv), 12) AS distance
        FROM {source}, q WHERE {where}),
    r AS (SELECT *, (row_number() OVER (ORDER BY distance, id))::int AS rank FROM d)
    SELECT id, round(distance, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 10"""


def sql_round(value: str, digits: int) -> str:
    """Nearest number of so many decimals by the stored value, ties to even."""
    return f"round_even(({value}) * 1e{digits}, 0) / 1e{digits}"


def batch_sql(where: str, k: int) -> str:
    """Top-k of the rows that pass for each row whose id is divisible by 20."""
    return f"""
    WITH d AS (
        SELECT q.vec_id AS qid, e.vec_id AS id,
               round(list_cosine_distance(e.embedding::double[], q.embedding::double[]), 12)
                   AS distance
        FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND {where}),
    r AS (
        SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY distance, id))::int AS rank FROM d)
    SELECT qid, id, round(distance, 6) + 0.0 AS distance, rank FROM r WHERE rank <= {k}"""


def pair_sql(source: str, threshold: float) -> str:
    return f"""
        SELECT a.id AS id_a, b.id AS id_b,
               list_cosine_distance(a.v::double[], b.v::double[]) AS distance
        FROM {source} a JOIN {source} b ON a.id < b.id
        WHERE list_cosine_distance(a.v::double[], b.v::double[]) < {threshold}"""


def encoded(name: str, table: str, key: str) -> str:
    """Unit bag-of-words vectors of a text table, as dense float lists."""
    return f"""
    {name}_tokens AS (SELECT {key} AS k, unnest(string_split(text, ' ')) AS w FROM {table}),
    {name}_counts AS (
        SELECT k, ('0x' || substr(md5(w), 1, 8))::bigint % 64 AS b, count(*) AS c
        FROM {name}_tokens WHERE w <> '' GROUP BY ALL),
    {name}_norms AS (SELECT k, sqrt(sum(c * c)) AS n FROM {name}_counts GROUP BY k),
    {name} AS (
        SELECT {key} AS id,
               list(coalesce(c / n, 0)::float ORDER BY t.b) AS v
        FROM {table} CROSS JOIN range(64) t(b)
        LEFT JOIN {name}_counts x ON x.k = {key} AND x.b = t.b
        LEFT JOIN {name}_norms y ON y.k = {key}
        GROUP BY {key})"""


DUPLICATES = f"""
    WITH {PLANTED}, p AS ({pair_sql('planted', 0.05)})
    SELECT id_a, id_b, round(distance, 6) + 0.0 AS distance FROM p"""

# Pictures that are empty or cut short.
BROKEN = "(vec_id % 10 IN (3, 7))"

# The nearest half-precision number, ties to even.
STEP = "pow(2, greatest(floor(log2(abs(x))), -14) - 10)"
HALF = f"CASE WHEN x = 0 THEN 0 ELSE round_even(x / {STEP}, 0) * {STEP} END"


def assigned(r: int) -> str:
    """Nearest of the centroids c<r>(cluster, mean) for each row, as best<r>."""
    return f"""
    best{r} AS (
        SELECT vec_id, arg_min(cluster, d2) AS cluster, min(d2) AS d2
        FROM (SELECT vec_id, cluster,
                     list_sum(list_transform(list_zip(embedding::double[], mean),
                                             lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
              FROM (SELECT vec_id, embedding FROM embeddings) e, c{r})
        GROUP BY vec_id)"""


def moved(r: int) -> str:
    """Means of the rows of best<r>, as c<r + 1>."""
    return f"""
    c{r + 1} AS (
        SELECT cluster, list(m ORDER BY i) AS mean
        FROM (SELECT cluster, i, avg(embedding[i]::double) AS m
              FROM embeddings JOIN best{r} USING (vec_id), range(1, 65) t(i) GROUP BY cluster, i)
        GROUP BY cluster)"""


KMEANS = f"""
    WITH {MEANS}, c0 AS (SELECT label AS cluster, mean FROM means),
    {assigned(0)}, {moved(0)}, {assigned(1)}, {moved(1)}, {assigned(2)}
    SELECT cluster, count(*) AS n, round(sum(d2), 6) AS inertia FROM best2 GROUP BY cluster"""

WORDS = "('0x' || substr(md5('42:' || vec_id || ':' || i), 1, 8))::bigint / 4294967296.0"


def oracle_sql() -> dict[str, str]:
    more = llm.oracle_sql() if llm else {}
    if llm and corpus_pipeline.ORACLE_SQL:
        more["pipeline"] = corpus_pipeline.ORACLE_SQL
    return more | {
        "scan_vectors": """
            SELECT vec_id AS id, len(embedding)::int AS dim,
                   round(list_sum(embedding::double[]), 6) AS total FROM embeddings""",
        "append_vectors": """
            SELECT id, count(*) AS copies FROM (
                SELECT vec_id AS id FROM embeddings UNION ALL SELECT vec_id FROM embeddings)
            GROUP BY id""",
        "quantize_f16": f"""
            SELECT vec_id AS id, (2 * len(embedding))::int AS bytes,
                   round(list_sum(list_transform(embedding::double[], lambda x: {HALF})), 6) AS total
            FROM embeddings""",
        "kmeans_rounds": KMEANS,
        "cluster_minibatch": "SELECT count(*) AS n_rows, true AS near FROM embeddings",
        "ivf_nearest": "SELECT vec_id AS id, 0::int AS nearer FROM embeddings",
        "pq_nearest": "SELECT vec_id AS id, 0::bigint AS nearer FROM embeddings",
        "search_ivf_appended": topk("embeddings", "vec_id"),
        "filter_guard": """
            SELECT 'full' AS name, 'width,height,file_size,file_mtime' AS columns, false AS refused,
                   count(*) AS n_rows
            FROM embeddings
            WHERE 320 + (vec_id * 37) % 3000 > 1920 AND 1000 + (vec_id * 7919) % 6000000 < 5000000
            UNION ALL
            SELECT 'plain', '', true, count(*) FROM embeddings""",
        "search_ivf_batch": batch_sql("true", 10),
        "search_ivf_filtered": batch_sql("e.vec_id % 97 = 5", 25),
        "search_ivf_recall": """
            SELECT count(*) FILTER (vec_id % 20 = 0) AS n_queries, true AS recall_reached
            FROM embeddings""",
        "layout_trust": """
            SELECT count(*) AS n_rows, count(*) FILTER (vec_id % 20 = 0) AS n_asked, true AS better
            FROM embeddings""",
        "knn_descent": "SELECT count(*) AS n_rows, true AS recall_reached FROM embeddings",
        "pq_residual_error": """
            SELECT count(*) AS n_rows, true AS same_rows, true AS residuals_closer
            FROM embeddings""",
        "preview_check": "SELECT least(8, count(*)) AS n, least(8, count(*)) AS n_ids FROM embeddings",
        "project_2d_moments": """
            SELECT count(*) AS n, 0.0::double AS mean_x, 0.0::double AS mean_y,
                   0.0::double AS cov_xy, true AS widest FROM embeddings""",
        "project_3d_moments": """
            SELECT count(*) AS n, 0.0::double AS mean_x, 0.0::double AS mean_y,
                   0.0::double AS mean_z, 0.0::double AS cov_xy, 0.0::double AS cov_xz,
                   0.0::double AS cov_yz, true AS widest FROM embeddings""",
        "layout_ids": "SELECT vec_id AS id, true AS placed FROM embeddings",
        "search_topk": topk("embeddings", "vec_id"),
        "search_filtered": topk(
            "embeddings",
            "'/data/img_' || lpad(vec_id::varchar, 6, '0') || '.jpg'",
            "320 + (vec_id * 37) % 3000 > 1920 AND 1000 + (vec_id * 7919) % 6000000 < 5000000",
        ),
        "search_batch": BATCH,
        "search_json": BATCH,
        "search_text": f"""
            WITH {encoded('docs', 'documents', 'doc_id')},
            {encoded('asked', 'benchmark', 'item_id')},
            d AS (
                SELECT a.id AS qid, d.id,
                       round(1 - CASE WHEN list_dot_product(d.v::double[], d.v::double[]) = 0
                                   OR list_dot_product(a.v::double[], a.v::double[]) = 0 THEN 0
                             ELSE list_cosine_similarity(d.v::double[], a.v::double[]) END, 12)
                       AS distance
                FROM docs d, asked a),
            r AS (
                SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY distance, id))::int AS rank
                FROM d)
            SELECT qid, id, round(distance, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 5""",
        "embed_documents": f"""
            WITH {encoded('docs', 'documents', 'doc_id')}
            SELECT id, round(list_dot_product(v::double[], v::double[]), 6) AS sum_sq,
                   round(list_dot_product(v::double[], range(1, 65)::double[]), 6) AS checksum
            FROM docs""",
        "distinct_ids": "SELECT DISTINCT vec_id AS id FROM embeddings",
        "cosine_distance": f"""
            WITH {MEANS}
            SELECT vec_id AS id,
                   round(list_cosine_distance(embedding::double[], mean), 6) + 0.0 AS distance
            FROM embeddings JOIN means USING (label)""",
        "l2_normalize": f"""
            WITH {PLANTED}, n AS (
                SELECT id, v::double[] AS v,
                       sqrt(list_dot_product(v::double[], v::double[])) AS n FROM planted)
            SELECT id,
                   round(list_sum(list_transform(v, lambda x: (x / n) * (x / n))), 6) AS sum_sq,
                   round(v[1] / n, 6) + 0.0 AS first
            FROM n""",
        "table_stats": """
            SELECT 'embeddings' AS "table", count(*) AS row_count, NULL::varchar AS error
            FROM embeddings""",
        "export_by_class": """
            SELECT vec_id AS id, printf('train_%05d.jpg', vec_id) AS file_name,
                   printf('class_%03d', label) AS class_name FROM embeddings""",
        "list_images": """
            SELECT vec_id AS id, 'class ' || label || '/' || vec_id || '.png' AS last_two,
                   vec_id % 10 = 3 AS empty FROM embeddings""",
        "image_metadata": f"""
            SELECT vec_id AS id, CASE WHEN NOT {BROKEN} THEN (1 + vec_id % 37)::int END AS width,
                   CASE WHEN NOT {BROKEN} THEN (1 + vec_id % 11)::int END AS height,
                   {BROKEN} AS failed FROM embeddings""",
        "tree_usage": "SELECT count(*) AS files FROM embeddings",
        "index_files": f"""
            WITH n AS (
                SELECT count(*) FILTER (NOT {BROKEN}) AS good, count(*) FILTER ({BROKEN}) AS bad
                FROM embeddings)
            SELECT 1 AS run, good AS total_indexed, bad AS total_errors,
                   ceil(good / 256.0)::bigint AS total_batches, 0::bigint AS total_skipped FROM n
            UNION ALL SELECT 2, 0, bad, 0, good FROM n""",
        "stream_ingest": f"""
            SELECT vec_id AS id, (1 + vec_id % 37)::int AS width, (1 + vec_id % 11)::int AS height
            FROM embeddings WHERE NOT {BROKEN}""",
        "synthetic_vectors": f"""
            WITH e AS (SELECT vec_id, i, {WORDS} AS x FROM embeddings, range(64) t(i)),
            n AS (SELECT vec_id, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM e
                  GROUP BY vec_id)
            SELECT vec_id AS id, len(v)::int AS dim, round((v[1] / n)::float::double, 5) AS first,
                   round((v[64] / n)::float::double, 5) AS last FROM n""",
        "incremental_new_ids": """
            SELECT doc_id AS id FROM documents ANTI JOIN labels USING (doc_id)""",
        "ingest_stats": """
            WITH f AS (
                SELECT doc_id IN (SELECT doc_id FROM labels) AS known, n_chars < 100 AS failed
                FROM documents)
            SELECT count(*) FILTER (NOT known AND NOT failed) AS total_indexed,
                   count(*) FILTER (NOT known AND failed) AS total_errors,
                   ceil(count(*) FILTER (NOT known AND NOT failed) / 256.0)::bigint
                       AS total_batches,
                   count(*) FILTER (known) AS total_skipped
            FROM f""",
        "duplicate_pairs": DUPLICATES,
        "duplicate_pairs_lsh": DUPLICATES,
        "duplicate_top": f"""
            WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings),
            p AS ({pair_sql('e', 0.6)})
            SELECT id_a, id_b, round(distance, 6) + 0.0 AS distance FROM p
            ORDER BY round(p.distance, 12), id_a, id_b LIMIT 20""",
        "knn_graph": """
            WITH d AS (
                SELECT a.vec_id AS qid, b.vec_id AS id,
                       round(list_cosine_distance(a.embedding::double[], b.embedding::double[]),
                             12) AS distance
                FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
            r AS (
                SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY distance, id))::int AS rank
                FROM d)
            SELECT qid, id, round(distance, 6) + 0.0 AS distance, rank FROM r
            WHERE rank <= 10""",
        "label_lookup": f"""
            WITH names AS (
                SELECT unnest({CLASS_NAMES}) AS name, unnest(range({len(CLASS_NAMES)})) AS label)
            SELECT vec_id AS id, e.label, coalesce(name, 'unlabeled') AS class_name
            FROM embeddings e LEFT JOIN names USING (label)""",
        "class_name": """
            SELECT vec_id AS id, printf('class_%03d', label) AS class_name,
                   printf('%05d.jpg', vec_id) AS file_name FROM embeddings""",
        "path_parts": r"""
            WITH s AS (
                SELECT page_id, url, string_split(url, '/') AS raw,
                       list_filter(string_split(url, '/'), lambda p: p <> '') AS parts
                FROM pages)
            SELECT page_id, raw[-1] AS base,
                   CASE WHEN contains(url, '/') THEN array_to_string(parts[-2:], '/')
                        ELSE url END AS last_two,
                   lower(regexp_extract(raw[-1], '^.+(\.[^.]+)$', 1)) AS suffix
            FROM s""",
        "cluster_groups": """
            WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
            SELECT label AS cluster,
                   (('0x' || substr(md5(vec_id::varchar), 1, 8))::bigint
                    % ceil(n / 10000.0)::bigint)::int AS part,
                   n, string_agg(vec_id, ',' ORDER BY vec_id) AS ids
            FROM embeddings JOIN n USING (label) GROUP BY 1, 2, 3""",
        "cluster_preview": """
            WITH r AS (
                SELECT label AS cluster, vec_id AS id,
                       (row_number() OVER (PARTITION BY label ORDER BY vec_id))::int AS rank,
                       count(*) OVER (PARTITION BY label) AS size
                FROM embeddings)
            SELECT cluster, rank, id, size, greatest(size - 6, 0) AS more FROM r
            WHERE rank <= 6""",
        "centroid_assign": f"""
            WITH {MEANS}, d AS (
                SELECT vec_id, label,
                       list_sum(list_transform(
                           list_zip(embedding::double[], mean),
                           lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
                FROM (SELECT vec_id, embedding FROM embeddings) e, means),
            best AS (
                SELECT vec_id, arg_min(label, d2) AS cluster, min(d2) AS d2 FROM d
                GROUP BY vec_id)
            SELECT cluster, count(*) AS n, round(sum(d2), 6) AS inertia FROM best
            GROUP BY cluster""",
        "cluster_kmeans": """
            SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_assigned,
                   10::bigint AS n_clusters FROM embeddings""",
        "latency_summary": f"""
            SELECT event_type, {sql_round("avg(value)", 6)} AS mean,
                   {sql_round("quantile_cont(value, 0.5)", 6)} AS p50,
                   {sql_round("quantile_cont(value, 0.95)", 6)} AS p95,
                   {sql_round("quantile_cont(value, 0.99)", 6)} AS p99,
                   {sql_round("min(value)", 6)} AS min, {sql_round("max(value)", 6)} AS max
            FROM events GROUP BY event_type""",
        "throughput": """
            SELECT event_type, count(*) AS n,
                   round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) ELSE 0 END, 6)
                       AS per_s
            FROM events GROUP BY event_type""",
        "bench_report": f"""
            SELECT event_type AS dataset, count(*) AS n,
                   {sql_round("sum(value) / 1000", 1)} AS time_s,
                   {sql_round("CASE WHEN sum(value) > 0 THEN count(*) / (sum(value) / 1000) ELSE 0 END", 1)} AS per_s,
                   {sql_round("avg(value)", 2)} AS query_mean_ms,
                   {sql_round("quantile_cont(value, 0.5)", 2)} AS query_p50_ms,
                   {sql_round("quantile_cont(value, 0.95)", 2)} AS query_p95_ms,
                   {sql_round("quantile_cont(value, 0.99)", 2)} AS query_p99_ms
            FROM events GROUP BY event_type""",
        "bench_record": f"""
            WITH found AS ({BATCH}),
            samples AS (
                SELECT qid AS dataset, 'mean of ' || qid AS sample_query,
                       string_agg(id || '@' || printf('%.5f', distance), ' ' ORDER BY rank)
                           AS sample_results
                FROM found WHERE rank <= 3 GROUP BY qid),
            ingest AS (
                SELECT label AS dataset, count(*) AS num_images,
                       {sql_round("sum(len(embedding) * 4) / 1e3", 1)} AS dataset_size_mb,
                       count(*) FILTER (vec_id % 50 <> 7) AS indexed,
                       count(*) FILTER (vec_id % 50 = 7) AS errors,
                       count(*) / 100 AS ingest_time_s
                FROM embeddings GROUP BY label),
            runs AS (
                SELECT (event_id % 10)::int AS dataset, {sql_round("avg(value)", 2)} AS query_mean_ms,
                       {sql_round("quantile_cont(value, 0.5)", 2)} AS query_p50_ms,
                       {sql_round("quantile_cont(value, 0.95)", 2)} AS query_p95_ms,
                       {sql_round("quantile_cont(value, 0.99)", 2)} AS query_p99_ms
                FROM events GROUP BY 1)
            SELECT dataset, num_images, dataset_size_mb, indexed, errors, ingest_time_s,
                   {sql_round("indexed / ingest_time_s", 1)} AS ingest_throughput_ips,
                   {sql_round("indexed * 0.25::double", 1)} AS db_size_mb, query_mean_ms, query_p50_ms,
                   query_p95_ms, query_p99_ms, sample_query, sample_results
            FROM runs JOIN ingest USING (dataset) JOIN samples USING (dataset)""",
        "scaling_factor": """
            WITH s AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM events),
            m AS (SELECT n, avg(value) AS avg_ms FROM s GROUP BY n)
            SELECT n, round(avg_ms, 6) AS avg_ms,
                   round(avg_ms / first_value(avg_ms) OVER (ORDER BY n), 6) AS factor FROM m""",
        "pca_centred_norms": """
            WITH places AS (
                SELECT i, avg(embedding[i]::double) AS m FROM embeddings, range(1, 65) t(i)
                GROUP BY i),
            centre AS (SELECT list(m ORDER BY i) AS mean FROM places)
            SELECT vec_id AS id,
                   round(list_sum(list_transform(
                       list_zip(embedding::double[], mean),
                       lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS sum_sq
            FROM embeddings, centre""",
        "ivf_cells": """
            SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_assigned,
                   16::bigint AS n_cells FROM embeddings""",
        "pq_encode": "SELECT vec_id AS id, 16::int AS code_bytes FROM embeddings",
        "search_ivf": topk("embeddings", "vec_id"),
    }
