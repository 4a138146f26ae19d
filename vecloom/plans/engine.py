"""One object for a folder of vector tables: ingest, search and analysis as DataFrames."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vecloom.functions.encoders import Encoder
from vecloom.functions.vectors import unit_rows
from vecloom.operators import ann, clusters, pairs, probing, projection, quantize, search
from vecloom.plans.ingest import index_files
from vecloom.session import materialise
from vecloom.sources import tables

DEFAULT_TABLE = "vectors"


class VectorEngine:
    """Vector tables below ``base_path``, on storage every executor can reach."""

    def __init__(
        self,
        spark: SparkSession,
        base_path: str,
        image_encoder: Encoder | None = None,
        text_encoder: Encoder | None = None,
    ):
        self.spark = spark
        self.base_path = base_path.rstrip("/")
        self.image_encoder = image_encoder
        self.text_encoder = text_encoder

    def path(self, table: str) -> str:
        return f"{self.base_path}/{table}"

    def index_path(self, table: str) -> str:
        return f"{self.base_path}/{table}__ivf"

    def table(self, table: str = DEFAULT_TABLE) -> DataFrame:
        return quantize.from_half(tables.read_table(self.spark, self.path(table)))

    def append(self, rows: DataFrame, table: str = DEFAULT_TABLE) -> None:
        tables.append_vectors(rows, self.path(table))
        self.update_index(table)

    def update_index(self, table: str = DEFAULT_TABLE) -> None:
        """Bring rows written since into the search index, if the table has one."""
        if ann.index_exists(self.spark, self.index_path(table)):
            ann.update_index(self.table(table), self.index_path(table))

    def index(
        self,
        data_dir: str,
        batch_size: int = 256,
        table: str = DEFAULT_TABLE,
        incremental: bool = True,
    ) -> DataFrame:
        if self.image_encoder is None:
            raise ValueError("an image encoder is needed to ingest files")
        totals = index_files(
            self.spark, data_dir, self.path(table), self.image_encoder, batch_size, incremental
        )
        self.update_index(table)
        return totals

    def create_index(
        self,
        table: str = DEFAULT_TABLE,
        num_partitions: int = 256,
        num_sub_vectors: int | None = None,
    ) -> None:
        ann.create_index(
            self.table(table), self.index_path(table), num_partitions, num_sub_vectors
        )

    def filter_columns(self, table: str = DEFAULT_TABLE) -> list[str]:
        """Metadata columns a search may filter on; none for a table of vectors only."""
        columns = tables.read_table(self.spark, self.path(table)).columns
        return [c for c in tables.METADATA if c in columns]

    def encode_query(self, query) -> np.ndarray:
        """A raw vector as it is; an existing file is an image; any other string is text."""
        if isinstance(query, (np.ndarray, list, tuple)):
            return np.asarray(query, dtype=np.float32)
        text = str(query)
        # Asked of the path's own file system, so an image may lie on shared storage.
        if tables.is_file(self.spark, text):
            found = self.spark.read.format("binaryFile").load(text).select("content").first()
            encoder, value = self.image_encoder, bytes(found["content"]) if found else b""
        else:
            encoder, value = self.text_encoder, text
        if encoder is None:
            raise ValueError("no encoder for this kind of query")
        return unit_rows(np.asarray(encoder()([value])), np.float32)[0]

    def search(
        self,
        query: str | Path | np.ndarray,
        top_k: int = 5,
        table: str = DEFAULT_TABLE,
        where: str | None = None,
        nprobe: int | None = None,
        refine: int | None = 10,
    ) -> DataFrame:
        """Exact by default; with ``nprobe`` the IVF-PQ index is searched."""
        vector = self.encode_query(query)
        if nprobe is not None:
            return ann.search_index(
                self.spark, self.index_path(table), vector, top_k, nprobe, where, refine
            )
        return search.search_topk(self.table(table), vector, top_k, where)

    def search_batch(
        self,
        queries: DataFrame,
        top_k: int = 5,
        table: str = DEFAULT_TABLE,
        where: str | None = None,
        nprobe: int | None = None,
        refine: int | None = 10,
        **options,
    ) -> DataFrame:
        """Top-k for each row of queries(qid, qv): exact, or from the index with ``nprobe``."""
        if nprobe is not None:
            return probing.search_index_batch(
                self.spark, self.index_path(table), queries, top_k, nprobe, where, refine, **options
            )
        return search.search_batch(self.table(table), queries, top_k, where, **options)

    def index_report(self, table: str = DEFAULT_TABLE) -> DataFrame:
        """How well the code books still fit each batch of the index."""
        return ann.index_report(self.spark, self.index_path(table))

    def table_stats(self, table: str = DEFAULT_TABLE) -> DataFrame:
        return tables.table_stats(self.spark, self.path(table), table)

    def find_duplicates(
        self,
        threshold: float = 0.05,
        table: str = DEFAULT_TABLE,
        limit: int | None = None,
        exact: bool = True,
        star: bool = False,
    ) -> DataFrame:
        rows = self.table(table)
        key = "row_key" if "row_key" in rows.columns else None
        find = pairs.duplicate_pairs if exact else pairs.duplicate_pairs_hashed
        return find(rows, threshold, limit=limit, key_col=key, star=star)

    def cluster(self, n_clusters: int = 10, table: str = DEFAULT_TABLE, **fit) -> DataFrame:
        return clusters.cluster_rows(self.table(table), n_clusters, **fit)

    def cluster_report(
        self, n_clusters: int = 10, table: str = DEFAULT_TABLE, **fit
    ) -> tuple[DataFrame, DataFrame]:
        """Groups (cluster, part, n, ids) and totals (n_clusters, n_images, inertia) of one fit."""
        placed = materialise(self.cluster(n_clusters, table, **fit).select("id", "cluster", "d2"), "placed")
        return clusters.cluster_groups(placed), clusters.cluster_stats(placed, n_clusters)

    def cluster_stats(self, n_clusters: int = 10, table: str = DEFAULT_TABLE, **fit) -> DataFrame:
        """(n_clusters, n_images, inertia) of a clustering."""
        return clusters.cluster_stats(self.cluster(n_clusters, table, **fit), n_clusters)

    def reduce_dimensions(
        self, method: str = "tsne", n_components: int = 2, table: str = DEFAULT_TABLE
    ) -> DataFrame:
        return projection.reduce_dimensions(self.table(table), method, n_components)

    def quantize_table(self, table: str = DEFAULT_TABLE) -> DataFrame:
        return quantize.quantize_table(self.spark, self.path(table))

    def preview(self, table: str = DEFAULT_TABLE, n: int = 8, seed: int = 0) -> DataFrame:
        return search.preview_sample(tables.read_table(self.spark, self.path(table)), n, seed)
