"""PCA reduction, 2-D/3-D maps and a neighbour layout."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.layout import CURVES, ROUNDS, optimise, weighted_edges
from vecloom.operators.neighbours import neighbour_graph
from vecloom.session import materialise

AXES = ("x", "y", "z")
# Standard deviation of the widest axis at the start of a layout.
START_SPREAD = 5.0


def pca_reduce(
    df: DataFrame, k: int | None = None, id_col: str = "id", vector_col: str = "vector"
) -> DataFrame:
    """(id, reduced): centred PCA coordinates, by default ``min(50, dim, n - 1)`` of them.

    Either sign of a component is valid; here its largest loading is positive.
    """
    source = df.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        array_to_vector(F.col(vector_col).cast("array<double>")).alias("raw"),
    )
    n = source.count()
    if n < 2:
        return source.select("id", F.array_repeat(F.lit(0.0), k or 1).alias("reduced"))
    dim = source.first()["raw"].size
    keep = min(k or 50, dim, n - 1)
    fitted = Pipeline(
        stages=[
            StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred"),
            PCA(k=keep, inputCol="centred", outputCol="turned"),
        ]
    ).fit(source)
    loadings = fitted.stages[1].pc.toArray()
    peaks = loadings[np.abs(loadings).argmax(axis=0), np.arange(keep)]
    signs = ElementwiseProduct(
        scalingVec=Vectors.dense(np.where(peaks < 0, -1.0, 1.0)),
        inputCol="turned",
        outputCol="signed",
    )
    out = signs.transform(fitted.transform(source)).select(
        "id", vector_to_array("signed").alias("reduced")
    )
    if k and k > keep:
        out = out.withColumn(
            "reduced", F.concat("reduced", F.array_repeat(F.lit(0.0), k - keep))
        )
    return out


def project(df: DataFrame, n_components: int = 2, **columns) -> DataFrame:
    """(id, x, y[, z]) on the first principal axes."""
    if n_components not in (2, 3):
        raise ValueError("n_components must be 2 or 3")
    reduced = pca_reduce(df, n_components, **columns)
    return reduced.select(
        "id", *[F.element_at("reduced", i + 1).alias(AXES[i]) for i in range(n_components)]
    )


def layout(
    df: DataFrame,
    n_components: int = 2,
    rounds: int = ROUNDS,
    neighbours: int | None = None,
    method: str = "umap",
    exact: bool = False,
    id_col: str = "id",
    vector_col: str = "vector",
    **options,
) -> DataFrame:
    """(id, x, y[, z]): a map that keeps near rows near.

    The map starts from the leading principal axes, and neighbour edges, weighted as
    ``method`` says, move its points (see layout.py). Neighbours are found by descent, or
    exactly if asked for; nothing that grows with the table is broadcast. Ids are unique.
    """
    axes = AXES[:n_components]
    rows = df.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("vector")
    )
    n = rows.count()
    if n < 3:
        return project(rows, n_components)
    start = materialise(project(rows, n_components), "layout-start")
    k = min(n - 1, neighbours or max(5, min(30, n - 1)))
    graph = neighbour_graph(rows, k, exact=exact)
    edges = materialise(weighted_edges(graph, k, method), "layout-edges")
    size = start.agg(*[F.stddev(a).alias(a) for a in axes]).first()
    wide = max(size[a] or 0.0 for a in axes) or 1.0
    points = start.select("id", *[(F.col(a) * (START_SPREAD / wide)).alias(a) for a in axes])
    return optimise(points, edges, axes, method, k, rounds, **options)


def reduce_dimensions(
    df: DataFrame, method: str = "tsne", n_components: int = 2, **options
) -> DataFrame:
    """``pca`` is the linear map; ``tsne`` and ``umap`` are neighbour layouts that differ in how
    edges are weighted and in the curve of attraction."""
    if method == "pca":
        return project(df, n_components, **options)
    if method in CURVES:
        return layout(df, n_components, method=method, **options)
    raise ValueError(f"unknown reduction method {method!r}; there are pca, tsne and umap")
