"""Reduction of feature vectors to 2-D points (M1 PCA; M2 neighbour-graph layout, which falls back to it).

PCA is Spark ML's: the covariance is a distributed tree aggregate of a
``d x d`` matrix, with ``d`` bounded by the vocabulary cap (or the embedding
width), and the eigen-solve of that small matrix runs on the driver.
Projection is per row.  Spark's ``transform`` does not centre, so the mean of
the projected columns is subtracted; each component's sign is fixed so its
largest-magnitude loading is positive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.session import ensure_checkpoint_dir


def pca2(features: DataFrame, features_col: str = "features", n_rows: int | None = None,
         keep: tuple[str, ...] = ()) -> DataFrame:
    """M1: ``(record_id, x, y)`` from ``(record_id, features)``, with the columns in ``keep``.

    Components = min(2, n, d); a single component is padded with y = 0.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    first = features.select(features_col).head()
    if first is None:
        raise ValueError("no rows to reduce")
    d = first[0].size
    n = n_rows if n_rows is not None else features.count()
    k = min(2, n, d)
    model = PCA(k=k, inputCol=features_col, outputCol="_pc").fit(features.select(features_col))
    pc = model.pc.toArray()  # d x k, d bounded by the feature cap
    signs = []
    for j in range(k):
        col = pc[:, j]
        idx = int(abs(col).argmax())
        signs.append(-1.0 if col[idx] < 0 else 1.0)
    proj = model.transform(features).select("record_id", *keep, vector_to_array("_pc").alias("_a"))
    coords = [F.element_at("_a", j + 1) * F.lit(signs[j]) for j in range(k)]
    pts = proj.select("record_id", *keep, coords[0].alias("x"),
                      (coords[1] if k > 1 else F.lit(0.0)).alias("y"))
    means = pts.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")).first()
    return pts.select("record_id", *keep, (F.col("x") - F.lit(means["mx"])).alias("x"),
                      (F.col("y") - F.lit(means["my"] if k > 1 else 0.0)).alias("y"))


def layout2(features: DataFrame, features_col: str = "features", n_rows: int | None = None,
            keep: tuple[str, ...] = (), method: str = "pca", neighbours: int = 15, min_dist: float = 0.1,
            seed: int = 42) -> tuple[DataFrame, str]:
    """M2: ``(points, method used)``; ``method`` is ``"pca"`` or ``"neighbours"``.

    The neighbour-graph layout (cosine neighbours, M2a to M2c) starts at the PCA
    points.  Fewer than 2 neighbours, or a graph without edges, give way to PCA (M2d).
    """
    n = n_rows if n_rows is not None else features.count()
    placed = pca2(features, features_col, n, keep)
    k = min(neighbours, n - 1)
    if method == "pca" or k < 2:
        return placed, "pca"
    if method != "neighbours":
        raise ValueError(f"unknown layout {method!r}")
    from pyspark.ml.functions import vector_to_array

    from shoal.operators.layout import fuzzy_graph, layout_epochs
    from shoal.operators.neighbors import knn

    ensure_checkpoint_dir(features.sparkSession)
    kind = features.schema[features_col].dataType.simpleString()
    vector = vector_to_array(features_col) if kind == "vector" else F.col(features_col)
    rows = features.select("record_id", vector.alias("v"))
    graph = fuzzy_graph(knn(rows, k - 1, vector_col="v", metric="cosine", include_self=False, n_rows=n), k).checkpoint()
    if graph.isEmpty():
        return placed, "pca"
    placed = placed.checkpoint()
    moved = layout_epochs(graph, placed.select("record_id", "x", "y"), min_dist=min_dist, seed=seed)
    return (placed.drop("x", "y").join(moved, "record_id") if keep else moved), "neighbours"
