"""M6: silhouette of a clustering on its 2-D points, noise removed.

``euclidean`` is the reference's score.  It is defined over all pairs of
points, so its cost is O(n^2) work: asking points are hashed into blocks, and each block
meets all points (beyond ``MOST_ASKED`` in several parts) in one
cogroup, where NumPy sums the distances from each asking point to each
cluster, a few at a time.  No pair row is ever emitted -- the output
is one row per (point, cluster, part) -- and the per-point sums are
combined by a two-level aggregate.  Points are copied once for each block, so there are only as many
blocks as keep the machines busy (``SIDES``): what is shuffled grows like the points.

``squared_euclidean`` is Spark's ``ClusteringEvaluator`` score: exact for
squared distances, O(n * k) work, for clusterings too large for the
all-pairs score.  It is a different number, named as such.

``euclidean_tree`` is the reference's score from a tree of blocks
(:mod:`shoal.operators.silhouette_tree`): near blocks exactly, far ones within a
proven bound, which :func:`silhouette_within` returns.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators.spanning import by_block

#: Points of an asking block at least, blocks up to which smaller blocks are preferred, the points that a block asks at once, and
#: its points times clusters at most.
BLOCK_SIZE, SIDES, MOST_ASKED, MOST_SUMS = 2048, 24, 1 << 20, 1 << 22
#: Distances computed at once, and those of one asking point.
ENTRIES, COLUMNS = 1 << 17, 4096
#: Tasks for each block, so that two blocks rarely share one.
SPREAD = 8


def _distance_sums(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each point ``(x, y)`` the sums of its distances to the runs of ``(rx, ry)`` that begin at ``starts``."""
    n, m = len(x), len(rx)
    sums, rows = np.zeros((n, len(starts))), max(1, ENTRIES // max(1, min(m, COLUMNS)))
    a, b = np.empty((rows, min(m, COLUMNS))), np.empty((rows, min(m, COLUMNS)))
    for j in range(0, m, COLUMNS):
        px, py = rx[j:j + COLUMNS], ry[j:j + COLUMNS]
        first, last = np.searchsorted(starts, j, "right") - 1, np.searchsorted(starts, j + len(px))
        cuts = np.maximum(starts[first:last] - j, 0)
        for i in range(0, n, rows):
            d, e = a[:min(rows, n - i), :len(px)], b[:min(rows, n - i), :len(px)]
            np.subtract(x[i:i + rows, None], px, out=d)
            np.subtract(y[i:i + rows, None], py, out=e)
            np.add(np.multiply(d, d, out=d), np.multiply(e, e, out=e), out=d)
            sums[i:i + rows, first:last] += np.add.reduceat(np.sqrt(d, out=d), cuts, axis=1)
    return sums


def _block_sums(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    if q.empty or r.empty:
        return pd.DataFrame({"record_id": pd.Series([], dtype="int64"), "own": pd.Series([], dtype="int32"),
                             "cluster": pd.Series([], dtype="int32"), "s": pd.Series([], dtype="float64"),
                             "c": pd.Series([], dtype="int64")})
    order = np.argsort(r["rc"].to_numpy(), kind="stable")
    labels, starts, counts = np.unique(r["rc"].to_numpy()[order], return_index=True, return_counts=True)
    sums = _distance_sums(*(c.to_numpy(float) for c in (q["x"], q["y"])), *(r[c].to_numpy(float)[order] for c in ("rx", "ry")), starts)
    nq, nc = sums.shape
    return pd.DataFrame({
        "record_id": np.repeat(q["record_id"].to_numpy(), nc).astype("int64"),
        "own": np.repeat(q["cluster"].to_numpy(), nc).astype("int32"),
        "cluster": np.tile(labels, nq).astype("int32"),
        "s": sums.reshape(-1),
        "c": np.tile(counts, nq).astype("int64"),
    })


def _sides(n: int, clusters: int, block_size: int) -> tuple[int, int]:
    """Blocks of asking points and parts of those asked, for ``n`` points."""
    parts = max(1, math.ceil(n / MOST_ASKED))
    return max(1, min(math.ceil(n / block_size), SIDES), math.ceil(n * clusters / MOST_SUMS), parts), parts


def silhouette_samples(points: DataFrame, block_size: int = BLOCK_SIZE, n_rows: int | None = None) -> DataFrame:
    """Per-point euclidean silhouette ``(record_id, cluster, s)`` over ``(record_id, x, y, cluster)``
    with noise (cluster < 0) removed; a singleton cluster scores 0."""
    valid = points.where(F.col("cluster") >= 0).select("record_id", "x", "y", F.col("cluster").cast("int").alias("cluster"))
    has = valid.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("k")).first()
    blocks, parts = _sides(n_rows if n_rows is not None else has["n"], has["k"], block_size)

    def some(n):                                                             # of the sequence's type, as both sides are dealt by hash
        return F.pmod(F.xxhash64("record_id", "x", "y"), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = valid.select("record_id", "x", "y", "cluster", some(blocks).alias("qb"), every(parts).alias("rb"))
    # the reference side gets fresh column names so the cogroup is not an ambiguous self-join
    r = valid.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("cluster").alias("rc"),
                     some(parts).alias("rb"), every(blocks).alias("qb"))
    tasks, key = SPREAD * blocks * parts if blocks > 1 else 1, ("qb", "rb")
    sums = by_block(q, tasks, *key).groupBy(*key).cogroup(by_block(r, tasks, *key).groupBy(*key)).applyInPandas(
        lambda a, b: _block_sums(a, b), "record_id long, own int, cluster int, s double, c long")
    per = sums.groupBy("record_id", "own", "cluster").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    own = F.col("cluster") == F.col("own")
    pt = per.groupBy("record_id", "own").agg(
        F.max(F.when(own, F.col("c"))).alias("oc"),
        F.max(F.when(own & (F.col("c") > 1), F.col("s") / (F.col("c") - 1))).alias("a"),
        F.min(F.when(~own, F.col("s") / F.col("c"))).alias("b"))
    m = F.greatest("a", "b")
    s = F.when((F.col("oc") <= 1) | m.isNull() | (m == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / m)
    return pt.select("record_id", F.col("own").alias("cluster"), s.alias("s"))


def silhouette(points: DataFrame, method: str = "euclidean", block_size: int = BLOCK_SIZE,
               n_clusters: int | None = None) -> float | None:
    """Mean silhouette, or None unless > 1 distinct label and more valid rows
    than ``n_clusters`` (the reported count; by default the distinct labels)."""
    valid = points.where(F.col("cluster") >= 0)
    st = valid.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("k")).first()
    n, k = int(st["n"]), int(st["k"])
    if k < 2 or n <= (n_clusters if n_clusters is not None else k):
        return None
    if method == "squared_euclidean":
        from pyspark.ml.evaluation import ClusteringEvaluator
        from pyspark.ml.feature import VectorAssembler
        v = VectorAssembler(inputCols=["x", "y"], outputCol="_v").transform(valid)
        ev = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster", metricName="silhouette",
                                 distanceMeasure="squaredEuclidean")
        return float(ev.evaluate(v.withColumn("cluster", F.col("cluster").cast("double"))))
    if method == "euclidean_tree":
        return silhouette_within(valid, n_clusters=n_clusters)[0]
    return float(silhouette_samples(valid, block_size, n).agg(F.avg("s")).first()[0])


def silhouette_within(points: DataFrame, tolerance: float = 0.01, n_clusters: int | None = None) -> tuple[float, float] | None:
    """``(mean silhouette, bound)``: the euclidean score lies within ``bound``; None where :func:`silhouette` is None."""
    from shoal.operators.silhouette_tree import silhouette_bounds

    st = silhouette_bounds(points, tolerance).agg(F.avg("s").alias("s"), F.avg("bound").alias("b"), F.count(F.lit(1)).alias("n"),
                                                  F.count_distinct("cluster").alias("k")).first()
    if st["k"] < 2 or st["n"] <= (n_clusters if n_clusters is not None else st["k"]):
        return None
    return float(st["s"]), float(st["b"])
