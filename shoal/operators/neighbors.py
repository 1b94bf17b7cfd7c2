"""Exact k nearest neighbours (M2a cosine, M4a core distance, M4b mutual reachability).

2-D points use :func:`knn_plane`, which visits only near blocks.  For vectors,
points are hashed into blocks; each (query block,
reference block) pair meets in one cogroup where NumPy keeps the ``k``
closest references of every query point (ties by id).  A point
therefore emits at most ``k`` rows per block pair, never one row per pair,
and the final top-k per point is a ``row_number() <= k`` window group limit.
The search is exact (no candidate cap); its work is O(n^2 / parallelism).
Every point is copied once for each block, so there are only as many blocks as
keep the machines busy (``SIDES``): what is shuffled then grows like the points, until
blocks reach the size that a task's memory bounds (``BLOCK_ENTRIES``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.spanning import blocks_for, by_block, spanning_tree
from shoal.session import ensure_checkpoint_dir

#: Points of a block at least, blocks up to which smaller blocks are preferred, and the numbers of a block's points at most.
BLOCK_SIZE, SIDES, BLOCK_ENTRIES = 2048, 12, 1 << 22
#: Distances computed at once.
ENTRIES = 1 << 22
_EMPTY = {"record_id": "int64", "neighbor_id": "int64", "dist": "float64"}


def _matrix(pdf: pd.DataFrame, cols: list[str], vector: bool) -> np.ndarray:
    if vector:
        return np.stack([np.asarray(v, dtype=np.float64) for v in pdf[cols[0]]]) if len(pdf) else np.zeros((0, 1))
    return pdf[cols].to_numpy(dtype=np.float64)


def _unit(a: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(size == 0, 1, size)


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` least entries of each row in order, of equal ones those of the first columns; no row is sorted whole."""
    k = min(k, d.shape[1])
    bound = np.partition(d, k - 1, axis=1)[:, k - 1:k]
    rows, cols = (d <= np.where(np.isnan(bound), np.inf, bound)).nonzero()
    order = np.lexsort((cols, d[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(len(d)))
    take = np.arange(len(rows)) - first[rows] < k
    return rows[take], cols[take]


def _block_knn(k: int, metric: str, cols: list[str], rcols: list[str], vector: bool, include_self: bool):
    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in _EMPTY.items()})
        r = r.sort_values("rid", kind="stable")  # stable sorts below then break ties by id
        a, b = _matrix(q, cols, vector), _matrix(r, rcols, vector)
        if metric == "cosine":
            a, b = _unit(a), _unit(b).T
        qid, rid = q["record_id"].to_numpy(), r["rid"].to_numpy()
        found = []
        step = max(1, ENTRIES // len(r) // (1 if metric == "cosine" else len(cols)))
        for i in range(0, len(q), step):
            some = a[i:i + step]
            d = 1.0 - some @ b if metric == "cosine" else np.sqrt(((some[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
            if not include_self:
                d[qid[i:i + step, None] == rid[None, :]] = np.inf
            rows, at = _least(d, k)
            found.append((rows + i, at, d[rows, at]))
        rows, cols_, dist = (np.concatenate(x) for x in zip(*found))
        keep = np.isfinite(dist)
        return pd.DataFrame({"record_id": qid[rows][keep].astype("int64"),
                             "neighbor_id": rid[cols_][keep].astype("int64"),
                             "dist": dist[keep]})
    return run


def _sides(n: int, width: int, block_size: int) -> int:
    """Blocks for ``n`` points of ``width`` numbers; both sides of the search have so many."""
    most = max(block_size, BLOCK_ENTRIES // max(width, 1))
    return max(1, min(math.ceil(n / block_size), SIDES), math.ceil(n / most))


def knn(points: DataFrame, k: int, coords: list[str] | None = None, vector_col: str | None = None,
        metric: str = "euclidean", include_self: bool = True, block_size: int = BLOCK_SIZE,
        n_rows: int | None = None) -> DataFrame:
    """``(record_id, rank, neighbor_id, dist)``: the ``k`` nearest points of every point
    (ties by neighbour id).  Pass 2-D ``coords`` or an array ``vector_col``."""
    vector = vector_col is not None
    cols = [vector_col] if vector else (coords or ["x", "y"])
    width = F.max(F.size(vector_col)) if vector else F.lit(len(cols))
    has = points.agg(F.count(F.lit(1)).alias("n"), width.alias("width")).first()
    blocks = _sides(n_rows if n_rows is not None else has["n"], has["width"] or 1, block_size)
    blk = F.pmod(F.xxhash64("record_id"), F.lit(blocks)).cast("int")     # of the sequence's type, as both sides are dealt by hash
    seq = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = points.select("record_id", *cols, blk.alias("qb"), seq.alias("rb"))
    rcols = [f"r_{c}" for c in cols]
    r = points.select(F.col("record_id").alias("rid"), *[F.col(c).alias(rc) for c, rc in zip(cols, rcols)],
                      blk.alias("rb"), seq.alias("qb"))
    pairs, key = blocks * blocks, ("qb", "rb")
    cand = by_block(q, pairs, *key).groupBy(*key).cogroup(by_block(r, pairs, *key).groupBy(*key)).applyInPandas(
        _block_knn(k, metric, cols, rcols, vector, include_self), "record_id long, neighbor_id long, dist double")
    w = Window.partitionBy("record_id").orderBy("dist", "neighbor_id")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("record_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "dist"))


# -- 2-D points: blocks along a space-filling curve -----------------------------------

#: Blocks of a group whose common box is tested before their own.
BOX_GROUP = 256
_CURVE_BITS = 16


def _curve(x: Column, y: Column, box) -> Column:
    """Position on the Z-order curve: the bits of both scaled coordinates, interleaved."""
    top = (1 << _CURVE_BITS) - 1

    def scaled(c, lo, hi):
        return F.round((c - F.lit(lo)) / F.lit((hi - lo) or 1.0) * top).cast("bigint")

    def spread(v):                                            # a bit at every second place
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return v
    return spread(scaled(x, box["x0"], box["x1"])) + 2 * spread(scaled(y, box["y0"], box["y1"]))


def _nearest(q: np.ndarray, qid: np.ndarray, r: np.ndarray, rid: np.ndarray, k: int, include_self: bool):
    """``(row of q, id, distance)`` of the ``k`` nearest references of each query, ties by id; ``rid`` is sorted."""
    for i in range(0, len(q), 1024):
        a, ids = q[i:i + 1024], qid[i:i + 1024]
        d = np.sqrt((a[:, None, 0] - r[None, :, 0]) ** 2 + (a[:, None, 1] - r[None, :, 1]) ** 2)
        if not include_self:
            d[ids[:, None] == rid[None, :]] = np.inf
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(a)), at.shape[1])
        dist = d[rows, at.ravel()]
        ok = np.isfinite(dist)
        yield rows[ok] + i, rid[at.ravel()[ok]], dist[ok]


def _found(q: pd.DataFrame, r: pd.DataFrame, k: int, include_self: bool) -> pd.DataFrame:
    r = r.sort_values("record_id", kind="stable")
    qid, rid = q["record_id"].to_numpy(), r["record_id"].to_numpy()
    parts = list(_nearest(q[["x", "y"]].to_numpy(float), qid, r[["x", "y"]].to_numpy(float), rid, k, include_self))
    rows, ids, dist = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, int),) * 3
    return pd.DataFrame({"record_id": qid[rows].astype("int64"), "neighbor_id": ids.astype("int64"), "dist": dist.astype(float)})


def knn_plane(points: DataFrame, k: int, include_self: bool = True, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``(record_id, rank, neighbor_id, dist)``: the exact ``k`` nearest points of every 2-D point, ties by id.

    Points are dealt to blocks along a space-filling curve.  The nearest points in a
    point's own block bound the distance of its true neighbours; it then visits
    only the other blocks whose box is within that bound, so its copies follow the
    shape of the data, not the number of blocks.  The driver holds one box for each
    block; beyond ``spanning.MOST_BLOCKS`` blocks these grow instead of their number.
    """
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    pts = points.select(F.col("record_id").cast("bigint").alias("record_id"), F.col("x").cast("double").alias("x"),
                        F.col("y").cast("double").alias("y"))
    box = pts.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
                  F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not box["n"]:
        return spark.createDataFrame([], "record_id long, rank int, neighbor_id long, dist double")
    blocks = blocks_for(box["n"], block_size)
    dealt = pts.repartitionByRange(blocks, _curve(F.col("x"), F.col("y"), box), "record_id") \
        .withColumn("block", F.spark_partition_id()).checkpoint()
    boxes = dealt.groupBy("block").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                                       F.max("y").alias("y1")).orderBy("block").toPandas()
    shared = spark.sparkContext.broadcast(boxes.to_numpy(float))

    found = "record_id long, neighbor_id long, dist double"
    own = by_block(dealt, blocks, "block").groupBy("block").applyInPandas(lambda g: _found(g, g, k, include_self), found).checkpoint()
    w = Window.partitionBy("record_id").orderBy("dist", "neighbor_id")
    if blocks == 1:                                           # nothing lies elsewhere
        return own.withColumn("rank", F.row_number().over(w).cast("int")).select("record_id", "rank", "neighbor_id", "dist")
    bound = own.groupBy("record_id").agg(F.max("dist").alias("r"), F.count(F.lit(1)).alias("c")) \
        .select(F.col("record_id").alias("_id"), F.when(F.col("c") >= k, F.col("r")).alias("r"))
    asking = dealt.join(bound, F.col("record_id") == F.col("_id"), "left").drop("_id")

    def visits(batches):
        b = shared.value
        starts = np.arange(0, len(b), BOX_GROUP)
        outer = np.stack([np.minimum.reduceat(b[:, 1], starts), np.maximum.reduceat(b[:, 2], starts),
                          np.minimum.reduceat(b[:, 3], starts), np.maximum.reduceat(b[:, 4], starts)], 1)

        def near(p, boxes, r):
            dx = np.maximum(np.maximum(boxes[:, 0] - p[:, :1], p[:, :1] - boxes[:, 1]), 0)
            dy = np.maximum(np.maximum(boxes[:, 2] - p[:, 1:], p[:, 1:] - boxes[:, 3]), 0)
            return np.sqrt(dx * dx + dy * dy) <= r[:, None]

        for pdf in batches:
            p = pdf[["x", "y"]].to_numpy(float)
            r = pdf["r"].fillna(np.inf).to_numpy(float) * (1 + 1e-12)      # a box may touch the bound
            out = []
            groups = near(p, outer, r)
            for g in groups.any(0).nonzero()[0]:
                rows = groups[:, g].nonzero()[0]
                at, which = near(p[rows], b[starts[g]:starts[g] + BOX_GROUP, 1:], r[rows]).nonzero()
                v = pdf.iloc[rows[at]][["record_id", "x", "y", "block"]].copy()
                v["target"] = b[starts[g] + which, 0].astype("int32")
                out.append(v[v["target"] != v["block"]])
            if out:
                yield pd.concat(out)[["target", "record_id", "x", "y"]]

    asked = asking.mapInPandas(visits, "target int, record_id long, x double, y double")
    refs = dealt.select(F.col("block").alias("target"), "record_id", "x", "y")
    more = by_block(asked, blocks, "target").groupBy("target").cogroup(by_block(refs, blocks, "target").groupBy("target")).applyInPandas(
        lambda q, r: _found(q, r, k, include_self), found)
    return (own.unionByName(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("record_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "dist"))


def core_distances(points: DataFrame, min_samples: int = 3, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``(record_id, core)``: distance to the ``min_samples``-th nearest point, self counted."""
    nn = knn_plane(points, min_samples, block_size=block_size)
    return nn.groupBy("record_id").agg(F.max("dist").alias("core"))


def mutual_reachability(points: DataFrame, min_samples: int = 3, k: int | None = None,
                        block_size: int = BLOCK_SIZE) -> DataFrame:
    """M4b over the k-NN candidate edges: ``(record_id, neighbor_id, mreach)`` with
    mreach = max(core a, core b, distance).  Cores and edges come from one search."""
    k = k or min_samples
    nn = knn_plane(points, max(min_samples, k + 1), block_size=block_size).checkpoint()
    core = nn.where(F.col("rank") <= min_samples).groupBy("record_id").agg(F.max("dist").alias("core"))
    w = Window.partitionBy("record_id").orderBy("rank")
    edges = nn.where(F.col("record_id") != F.col("neighbor_id")).withColumn("_i", F.row_number().over(w)) \
        .where(F.col("_i") <= k)
    a = core.select("record_id", F.col("core").alias("core_a"))
    b = core.select(F.col("record_id").alias("neighbor_id"), F.col("core").alias("core_b"))
    j = edges.join(a, "record_id").join(b, "neighbor_id")
    return j.select("record_id", "neighbor_id", F.greatest("core_a", "core_b", "dist").alias("mreach"))


# -- M4c: minimum spanning forest of the mutual-reachability graph -----------------

def spanning_forest(points: DataFrame, min_samples: int = 3, block_size: int = BLOCK_SIZE,
                    max_rounds: int = 64) -> DataFrame:
    """The minimum spanning tree of the mutual-reachability graph, ``(a, b, w)`` with a < b,
    the one under the order (w, a, b): see :mod:`shoal.operators.spanning`."""
    return spanning_tree(points, min_samples, block_size, max_rounds).edges()
