"""The neighbour graph's weights and a 2-D layout that follows them.

M2b.  A point's neighbours get weights exp(-(d - nearest) / scale), the scale found by
bisection so that they sum to log2 k; an edge that two points give each other has
w + w' - w w'.  One pass over neighbour lists, one grouped union.

M2c.  Points start at their principal components and lie in blocks along a
space-filling curve there.  A task moves the points of its block for ``EXCHANGE``
epochs: edges attract, hash-seeded samples of all points repel, and neighbours in
other blocks stay where they were when the turn began; then positions are exchanged through the
checkpoint folder.  Each epoch sums a point's gradients.  All random choices
come from hashes of record ids and the epoch, so the layout is the same for any partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators.spanning import MOST_BLOCKS, by_block
from shoal.session import ensure_checkpoint_dir

#: Halvings of the scale's interval, and the least scale as a share of the mean distance.
HALVINGS, LEAST_SCALE = 64, 1e-3
#: Epochs, epochs between two exchanges of positions, samples that repel a point in an epoch.
EPOCHS, EXCHANGE, REPEL = 200, 20, 5
#: Points of a block; points in the sample that repels (one broadcast of 64 kB).
BLOCK_SIZE, SAMPLE = 2048, 4096
#: Cells of the curve whose points are counted to deal them to blocks.
CELLS = 1 << 16
#: Start positions fill a square of this size; largest step of a coordinate for one edge.
SPREAD, CLIP = 10.0, 4.0


# -- M2b ---------------------------------------------------------------------------

def local_scales(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest positive distance and scale of each row of ``d`` (distances to neighbours, infinite where there is none).

    With ``k`` neighbours, the point itself counted, the weights sum to log2 k.
    """
    known = np.isfinite(d)
    rho = np.where(known & (d > 0), d, np.inf).min(1, initial=np.inf)
    rho = np.where(np.isfinite(rho), rho, 0.0)
    gap = np.maximum(np.where(known, d, 0) - rho[:, None], 0)
    lo, hi, mid = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(HALVINGS):
        over = (np.exp(-gap / mid[:, None]) * known).sum(1) > math.log2(k)
        hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)
        mid = np.where(np.isfinite(hi), (lo + np.where(np.isfinite(hi), hi, 0)) / 2, mid * 2)
        mid = np.maximum(mid, np.finfo(float).tiny)
    mean = np.where(known, d, 0).sum(1) / np.maximum(known.sum(1) + 1, 1)         # the point itself at distance 0
    return rho, np.maximum(mid, LEAST_SCALE * mean)


def fuzzy_graph(neighbours: DataFrame, k: int) -> DataFrame:
    """``(a, b, w)`` with a < b from ``(record_id, neighbor_id, dist)``, at most ``k - 1`` other points of each.

    ``k`` counts the point itself, as the reference's neighbour count does.
    """
    lists = neighbours.where(F.col("record_id") != F.col("neighbor_id")).groupBy("record_id").agg(
        F.sort_array(F.collect_list(F.struct("dist", "neighbor_id"))).alias("near"))

    def weights(batches):
        for b in batches:
            near = [[(r["dist"], r["neighbor_id"]) for r in x] for x in b["near"]]
            size = np.array([len(x) for x in near])
            d = np.full((len(near), max(size.max(initial=0), 1)), np.inf)
            for i, x in enumerate(near):
                d[i, :len(x)] = [t[0] for t in x]
            rho, scale = local_scales(d, k)
            w = np.exp(-np.maximum(np.where(np.isfinite(d), d, 0) - rho[:, None], 0) / scale[:, None])
            rows = np.repeat(np.arange(len(near)), size)
            yield pd.DataFrame({"record_id": b["record_id"].to_numpy()[rows].astype("int64"),
                                "neighbor_id": np.array([t[1] for x in near for t in x], dtype="int64"),
                                "w": w[np.isfinite(d)]})

    one = lists.mapInPandas(weights, "record_id long, neighbor_id long, w double")
    forth = F.col("record_id") < F.col("neighbor_id")
    both = one.groupBy(F.least("record_id", "neighbor_id").alias("a"), F.greatest("record_id", "neighbor_id").alias("b")).agg(
        F.coalesce(F.max(F.when(forth, F.col("w"))), F.lit(0.0)).alias("p"),
        F.coalesce(F.max(F.when(~forth, F.col("w"))), F.lit(0.0)).alias("q"))
    return both.select("a", "b", (F.col("p") + F.col("q") - F.col("p") * F.col("q")).alias("w"))


# -- M2c ---------------------------------------------------------------------------

def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """``a, b`` of 1 / (1 + a d^(2 b)), fitted to 1 up to ``min_dist`` and exp(-(d - min_dist) / spread) beyond (Gauss-Newton)."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(100):
        t = d ** (2 * b)
        f = 1 / (1 + a * t)
        j = np.stack([-t * f * f, -2 * a * t * np.log(d) * f * f], 1)
        step = np.linalg.solve(j.T @ j + 1e-9 * np.eye(2), j.T @ (y - f))
        a, b = max(a + step[0], 1e-3), max(b + step[1], 1e-3)
    return float(a), float(b)


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _epochs(own: pd.DataFrame, edges: pd.DataFrame, far: np.ndarray, far_ids: np.ndarray, first: int, last: int,
            epochs: int, ab: tuple[float, float], seed: int) -> pd.DataFrame:
    """The block's points after epochs ``first`` to ``last``; ``edges`` has ``i, j, w`` and the place of ``j`` at the start."""
    a, b = ab
    own = own.sort_values("record_id").reset_index(drop=True)
    ids = own["record_id"].to_numpy()
    pos = own[["x", "y"]].to_numpy(float)
    edges = edges.sort_values(["i", "j"])
    i = np.searchsorted(ids, edges["i"].to_numpy())
    j = np.searchsorted(ids, edges["j"].to_numpy())
    inside = (j < len(ids)) & (ids[np.minimum(j, len(ids) - 1)] == edges["j"].to_numpy())
    there = edges[["jx", "jy"]].to_numpy(float)
    w = edges["w"].to_numpy()
    total = np.bincount(i, w, len(ids))
    far = far.copy()
    at = np.searchsorted(ids, far_ids)                       # members of the sample that lie in this block move on
    mine = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == far_ids)
    with np.errstate(over="ignore"):
        key = _mix(ids.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    for epoch in range(first, last):
        rate = 1.0 - epoch / epochs
        there[inside] = pos[j[inside]]
        far[mine] = pos[at[mine]]
        gap = pos[i] - there
        d2 = (gap * gap).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            pull = np.where(d2 > 0, -2 * a * b * d2 ** (b - 1) / (1 + a * d2 ** b), 0)
        move = np.clip(pull[:, None] * gap, -CLIP, CLIP) * w[:, None]
        step = np.stack([np.bincount(i, move[:, c], len(ids)) for c in (0, 1)], 1).astype(float)
        for s in range(REPEL if len(far) > 1 else 0):
            with np.errstate(over="ignore"):
                pick = (_mix(key + np.uint64(epoch * REPEL + s + 1)) % np.uint64(len(far))).astype(np.int64)
            gap = pos - far[pick]
            d2 = (gap * gap).sum(1)
            push = np.where(far_ids[pick] != ids, 2 * b / ((0.001 + d2) * (1 + a * d2 ** b)), 0)
            step += np.clip(push[:, None] * gap, -CLIP, CLIP) * total[:, None]
        # the sum over a point's edges, as a mean with at most full weight: whole sums overshoot
        pos += rate * step / np.maximum(total, 1)[:, None]
    return pd.DataFrame({"record_id": ids, "x": pos[:, 0], "y": pos[:, 1]})


def _dealt(cells: list, n: int, block_size: int) -> tuple[list[tuple[int, int, int]], int]:
    """``(cell, first block, blocks)`` from the cells' counts, and the number of blocks.

    Cells in the curve's order fill blocks up to their size; a cell with more points
    than a block has blocks of its own, among which its points are dealt by hash.
    """
    size = max(block_size, math.ceil(n / MOST_BLOCKS))
    out, block, filled = [], 0, 0
    for c, many in sorted((r["cell"], r["count"]) for r in cells):
        if filled and filled + many > size:
            block, filled = block + 1, 0
        parts = math.ceil(many / size)
        out.append((c, block, parts))
        block, filled = (block, filled + many) if parts == 1 else (block + parts, 0)
    return out, block + bool(filled)


def _turn(shared, first: int, last: int, epochs: int, ab: tuple[float, float], seed: int):
    def move(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        return _epochs(own, edges, *shared.value, first, last, epochs, ab, seed).assign(block=own["block"].iloc[0])
    return move


def layout_epochs(graph: DataFrame, start: DataFrame, epochs: int = EPOCHS, exchange: int = EXCHANGE, min_dist: float = 0.1,
                  seed: int = 42, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``(record_id, x, y)`` for the points of ``start`` along the edges ``(a, b, w)``.

    Points without an edge stay at their start.
    """
    from shoal.operators.neighbors import _curve

    spark = start.sparkSession
    ensure_checkpoint_dir(spark)
    box = start.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
                    F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not box["n"]:
        return start.select("record_id", "x", "y")
    size = max(box["x1"] - box["x0"], box["y1"] - box["y0"]) or 1.0
    # equal points would never part: every point starts off by a hash of its id
    off = [(F.pmod(F.xxhash64("record_id", F.lit(f"{seed}{c}")), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-3 for c in "xy"]
    cell = F.expr("curve div " + str((1 << 32) // CELLS))
    placed = start.select(F.col("record_id").cast("long").alias("record_id"), "x", "y",
                          _curve(F.col("x"), F.col("y"), box).alias("curve")).withColumn("cell", cell).drop("curve")
    deal, blocks = _dealt(placed.groupBy("cell").count().collect(), box["n"], block_size)       # at most CELLS rows
    deal = F.broadcast(spark.createDataFrame(deal, "cell long, first int, parts int"))
    block = F.col("first") + F.pmod(F.xxhash64("record_id"), F.col("parts")).cast("int")
    place = placed.join(deal, "cell").select(block.alias("block"), "record_id", (F.col("x") * (SPREAD / size) + off[0]).alias("x"),
                                             (F.col("y") * (SPREAD / size) + off[1]).alias("y")).checkpoint()
    at = place.select("record_id", "block")
    ends = graph.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").union(graph.select("b", "a", "w"))
    ends = ends.join(at.select(F.col("record_id").alias("i"), F.col("block").alias("at")), "i").checkpoint()
    ab = curve(min_dist)
    turn = epochs if blocks == 1 else exchange
    # the sample is the same points in every turn: the smallest hashes
    names = place.select("record_id", F.xxhash64("record_id", F.lit(seed)).alias("h")).orderBy("h", "record_id").limit(SAMPLE)
    sample = [r["record_id"] for r in names.collect()]
    chosen = F.broadcast(spark.createDataFrame([(r,) for r in sample], "record_id long"))
    for first in range(0, epochs, turn):
        last = min(first + turn, epochs)
        seen = place.join(chosen, "record_id").select("record_id", "x", "y").orderBy("record_id").toPandas()
        shared = spark.sparkContext.broadcast((seen[["x", "y"]].to_numpy(float), seen["record_id"].to_numpy()))
        known = ends.join(place.select(F.col("record_id").alias("j"), F.col("x").alias("jx"), F.col("y").alias("jy")), "j")
        place = by_block(place, blocks, "block").groupBy("block").cogroup(by_block(known, blocks, "at").groupBy("at")).applyInPandas(
            _turn(shared, first, last, epochs, ab, seed), "block int, record_id long, x double, y double").checkpoint()
    return place.select("record_id", "x", "y")


def preservation(neighbours: DataFrame, points: DataFrame, k: int) -> float:
    """The share of the first ``k`` neighbours in ``neighbours`` that are among the ``k`` nearest in the plane."""
    from shoal.operators.neighbors import knn_plane

    near = knn_plane(points, k, include_self=False).select("record_id", "neighbor_id", F.lit(1).alias("hit"))
    want = neighbours.where(F.col("rank") <= k).select("record_id", "neighbor_id")
    return float(want.join(near, ["record_id", "neighbor_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0])
