"""M6 without all pairs: euclidean silhouettes from a tree of blocks, with a proven bound of the error.

Points lie in blocks along a space-filling curve; four neighbouring blocks make a
node of the next level, and so on.  A node knows, for each cluster, how many
points it holds, their mean, and their variance.  The mean distance from a point to ``n`` points
whose mean lies ``d`` away lies between ``d`` (the distance is convex) and
``sqrt(d^2 + variance)`` (the mean of squares bounds the square of the mean).

A block of asking points walks down the tree: where these two differ by at most
twice the tolerance, for every cluster and wherever in the block's box a point
lies, the node answers with the middle of both; else its children are asked.  Blocks
at the bottom that are still too near meet the asking block exactly.  So
a block meets its surroundings and a few nodes of each level, whatever the number of points.

Blocks that follow each other on the curve are a group, which is one group of a cogroup: its surroundings are copied once
for all of its blocks, and a point's sums over all it meets are one row for each cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators.neighbors import _curve
from shoal.operators.spanning import BLOCK_SIZE, ENTRIES, SLACK, blocks_for, by_block
from shoal.session import ensure_checkpoint_dir

#: Children of a node.
FAN = 4
#: Blocks times clusters of the tree that every task holds; beyond, blocks grow.
MOST_ENTRIES = 1 << 18
#: Points of a group of blocks, and the points around it that it meets at once.
GROUP, MOST_ASKED = 2048, 1 << 18

_SUMS = "record_id long, own int, cluster int, s double, e double, c long"


def _levels(leaf: np.ndarray) -> list[np.ndarray]:
    """The tree over ``leaf[block, cluster] = (n, mean x, mean y, sum of squares about the mean)``, bottom first:
    ``(n, mean x, mean y, variance)``."""
    out = []
    n, mx, my, ss = leaf[..., 0], leaf[..., 1], leaf[..., 2], leaf[..., 3]
    while True:
        out.append(np.stack([n, mx, my, ss / np.maximum(n, 1)], -1))
        if len(n) == 1:
            return out
        pad = -len(n) % FAN
        n, mx, my, ss = (np.concatenate([a, np.zeros((pad, a.shape[1]))]).reshape(-1, FAN, a.shape[1]) for a in (n, mx, my, ss))
        total = n.sum(1)
        px, py = (n * mx).sum(1) / np.maximum(total, 1), (n * my).sum(1) / np.maximum(total, 1)
        # squares about the common mean: those about each part's mean and those of the parts' means
        ss = (ss + n * ((mx - px[:, None]) ** 2 + (my - py[:, None]) ** 2)).sum(1)
        n, mx, my = total, px, py


def _walk(box: np.ndarray, levels: list[np.ndarray], tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """For asking points within ``box``: the far nodes' entries ``(node, cluster, 4)``, and the numbers of the near blocks."""
    far, at = [], np.arange(1)
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        node = level[at]
        dx = np.maximum(np.maximum(box[0] - node[..., 1], node[..., 1] - box[1]), 0)
        dy = np.maximum(np.maximum(box[2] - node[..., 2], node[..., 2] - box[3]), 0)
        d = np.sqrt(dx * dx + dy * dy)
        ok = ((node[..., 0] == 0) | (np.sqrt(d * d + node[..., 3]) <= (1 + 2 * tolerance) * d)).all(1)
        far.append(node[ok])
        at = at[~ok]
        if depth:
            at = (at[:, None] * FAN + np.arange(FAN)).ravel()
            at = at[at < len(levels[depth - 1])]
    return np.concatenate(far), at


def _rows(pdf: pd.DataFrame, labels: np.ndarray, s: np.ndarray, e: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    """One row for each point and cluster that has points."""
    some = np.flatnonzero(c)
    m = len(pdf)
    return pd.DataFrame({
        "record_id": np.repeat(pdf["record_id"].to_numpy(np.int64), len(some)),
        "own": np.repeat(pdf["cluster"].to_numpy(np.int32), len(some)), "cluster": np.tile(labels[some], m).astype(np.int32),
        "s": s[:, some].ravel(), "e": e[:, some].ravel(), "c": np.tile(c[some], m).astype(np.int64)})


def _add_far(x: np.ndarray, y: np.ndarray, far: np.ndarray, s: np.ndarray, e: np.ndarray, c: np.ndarray) -> None:
    """Adds the sums, their errors and the counts of the far nodes' points."""
    step = max(1, ENTRIES // s.size)
    for i in range(0, len(far), step):
        n, mx, my, var = np.moveaxis(far[i:i + step], -1, 0)
        low = (x[:, None, None] - mx) ** 2 + (y[:, None, None] - my) ** 2
        high = np.sqrt(low + var)
        np.sqrt(low, out=low)
        s += (n * (low + high)).sum(1) / 2
        e += (n * (high - low + high * SLACK)).sum(1) / 2
    c += far[..., 0].sum(0).astype(np.int64)


def _add_near(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, at: np.ndarray, s: np.ndarray, c: np.ndarray) -> None:
    """Adds the distances to the near points, of the clusters ``at``, and their counts."""
    order = np.argsort(at, kind="stable")
    rx, ry = rx[order], ry[order]
    n = np.bincount(at, minlength=len(c))
    some = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[some]
    step = max(1, ENTRIES // len(rx))
    for i in range(0, len(x), step):
        d = np.sqrt((x[i:i + step, None] - rx) ** 2 + (y[i:i + step, None] - ry) ** 2)
        s[i:i + step, some] += np.add.reduceat(d, starts, axis=1)
    c += n


def _group_sums(q: pd.DataFrame, r: pd.DataFrame, tree, tolerance: float, with_far: bool) -> pd.DataFrame:
    """The sums of a group's points over the far nodes and over those near blocks of each that are in ``r``."""
    levels, areas, labels, first = tree
    leaf = first[r["r_group"].to_numpy(int)] + r["r_block"].to_numpy(int)
    order = np.argsort(leaf, kind="stable")
    leaf, rx, ry = leaf[order], r["rx"].to_numpy(float)[order], r["ry"].to_numpy(float)[order]
    at = np.searchsorted(labels, r["rc"].to_numpy(int)[order])
    out = []
    for b, some in q.groupby(first[q["group"].to_numpy(int)] + q["block"].to_numpy(int)):
        far, near = _walk(areas[b], levels, tolerance)
        x, y = some["x"].to_numpy(float), some["y"].to_numpy(float)
        s, e, c = np.zeros((len(x), len(labels))), np.zeros((len(x), len(labels))), np.zeros(len(labels), np.int64)
        if with_far:
            _add_far(x, y, far, s, e, c)
        low, high = np.searchsorted(leaf, near), np.searchsorted(leaf, near, "right")
        met = np.concatenate([np.arange(i, j) for i, j in zip(low, high)] or [np.zeros(0, int)])
        if len(met):
            _add_near(x, y, rx[met], ry[met], at[met], s, c)
        out.append(_rows(some, labels, s, e, c))
    return pd.concat(out)


def _score(a, b):
    m = F.greatest(a, b)
    return F.when(a.isNull() | b.isNull() | (m == 0), F.lit(0.0)).otherwise((b - a) / m)


def silhouette_bounds(points: DataFrame, tolerance: float = 0.01, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``(record_id, cluster, s, bound)`` over ``(record_id, x, y, cluster)``: the euclidean silhouette lies within ``bound`` of ``s``.

    ``tolerance`` is the largest relative error of a mean distance; 0 compares all points exactly, but for heaps of equal ones.
    Noise (cluster < 0) and points without a coordinate are left out; a cluster's only point, and every point of a single
    cluster, has 0.  The driver holds the tree, at most ``MOST_ENTRIES`` blocks times clusters; more clusters than that raise.
    """
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    real = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("x", "y")]
    pts = points.select("record_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
                        F.col("cluster").cast("int").alias("cluster")).where((F.col("cluster") >= 0) & real[0] & real[1])
    box = pts.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                  F.max("y").alias("y1"), F.count_distinct("cluster").alias("k")).first()
    if not box["n"]:
        return spark.createDataFrame([], "record_id long, cluster int, s double, bound double")
    if box["k"] > MOST_ENTRIES:
        raise ValueError(f"{box['k']} clusters: at most {MOST_ENTRIES}")
    blocks = min(blocks_for(box["n"], block_size), max(1, MOST_ENTRIES // box["k"]))
    size = -(-box["n"] // blocks)
    along = _curve(F.col("x"), F.col("y"), box), "record_id"
    # the number of a row has its partition in the bits from 33 on
    dealt = pts.repartitionByRange(blocks_for(box["n"], max(size, GROUP)), *along).sortWithinPartitions(*along) \
        .withColumn("_i", F.monotonically_increasing_id()).select(
            "record_id", "x", "y", "cluster", F.shiftright("_i", 33).cast("int").alias("group"),
            F.floor((F.col("_i") % F.lit(1 << 33)) / size).cast("int").alias("block")).checkpoint()
    parts = dealt.groupBy("group", "block", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        (F.var_pop("x") + F.var_pop("y")).alias("var"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
        F.max("y").alias("y1")).toPandas()
    labels = np.sort(parts["cluster"].unique())
    found = parts[["group", "block"]].drop_duplicates().sort_values(["group", "block"]).to_numpy(int)
    first = np.searchsorted(found[:, 0], np.arange(found[-1, 0] + 2))        # of each group's blocks, which lie in a row
    which, col = first[parts["group"].to_numpy()] + parts["block"].to_numpy(), np.searchsorted(labels, parts["cluster"])
    leaf, boxes = np.zeros((len(found), len(labels), 4)), np.full((len(found), 4), np.nan)
    leaf[which, col] = np.stack([parts["n"], parts["mx"], parts["my"], parts["n"] * parts["var"]], 1)
    for i, (name, take) in enumerate((("x0", np.fmin), ("x1", np.fmax), ("y0", np.fmin), ("y1", np.fmax))):
        take.at(boxes[:, i], which, parts[name].to_numpy())
    shared = spark.sparkContext.broadcast((_levels(leaf), boxes, labels, first))

    def near(batches):
        levels, areas, _, start = shared.value
        points = levels[0][..., 0].sum(1)
        for pdf in batches:
            for g in pdf["id"]:
                met = [_walk(areas[b], levels, tolerance)[1] for b in range(start[g], start[g + 1])]
                if met:
                    rb = np.unique(np.concatenate(met))
                    part = (np.cumsum(points[rb]) // MOST_ASKED).astype(np.int32)
                    rg = np.searchsorted(start, rb, "right") - 1
                    # a group that meets nothing exactly has its far nodes
                    pairs = (part - part[0], rg, rb - start[rg]) if len(rb) else ([0], [-1], [-1])
                    yield pd.DataFrame(dict(zip(("part", "group", "block"), pairs), qg=g), dtype=np.int32)[["qg", "part", "group", "block"]]

    last = len(first) - 1
    pairs = spark.range(0, last, 1, min(last, 4 * spark.sparkContext.defaultParallelism)) \
        .mapInPandas(near, "qg int, part int, group int, block int").checkpoint()
    asking = pairs.select("qg", "part").distinct()
    q = dealt.join(asking, dealt["group"] == asking["qg"])
    # the reference side gets fresh column names so the cogroup is not an ambiguous self-join
    met = pairs.select(*[F.col(c).alias(f"r_{c}") for c in pairs.columns])
    r = dealt.select(F.col("group").alias("r_group"), F.col("block").alias("r_block"), F.col("x").alias("rx"), F.col("y").alias("ry"),
                     F.col("cluster").alias("rc")).join(met, ["r_group", "r_block"])
    tasks, key, rkey = asking.count(), ("qg", "part"), ("r_qg", "r_part")
    sums = by_block(q, tasks, *key).groupBy(*key).cogroup(by_block(r, tasks, *rkey).groupBy(*rkey)).applyInPandas(
        lambda k, a, b: _group_sums(a, b, shared.value, tolerance, k[1] == 0), _SUMS)
    per = sums.groupBy("record_id", "own", "cluster").agg(F.sum("s").alias("s"), F.sum("e").alias("e"), F.sum("c").alias("c"))
    own = F.col("cluster") == F.col("own")
    others = F.col("c") - F.when(own, 1).otherwise(0)                        # itself is at distance 0
    mean, err = F.when(others > 0, F.col("s") / others), F.when(others > 0, F.col("e") / others)
    side = {"a": (F.max, own), "b": (F.min, ~own)}
    out = per.groupBy("record_id", "own").agg(*[
        take(F.when(where, value)).alias(f"{name}{end}") for name, (take, where) in side.items()
        for end, value in (("", mean), ("_low", F.greatest(mean - err, F.lit(0.0))), ("_high", mean + err))])
    s, least, most = (_score(F.col(a), F.col(b)) for a, b in (("a", "b"), ("a_high", "b_low"), ("a_low", "b_high")))
    return out.select("record_id", F.col("own").alias("cluster"), s.alias("s"), F.greatest(most - s, s - least).alias("bound"))
