"""The minimum spanning tree of the mutual-reachability graph of 2-D points.

Points lie in blocks along a space-filling curve.  A round has two steps.

*Inside a block* components that lie wholly in it take their cheapest outgoing
edges again and again, as long as these are cheaper than anything outside the
block can be: a point's edges out of the block weigh at least its own core
distance and its distance to the nearest other block's box.  All but the
components near a block's border settle there.

*Across blocks* the cheapest edge that a component has inside its blocks bounds
the search: a point visits only the blocks whose box and least core distance
are within that bound, and none that its own component fills.  So the copies made
follow the borders of the components, not the number of blocks.

Edges are compared by (weight, a, b), so the tree is unique.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.session import ensure_checkpoint_dir

#: Points of a block, and the most blocks: beyond, blocks grow, so that the boxes stay a few MB.
BLOCK_SIZE, MOST_BLOCKS = 2048, 1 << 16
#: Up to so many components' choices are merged on the driver; beyond, by joins.
DRIVER_MERGES = 200_000
#: The most tasks that blocks are dealt to.
MOST_TASKS = 2048
#: Entries of a distance matrix computed at once.
ENTRIES = 1 << 21
#: Distances to boxes and between points may differ in their last digits.
SLACK = 1e-12

_STATE = "record_id long, x double, y double, core double, lb double, comp long, home int"
_EDGE = "w double, a long, b long"
_LOCAL = f"kind string, block int, {_STATE}, {_EDGE}, other long"


def blocks_for(n: int, block_size: int) -> int:
    return max(1, min(MOST_BLOCKS, math.ceil(n / block_size)))


def by_block(rows: DataFrame, blocks: int, *key: str) -> DataFrame:
    """``rows`` with each block whole, over about as many tasks as there are blocks.

    A block's work is its pairs of points.  Left to its size in bytes, which is small, Spark would put all blocks in one task.
    """
    return rows.repartition(max(1, min(blocks, MOST_TASKS)), *key)


def box_distance(x: np.ndarray, y: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Distance of each point to each box ``(x0, x1, y0, y1)``: never above that to a point in it."""
    dx = np.maximum(np.maximum(boxes[:, 0] - x[:, None], x[:, None] - boxes[:, 1]), 0)
    dy = np.maximum(np.maximum(boxes[:, 2] - y[:, None], y[:, None] - boxes[:, 3]), 0)
    return np.sqrt(dx * dx + dy * dy) * (1 - SLACK)


def _far_distance(x: np.ndarray, y: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Distance of each point to the farthest corner of each box."""
    dx = np.maximum(np.abs(boxes[:, 0] - x[:, None]), np.abs(x[:, None] - boxes[:, 1]))
    dy = np.maximum(np.abs(boxes[:, 2] - y[:, None]), np.abs(y[:, None] - boxes[:, 3]))
    return np.sqrt(dx * dx + dy * dy) * (1 + SLACK)


def cheapest(q: pd.DataFrame, r: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the row of ``r`` (sorted by id) of another component with the cheapest edge, and its weight.

    Of equally cheap ones the smallest id; the weight is infinite if there is none.
    """
    qx, qy, qc, qf = (q[c].to_numpy() for c in ("x", "y", "core", "comp"))
    rx, ry, rc, rf = (r[c].to_numpy() for c in ("x", "y", "core", "comp"))
    at, best = np.zeros(len(q), np.int64), np.full(len(q), np.inf)
    if not len(r):
        return at, best
    step = max(1, ENTRIES // len(r))
    for i in range(0, len(q), step):
        s = slice(i, i + step)
        w = np.sqrt((qx[s, None] - rx) ** 2 + (qy[s, None] - ry) ** 2)
        np.maximum(w, rc, out=w)
        np.maximum(w, qc[s, None], out=w)
        w[qf[s, None] == rf] = np.inf
        at[s] = w.argmin(1)
        best[s] = w[np.arange(len(w)), at[s]]
    return at, best


def _by_component(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    """The cheapest edge of each component of ``q`` to points of ``r``: ``comp, w, a, b, other``."""
    at, w = cheapest(q, r)
    ok = np.isfinite(w)
    other = r.iloc[at[ok]]
    mine, theirs = q["record_id"].to_numpy()[ok], other["record_id"].to_numpy()
    found = pd.DataFrame({"comp": q["comp"].to_numpy()[ok], "w": w[ok], "a": np.minimum(mine, theirs),
                          "b": np.maximum(mine, theirs), "other": other["comp"].to_numpy()})
    return found.sort_values(["comp", "w", "a", "b"]).drop_duplicates("comp")


class Merged:
    """Union-find whose representatives are the smallest labels."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, c: int) -> int:
        top = c
        while (nxt := self.up.get(top, top)) != top:
            top = nxt
        while c != top:
            self.up[c], c = top, self.up.get(c, c)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = sorted((self.root(a), self.root(b)))
        if a != b:
            self.up[b] = a
        return a != b


def _settle(block: pd.DataFrame, boxes: np.ndarray, number: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The block's points with their components after all sure merges inside it, and the tree's edges found."""
    p = block.sort_values("record_id", kind="stable").reset_index(drop=True)
    if np.isnan(p["lb"].to_numpy()).all():
        p["lb"] = _outside(p, boxes, number)
    edges = []
    sure = np.maximum(p["core"].to_numpy(), p["lb"].to_numpy()) * (1 - SLACK)
    while True:
        comp = p["comp"].to_numpy()
        bound = pd.Series(sure).groupby(comp).min()
        here = pd.Series(p["home"].to_numpy() >= 0).groupby(comp).all()
        asking = here[here].index
        if not len(asking):
            break
        found = _by_component(p[p["comp"].isin(asking)], p)
        found = found[found["w"].to_numpy() < bound.loc[found["comp"]].to_numpy()]
        if not len(found):
            break
        merged = Merged()
        new = [e for e in found.itertuples() if merged.join(e.comp, e.other)]
        edges += [(e.w, e.a, e.b) for e in new]
        label = {c: merged.root(c) for c in np.unique(comp).tolist()}
        p["comp"] = p["comp"].map(label)
        away = set(p.loc[p["home"] < 0, "comp"])              # what has grown into another block's component
        p.loc[p["comp"].isin(away), "home"] = -1
    return p, pd.DataFrame(edges, columns=["w", "a", "b"])


def _outside(p: pd.DataFrame, boxes: np.ndarray, number: int) -> np.ndarray:
    """Distance of each point to the nearest box of another block."""
    x, y = p["x"].to_numpy(), p["y"].to_numpy()
    own = np.array([x.min(), x.max(), y.min(), y.max()])
    others = boxes[boxes[:, 0] != number, 1:5]
    if not len(others):
        return np.full(len(p), np.inf)
    dx = np.maximum(np.maximum(others[:, 0] - own[1], own[0] - others[:, 1]), 0)
    dy = np.maximum(np.maximum(others[:, 2] - own[3], own[2] - others[:, 3]), 0)
    gap = np.sqrt(dx * dx + dy * dy)
    reach = math.hypot(own[1] - own[0], own[3] - own[2])
    near, beyond = others[gap <= reach], gap[gap > reach]
    out = np.full(len(p), beyond.min() if len(beyond) else np.inf)
    for i in range(0, len(near), 1024):
        out = np.minimum(out, box_distance(x, y, near[i:i + 1024]).min(1))
    return out


def _local(shared):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        number = int(block["block"].iloc[0])
        p, edges = _settle(block.drop(columns="block"), shared.value, number)
        best = _by_component(p, p)
        cores = p.groupby("comp").agg(core=("core", "min"), home=("home", "min")).reset_index()
        best = cores.merge(best, "left", "comp")              # without an edge where one component fills the block
        parts = [p.assign(kind="point"), edges.assign(kind="edge"), best.assign(kind="best")]
        out = pd.concat([x for x in parts if len(x)], ignore_index=True).assign(block=number)
        return out.reindex(columns=[c.split()[0] for c in _LOCAL.split(", ")]).astype(
            {"kind": object} | {c: "Int64" for c in ("record_id", "comp", "home", "a", "b", "other")})
    return run


def _visits(shared):
    """Points of a block with the blocks that they must visit (``target``)."""
    def run(p: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        table, whole, filled = shared.value                   # number, box, least and greatest core; whether one component fills it, and which
        names = ["target", "record_id", "x", "y", "core", "comp"]
        out = []
        # all components of the block at once: a point's bound is that of its component
        u = p["comp"].map(dict(zip(bounds["of_comp"], bounds["u"]))).to_numpy(float)
        elsewhere = table[:, 0] != p["block"].iloc[0] if len(p) else np.zeros(0, bool)
        comps = p["comp"].to_numpy()
        for comp in np.unique(comps[np.isnan(u)]).tolist():   # no edge known yet: the farthest that the cheapest can be
            rows, other = comps == comp, table[elsewhere & ~(whole & (filled == comp))]
            x, y, core = (p[c].to_numpy()[rows] for c in ("x", "y", "core"))
            u[rows] = min((float(np.maximum(np.maximum(_far_distance(x, y, other[i:i + 1024, 1:5]), other[i:i + 1024, 6]),
                                            core[:, None]).min()) for i in range(0, len(other), 1024)), default=-np.inf)
        some = p["core"].to_numpy() <= u
        if some.any():
            rows, u, comps = p[some], u[some], comps[some]
            x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
            own = np.array([x.min(), x.max(), y.min(), y.max()])
            gap = np.maximum(np.maximum(table[:, 1] - own[1], own[0] - table[:, 2]), 0) ** 2 \
                + np.maximum(np.maximum(table[:, 3] - own[3], own[2] - table[:, 4]), 0) ** 2
            close = np.flatnonzero(elsewhere & (np.sqrt(gap) * (1 - SLACK) <= u.max()) & (table[:, 5] <= u.max()))
            for i in range(0, len(close), 256):
                near = close[i:i + 256]
                visit = (box_distance(x, y, table[near, 1:5]) <= u[:, None]) & (table[near, 5] <= u[:, None]) \
                    & ~(whole[near] & (filled[near] == comps[:, None]))
                at, which = visit.nonzero()
                v = rows.iloc[at][["record_id", "x", "y", "core", "comp"]].copy()
                v["target"] = table[near[which], 0].astype("int64")
                out.append(v)
        if not out:
            return pd.DataFrame({c: pd.Series([], dtype="float64" if c in ("x", "y", "core") else "int64") for c in names})
        return pd.concat(out)[names]
    return run


def _meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    if q.empty or r.empty:
        return pd.DataFrame({c: pd.Series([], dtype="float64" if c == "w" else "int64") for c in ("comp", "w", "a", "b", "other")})
    return _by_component(q, r.sort_values("record_id", kind="stable"))


def _merge_on_driver(chosen: list) -> list[tuple[int, int, int]]:
    """``(comp, new, home)`` for every component: its new label, and the block that holds all of it, or -1."""
    merged = Merged()
    for r in chosen:
        merged.join(r["comp"], r["other"])
    home: dict[int, int] = {}
    for r in chosen:
        new = merged.root(r["comp"])
        home[new] = r["home"] if home.get(new, r["home"]) == r["home"] else -1
    return [(r["comp"], (new := merged.root(r["comp"])), home[new]) for r in chosen]


def _merge_by_joins(chosen: DataFrame) -> DataFrame:
    """The same by pointer jumping: of two components that chose each other the smaller label is the root."""
    par = chosen.select("comp", F.col("other").alias("parent"), "home")
    back = par.select(F.col("comp").alias("parent"), F.col("parent").alias("pp"))
    top = (F.col("pp") == F.col("comp")) & (F.col("comp") < F.col("parent"))
    par = par.join(back, "parent", "left").select(
        "comp", F.when(top, F.col("comp")).otherwise(F.col("parent")).alias("parent"), "home").checkpoint()
    while True:
        hop = par.select(F.col("comp").alias("parent"), F.col("parent").alias("grand"))
        nxt = par.join(hop, "parent").select("comp", F.col("grand").alias("parent"), "home", F.col("parent").alias("old")).checkpoint()
        changed = nxt.where("parent <> old").limit(1).count()
        par = nxt.drop("old")
        if not changed:
            break
    one = par.groupBy("parent").agg(F.min("home").alias("h0"), F.max("home").alias("h1"), F.min("comp").alias("new"))
    one = one.select("parent", "new", F.when(F.col("h0") == F.col("h1"), F.col("h0")).otherwise(F.lit(-1)).alias("home"))
    return par.drop("home").join(one, "parent").select("comp", "new", "home")


class NotSettled(RuntimeError):
    """The rounds allowed left more than one component."""


@dataclass
class Tree:
    """Edges ``(a, b, w)`` between the points kept of equal ones, those points ``(record_id, block, copies)``, and the others ``(record_id, kept)``."""

    links: DataFrame
    nodes: DataFrame
    copies: DataFrame | None
    blocks: int

    def edges(self) -> DataFrame:
        """All edges of the tree: the others hang on the point kept."""
        if self.copies is None:
            return self.links
        return self.links.unionByName(self.copies.select(F.col("kept").alias("a"), F.col("record_id").alias("b"), F.lit(0.0).alias("w")))


def _copies(pts: DataFrame, min_samples: int) -> tuple[DataFrame, DataFrame | None]:
    """One row for each set of at least ``min_samples`` equal points (their smallest id, core distance 0), the others as they are.

    All their edges with each other weigh 0, so the tree joins each to the smallest id.
    """
    heaps = pts.groupBy("x", "y").agg(F.count(F.lit(1)).alias("copies"), F.min("record_id").alias("kept")) \
        .where(F.col("copies") >= max(2, min_samples)).checkpoint()
    if heaps.isEmpty():
        return pts.withColumn("copies", F.lit(1).cast("long")), None
    marked = pts.join(heaps, ["x", "y"], "left")
    kept = marked.where(F.col("kept").isNull() | (F.col("kept") == F.col("record_id")))
    one = kept.select("record_id", "x", "y", F.coalesce("copies", F.lit(1)).alias("copies"))
    more = marked.where(F.col("kept") != F.col("record_id")).select("record_id", "kept")
    return one, more.checkpoint()


def _cores(pts: DataFrame, min_samples: int, block_size: int, heaps: bool) -> DataFrame:
    """``(record_id, core)``: as :func:`core_distances`, a heap counting as often as it has copies."""
    from shoal.operators.neighbors import knn_plane

    nn = knn_plane(pts, min_samples, block_size=block_size)
    if not heaps:
        return nn.groupBy("record_id").agg(F.max("dist").alias("core"))
    many = pts.where(F.col("copies") >= min_samples).select(F.col("record_id").alias("neighbor_id"), F.lit(True).alias("heap"))
    near = nn.join(many, "neighbor_id", "left")
    return near.groupBy("record_id").agg(F.least(F.max("dist"), F.min(F.when(F.col("heap"), F.col("dist")))).alias("core"))


def spanning_tree(points: DataFrame, min_samples: int = 3, block_size: int = BLOCK_SIZE, max_rounds: int = 64) -> Tree:
    """The minimum spanning tree of the mutual-reachability graph of ``(record_id, x, y)``, with its points' blocks.

    Raises :class:`NotSettled` if ``max_rounds`` rounds leave more than one component.
    """
    from shoal.operators.neighbors import _curve

    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    pts = points.select(F.col("record_id").cast("long").alias("record_id"), F.col("x").cast("double").alias("x"),
                        F.col("y").cast("double").alias("y"))
    ones, more = _copies(pts, min_samples)
    ones = ones.checkpoint()
    box = ones.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
                   F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not box["n"]:
        return Tree(spark.createDataFrame([], "a long, b long, w double"),
                    spark.createDataFrame([], "record_id long, block int, copies long"), None, 1)
    blocks = blocks_for(box["n"], block_size)
    core = _cores(ones, min_samples, block_size, more is not None)
    dealt = ones.join(core, "record_id").repartitionByRange(blocks, _curve(F.col("x"), F.col("y"), box), "record_id") \
        .withColumn("block", F.spark_partition_id()).checkpoint()
    return Tree(_rounds(spark, dealt, blocks, max_rounds), dealt.select("record_id", "block", "copies"), more, blocks)


def _rounds(spark: SparkSession, dealt: DataFrame, blocks: int, max_rounds: int) -> DataFrame:
    boxes = dealt.groupBy("block").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.min("core").alias("c0"), F.max("core").alias("c1")).orderBy("block").toPandas().to_numpy(float)    # at most MOST_BLOCKS rows
    shared = spark.sparkContext.broadcast(boxes)
    state = dealt.select("block", "record_id", "x", "y", "core", F.lit(float("nan")).alias("lb"),
                         F.col("record_id").alias("comp"), F.col("block").alias("home"))
    found: list[DataFrame] = []
    edge = ("a", "b", "w")
    for _ in range(max_rounds):
        step = by_block(state, len(boxes), "block").groupBy("block").applyInPandas(_local(shared), _LOCAL).checkpoint()
        found.append(step.where("kind = 'edge'").select(*edge))
        best = step.where("kind = 'best'")
        fills = best.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("comp")).toPandas()
        by = {b: (n == 1, c) for b, n, c in fills.itertuples(index=False)}
        whole, filled = (np.array([by[int(b)][i] for b in boxes[:, 0]]) for i in (0, 1))
        if whole.all() and (filled == filled[0]).all():
            return _union(found)
        tables = spark.sparkContext.broadcast((boxes, whole, filled))
        real = best.where("w is not null")
        bound = real.groupBy("comp").agg(F.min("w").alias("u"))
        bounds = best.select("block", "comp").join(bound, "comp", "left").select(
            F.col("block").alias("of_block"), F.col("comp").alias("of_comp"), "u")
        pts = step.where("kind = 'point'").select("block", *(c.split()[0] for c in _STATE.split(", ")))
        many = len(boxes)
        asked = by_block(pts, many, "block").groupBy("block").cogroup(by_block(bounds, many, "of_block").groupBy("of_block")).applyInPandas(
            _visits(tables), "target int, record_id long, x double, y double, core double, comp long")
        there = pts.select(F.col("block").alias("target"), "record_id", "x", "y", "core", "comp")
        across = by_block(asked, many, "target").groupBy("target").cogroup(by_block(there, many, "target").groupBy("target")).applyInPandas(
            _meet, f"comp long, {_EDGE}, other long")
        every = real.select("comp", "w", "a", "b", "other").unionByName(across)
        home = best.groupBy("comp").agg(F.min("home").alias("home"))
        chosen = every.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).join(home, "comp") \
            .select("comp", "home", "e.*").checkpoint()
        found.append(chosen.select(*edge))
        if chosen.count() <= DRIVER_MERGES:
            names = F.broadcast(spark.createDataFrame(_merge_on_driver(chosen.collect()), "comp long, new long, home int"))
        else:
            names = _merge_by_joins(chosen)
        state = pts.drop("home").join(names, "comp").select("block", "record_id", "x", "y", "core", "lb",
                                                            F.col("new").alias("comp"), "home")
    raise NotSettled(f"spanning_tree: not settled after {max_rounds} rounds")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["a", "b"])                      # two components may have chosen the same edge
