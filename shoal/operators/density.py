"""M4d and M4: hierarchical density clusters from the spanning tree, by tree contraction.

The dendrogram over the tree's edges is never built in one task.  Nodes (points at
first) lie in groups of blocks; in its group a component merges along its cheapest
edge as long as that edge does not leave the group, since then no other part of
the data has a say in it.  What is left of a group are the components that
wait for an edge leaving it, one row each, and the edges between them.  Sixteen
groups make one of the next level, until one group holds all.

A component needs few numbers to go on: its size, and, once it has
``min_cluster_size`` points, the cluster that it is in, the sum of 1 / distance
over the points that have left that cluster so far, and the best total stability below
it.  Two such components that merge close their clusters; a smaller one that
merges into such a component leaves its points there.  A closed cluster is
taken if its stability is at least that of the best choice below it.  The way
back goes through the same groups in reverse: a cluster is covered by the
topmost taken one above it, or by itself if it is taken.  The root is never taken.

Edges are compared by (weight, a, b): the outcome is the same for any partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators.cluster import ClusterRun
from shoal.operators.spanning import BLOCK_SIZE, Tree, spanning_tree
from shoal.session import ensure_checkpoint_dir

#: Groups that make one of the next level.
FAN = 16

_NODE = "node long, size long, cluster string, lam double, inner double"
_STEP = f"kind string, grp int, to long, {_NODE}, parent string, stability double, take boolean, seq int, u long, v long, w double, a long, b long"
_NAMES = [c.split()[0] for c in _STEP.split(", ")]


class _Part:
    """A component: its size, its smallest nodes while it is small, its open cluster once it is not."""

    __slots__ = ("size", "small", "cluster", "lam", "inner", "out")

    def __init__(self, size, small, cluster, lam, inner, out):
        self.size, self.small, self.cluster, self.lam, self.inner, self.out = size, small, cluster, lam, inner, out


def _contract(nodes: pd.DataFrame, edges: pd.DataFrame, least: int, last: bool) -> list[dict]:
    """The rows of one group: where each node went, what is left, and the clusters closed."""
    parts: dict[int, _Part] = {}
    up: dict[int, int] = {}
    for r in nodes.itertuples():
        out = (r.w, int(r.a), int(r.b)) if r.a is not None and not pd.isna(r.a) else (math.inf, 0, 0)
        cluster = None if pd.isna(r.cluster) else r.cluster
        parts[r.node] = _Part(r.size, [] if cluster else [r.node], cluster, r.lam, r.inner, out)
    attached: dict[int, str] = {}
    rows: list[dict] = []

    def root(c):
        top = c
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while c != top:
            up[c], c = top, up.get(c, c)
        return top

    def leave(p: _Part, cluster: str):
        for n in p.small:
            attached[n] = cluster
        p.small = []

    def close(p: _Part, lam: float, parent: str | None) -> float:
        stability = p.lam - p.size * lam
        take = parent is not None and stability >= p.inner
        rows.append({"kind": "closed", "cluster": p.cluster, "parent": parent, "size": p.size,
                     "stability": stability, "take": take, "seq": len(rows)})
        return max(stability, p.inner)

    left = []
    for e in edges.sort_values(["w", "a", "b"]).itertuples():
        i, j = root(e.u), root(e.v)
        x, y = parts[i], parts[j]
        key = (e.w, e.a, e.b)
        if x.out < key or y.out < key:                        # one of them merges elsewhere first, and so the other waits
            x.out, y.out = min(x.out, key), min(y.out, key)
            left.append(e)
            continue
        lam = 1.0 / e.w if e.w > 0 else math.inf
        i, j = min(i, j), max(i, j)
        name = f"{e.a}:{e.b}"
        z = _Part(x.size + y.size, [], None, 0.0, -math.inf, min(x.out, y.out))
        if x.cluster and y.cluster:
            z.cluster, z.inner = name, close(x, lam, name) + close(y, lam, name)
            z.lam = z.size * lam
        elif x.cluster or y.cluster:
            big, little = (x, y) if x.cluster else (y, x)
            leave(little, big.cluster)
            z.cluster, z.lam, z.inner = big.cluster, big.lam + little.size * lam, big.inner
        elif z.size >= least:
            z.cluster, z.lam = name, z.size * lam
            leave(x, name)
            leave(y, name)
        else:
            z.small = x.small + y.small
        up[j] = i
        parts[i] = z
        del parts[j]
    if last:
        for p in parts.values():
            if p.cluster:
                close(p, 0.0, None)
    for n in nodes["node"].tolist():
        rows.append({"kind": "node", "node": n, "to": root(n), "cluster": attached.get(n)})
    rows += [{"kind": "stub", "node": n, "size": p.size, "cluster": p.cluster, "lam": p.lam, "inner": p.inner}
             for n, p in parts.items()]
    rows += [{"kind": "edge", "u": root(e.u), "v": root(e.v), "w": e.w, "a": e.a, "b": e.b} for e in left]
    return rows


def _contracted(least: int, last: bool):
    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        grp = int(nodes["grp"].iloc[0])
        out = pd.DataFrame(_contract(nodes, edges, least, last)).assign(grp=grp).reindex(columns=_NAMES)
        for c in ("kind", "cluster", "parent"):
            out[c] = out[c].astype(object).where(out[c].notna(), None)
        out["take"] = out["take"].astype("boolean")
        whole = ["to", "node", "size", "seq", "u", "v", "a", "b"]
        return out.astype({c: "Int64" for c in whole}).astype({c: "float64" for c in ("lam", "inner", "stability", "w")})
    return run


def _covers(g: pd.DataFrame) -> pd.DataFrame:
    """The topmost taken cluster at or above each closed one of a group; parents were closed after their children."""
    cover: dict[str, str | None] = {}
    for r in g.sort_values("seq", ascending=False).itertuples():
        above = cover.get(r.parent) if r.parent in cover else (None if pd.isna(r.above) else r.above)
        cover[r.cluster] = above or (r.cluster if r.take else None)
    return pd.DataFrame({"cluster": pd.Series(list(cover), dtype=object), "cover": pd.Series(list(cover.values()), dtype=object)})


def condensed_tree(tree: Tree, min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """M4d: ``(clusters, points)`` of the condensed tree.

    ``clusters``: ``cluster, parent`` (null for the root), ``size, stability, taken``.
    ``points``: ``record_id, cluster``, the taken cluster that holds the point, null for noise.
    """
    spark = tree.links.sparkSession
    ensure_checkpoint_dir(spark)
    least = min_cluster_size
    depth = max(0, math.ceil(math.log(max(tree.blocks, 1), FAN) - 1e-9))
    heap = F.col("copies") >= F.lit(max(least, 2))
    nodes = tree.nodes.select(
        F.col("record_id").alias("node"), F.col("copies").alias("size"),
        F.when(heap, F.col("record_id").cast("string")).alias("cluster"),
        F.when(heap, F.lit(math.inf)).otherwise(F.lit(0.0)).alias("lam"), F.lit(-math.inf).alias("inner"), F.col("block").alias("grp"))
    at = tree.nodes.select("record_id", F.col("block"))
    edges = tree.links.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v"))
    if depth:
        for end, grp in (("u", "gu"), ("v", "gv")):
            edges = edges.join(at.select(F.col("record_id").alias(end), F.col("block").alias(grp)), end)
    else:
        edges = edges.withColumn("gu", F.lit(0)).withColumn("gv", F.lit(0))
        nodes = nodes.withColumn("grp", F.lit(0))
    edges = edges.select("u", "v", "gu", "gv", "w", "a", "b").checkpoint()
    went, closed = [], []
    for level in range(depth + 1):
        cross = edges.where("gu <> gv")
        ends = cross.select(F.col("u").alias("node"), "w", "a", "b").union(cross.select("v", "w", "a", "b"))
        waits = ends.groupBy("node").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("node", "e.*")
        here = nodes.join(waits, "node", "left")
        inner = edges.where("gu = gv").withColumnRenamed("gu", "grp").drop("gv")
        step = here.groupBy("grp").cogroup(inner.groupBy("grp")).applyInPandas(
            _contracted(least, level == depth), _STEP).checkpoint()
        went.append(step.where("kind = 'node'").select("node", "to", "cluster"))
        closed.append(step.where("kind = 'closed'").select("grp", "cluster", "parent", "size", "stability", "take", "seq"))
        if level == depth:
            break
        up = F.expr(f"grp div {FAN}").cast("int")
        nodes = step.where("kind = 'stub'").select("node", "size", "cluster", "lam", "inner", up.alias("grp"))
        moved = cross
        for end in ("u", "v"):
            moved = moved.join(went[-1].select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end)
        moved = moved.select(F.col("u_to").alias("u"), F.col("v_to").alias("v"), F.expr(f"gu div {FAN}").cast("int").alias("gu"),
                             F.expr(f"gv div {FAN}").cast("int").alias("gv"), "w", "a", "b")
        left = step.where("kind = 'edge'").select("u", "v", up.alias("gu"), up.alias("gv"), "w", "a", "b")
        edges = moved.unionByName(left).checkpoint()

    covers = None
    for level in range(depth, -1, -1):
        rows = closed[level]
        above = rows.withColumn("above", F.lit(None).cast("string")) if covers is None else rows.join(
            covers.select(F.col("cluster").alias("parent"), F.col("cover").alias("above")), "parent", "left")
        found = above.groupBy("grp").applyInPandas(lambda g: _covers(g), "cluster string, cover string").checkpoint()
        covers = found if covers is None else covers.unionByName(found)

    # each point's innermost cluster: at the level where its part grew large enough, or met such a part
    spot = went[0].select(F.col("node").alias("record_id"), "to", "cluster")
    for later in went[1:]:
        nxt = later.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("cluster").alias("c2"))
        spot = spot.join(nxt, "to", "left").select("record_id", F.col("to2").alias("to"), F.coalesce("cluster", "c2").alias("cluster"))
    heaps = tree.nodes.where(heap).select("record_id", F.col("record_id").cast("string").alias("own"))
    spot = spot.join(heaps, "record_id", "left").select("record_id", F.coalesce("own", "cluster").alias("cluster"))
    points = spot.join(covers, "cluster", "left").select("record_id", F.col("cover").alias("cluster"))
    if tree.copies is not None:
        of = points.select(F.col("record_id").alias("kept"), "cluster")
        points = points.unionByName(tree.copies.join(of, "kept").select("record_id", "cluster"))
    clusters = closed[0]
    for c in closed[1:]:
        clusters = clusters.unionByName(c)
    clusters = clusters.drop("grp", "seq").join(covers, "cluster").select(
        "cluster", "parent", "size", "stability", (F.coalesce("cover", F.lit("")) == F.col("cluster")).alias("taken"))
    return clusters, points.checkpoint()


def numbered(points: DataFrame) -> DataFrame:
    """``(record_id, cluster INT)``: clusters numbered from 0 by their smallest record id, noise -1.

    The numbers come from a range sort and the partitions' offsets, not from one task.
    """
    first = points.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.min("record_id").alias("first"))
    sort = first.orderBy("first").withColumn("pid", F.spark_partition_id()).checkpoint()
    sizes = {r["pid"]: r["count"] for r in sort.groupBy("pid").count().collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]

    def run(batches):
        n: dict[int, int] = {}
        for b in batches:
            out = []
            for p in b["pid"].tolist():
                out.append(starts[p] + n.get(p, 0))
                n[p] = n.get(p, 0) + 1
            yield pd.DataFrame({"cluster": b["cluster"].astype(object), "number": np.array(out, "int32")})

    names = sort.select("cluster", "pid").mapInPandas(run, "cluster string, number int")
    return points.join(names, "cluster", "left").select("record_id", F.coalesce("number", F.lit(-1)).cast("int").alias("cluster"))


def density(points: DataFrame, min_cluster_size: int = 5, min_samples: int = 3, n_rows: int | None = None,
            block_size: int = BLOCK_SIZE) -> ClusterRun:
    """M4: density clusters of ``(record_id, x, y)``; noise is -1.

    ``min_cluster_size`` is clamped to max(2, n // 5) and ``min_samples`` to that.
    """
    ensure_checkpoint_dir(points.sparkSession)
    n = n_rows if n_rows is not None else points.count()
    least = min(min_cluster_size, max(2, n // 5))
    tree = spanning_tree(points, min(min_samples, least), block_size)
    labels = numbered(condensed_tree(tree, least)[1]).checkpoint()
    st = labels.agg(F.max("cluster").alias("top"), F.count(F.when(F.col("cluster") < 0, 1)).alias("noise")).first()
    return ClusterRun(labels, "hdbscan", "hdbscan", 0 if st["top"] is None else st["top"] + 1, int(st["noise"]))
