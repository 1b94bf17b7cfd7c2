"""Sharding by a k-d tree over document metadata (DataFrame functions only).

Equal texts form a group that moves as one.  The tree starts with all groups;
each node is split along its widest metadata dimension at the weighted median
of the groups' bytes, until a leaf holds the target bytes.  A median is found
by histograms: every round sums bytes by (node, bin) in Spark, the driver picks
each node's crossing bin, and the next round looks only inside it.  The driver
sees at most ``MAX_BINS`` sums a round, never groups or documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import documents, materialise

#: Sums that one round brings to the driver, over all nodes of a level.
MAX_BINS = 1 << 15
#: A cut is exact enough when the open bin holds this share of a leaf's bytes.
TOLERANCE = 0.0005
#: A node whose best cut is off by this share of its bytes tries its next widest dimension.
RETRY = 0.002
#: Trees up to so many nodes a level are sent to the tasks as a broadcast table.
BROADCAST_NODES = 100_000
_TIE_MAX = (1 << 62) - 1


def _prefix(c: Column) -> Column:
    """The first six bytes of a string as a number that keeps their order; null first."""
    hexed = F.rpad(F.hex(F.substring(F.coalesce(c.cast("string"), F.lit("")).cast("binary"), 1, 6)), 12, "0")
    return F.conv(hexed, 16, 10).cast("bigint")


def document_dims(docs: DataFrame) -> dict[str, Column]:
    """The dimensions used for ``documents``: those of size, id, language and source that exist."""
    dims = {"size": F.col("_size")}
    if "doc_id" in docs.columns:
        dims["doc_id"] = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1).cast("bigint"))
    for c in ("lang", "source"):
        if c in docs.columns:
            dims[c] = _prefix(F.col(c))
    return dims


@dataclass
class _Search:
    """One node's search for its cut: positions lo..hi hold the target, ``base`` bytes lie below."""

    dim: int
    lo: int
    hi: int
    base: int
    target: float
    total: int
    value: int | None = None      # set once the search is among equal values, by tie


@dataclass
class _Cut:
    dim: int
    value: int
    tie: int
    off: float


def _side(nodes: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    return groups.join(F.broadcast(nodes) if n <= BROADCAST_NODES else nodes, "node")


def _find_cuts(groups: DataFrame, open_: dict[int, _Search], tol: float) -> dict[int, _Cut]:
    """The cut of each node: the boundary nearest to its target, by histogram rounds."""
    spark, cuts = groups.sparkSession, {}
    open_ = dict(open_)
    while open_:
        bins = max(16, min(1024, MAX_BINS // len(open_)))
        rows = [(k, s.dim, s.value, s.lo, s.hi, max(1, -(-(s.hi - s.lo + 1) // bins))) for k, s in open_.items()]
        nodes = spark.createDataFrame(rows, "node int, dim int, value bigint, lo bigint, hi bigint, width bigint")
        x = F.element_at("dims", F.col("dim") + 1)
        at = F.when(F.col("value").isNull(), x).otherwise(F.col("tie"))
        hist = _side(nodes, groups, len(rows)).where(F.col("value").isNull() | (x == F.col("value"))) \
            .withColumn("_at", at).where(F.col("_at").between(F.col("lo"), F.col("hi"))) \
            .groupBy("node", F.expr("(_at - lo) div width").alias("bin")) \
            .agg(F.sum("bytes").alias("w"), F.min("_at").alias("first"), F.max("_at").alias("last"))
        by_node: dict[int, list] = {}
        for r in hist.collect():
            by_node.setdefault(r["node"], []).append(r)
        for k, s in list(open_.items()):
            below = s.base
            found = sorted(by_node.get(k, []), key=lambda r: r["bin"])
            for r in found:
                if below + r["w"] >= s.target or r is found[-1]:
                    break
                below += r["w"]
            if not found:                                      # an empty node
                cuts[k] = _Cut(s.dim, s.hi, _TIE_MAX, 0.0)
                del open_[k]
            elif r["first"] < r["last"] and r["w"] > tol:
                open_[k].lo, open_[k].hi, open_[k].base = r["first"], r["last"], below
            elif s.value is None and r["first"] == r["last"] and r["w"] > tol:
                open_[k] = _Search(s.dim, 0, _TIE_MAX, below, s.target, s.total, r["first"])
            else:                                              # before or after this bin, whichever is nearer
                over, under = below + r["w"] - s.target, s.target - below
                edge, off = (r["last"], over) if over <= under else (r["first"] - 1, under)
                cuts[k] = _Cut(s.dim, edge, _TIE_MAX, abs(off)) if s.value is None \
                    else _Cut(s.dim, s.value, edge, abs(off))
                del open_[k]
    return cuts


def kd_leaves(groups: DataFrame, n_leaves: int) -> DataFrame:
    """Add ``leaf`` (0 to ``n_leaves - 1``) to ``groups(dims array<bigint>, tie, bytes, ...)``.

    ``tie`` orders groups equal in a dimension.  Nodes that share their leaves
    unevenly are cut at the matching weighted quantile.
    """
    spark = groups.sparkSession
    groups = materialise(groups.withColumn("node", F.lit(0)), "op10-tree")
    stat = groups.agg(F.sum("bytes").alias("b"), F.max(F.size("dims")).alias("d")).first()
    total, n_dims = stat["b"] or 0, stat["d"] or 0
    tol = TOLERANCE * total / max(1, n_leaves)
    spans = {0: (0, n_leaves)}                                 # node -> its leaves
    world = None
    while total and any(hi - lo > 1 for lo, hi in spans.values()):
        ends = groups.groupBy("node").agg(F.sum("bytes").alias("b"), *[
            f(F.element_at("dims", d + 1)).alias(f"{n}{d}") for d in range(n_dims)
            for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        world = world or [max(1, ends[0][f"hi{d}"] - ends[0][f"lo{d}"]) for d in range(n_dims)]
        order, box = {}, {}
        for r in ends:
            k = r["node"]
            if spans[k][1] - spans[k][0] > 1:
                box[k] = r
                order[k] = sorted(range(n_dims), key=lambda d, r=r: -(r[f"hi{d}"] - r[f"lo{d}"]) / world[d])
        best: dict[int, _Cut] = {}
        for turn in range(n_dims):
            todo = {}
            for k, dims in order.items():
                if k in best and best[k].off <= max(tol, RETRY * box[k]["b"]):
                    continue
                lo, hi = spans[k]
                share = ((hi - lo) // 2) / (hi - lo)
                d = dims[turn]
                todo[k] = _Search(d, box[k][f"lo{d}"], box[k][f"hi{d}"], 0, share * box[k]["b"], box[k]["b"])
            for k, cut in _find_cuts(groups, todo, tol).items():
                if k not in best or cut.off < best[k].off:
                    best[k] = cut
        cuts = spark.createDataFrame([(k, c.dim, c.value, c.tie) for k, c in best.items()] or [(-1, 0, 0, 0)],
                                     "node int, dim int, value bigint, t bigint")
        x = F.element_at("dims", F.col("dim") + 1)
        left = (x < F.col("value")) | ((x == F.col("value")) & (F.col("tie") <= F.col("t")))
        cuts = F.broadcast(cuts) if len(best) <= BROADCAST_NODES else cuts
        stepped = groups.join(cuts, "node", "left").withColumn("node", F.when(
            F.col("dim").isNull(), F.col("node") * 2).otherwise(F.col("node") * 2 + F.when(left, 0).otherwise(1))) \
            .drop("dim", "value", "t")
        groups = materialise(stepped.withColumn("node", F.col("node").cast("int")), "op10-tree")
        nxt = {}
        for k, (lo, hi) in spans.items():
            mid = lo + (hi - lo) // 2
            if hi - lo > 1:
                nxt[2 * k], nxt[2 * k + 1] = (lo, mid), (mid, hi)
            else:
                nxt[2 * k] = (lo, hi)
        spans = nxt
    leaves = spark.createDataFrame([(k, lo) for k, (lo, _) in spans.items()], "node int, leaf int")
    return _side(leaves, groups, len(spans)).drop("node")


def shard_groups(rows: DataFrame, n_shards: int) -> tuple[DataFrame, dict[str, int]]:
    """``(gkey, piece, shard)`` for ``rows(doc_id, gkey, size, dims)``, and the groups that go in pieces.

    A group over a shard's bytes cannot stay whole if shards are to be equal: it
    goes in pieces of about a quarter shard.  There are fewer such groups than
    shards, so they are listed on the driver.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = total / max(1, n_shards)
    large = rows.groupBy("gkey").agg(F.sum("size").alias("b")).where(F.col("b") > target).collect() if total else []
    pieces = {r["gkey"]: ceil(4 * r["b"] / target) for r in large}
    rows = with_piece(rows, pieces)
    n_dims = rows.select(F.max(F.size("dims"))).first()[0] or 0
    groups = rows.groupBy("gkey", "piece").agg(F.sum("size").alias("bytes"), *[
        F.min(F.element_at("dims", d + 1)).alias(f"d{d}") for d in range(n_dims)])
    groups = groups.select("gkey", "piece", "bytes", F.array(*[f"d{d}" for d in range(n_dims)]).cast(
        "array<bigint>").alias("dims"), F.shiftrightunsigned(F.xxhash64("gkey", "piece"), 2).alias("tie"))
    return kd_leaves(groups, n_shards).select("gkey", "piece", F.col("leaf").alias("shard")), pieces


def with_piece(rows: DataFrame, pieces: dict[str, int]) -> DataFrame:
    """Add ``piece``: 0, or for a listed group a number that its ``doc_id`` decides."""
    piece = F.lit(0).cast("bigint")
    for g, n in pieces.items():
        piece = F.when(F.col("gkey") == g, F.pmod(F.xxhash64("doc_id"), F.lit(n))).otherwise(piece)
    return rows.withColumn("piece", piece.cast("bigint"))


def numbered(rows: DataFrame, by: str, order: list[str], tag: str) -> DataFrame:
    """Add ``slot``: a gapless number from 0 within ``by``, in the order given.

    The rows are range-sorted and written once; the driver sees one count for
    each (task, value of ``by``), so no window holds a whole shard.
    """
    at = materialise(rows.repartitionByRange(*[F.col(c) for c in [by, *order]])
                     .sortWithinPartitions(by, *order).withColumn("_i", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_i", 33)
    counts = at.groupBy(part.alias("_p"), by).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("n")).collect()
    seen: dict = {}
    offsets = []
    for r in sorted(counts, key=lambda r: r["_p"]):
        offsets.append((r["_p"], r[by], seen.get(r[by], 0) - r["_first"]))
        seen[r[by]] = seen.get(r[by], 0) + r["n"]
    off = rows.sparkSession.createDataFrame(offsets, "_p bigint, _by int, _off bigint")
    # at most one row for each task and one more for each shard
    return at.join(F.broadcast(off), (part == F.col("_p")) & (F.col(by) == F.col("_by"))) \
        .withColumn("slot", F.col("_i") + F.col("_off")).drop("_p", "_by", "_off", "_i")


def kd_shard(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, text: str = "text",
             doc_id: str = "doc_id", dims: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 1.  Give ``n_shards``, or
    ``target_bytes`` for as many leaves as the total needs.  Equal texts share a
    shard (null counts as empty); only a group of more bytes than a shard is
    dealt in pieces.  Null metadata sort first, repeated rows and ids are rows of
    their own, an empty table gives an empty result, and shards may stay empty
    when there are fewer groups.  Columns other than the named ones are not read.
    """
    dims = document_dims(docs) if dims is None else dims
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_size", (F.octet_length(t) + 1).cast("bigint")).select(
        F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.col("_size").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), F.sha2(t.cast("binary"), 256).alias("gkey"),
        F.array(*[c.cast("bigint") for c in dims.values()]).alias("dims"))
    rows = materialise(rows, "op10-rows")
    if n_shards is None:
        n_shards = max(1, ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    shards, pieces = shard_groups(rows, n_shards)
    placed = with_piece(rows, pieces).join(shards, ["gkey", "piece"]).select("uid", "doc_id", "size", "text_crc32", "shard")
    return numbered(placed, "shard", ["doc_id", "uid"], "op10-slots").drop("uid")


def op10_kd_sharding(spark, sf_dir: str) -> DataFrame:
    return kd_shard(documents(spark, sf_dir), n_shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, n_shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows with their own columns and ``shard`` (a column of that name is replaced).

    Shards as :func:`kd_shard`: rows of equal texts, such as the copies of a mixture, stay together.
    """
    dims = document_dims(docs)
    t = F.coalesce(F.col(text), F.lit(""))
    own = [F.col(c) for c in docs.columns if c != "shard"]
    wide = docs.withColumn("_size", (F.octet_length(t) + 1).cast("bigint")).select(
        F.struct(*own).alias("_row"), F.col(doc_id).alias("doc_id"), F.col("_size").alias("size"),
        F.sha2(t.cast("binary"), 256).alias("gkey"),
        F.array(*[c.cast("bigint") for c in dims.values()]).alias("dims"))
    rows = materialise(wide.select("doc_id", "size", "gkey", "dims"), "op10-rows")
    shards, pieces = shard_groups(rows, n_shards)
    return with_piece(wide, pieces).join(shards, ["gkey", "piece"]).select("_row.*", "shard")
