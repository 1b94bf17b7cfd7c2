"""Helpers shared by the corpus operators: shared-folder tables, row batches, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.session import ensure_checkpoint_dir, ship_package

#: Rows handed to Python at once; with texts of about 100 kB a batch stays near 25 MB.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> str:
    """Ship the package to the workers and return the shared checkpoint folder."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def materialise(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor re-reads files that every machine sees,
    and values that depend on task placement (row numbers) stay fixed.
    """
    spark = df.sparkSession
    path = f"{prepare(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with small batches, so that a task's memory follows text sizes, not row counts."""
    spark = df.sparkSession
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(fn, schema)


#: ``attach`` treats a key as frequent from this share of the rows on, and from this many rows on.
HEAVY_SHARE, HEAVY_ROWS = 0.002, 200


def attach(rows: DataFrame, values: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``values`` on ``keys``; ``values`` has each key once and, in ``count``, its number of rows
    (left out of the result).

    Frequent keys (at most ``1 / HEAVY_SHARE`` of them, as each has over that
    share of the rows) are joined by broadcast, so that no task gets all rows of
    one; the others are shuffled.  ``rows`` should be a written table: it is read twice.
    """
    values = materialise(values, "attach")
    n = values.agg(F.sum(count)).first()[0] or 0
    hot = materialise(values.where(F.col(count) > max(HEAVY_ROWS, int(HEAVY_SHARE * n))), "attach-hot")
    values = values.drop(count)
    if hot.isEmpty():
        return rows.join(values, keys)
    hot = F.broadcast(hot.drop(count))
    return rows.join(hot, keys, "left_anti").join(values, keys).unionByName(rows.join(hot, keys))


def held_out(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null id counts as the empty string."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 5 == 0


def first_by_hash(rows: DataFrame, group: str, h: str, most: dict, ties: list[str]) -> DataFrame:
    """At most ``most[g]`` rows of each group ``g``: those with the smallest 64-bit hash ``h``, then by ``ties``.

    A group's count says below which hash one and a half times as many rows are to be
    expected, so the window that picks the exact ones sees no more than that,
    whatever the group's size; other groups than those in ``most`` are left out.
    """
    unit = F.shiftrightunsigned(h, 11) / float(1 << 53)
    counts = {r[group]: r["count"] for r in rows.where(F.col(group).isin(list(most))).groupBy(group).count().collect()}
    bound = F.lit(-1.0)
    for g, n in counts.items():
        bound = F.when(F.col(group) == g, F.lit(min(1.0, (1.5 * most[g] + 100) / n))).otherwise(bound)
    number = F.row_number().over(Window.partitionBy(group).orderBy(unit, *ties))
    limit = F.lit(0)
    for g in counts:
        limit = F.when(F.col(group) == g, F.lit(most[g])).otherwise(limit)
    return rows.where(unit < bound).withColumn("_i", number).where(F.col("_i") <= limit).drop("_i")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` for undirected ``edges(a, b)``: component is the smallest node reachable.

    Minimum labels travel along edges and labels are then shortened by pointer
    jumping, each round a pair of equi-joins written to the shared folder.
    Only the number of changed labels reaches the driver.  Raises if
    ``max_rounds`` rounds don't settle it, rather than return partial classes.
    """
    e = edges.select("a", "b").where("a <> b").distinct()
    both = materialise(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(
        F.min("b").alias("_n")).select("node", F.least("node", "_n").alias("component")), "cc")
    for _ in range(max_rounds):
        told = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(
            F.min("component").alias("_m"))
        step = labels.join(told, "node", "left").select(
            "node", F.least("component", F.coalesce("_m", "component")).alias("component"),
            F.col("component").alias("_old"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        new = materialise(step.join(up, "component", "left").select(
            "node", F.least("component", F.coalesce("_up", "component")).alias("component"), "_old"), "cc")
        changed = new.where("component <> _old").limit(1).count()
        labels = new.drop("_old")
        if not changed:
            return labels
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
