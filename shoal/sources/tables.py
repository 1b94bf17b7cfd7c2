"""Read any Spark table and bind its columns to record roles.

Operators downstream use one canonical record schema::

    record_id BIGINT, store, block, summary, detail, category, category_name,
    document_text STRING

plus ``assignments(record_id, cluster INT)`` and ``points(record_id, x, y)``.
A :class:`Roles` object maps a foreign table onto it; an absent role becomes
``''`` (text roles) so the dependent outputs still have a stable schema.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions import text as T

RECORD_COLUMNS = ["record_id", "store", "block", "summary", "detail", "category",
                  "category_name", "document_text"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of ``{sf_dir}/{name}.parquet`` (pushdown and pruning by Catalyst)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def append_sources(frames: list[DataFrame], id_col: str = "record_id") -> DataFrame:
    """Concatenate separately read record sources (by column name), with ids that stay distinct.

    The ``i``-th of ``n`` sources gets the ids ``id * n + i``: no two sources share one, and the
    order within a source is kept.
    """
    n = len(frames)
    own = [f.withColumn(id_col, F.col(id_col) * n + i) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


RoleSpec = str | Column | None


@dataclass(frozen=True)
class Roles:
    """Column-role binding: each field names a source column or gives an expression.

    Give ``record_id`` a real key: without one, ids come from
    ``monotonically_increasing_id`` and are only stable for the same input splits.
    """

    record_id: RoleSpec = "record_id"
    store: RoleSpec = None
    block: RoleSpec = None
    summary: RoleSpec = None
    detail: RoleSpec = None
    category: RoleSpec = None
    category_name: RoleSpec = None
    document_text: RoleSpec = None

    @staticmethod
    def _expr(spec: RoleSpec, default: Column) -> Column:
        if spec is None:
            return default
        return F.col(spec) if isinstance(spec, str) else spec

    def bind(self, df: DataFrame) -> DataFrame:
        """Project ``df`` onto the canonical record schema."""
        empty = F.lit("")
        rid = self._expr(self.record_id, F.monotonically_increasing_id()).cast("bigint")
        summary = self._expr(self.summary, empty).cast("string")
        detail = self._expr(self.detail, empty).cast("string")
        category = self._expr(self.category, empty).cast("string")
        name = self._expr(self.category_name, T.category_name(category)).cast("string")
        out = df.select(
            rid.alias("record_id"),
            self._expr(self.store, empty).cast("string").alias("store"),
            self._expr(self.block, empty).cast("string").alias("block"),
            summary.alias("summary"),
            detail.alias("detail"),
            category.alias("category"),
            name.alias("category_name"),
        )
        doc = (self._expr(self.document_text, None) if self.document_text is not None
               else T.document_text("category_name", "summary", "detail"))
        return out.withColumn("document_text", doc.cast("string"))
