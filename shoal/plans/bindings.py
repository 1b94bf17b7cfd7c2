"""Bindings of the driver tables onto the record / assignment / point roles.

documents (store = source, category = lang, id = doc_id) joined with labels
(block = quality, '-1' if absent); summary = the first line of the text,
detail = the whole text when it has more than one line, else ''.  So the
document text is always the whole text.  Every document has a cluster (an
arithmetic bucket of its id; one bucket is read as noise, -1) and a 2-D point
(two statistics of its whole text).  embeddings have clusters of their own
(label 0 read as noise) and points that project all their components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.sources.tables import Roles, read_table

def doc_roles() -> Roles:
    return Roles(
        record_id="doc_id",
        store="source",
        block=F.coalesce(F.col("quality").cast("string"), F.lit("-1")),
        summary=F.substring_index(F.col("text"), "\n", 1),
        detail=F.when(F.instr(F.col("text"), "\n") > 0, F.col("text")).otherwise(F.lit("")),
        category="lang",
        category_name="lang",
    )


def dealt(docs: DataFrame) -> DataFrame:
    """The rows over as many partitions as the session's shuffles have: the test tables are one row group."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def doc_records(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    docs = dealt(docs) if deal else docs
    quality = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return doc_roles().bind(docs.join(quality, "doc_id", "left"))


BUCKETS = 11


def doc_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record_id, cluster)`` for every document: -1 (noise) to 9."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("record_id"), doc_cluster(F.col("doc_id")).alias("cluster"))


def doc_cluster(doc_id):
    return (F.pmod(doc_id * 7919, F.lit(BUCKETS)) - 1).cast("int")


def doc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record_id, x, y)`` for every document: log length and share of spaces of the whole text."""
    docs = read_table(spark, sf_dir, "documents")
    t = F.coalesce("text", F.lit(""))
    n = F.length(t)
    return docs.select(
        F.col("doc_id").alias("record_id"), F.log(1.0 + n).alias("x"),
        ((n - F.length(F.replace(t, F.lit(" "), F.lit("")))) / (1.0 + n)).alias("y"))


def emb_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("bigint").alias("record_id"),
        F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).cast("int").alias("cluster"),
    )


#: Fixed projection of the embeddings onto the plane: every component has a weight in both.
VECTOR_SIZE = 64
X_WEIGHTS = [((i * 37) % VECTOR_SIZE - 32) / VECTOR_SIZE for i in range(VECTOR_SIZE)]
Y_WEIGHTS = [((i * 23 + 11) % VECTOR_SIZE - 32) / VECTOR_SIZE for i in range(VECTOR_SIZE)]


def emb_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("record_id"), F.col("embedding").cast("array<double>").alias("v"))

    def dot(weights):
        w = F.array(*map(F.lit, weights))
        return F.aggregate(F.zip_with("v", w, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)

    return emb.select("record_id", dot(X_WEIGHTS).alias("x"), dot(Y_WEIGHTS).alias("y"))


def clustered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its cluster."""
    return doc_records(spark, sf_dir, deal=True).withColumn("cluster", doc_cluster(F.col("record_id")))


# DuckDB text of the same binding, shared by the oracle queries.  ``@WS@`` is
# replaced by the whitespace class (RE2 reads the same escapes as Java here).
ORACLE_RECORDS = """
records AS (
  SELECT d.doc_id AS record_id, d.source AS store,
         coalesce(CAST(l.quality AS VARCHAR), '-1') AS block,
         split_part(d.text, chr(10), 1) AS summary,
         CASE WHEN strpos(d.text, chr(10)) > 0 THEN d.text ELSE '' END AS detail,
         d.lang AS category, d.lang AS category_name
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
docrec AS (
  SELECT *, CASE
      WHEN regexp_replace(detail, '^@WS@+|@WS@+$', '', 'g') <> '' THEN regexp_replace(detail, '^@WS@+|@WS@+$', '', 'g')
      WHEN regexp_replace(summary, '^@WS@+|@WS@+$', '', 'g') <> '' THEN regexp_replace(summary, '^@WS@+|@WS@+$', '', 'g')
      ELSE category_name END AS document_text
  FROM records
),
assignments AS (
  SELECT doc_id AS record_id, CAST((doc_id * 7919) % @BUCKETS@ - 1 AS INTEGER) AS cluster FROM documents
),
points AS (
  SELECT doc_id AS record_id, ln(1.0::DOUBLE + length(coalesce(text, ''))) AS x,
         (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', ''))) / (1.0::DOUBLE + length(coalesce(text, ''))) AS y
  FROM documents
),
eassignments AS (
  SELECT vec_id AS record_id, CAST(CASE WHEN label = 0 THEN -1 ELSE label END AS INTEGER) AS cluster
  FROM embeddings
),
epoints AS (
  SELECT vec_id AS record_id, list_inner_product(CAST(embedding AS DOUBLE[]), @XW@) AS x,
         list_inner_product(CAST(embedding AS DOUBLE[]), @YW@) AS y
  FROM embeddings
),
crec AS (
  SELECT r.*, a.cluster FROM docrec r JOIN assignments a USING (record_id)
)
"""


def oracle_sql_text(sql: str) -> str:
    from shoal.functions.text import WS_CLASS
    return (sql.replace("@WS@", WS_CLASS).replace("@BUCKETS@", str(BUCKETS))
            .replace("@XW@", f"CAST({X_WEIGHTS} AS DOUBLE[])").replace("@YW@", f"CAST({Y_WEIGHTS} AS DOUBLE[])"))


# ---------------------------------------------------------------------------
# Sheet-cell bindings for the grid operators.
#
# conversations: one sheet per conversation (file = conv_id), one sheet row
# per turn (row = turn + 7); a user turn carries a summary marker in E
# ("{turn div 2 + 1}."), an assistant turn a detail marker in F ("({turn})");
# the whole text sits in G with G..O merged on every turn row, and the text's
# first character is the candidate category in R.  D4 / N4 hold the store
# ("store-{conv_id}") and block (role of turn 0).
# ---------------------------------------------------------------------------

def conv_cells(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    """One scan: each turn is exploded into its cells; ``step`` rows lie between turns."""
    from shoal.operators.grid import TARGET_SHEET
    conv = read_table(spark, sf_dir, "conversations")
    turn_row = (F.col("turn") * step + 7).cast("int")
    file = F.col("conv_id").cast("string")

    def cell(when, row, col, value):
        return F.when(when, F.struct(row.alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value")))
    first = F.col("turn") == 0
    cells = F.array(
        cell(F.col("role") == "user", turn_row, 5, F.concat(F.expr("turn div 2 + 1").cast("string"), F.lit("."))),
        cell(F.col("role") == "assistant", turn_row, 6, F.concat(F.lit("("), F.col("turn").cast("string"), F.lit(")"))),
        cell(F.lit(True), turn_row, 7, F.col("text")),
        cell(F.lit(True), turn_row, 18, F.substring("text", 1, 1)),
        cell(first, F.lit(4), 4, F.concat(F.lit("store-"), file)),
        cell(first, F.lit(4), 14, F.col("role")))
    return conv.select(file.alias("file"), F.lit(TARGET_SHEET).alias("sheet"), F.explode(cells).alias("c")) \
        .select("file", "sheet", F.col("c.row").cast("int").alias("row"), F.col("c.col").cast("int").alias("col"),
                F.col("c.value").alias("value")).where(F.col("value").isNotNull())


def conv_merges(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    from shoal.operators.grid import TARGET_SHEET
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").cast("string").alias("file"), F.lit(TARGET_SHEET).alias("sheet"),
                       (F.col("turn") * step + 7).cast("int").alias("min_row"), F.lit(7).alias("min_col"),
                       (F.col("turn") * step + 7).cast("int").alias("max_row"), F.lit(15).alias("max_col"))


def lineitem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet per order (file = l_orderkey), one row per line in column order
    (row = 6 + its position), candidate columns P, Q, R = l_returnflag,
    l_linestatus, l_linenumber.  An order has few lines, so the window per
    order stays small whatever the table size."""
    from pyspark.sql import Window

    from shoal.operators.grid import TARGET_SHEET
    li = read_table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    rows = li.select(F.col("l_orderkey").cast("string").alias("file"), F.lit(TARGET_SHEET).alias("sheet"),
                     (F.row_number().over(w) + 6).cast("int").alias("row"),
                     "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string").alias("l_linenumber"))
    return rows.select("file", "sheet", "row", F.explode(F.array(
        F.struct(F.lit(16).alias("col"), F.col("l_returnflag").alias("value")),
        F.struct(F.lit(17).alias("col"), F.col("l_linestatus").alias("value")),
        F.struct(F.lit(18).alias("col"), F.col("l_linenumber").alias("value")))).alias("c")) \
        .select("file", "sheet", "row", F.col("c.col").cast("int").alias("col"), F.col("c.value").alias("value")) \
        .where(F.col("value").isNotNull())


def oracle_conv_cells(step: int) -> str:
    return ORACLE_CONV_CELLS.replace("turn * 1 + 7", f"turn * {step} + 7")


ORACLE_CONV_CELLS = """
cbase AS (SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn * 1 + 7 AS INTEGER) AS row, turn, role, text FROM conversations),
cells AS (
  SELECT file, row, 5 AS col, CAST(turn // 2 + 1 AS VARCHAR) || '.' AS value FROM cbase WHERE role = 'user'
  UNION ALL SELECT file, row, 6, '(' || CAST(turn AS VARCHAR) || ')' FROM cbase WHERE role = 'assistant'
  UNION ALL SELECT file, row, g.c, text FROM cbase CROSS JOIN generate_series(7, 15) AS g(c) WHERE text IS NOT NULL
  UNION ALL SELECT file, row, 18, substr(text, 1, 1) FROM cbase WHERE text IS NOT NULL
  UNION ALL SELECT file, 4, 4, 'store-' || file FROM cbase WHERE turn = 0
  UNION ALL SELECT file, 4, 14, role FROM cbase WHERE turn = 0 AND role IS NOT NULL
)
"""

ORACLE_LINEITEM_CELLS = """
lrows AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS file,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
              l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) + 6 AS INTEGER) AS row,
         l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber
  FROM lineitem
),
cells AS (
  SELECT file, row, 16 AS col, l_returnflag AS value FROM lrows WHERE l_returnflag IS NOT NULL
  UNION ALL SELECT file, row, 17, l_linestatus FROM lrows WHERE l_linestatus IS NOT NULL
  UNION ALL SELECT file, row, 18, l_linenumber FROM lrows WHERE l_linenumber IS NOT NULL
)
"""
