"""Exact dedup by deterministic block naming (DataFrame functions only).

A text is cut into fixed-size blocks.  Equal blocks get the same integer and
different blocks different integers ("names"): blocks are dealt to buckets by
hash, sorted inside the bucket, and a block's name is its bucket and its dense
rank there.  Adjacent names are then paired and the pairs named the same way,
until each document has one name.  Two texts of the same number of blocks get
the same last name if and only if they are equal: no hash decides equality.

Very frequent blocks or pairs would fill one bucket, so they are named apart:
at most ``rows / heavy_min`` values can be that frequent, and that small table is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.common import attach, materialise

#: The characters deleted before texts are compared: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
#: Code points in a block.
BLOCK = 2048
#: Buckets that blocks are dealt to by hash; a bucket is sorted in one task.
BUCKETS = 4096
#: A value is frequent from this share of the rows on, and from this many rows on.
HEAVY_SHARE, HEAVY_ROWS = 0.002, 200
_RANKS = 1 << 40


def squeeze(text: Column) -> Column:
    """The text without its white space; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def assign_names(rows: DataFrame, keys: list[str], n_rows: int, buckets: int = BUCKETS) -> DataFrame:
    """Add ``name`` (bigint): equal for rows equal in all ``keys``, different otherwise.

    Key columns must not be null.  ``rows`` must be a table (it is read twice).
    The broadcast side holds at most ``1 / HEAVY_SHARE`` values: each is in over
    that share of the rows.
    """
    least = max(HEAVY_ROWS, int(HEAVY_SHARE * n_rows))
    h = F.xxhash64(*keys)
    often = rows.select(h.alias("_h")).groupBy("_h").count().where(F.col("count") > least).select("_h")
    heavy_hashes = [r["_h"] for r in often.collect()]        # at most 1 / HEAVY_SHARE longs
    bucket = F.pmod(F.xxhash64(h), F.lit(buckets))
    by_rank = Window.partitionBy("_b").orderBy(*keys)
    name = F.col("_b") * F.lit(_RANKS) + F.dense_rank().over(by_rank)
    light = rows
    if heavy_hashes:
        light = rows.where(~h.isin(heavy_hashes))
    out = light.withColumn("_b", bucket).withColumn("name", name).drop("_b")
    if heavy_hashes:
        hot = rows.where(h.isin(heavy_hashes))
        # distinct is combined in each map task, so few copies of each value move
        named = hot.select(*keys).distinct().withColumn("_b", F.lit(buckets).cast("bigint")) \
            .withColumn("_hname", name).drop("_b")
        out = out.unionByName(hot.join(F.broadcast(named), keys).withColumnRenamed("_hname", "name")
                              .select(*out.columns))
    return out


def identities(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``(uid, doc_id, n_chars, text_sha256, n_blocks, name)``: one row per input row.

    ``(n_blocks, name)`` is the collision-free identity of the text without its
    white space.  ``uid`` numbers the rows, so repeated ids and null ids stay
    apart.  Null and empty texts have no block and share the name 0.
    """
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("_t")) \
        .withColumn("_s", squeeze(F.col("_t")))
    cut = base.select(
        "uid", "doc_id", F.length("_t").cast("bigint").alias("n_chars"),
        F.sha2(F.col("_s").cast("binary"), 256).alias("text_sha256"),
        F.regexp_extract_all("_s", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("_p"))
    cut = cut.withColumn("n_blocks", F.size("_p"))
    wide = cut.select("uid", "doc_id", "n_chars", "text_sha256", "n_blocks",
                      F.posexplode_outer("_p").alias("pos", "block"))
    wide = wide.withColumn("pos", F.coalesce("pos", F.lit(0))) \
        .withColumn("block", F.coalesce("block", F.lit("")))
    for c in ("doc_id", "n_chars", "text_sha256"):          # a document's own columns ride on its first block
        wide = wide.withColumn(c, F.when(F.col("pos") == 0, F.col(c)))
    wide = materialise(wide, "op2-blocks")
    n = wide.count()
    level = materialise(assign_names(wide, ["block"], n).drop("block"), "op2-names")
    own = level.where("pos = 0").select("uid", "doc_id", "n_chars", "text_sha256")
    done = level.where("n_blocks <= 1").select("uid", F.col("n_blocks").cast("int"), "name")
    rest = level.where("n_blocks > 1").select("uid", "pos", "n_blocks", "name")
    width = 1
    longest = level.agg(F.max("n_blocks")).first()[0] or 0
    while width < longest:
        width *= 2
        pairs = rest.groupBy("uid", F.expr("pos div 2").cast("int").alias("pos"), "n_blocks").agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        pairs = materialise(pairs, "op2-pairs")
        named = materialise(assign_names(pairs, ["left", "right"], pairs.count())
                            .select("uid", "pos", "n_blocks", "name"), "op2-names")
        done = done.unionByName(named.where(F.col("n_blocks") <= width).select("uid", "n_blocks", "name"))
        rest = named.where(F.col("n_blocks") > width)
    return own.join(done, "uid")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without white space.  Of equal texts, the row
    with the most code points stays, then the smallest ``doc_id`` (a null id comes
    last), then the row read first, so exactly one row of a group is ``kept`` even
    if ids repeat.  Null texts count as empty and form one group with them; an
    empty table gives an empty result.  Only the two named columns are read.
    """
    ids = materialise(identities(docs, text, doc_id, block), "op2-ids")
    best = F.min(F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"),
                          F.col("doc_id").alias("c"), F.col("uid").alias("d")))
    groups = ids.groupBy("n_blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_k"))
    groups = groups.withColumn("_members", F.col("group_size"))
    return attach(ids, groups, ["n_blocks", "name"], "_members").select(
        "doc_id", F.col("_k.c").alias("keep_id"), "group_size", (F.col("uid") == F.col("_k.d")).alias("kept"),
        "text_sha256")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from shoal.llm.common import documents
    return exact_dedup(documents(spark, sf_dir))


_S = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
ORACLE_OP2 = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_S} AS s FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(s) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)
"""
