"""Mixing sources to target weights by Poisson replication (DataFrame functions).

A source with weight w and n documents is to give ``w * target_rows`` rows, so each
of its documents is to be repeated ``rate = w * target_rows / n`` times on average.
A document's count is the inverse of the Poisson distribution with that mean at
a uniform number that a hash of seed and document decides; the document is
exploded by its count and all copies are dealt to places by another hash.
No draw depends on other rows, on partitions or on the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import documents, materialise

SEED = "mix-1"
#: A mean above this is drawn as a sum of parts of at most this mean, so that exp(-mean) stays exact.
LARGEST_PART = 32.0
#: Rate tables up to so many sources are broadcast; beyond, sources are joined by a salted shuffle.
BROADCAST_SOURCES = 100_000
SALTS = 64
_UNIT = float(1 << 52)


def _hash52(key: Column) -> Column:
    """The first 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint")


def rates(docs: DataFrame, weights: dict[str, float] | None, source: str = "source",
          target_rows: int | None = None) -> DataFrame:
    """``(src, rate, parts, cdf)``: one row per source, null included.

    Without ``weights`` all sources weigh the same; a source that has no weight
    gets 0.  ``cdf[k]`` is the chance of at most k copies for a mean of
    ``rate / parts``, up to where it is 1 for every 52-bit uniform number.
    """
    spark = docs.sparkSession
    sizes = materialise(docs.groupBy(F.col(source).alias("src")).agg(F.count(F.lit(1)).alias("n")), "op6-sources")
    stat = sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k")).first()
    if weights is None:
        w = sizes.withColumn("weight", F.lit(1.0 / max(1, stat["k"])))
    else:
        total = sum(weights.values()) or 1.0
        given = spark.createDataFrame([(k, float(v) / total) for k, v in weights.items()], "_s string, weight double")
        w = sizes.join(given, F.col("src").eqNullSafe(F.col("_s")), "left").withColumn(
            "weight", F.coalesce("weight", F.lit(0.0))).drop("_s")
    goal = float(stat["rows"] or 0) if target_rows is None else float(target_rows)
    w = w.withColumn("rate", F.col("weight") * F.lit(goal) / F.col("n")) \
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_PART).cast("int"))) \
        .withColumn("mean", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 20).cast("int")
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"),
                     F.array(F.exp(-F.col("mean"))).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"),
                        F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return materialise(w.select("src", "n", "rate", "parts", F.aggregate(
        F.sequence(F.lit(1), last), first, step)["all"].alias("cdf")), "op6-rates")


def _with_rates(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join on the source, null equal to null; the rate table's size is checked before it is broadcast."""
    on = F.col("_src").eqNullSafe(F.col("src"))
    if table.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), on)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")) \
        .join(salted, on & (F.col("_part") == F.col("_salt")))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source",
              doc_id: str = "doc_id", text: str = "text", target_rows: int | None = None,
              seed: str = SEED) -> DataFrame:
    """``(_row, doc_id, src, rate, copies, copy, place)``: a row for each copy of each document, shuffled.

    ``_row`` has all columns of the input row, whatever their names.  ``copy``
    counts from 0; ``place`` is the hash by which copies are dealt to partitions
    and sorted there.  Documents are told apart by id, or by text where the id is
    null; rows of one id get the same count each.  Null is a source like any
    other; an empty table gives an empty result.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("_src"),
                       key.alias("_key"))
    at = _with_rates(rows, rates(docs, weights, source, target_rows))

    def draw(part: Column) -> Column:
        u = (_hash52(F.concat_ws(":", F.lit(seed), part.cast("string"), F.col("_key"))) + F.lit(0.5)) / F.lit(_UNIT)
        return F.size(F.filter("cdf", lambda c: c < u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, p: acc + draw(p))
    drawn = at.withColumn("copies", copies).where("copies > 0") \
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    placed = drawn.withColumn("place", _hash52(F.concat_ws(
        ":", F.lit(seed), F.lit("place"), F.col("copy").cast("string"), F.col("_key"))))
    return placed.select("_row", "doc_id", F.col("_src").alias("src"), "rate", "copies", "copy", "place") \
        .repartition("place").sortWithinPartitions("place")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, **kw) -> DataFrame:
    """The shuffled copies with the documents' own columns; see :func:`replicate`."""
    return replicate(docs, weights, **kw).select("_row.*")


def op6_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """All sources to equal weights, as many rows as there are documents."""
    return replicate(documents(spark, sf_dir)).select(
        "doc_id", F.col("src").alias("source"), F.col("_row.lang").alias("lang"), F.col("_row.text").alias("text"),
        F.round("rate", 9).alias("rate"), "copies", "copy", "place")


#: cdf as in the operator: the same products and sums in the same order.
ORACLE_RATES = """
RECURSIVE sizes AS (SELECT source AS src, count(*) AS n FROM {docs} GROUP BY source),
stat AS (SELECT sum(n)::DOUBLE AS goal, count(*) AS k FROM sizes),
rates AS (SELECT src, (1.0::DOUBLE / k) * goal / n AS rate FROM sizes, stat),
cdf(src, mean, k, p, c) AS (
    SELECT src, rate, 0, exp(-rate), exp(-rate) FROM rates
    UNION ALL
    SELECT src, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf
    WHERE k < ceil(mean + 12 * sqrt(mean) + 20)),
cdfs AS (SELECT src, list(c ORDER BY k) AS cs FROM cdf GROUP BY src)
"""


def hash52_sql(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 13))::BIGINT"


ORACLE_OP6 = f"""
WITH {ORACLE_RATES.format(docs="documents")},
d AS (SELECT doc_id, source, lang, text, rate, cs,
             ({hash52_sql(f"'{SEED}:1:' || doc_id")} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM documents JOIN rates ON rates.src IS NOT DISTINCT FROM source
      JOIN cdfs ON cdfs.src IS NOT DISTINCT FROM source),
e AS (SELECT doc_id, source, lang, text, rate, len(list_filter(cs, lambda c: c < u))::INTEGER AS copies FROM d),
x AS (SELECT *, unnest(range(copies))::INTEGER AS copy FROM e)
SELECT doc_id, source, lang, text, round(rate, 9) AS rate, copies, copy,
       {hash52_sql(f"'{SEED}:place:' || copy || ':' || doc_id")} AS place
FROM x
"""
