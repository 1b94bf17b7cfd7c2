"""Registered queries (one per operator) and their DuckDB oracle SQL.

Every query reads the driver tables through the bindings in
:mod:`shoal.plans.bindings` and runs over the whole tables.  Arrays are
rendered as ``' | '``-joined strings and doubles rounded to 6 decimals so
both engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators import labels as L
from shoal.plans import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Word pattern used by the registered label queries: the driver's texts are
# European prose, so the CJK fallback would find no words at all.
LETTER_RUN = r"\p{L}+"
SEP = " | "
# Stopwords beside the fixed ones: words that the driver's texts do hold.
COMMON_WORDS = ["the", "and", "of", "la", "de", "der", "die"]
WORDS = {"pattern": LETTER_RUN, "stopwords": L.STOPWORDS + COMMON_WORDS}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = B.oracle_sql_text(sql)
        return fn
    return deco


def _sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _joined(c: str) -> F.Column:
    return F.array_join(F.col(c), SEP).alias(c)


# ---------------------------------------------------------------------------
# W1 / A12 / W2 / L4 -- the minimum slice
# ---------------------------------------------------------------------------

_ORACLE_WORDS = """
occ AS (
  SELECT cluster, record_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT cluster, record_id, regexp_extract_all(document_text, '\\p{L}+') AS ws FROM crec)
),
cnt AS (
  SELECT cluster, word, count(*) AS n, min(record_id * 10000000 + pos) AS first
  FROM occ WHERE length(word) >= 2 AND word NOT IN (%s)
  GROUP BY cluster, word
),
top AS (
  SELECT * FROM (
    SELECT cluster, word, n,
           row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first, word) AS rank
    FROM cnt) WHERE rank <= 10
)
""" % _sql_list(L.STOPWORDS + COMMON_WORDS)


@register("a12_word_counts", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}
SELECT cluster, word, n FROM cnt
""")
def a12_word_counts(spark, sf):
    recs = B.clustered_records(spark, sf)
    return L.word_counts(recs, **WORDS).select("cluster", "word", "n")


@register("w1_top_words", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}
SELECT cluster, CAST(rank AS INTEGER) AS rank, word, n FROM top
""")
def w1_top_words(spark, sf):
    return L.top_words(B.clustered_records(spark, sf), **WORDS)


_ORACLE_SAMPLES = """
smp AS (
  SELECT cluster, substr(document_text, 1, 200) AS t,
         row_number() OVER (PARTITION BY cluster ORDER BY record_id) AS rn
  FROM crec
)
"""


@register("w2_sample_texts", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_SAMPLES}
SELECT cluster, string_agg(t, ' | ' ORDER BY rn) AS sample_texts FROM smp WHERE rn <= 5 GROUP BY cluster
""")
def w2_sample_texts(spark, sf):
    return L.sample_texts(B.clustered_records(spark, sf)).select("cluster", _joined("sample_texts"))


@register("w3_representatives", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_SAMPLES}
SELECT cluster, string_agg(t, ' | ' ORDER BY rn) AS representative_texts FROM smp WHERE rn <= 3 GROUP BY cluster
""")
def w3_representatives(spark, sf):
    s = L.sample_texts(B.clustered_records(spark, sf))
    return s.select("cluster", F.array_join(L.representatives(F.col("sample_texts")), SEP)
                    .alias("representative_texts"))


_ORACLE_CARDS = f"""
cnts AS (SELECT cluster, count(*) AS count FROM crec GROUP BY cluster),
wl AS (
  SELECT cluster,
         string_agg(word, '{L.LABEL_SEPARATOR}' ORDER BY rank) FILTER (WHERE rank <= 3) AS lab,
         string_agg(word, '{L.WORDS_SEPARATOR}' ORDER BY rank) FILTER (WHERE rank <= 5) AS w5,
         max(CASE WHEN rank = 1 THEN word END) AS w1,
         string_agg(word, ' | ' ORDER BY rank) AS fw
  FROM top GROUP BY cluster
),
reps AS (
  SELECT cluster, string_agg(t, ' | ' ORDER BY rn) AS reps FROM smp WHERE rn <= 3 GROUP BY cluster
),
cards AS (
  SELECT c.cluster,
         CASE WHEN c.cluster = -1 THEN '{L.NOISE_LABEL}'
              WHEN wl.lab IS NULL THEN '{L.LABEL_PREFIX}' || CAST(c.cluster AS VARCHAR)
              ELSE wl.lab END AS label,
         CASE WHEN c.cluster = -1 THEN '{L.NOISE_DESCRIPTION}'
              WHEN wl.lab IS NULL THEN '{L.EMPTY_DESCRIPTION}'
              ELSE '{L.DESCRIPTION_TEMPLATE.split("{words}")[0]}' || wl.w5 ||
                   '{L.DESCRIPTION_TEMPLATE.split("{words}")[1].split("{first}")[0]}' || wl.w1 ||
                   '{L.DESCRIPTION_TEMPLATE.split("{first}")[1]}' END AS description,
         coalesce(reps.reps, '') AS representative_texts,
         coalesce(wl.fw, '') AS frequent_words,
         c.count
  FROM cnts c LEFT JOIN wl USING (cluster) LEFT JOIN reps USING (cluster)
)
"""


@register("l4_cluster_cards", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}
SELECT * FROM cards
""")
def l4_cluster_cards(spark, sf):
    cards = L.cluster_cards(B.clustered_records(spark, sf), **WORDS)
    return cards.select("cluster", "label", "description", _joined("representative_texts"),
                        _joined("frequent_words"), "count")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """documents -> TF-IDF -> PCA 2-D -> k-means -> silhouette -> label cards."""
    return m7_fit(spark, sf)


# ---------------------------------------------------------------------------
# Scalar projections P1-P7 over documents (whole texts)
# ---------------------------------------------------------------------------

from shoal.functions import text as TX  # noqa: E402
from shoal.operators import filters as FL  # noqa: E402
from shoal.operators import report as R  # noqa: E402
from shoal.sources.tables import read_table  # noqa: E402

_STRIP = "regexp_replace({0}, '^@WS@+|@WS@+$', '', 'g')"


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


@register("p1_normalize_text", """
SELECT doc_id AS record_id, trim(regexp_replace(coalesce(text, ''), '@WS@+', ' ', 'g')) AS normalized
FROM documents
""")
def p1_normalize_text(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("record_id"), TX.normalize_text("text").alias("normalized"))


@register("p2_truncate_text", """
SELECT doc_id AS record_id,
       CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 97) || '...' END AS truncated
FROM documents
""")
def p2_truncate_text(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("record_id"), TX.truncate_text("text", 100).alias("truncated"))


@register("p3_hover_truncate", f"""
WITH {B.ORACLE_RECORDS}
SELECT record_id,
       CASE WHEN summary IS NULL OR summary = '' THEN ''
            WHEN length(summary) > 100 THEN substr(summary, 1, 100) || '...' ELSE summary END AS hover_summary,
       CASE WHEN detail IS NULL OR detail = '' THEN ''
            WHEN length(detail) > 100 THEN substr(detail, 1, 100) || '...' ELSE detail END AS hover_detail
FROM records
""")
def p3_hover_truncate(spark, sf):
    r = B.doc_records(spark, sf)
    return r.select("record_id", TX.hover_truncate("summary").alias("hover_summary"),
                    TX.hover_truncate("detail").alias("hover_detail"))


@register("p4_normalize_number", f"""
SELECT doc_id AS record_id,
       translate(translate(text, 'aeiou', '{TX.FULLWIDTH_DIGITS[:5]}'), '{TX.FULLWIDTH_DIGITS}', '{TX.ASCII_DIGITS}') AS normalized
FROM documents
""")
def p4_normalize_number(spark, sf):
    """Vowels are turned into full-width digits first, so that every text has some."""
    d = _docs(spark, sf).select(F.col("doc_id").alias("record_id"),
                                F.translate("text", "aeiou", TX.FULLWIDTH_DIGITS[:5]).alias("t"))
    return d.select("record_id", TX.normalize_number("t").alias("normalized"))


@register("p5_document_text", f"""
WITH {B.ORACLE_RECORDS}
SELECT record_id, document_text FROM docrec
""")
def p5_document_text(spark, sf):
    return B.doc_records(spark, sf).select("record_id", "document_text")


@register("p6_blank_to_space", f"""
WITH {B.ORACLE_RECORDS}
SELECT record_id, CASE WHEN {_STRIP.format("coalesce(summary, '')")} = '' THEN ' ' ELSE summary END AS prepared
FROM (SELECT record_id, CASE record_id % 3 WHEN 0 THEN chr(9) || chr(12288) WHEN 1 THEN NULL ELSE summary END AS summary FROM records)
""")
def p6_blank_to_space(spark, sf):
    """A third of the summaries is made blank and a third null."""
    r = B.doc_records(spark, sf).select("record_id", F.when(F.col("record_id") % 3 == 0, F.lit("\t\u3000"))
                                        .when(F.col("record_id") % 3 == 2, F.col("summary")).alias("summary"))
    return r.select("record_id", TX.blank_to_space("summary").alias("prepared"))


@register("p7_clip_200", """
SELECT doc_id AS record_id, substr(text, 1, 200) AS clipped FROM documents
""")
def p7_clip_200(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("record_id"), TX.clip("text", 200).alias("clipped"))


# ---------------------------------------------------------------------------
# Projections, labels, colours
# ---------------------------------------------------------------------------

def _cards(spark, sf):
    return L.cluster_cards(B.clustered_records(spark, sf), **WORDS)


_REC_COLS = "record_id, store, block, summary, detail, category, category_name"


@register("p8_drop_internal", f"""
WITH {B.ORACLE_RECORDS}
SELECT {_REC_COLS} FROM records
""")
def p8_drop_internal(spark, sf):
    r = B.doc_records(spark, sf).withColumnRenamed("document_text", "_document_text")
    return R.drop_internal(r)


@register("p9_display_columns", f"""
WITH {B.ORACLE_RECORDS}
SELECT store, block, category, category_name, summary, detail FROM records
""")
def p9_display_columns(spark, sf):
    return R.display_columns(B.doc_records(spark, sf))


@register("p10_default_label", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}
SELECT a.record_id, a.cluster, coalesce(c.label, '{L.LABEL_PREFIX}' || CAST(a.cluster AS VARCHAR)) AS cluster_label
FROM assignments a LEFT JOIN cards c USING (cluster)
""")
def p10_default_label(spark, sf):
    return R.attach_card(B.doc_assignments(spark, sf), _cards(spark, sf))


@register("p10_default_label_nocards", f"""
WITH {B.ORACLE_RECORDS}
SELECT record_id, cluster,
       CASE WHEN cluster = -1 THEN '{R.NOISE_NAME}' ELSE '{L.LABEL_PREFIX}' || CAST(cluster AS VARCHAR) END AS cluster_label
FROM assignments
""")
def p10_default_label_nocards(spark, sf):
    return R.attach_card(B.doc_assignments(spark, sf), None)


@register("p11_highlight_opacity", f"""
WITH {B.ORACLE_RECORDS}
SELECT record_id, CAST(CASE WHEN cluster = 3 THEN 1.0 ELSE {R.DIM_OPACITY} END AS DOUBLE) AS opacity FROM assignments
""")
def p11_highlight_opacity(spark, sf):
    a = B.doc_assignments(spark, sf)
    return a.select("record_id", R.highlight_opacity(F.col("cluster"), 3).alias("opacity"))


_PALETTE_SQL = "[" + _sql_list(R.PALETTE) + "]"


@register("p12_cluster_color", f"""
WITH {B.ORACLE_RECORDS},
ids AS (SELECT DISTINCT cluster FROM assignments)
SELECT cluster, CASE WHEN cluster = -1 THEN '{R.NOISE_COLOR}'
  ELSE {_PALETTE_SQL}[((dense_rank() OVER (ORDER BY cluster) - 1 - (SELECT count(*) FROM ids WHERE cluster = -1)) % {len(R.PALETTE)}) + 1]
  END AS color
FROM ids
""")
def p12_cluster_color(spark, sf):
    return R.cluster_colors(B.doc_assignments(spark, sf))


@register("p13_cluster_option", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}
SELECT DISTINCT a.cluster, CAST(a.cluster AS VARCHAR) || ': ' || coalesce(c.label, '{R.OPTION_PREFIX}' || CAST(a.cluster AS VARCHAR)) AS option
FROM assignments a LEFT JOIN cards c USING (cluster) WHERE a.cluster <> -1
""")
def p13_cluster_option(spark, sf):
    return R.cluster_options(B.doc_assignments(spark, sf), _cards(spark, sf))


@register("j1_attach_labels", f"""
WITH {B.ORACLE_RECORDS}
SELECT r.record_id, r.store, a.cluster, round(p.x, 6) AS x, round(p.y, 6) AS y
FROM records r JOIN assignments a USING (record_id) JOIN points p USING (record_id)
""")
def j1_attach_labels(spark, sf):
    j = R.attach_labels(B.doc_records(spark, sf), B.doc_assignments(spark, sf), B.doc_points(spark, sf))
    return j.select("record_id", "store", "cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("j2_attach_card", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}
SELECT r.record_id, r.cluster, coalesce(c.label, '{L.LABEL_PREFIX}' || CAST(r.cluster AS VARCHAR)) AS cluster_label
FROM crec r LEFT JOIN cards c USING (cluster)
""")
def j2_attach_card(spark, sf):
    r = B.clustered_records(spark, sf).select("record_id", "cluster")
    return R.attach_card(r, _cards(spark, sf))


_ORACLE_CATEGORY = f"""
CASE WHEN regexp_extract({_STRIP.format('{0}')}, '{TX.CATEGORY_BRACKET}', 1) <> ''
     THEN upper(regexp_extract({_STRIP.format('{0}')}, '{TX.CATEGORY_BRACKET}', 1))
     WHEN regexp_matches({_STRIP.format('{0}')}, '{TX.CATEGORY_LETTER}') THEN upper({_STRIP.format('{0}')})
     END"""
_ORACLE_CATEGORY_NAME = ("coalesce(CASE upper({0}) "
                         + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TX.CATEGORY_NAMES.items())
                         + f" END, '{TX.UNCATEGORISED}')")


@register("j3_attach_category", f"""
SELECT doc_id AS record_id, cat AS category, {_ORACLE_CATEGORY_NAME.format('cat')} AS category_name
FROM (SELECT doc_id, {_ORACLE_CATEGORY.format('c')} AS cat
      FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '【' || substr(lang, 1, 1) || '】' || source ELSE ' ' || substr(lang, 1, 1) END AS c
            FROM documents))
""")
def j3_attach_category(spark, sf):
    """Category cells made of language and source: bracketed on even ids, a bare letter on odd ones."""
    letter = F.substring("lang", 1, 1)
    cell = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("【"), letter, F.lit("】"), F.col("source"))) \
        .otherwise(F.concat(F.lit(" "), letter))
    d = _docs(spark, sf).select(F.col("doc_id").alias("record_id"), cell.alias("c")) \
        .select("record_id", TX.extract_category("c").alias("category"))
    return d.withColumn("category_name", TX.category_name("category"))


# ---------------------------------------------------------------------------
# F1-F8 filters
# ---------------------------------------------------------------------------

_SPEC_STORES = ["src1", "src2", "src7"]
_SPEC_CATS = ["en", "fr"]
_SPEC_BLOCKS = ["1", "-1"]


def _filtered(spark, sf, spec):
    return FL.apply_filters(B.doc_records(spark, sf), spec).select(
        "record_id", "store", "block", "category_name", "detail")


_F_SELECT = f"WITH {B.ORACLE_RECORDS} SELECT record_id, store, block, category_name, detail FROM records"


@register("f1_filter_stores", _F_SELECT + f" WHERE store IN ({_sql_list(_SPEC_STORES)})")
def f1_filter_stores(spark, sf):
    return _filtered(spark, sf, FL.FilterSpec(stores=_SPEC_STORES))


@register("f2_filter_categories", _F_SELECT + f" WHERE category_name IN ({_sql_list(_SPEC_CATS)})")
def f2_filter_categories(spark, sf):
    return _filtered(spark, sf, FL.FilterSpec(categories=_SPEC_CATS))


@register("f3_filter_blocks", _F_SELECT + f" WHERE block IN ({_sql_list(_SPEC_BLOCKS)})")
def f3_filter_blocks(spark, sf):
    return _filtered(spark, sf, FL.FilterSpec(blocks=_SPEC_BLOCKS))


@register("f4_filter_doc_type", _F_SELECT + " WHERE detail = ''")
def f4_filter_doc_type(spark, sf):
    return _filtered(spark, sf, FL.FilterSpec(doc_type="概要のみ"))


@register("f5_apply_filters", _F_SELECT + f" WHERE category_name IN ({_sql_list(_SPEC_CATS)}) "
          f"AND block IN ({_sql_list(_SPEC_BLOCKS)}) AND detail <> ''")
def f5_apply_filters(spark, sf):
    return _filtered(spark, sf, FL.FilterSpec(categories=_SPEC_CATS, blocks=_SPEC_BLOCKS, doc_type="detail_only"))


@register("f5_filter_report", f"""
WITH {B.ORACLE_RECORDS}
SELECT count(*) FILTER (WHERE category_name IN ({_sql_list(_SPEC_CATS)}) AND detail <> '') AS kept,
       count(*) AS total
FROM records
""")
def f5_filter_report(spark, sf):
    return FL.filter_report(B.doc_records(spark, sf), FL.FilterSpec(categories=_SPEC_CATS, doc_type="detail_only"))


@register("f6_filter_options", f"""
WITH {B.ORACLE_RECORDS}
SELECT DISTINCT store AS value FROM records
""")
def f6_filter_options(spark, sf):
    return FL.filter_options(B.doc_records(spark, sf), "store")


@register("f6_filter_options_category", f"""
WITH {B.ORACLE_RECORDS}
SELECT DISTINCT category_name AS value FROM records
""")
def f6_filter_options_category(spark, sf):
    return FL.filter_options(B.doc_records(spark, sf), "category_name")


@register("f6_filter_options_block", f"""
WITH {B.ORACLE_RECORDS}
SELECT DISTINCT block AS value FROM records
""")
def f6_filter_options_block(spark, sf):
    return FL.filter_options(B.doc_records(spark, sf), "block")


@register("f7_drop_noise", f"""
WITH {B.ORACLE_RECORDS}
SELECT record_id, cluster FROM assignments WHERE cluster >= 0
""")
def f7_drop_noise(spark, sf):
    return FL.drop_noise(B.doc_assignments(spark, sf))


@register("f8_cluster_members", f"""
WITH {B.ORACLE_RECORDS}
SELECT record_id, store, cluster FROM crec WHERE cluster = 3
""")
def f8_cluster_members(spark, sf):
    return FL.cluster_members(B.clustered_records(spark, sf), 3).select("record_id", "store", "cluster")


# ---------------------------------------------------------------------------
# A1-A11 aggregates
# ---------------------------------------------------------------------------

@register("a1_summary_stats", f"""
WITH {B.ORACLE_RECORDS}
SELECT count(*) AS total_records,
       count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters,
       count(*) FILTER (WHERE cluster = -1) AS n_noise,
       count(DISTINCT store) AS unique_stores,
       round(CASE WHEN count(*) > 0 THEN (count(*) FILTER (WHERE cluster = -1)) / count(*) ELSE 0 END, 6) AS noise_ratio
FROM crec
""")
def a1_summary_stats(spark, sf):
    s = R.summary_stats(B.clustered_records(spark, sf))
    return s.withColumn("noise_ratio", F.round("noise_ratio", 6))


@register("a2_count_by_category", f"""
WITH {B.ORACLE_RECORDS}
SELECT category_name AS value, count(*) AS n FROM crec GROUP BY category_name
""")
def a2_count_by_category(spark, sf):
    return R.value_counts(B.clustered_records(spark, sf), "category_name")


@register("a3_count_by_store", f"""
WITH {B.ORACLE_RECORDS}
SELECT store AS value, count(*) AS n FROM crec GROUP BY store
""")
def a3_count_by_store(spark, sf):
    return R.value_counts(B.clustered_records(spark, sf), "store")


@register("a4_import_metrics", f"""
WITH {B.ORACLE_RECORDS}
SELECT count(*) AS rows, count(DISTINCT store) AS stores, count(DISTINCT category_name) AS categories,
       count(*) FILTER (WHERE detail = '') AS summary_only
FROM records
""")
def a4_import_metrics(spark, sf):
    return R.import_metrics(B.doc_records(spark, sf))


@register("a5_cluster_sizes", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS},
sz AS (SELECT cluster, count(*) AS n FROM assignments GROUP BY cluster)
SELECT sz.cluster, sz.n, round(sz.n / (SELECT sum(n) FROM sz), 6) AS share,
       coalesce(c.label, '{L.LABEL_PREFIX}' || CAST(sz.cluster AS VARCHAR)) AS name
FROM sz LEFT JOIN cards c USING (cluster)
""")
def a5_cluster_sizes(spark, sf):
    s = R.cluster_sizes(B.doc_assignments(spark, sf), _cards(spark, sf))
    return s.withColumn("share", F.round("share", 6))


@register("a6_cluster_stats", f"""
WITH {B.ORACLE_RECORDS},
pc AS (SELECT cluster, category_name, count(*) AS n FROM crec GROUP BY ALL)
SELECT d.cluster, d.count, d.category_dist, s.store_count FROM
 (SELECT cluster, CAST(sum(n) AS BIGINT) AS count, string_agg(category_name || ':' || CAST(n AS VARCHAR), ', ' ORDER BY category_name) AS category_dist
  FROM pc GROUP BY cluster) d
 JOIN (SELECT cluster, count(DISTINCT store) AS store_count FROM crec GROUP BY cluster) s USING (cluster)
""")
def a6_cluster_stats(spark, sf):
    s = R.cluster_stats(B.clustered_records(spark, sf))
    dist = F.array_join(F.transform(F.map_entries("category_dist"),
                                    lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ", ")
    return s.select("cluster", F.col("count").cast("bigint").alias("count"), dist.alias("category_dist"),
                    "store_count")


def _labelled(spark, sf):
    return R.attach_card(B.clustered_records(spark, sf), _cards(spark, sf))


_ORACLE_LABELLED = f"""
lab AS (
  SELECT r.*, coalesce(c.label, '{L.LABEL_PREFIX}' || CAST(r.cluster AS VARCHAR)) AS cluster_label
  FROM crec r LEFT JOIN cards c USING (cluster)
)
"""


LANGS = ["de", "en", "es", "fr"]


@register("a7_crosstab_category", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}, {_ORACLE_LABELLED}
SELECT cluster_label, {", ".join(f"count(*) FILTER (category_name = '{v}') AS {v}" for v in LANGS)},
       count(*) FILTER (category_name IS NULL) AS "{R.NULL_COLUMN}",
       count(*) FILTER (category_name NOT IN ({_sql_list(LANGS)})) AS "{R.OTHER_COLUMN}", count(*) AS total
FROM lab GROUP BY cluster_label
""")
def a7_crosstab_category(spark, sf):
    """Every row is counted: null and all other values have columns of their own, and the columns add up to ``total``."""
    return R.crosstab(_labelled(spark, sf), "cluster_label", "category_name", [*LANGS, R.NULL_COLUMN], rest=True)


@register("a7_crosstab_found", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}, {_ORACLE_LABELLED}
SELECT cluster_label, coalesce(category_name, '{R.NULL_COLUMN}') AS category_name, count(*) AS n FROM lab GROUP BY ALL
""")
def a7_crosstab_found(spark, sf):
    """The long form over the values that the data hold."""
    return R.crosstab_long(_labelled(spark, sf), "cluster_label", "category_name")


@register("a8_cluster_counts_only", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}, {_ORACLE_LABELLED}
SELECT cluster_label AS value, count(*) AS n FROM lab GROUP BY cluster_label
""")
def a8_cluster_counts_only(spark, sf):
    return R.value_counts(_labelled(spark, sf), "cluster_label")


@register("a9_crosstab_store", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}, {_ORACLE_LABELLED}
SELECT s.store, c.cluster_label, count(l.store) AS n
FROM (SELECT DISTINCT store FROM lab) s CROSS JOIN (SELECT DISTINCT cluster_label FROM lab) c
LEFT JOIN lab l ON l.store IS NOT DISTINCT FROM s.store AND l.cluster_label = c.cluster_label
GROUP BY ALL
""")
def a9_crosstab_store(spark, sf):
    labels = [r[0] for r in _cards(spark, sf).select("label").distinct().collect()]     # one for each cluster
    return R.crosstab_long(_labelled(spark, sf), "store", "cluster_label", labels)


@register("a10_centroids", f"""
WITH {B.ORACLE_RECORDS}
SELECT cluster, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy
FROM points JOIN assignments USING (record_id) GROUP BY cluster
""")
def a10_centroids(spark, sf):
    p = B.doc_points(spark, sf).join(B.doc_assignments(spark, sf), "record_id")
    c = R.centroids(p)
    return c.select("cluster", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@register("a11_n_clusters_noise", f"""
WITH {B.ORACLE_RECORDS}
SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters,
       count(*) FILTER (WHERE cluster = -1) AS n_noise
FROM assignments
""")
def a11_n_clusters_noise(spark, sf):
    return R.n_clusters_noise(B.doc_assignments(spark, sf))


# ---------------------------------------------------------------------------
# W4-W6, C1-C3, S7, L1-L3
# ---------------------------------------------------------------------------

@register("w4_random_per_cluster", f"""
WITH {B.ORACLE_RECORDS}
SELECT record_id, cluster FROM (
  SELECT record_id, cluster, row_number() OVER (
    PARTITION BY cluster ORDER BY ((record_id % 4294967291) * 48271 + 42) % 2147483647, record_id) AS rn
  FROM crec) WHERE rn <= 3
""")
def w4_random_per_cluster(spark, sf):
    r = R.random_per_cluster(B.clustered_records(spark, sf), 3, 42, key=R.lcg_key(42))
    return r.select("record_id", "cluster")


@register("w5_preview", f"""
WITH {B.ORACLE_RECORDS}
SELECT {_REC_COLS} FROM records ORDER BY record_id LIMIT 50
""")
def w5_preview(spark, sf):
    return R.preview(B.doc_records(spark, sf))


@register("w6_ordered_cards", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}
SELECT cluster, label, count FROM cards ORDER BY cluster
""")
def w6_ordered_cards(spark, sf):
    return R.ordered_cards(_cards(spark, sf)).select("cluster", "label", "count")


@register("c1_scatter_table", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS},
ids AS (SELECT DISTINCT cluster FROM assignments),
col AS (
  SELECT cluster, CASE WHEN cluster = -1 THEN '{R.NOISE_COLOR}'
    ELSE {_PALETTE_SQL}[((dense_rank() OVER (ORDER BY cluster) - 1 - (SELECT count(*) FROM ids WHERE cluster = -1)) % {len(R.PALETTE)}) + 1]
    END AS color FROM ids)
SELECT r.record_id, round(p.x, 6) AS x, round(p.y, 6) AS y, a.cluster,
       coalesce(c.label, '{L.LABEL_PREFIX}' || CAST(a.cluster AS VARCHAR)) AS cluster_label,
       col.color, CAST(1.0 AS DOUBLE) AS opacity,
       r.store AS hover_store, r.block AS hover_block, r.category_name AS hover_category,
       CASE WHEN r.summary IS NULL OR r.summary = '' THEN ''
            WHEN length(r.summary) > 100 THEN substr(r.summary, 1, 100) || '...' ELSE r.summary END AS hover_summary,
       CASE WHEN r.detail IS NULL OR r.detail = '' THEN ''
            WHEN length(r.detail) > 100 THEN substr(r.detail, 1, 100) || '...' ELSE r.detail END AS hover_detail
FROM records r JOIN assignments a USING (record_id) JOIN points p USING (record_id)
     LEFT JOIN cards c ON c.cluster = a.cluster LEFT JOIN col ON col.cluster = a.cluster
""")
def c1_scatter_table(spark, sf):
    t = R.scatter_table(B.doc_records(spark, sf), B.doc_assignments(spark, sf), B.doc_points(spark, sf),
                        _cards(spark, sf))
    return t.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@register("c2_annotation_table", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}
SELECT cluster, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy,
       coalesce(any_value(c.label), '{L.LABEL_PREFIX}' || CAST(cluster AS VARCHAR)) AS text
FROM points JOIN assignments USING (record_id) LEFT JOIN cards c USING (cluster)
GROUP BY cluster
""")
def c2_annotation_table(spark, sf):
    p = B.doc_points(spark, sf).join(B.doc_assignments(spark, sf), "record_id")
    a = R.annotation_table(p, _cards(spark, sf))
    return a.select("cluster", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "text")


@register("c3_report_cards", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS},
rp AS (SELECT cluster, string_agg(CASE WHEN length(t) <= 200 THEN t ELSE substr(t, 1, 197) || '...' END, ' | ' ORDER BY rn) AS r
       FROM smp WHERE rn <= 3 GROUP BY cluster)
SELECT c.cluster, c.label, c.count, coalesce(rp.r, '') AS representative_texts
FROM cards c LEFT JOIN rp USING (cluster)
""")
def c3_report_cards(spark, sf):
    c = R.report_cards(_cards(spark, sf))
    return c.select("cluster", "label", "count", _joined("representative_texts"))


@register("s7_export_csv", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}
SELECT r.record_id, r.store AS "{R.EXPORT_HEADERS['store']}", r.block AS "{R.EXPORT_HEADERS['block']}",
       r.summary AS "{R.EXPORT_HEADERS['summary']}", r.detail AS "{R.EXPORT_HEADERS['detail']}",
       r.category AS "{R.EXPORT_HEADERS['category']}", r.category_name AS "{R.EXPORT_HEADERS['category_name']}",
       a.cluster AS "{R.CLUSTER_NUMBER_HEADER}",
       coalesce(c.label, '{L.LABEL_PREFIX}' || CAST(a.cluster AS VARCHAR)) AS "{R.CLUSTER_NAME_HEADER}"
FROM records r JOIN assignments a USING (record_id) LEFT JOIN cards c ON c.cluster = a.cluster
""")
def s7_export_csv(spark, sf):
    r = B.doc_records(spark, sf).withColumnRenamed("document_text", "_document_text")
    return R.export_frame(r, B.doc_assignments(spark, sf), _cards(spark, sf), True, R.EXPORT_HEADERS)


@register("l1_fallback_label", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}
SELECT c.cluster, coalesce(wl.lab, '{L.LABEL_PREFIX}' || CAST(c.cluster AS VARCHAR)) AS label
FROM cnts c LEFT JOIN wl USING (cluster)
""")
def l1_fallback_label(spark, sf):
    recs = B.clustered_records(spark, sf)
    ids = recs.select("cluster").distinct()
    wl = L.word_lists(recs, **WORDS)
    j = ids.join(wl, "cluster", "left")
    return j.select("cluster", L.fallback_label(F.col("cluster"), F.col("frequent_words")).alias("label"))


@register("l2_fallback_description", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}
SELECT cluster, CASE WHEN wl.lab IS NULL THEN '{L.EMPTY_DESCRIPTION}'
  ELSE '{L.DESCRIPTION_TEMPLATE.split("{words}")[0]}' || wl.w5 ||
       '{L.DESCRIPTION_TEMPLATE.split("{words}")[1].split("{first}")[0]}' || wl.w1 ||
       '{L.DESCRIPTION_TEMPLATE.split("{first}")[1]}' END AS description
FROM cnts LEFT JOIN wl USING (cluster)
""")
def l2_fallback_description(spark, sf):
    recs = B.clustered_records(spark, sf)
    ids = recs.select("cluster").distinct()
    j = ids.join(L.word_lists(recs, **WORDS), "cluster", "left")
    return j.select("cluster", L.fallback_description(F.col("frequent_words")).alias("description"))


@register("l3_noise_card", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}
SELECT cluster, label, description, frequent_words, count FROM cards WHERE cluster = -1
""")
def l3_noise_card(spark, sf):
    c = _cards(spark, sf).where(F.col("cluster") == -1)
    return c.select("cluster", "label", "description", _joined("frequent_words"), "count")


# ---------------------------------------------------------------------------
# T1-T7 TF-IDF over documents (whole texts)
# ---------------------------------------------------------------------------

from shoal.operators import features as FT  # noqa: E402

_ORACLE_TERMS = """
toks AS (
  SELECT doc_id AS record_id,
         regexp_extract_all(lower(CASE WHEN regexp_replace(coalesce(text, ''), '^@WS@+|@WS@+$', '', 'g') = ''
                                       THEN ' ' ELSE text END), '[\\p{L}\\p{N}_]{2,}') AS t
  FROM documents
),
terms AS (
  SELECT record_id, t,
         list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) AS terms
  FROM toks
),
tf AS (SELECT record_id, term, count(*) AS tf FROM (SELECT record_id, unnest(terms) AS term FROM terms) GROUP BY ALL),
st AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM tf GROUP BY term),
n AS (SELECT count(*) AS N FROM documents),
kept AS (SELECT term, df, ctf FROM st, n WHERE df >= 2 AND df <= N * 0.95),
vocab AS (SELECT term, df FROM kept ORDER BY ctf DESC, term LIMIT 1000),
wt AS (SELECT record_id, term, tf * (ln((1 + N) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term), n),
nw AS (SELECT record_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY record_id)) AS weight FROM wt)
"""


def _doc_recs(spark, sf):
    return B.dealt(_docs(spark, sf)).select(F.col("doc_id").alias("record_id"), F.col("text").alias("document_text"))


@register("t1_tokens", f"""
WITH {_ORACLE_TERMS}
SELECT record_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM terms
""")
def t1_tokens(spark, sf):
    t = _doc_recs(spark, sf).select("record_id", TX.word_tokens(TX.blank_to_space("document_text")).alias("t"))
    return t.select("record_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("t2_ngrams", f"""
WITH {_ORACLE_TERMS}
SELECT record_id, CAST(len(terms) AS INTEGER) AS n_terms, array_to_string(terms, '|') AS terms FROM terms
""")
def t2_ngrams(spark, sf):
    t = FT.terms(_doc_recs(spark, sf))
    return t.select("record_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


@register("t3_df_prune", f"""
WITH {_ORACLE_TERMS}
SELECT term, df, ctf FROM kept
""")
def t3_df_prune(spark, sf):
    d = _doc_recs(spark, sf)
    n = d.count()
    st = FT.term_stats(FT.terms(d))
    return st.where((F.col("df") >= 2) & (F.col("df") <= F.lit(n * 0.95))).select("term", "df", "ctf")


@register("t4_vocab_top", f"""
WITH {_ORACLE_TERMS}
SELECT term, df FROM vocab
""")
def t4_vocab_top(spark, sf):
    d = _doc_recs(spark, sf)
    return FT.pruned_vocabulary(FT.tokens(d), d.count())


@register("t5_tfidf", f"""
WITH {_ORACLE_TERMS}
SELECT record_id, term, round(weight, 6) AS weight FROM nw
""")
def t5_tfidf(spark, sf):
    t = FT.tfidf_long(_doc_recs(spark, sf))
    return t.withColumn("weight", F.round("weight", 6))


@register("t7_assemble_features", f"""
WITH {_ORACLE_TERMS},
per AS (SELECT record_id, count(*) AS nnz, sum(weight * weight) AS sq FROM nw GROUP BY record_id)
SELECT d.doc_id AS record_id, CAST(coalesce(per.nnz, 0) AS INTEGER) AS nnz, round(coalesce(sqrt(per.sq), 0), 6) AS norm
FROM documents d LEFT JOIN per ON per.record_id = d.doc_id
""")
def t7_assemble_features(spark, sf):
    from pyspark.ml.functions import vector_to_array
    d = _doc_recs(spark, sf)
    v = FT.fit_tfidf(d).transform(d)
    arr = vector_to_array("features")
    return v.select("record_id", F.size(F.filter(arr, lambda x: x != 0)).alias("nnz"),
                    F.round(F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


# ---------------------------------------------------------------------------
# models
# ---------------------------------------------------------------------------

from shoal.operators import cluster as CL  # noqa: E402
from shoal.operators import evaluate as EV  # noqa: E402
from shoal.operators import reduce as RD  # noqa: E402
from shoal.operators import silhouette_tree as ST  # noqa: E402
from shoal.plans import pipeline as PL  # noqa: E402


def _doc_fit(spark, sf) -> PL.FitResult:
    return PL.fit(B.doc_records(spark, sf, deal=True), PL.PipelineConfig(word_pattern=LETTER_RUN))


@register("m1_pca2")
def m1_pca2(spark, sf):
    d = _doc_recs(spark, sf)
    feats = FT.fit_tfidf(d).transform(d).persist()
    pts = RD.pca2(feats)
    return pts.select("record_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("m3_kmeans")
def m3_kmeans(spark, sf):
    from shoal.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return CL.kmeans(B.emb_points(spark, sf).checkpoint()).assignments


@register("m7_fit")
def m7_fit(spark, sf):
    c = _doc_fit(spark, sf).cards
    return c.select("cluster", "label", "description", _joined("representative_texts"),
                    _joined("frequent_words"), "count")


# the covariance times itself, divided by the trace: after 16 times its first component alone is left
_SQUARED = """SELECT t + 1, list_transform(m, lambda r: list_transform(m, lambda k: list_dot_product(r, k) / list_sum(list_transform(m, lambda z: list_dot_product(z, z)))))"""
# the row as a unit vector whose largest loading is positive
_SIGNED = """SELECT list_transform(r, lambda z: z / sqrt(list_dot_product(r, r)) * sign(r[list_position(list_transform(r, lambda q: abs(q)), list_max(list_transform(r, lambda q: abs(q))))])) AS v"""


@register("m1_pca2_embeddings", f"""
WITH RECURSIVE e AS (SELECT vec_id AS id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT i, avg(v) AS mu FROM e GROUP BY i),
c AS (SELECT e.id, e.i, e.v - m.mu AS v FROM e JOIN means m USING (i)),
cov AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS s FROM c a JOIN c b USING (id) GROUP BY ALL),
mat AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM cov GROUP BY i)),
one AS (SELECT 0 AS t, m FROM mat UNION ALL
        {_SQUARED}
        FROM one WHERE t < 16),
v1 AS ({_SIGNED}
       FROM (SELECT unnest(m) AS r FROM one WHERE t = 16) ORDER BY list_dot_product(r, r) DESC LIMIT 1),
left2 AS (SELECT list_transform(m, lambda r, a: list_transform(r, lambda z, b: z - v[a] * v[b] * list_dot_product(v, list_transform(m, lambda k: list_dot_product(k, v))))) AS m
          FROM mat, v1),
two AS (SELECT 0 AS t, m FROM left2 UNION ALL
        {_SQUARED}
        FROM two WHERE t < 16),
v2 AS ({_SIGNED}
       FROM (SELECT unnest(m) AS r FROM two WHERE t = 16) ORDER BY list_dot_product(r, r) DESC LIMIT 1),
rows AS (SELECT id, list(v ORDER BY i) AS r FROM c GROUP BY id)
SELECT id AS record_id, round(list_dot_product(r, v1.v), 6) AS x, round(list_dot_product(r, v2.v), 6) AS y FROM rows, v1, v2
""")
def m1_pca2_embeddings(spark, sf):
    from pyspark.ml.functions import array_to_vector
    emb = read_table(spark, sf, "embeddings")
    feats = emb.select(F.col("vec_id").cast("bigint").alias("record_id"),
                       array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return RD.pca2(feats).select("record_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _cost(points, centres):
    return CL.assign_nearest(points, centres).agg(F.sum("d2")).first()[0]


@register("m3_kmeans_checks", """
SELECT count(*) AS points, CAST(8 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS wrong_labels, TRUE AS settled, TRUE AS best_of_restarts
FROM embeddings
""")
def m3_kmeans_checks(spark, sf):
    """What holds for any right k-means: each point has the label of the nearest centre, another Lloyd step
    hardly lowers the cost and never raises it, and more restarts never cost more than one."""
    from shoal.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    pts = B.emb_points(spark, sf).checkpoint()
    run, single = CL.kmeans(pts, k=8), CL.kmeans(pts, k=8, restarts=1)

    def centres(r):
        return [(i, float(c[0]), float(c[1])) for i, c in enumerate(r.model.clusterCenters())]
    cost, once = _cost(pts, centres(run)), _cost(pts, centres(single))
    after = _cost(pts, CL.centres_of(CL.lloyd_step(pts, centres(run))))
    # centres lie apart by far more than the digits in which two computations of a distance may differ
    near = CL.assign_nearest(pts, centres(run)).select("record_id", F.col("cluster").alias("nearest"))
    return run.assignments.join(near, "record_id").agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("cluster").alias("clusters"),
        F.count_if(F.col("cluster") != F.col("nearest")).alias("wrong_labels"),
        F.lit(cost * 0.99 <= after <= cost * (1 + 1e-9)).alias("settled"), F.lit(cost <= once * (1 + 1e-9)).alias("best_of_restarts"))


@register("m7_fit_checks", """
SELECT count(*) AS records, count(*) AS carded, CAST(8 AS BIGINT) AS clusters, TRUE AS centred, TRUE AS orthogonal,
       TRUE AS first_is_wider, TRUE AS scored, CAST(0 AS BIGINT) AS wrong_sizes
FROM documents
""")
def m7_fit_checks(spark, sf):
    """What holds for any right fit: every record has one point and one label, points are centred and their coordinates
    uncorrelated, the first one being the wider, and every card counts its cluster's records."""
    res = _doc_fit(spark, sf)
    labelled = res.points.join(res.assignments, "record_id")
    seen = labelled.agg(F.count_distinct("record_id").alias("n"), F.count(F.lit(1)).alias("rows"), F.avg("x").alias("mx"),
                        F.avg("y").alias("my"), F.corr("x", "y").alias("r"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")).first()
    score = res.run_stats.first()["silhouette"]
    sizes = res.assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return res.cards.select("cluster", "count").join(sizes, "cluster", "full").agg(
        F.lit(seen["n"] if seen["n"] == seen["rows"] else -1).cast("bigint").alias("records"), F.sum("count").alias("carded"),
        F.count("size").alias("clusters"), F.lit(max(abs(seen["mx"]), abs(seen["my"])) < 1e-9).alias("centred"),
        F.lit(abs(seen["r"]) < 1e-6).alias("orthogonal"), F.lit(seen["vx"] >= seen["vy"]).alias("first_is_wider"),
        F.lit(score is not None and -1 <= score <= 1).alias("scored"),
        F.count_if(~F.col("count").eqNullSafe(F.col("size"))).alias("wrong_sizes"))


def _emb_points(spark, sf):
    return B.emb_points(spark, sf).join(B.emb_assignments(spark, sf), "record_id")


_ORACLE_PTS = """
pts AS (SELECT p.record_id, p.x, p.y, a.cluster FROM epoints p JOIN eassignments a USING (record_id)),
cen AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM pts GROUP BY cluster),
near AS (
  SELECT * FROM (
    SELECT p.record_id, p.x, p.y, c.cluster, (p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy) AS d2,
           row_number() OVER (PARTITION BY p.record_id ORDER BY (p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy), c.cluster) AS rn
    FROM pts p CROSS JOIN cen c) WHERE rn = 1
)
"""


@register("m3a_assign_nearest", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_PTS}
SELECT record_id, cluster, round(d2, 6) AS d2 FROM near
""")
def m3a_assign_nearest(spark, sf):
    p = _emb_points(spark, sf)
    cen = CL.centres_of(R.centroids(p))
    a = CL.assign_nearest(p, cen)
    return a.select("record_id", "cluster", F.round("d2", 6).alias("d2"))


@register("m3b_lloyd_step", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_PTS}
SELECT cluster, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n FROM near GROUP BY cluster
""")
def m3b_lloyd_step(spark, sf):
    p = _emb_points(spark, sf)
    st = CL.lloyd_step(p, CL.centres_of(R.centroids(p)))
    return st.select("cluster", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "n")


_ORACLE_SILHOUETTE = """
pts AS (SELECT p.record_id, p.x, p.y, a.cluster FROM epoints p JOIN eassignments a USING (record_id) WHERE a.cluster >= 0),
pair AS (SELECT i.record_id, i.cluster AS own, j.cluster, sum(sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y))) AS s,
                count(*) AS c
         FROM pts i CROSS JOIN pts j GROUP BY ALL),
per AS (SELECT record_id, max(CASE WHEN cluster = own THEN c END) AS oc,
               max(CASE WHEN cluster = own AND c > 1 THEN s / (c - 1) END) AS a,
               min(CASE WHEN cluster <> own THEN s / c END) AS b
        FROM pair GROUP BY record_id),
sc AS (SELECT record_id, CASE WHEN oc <= 1 OR greatest(a, b) IS NULL OR greatest(a, b) = 0 THEN 0
                   ELSE (b - a) / greatest(a, b) END AS s FROM per)
"""


@register("m6_silhouette", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_SILHOUETTE}
SELECT round(avg(s), 6) AS silhouette, count(*) AS n FROM sc
""")
def m6_silhouette(spark, sf):
    s = EV.silhouette_samples(_emb_points(spark, sf))
    return s.agg(F.round(F.avg("s"), 6).alias("silhouette"), F.count(F.lit(1)).alias("n"))


@register("m6_silhouette_tree", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_SILHOUETTE}
SELECT record_id, round(s, 6) AS exact, TRUE AS within, TRUE AS narrow FROM sc
""")
def m6_silhouette_tree(spark, sf):
    """Silhouettes by the tree of blocks beside the exact ones, which have to lie within the bound."""
    pts = _emb_points(spark, sf).checkpoint()
    tree = ST.silhouette_bounds(pts, tolerance=0.01, block_size=16).select("record_id", F.col("s").alias("near"), "bound")
    both = EV.silhouette_samples(pts).join(tree, "record_id")
    return both.select("record_id", F.round("s", 6).alias("exact"), (F.abs(F.col("s") - F.col("near")) <= F.col("bound") + 1e-9).alias("within"),
                       (F.col("bound") < 0.1).alias("narrow"))


_ORACLE_SQUARED = """
pts AS (SELECT p.record_id, p.x, p.y, a.cluster FROM epoints p JOIN eassignments a USING (record_id) WHERE a.cluster >= 0),
cs AS (SELECT cluster, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS sq FROM pts GROUP BY cluster),
pc AS (SELECT p.record_id, p.cluster AS own, c.cluster, c.n,
              c.n * (p.x * p.x + p.y * p.y) + c.sq - 2 * (p.x * c.sx + p.y * c.sy) AS s
       FROM pts p CROSS JOIN cs c),
ab AS (SELECT record_id, max(CASE WHEN cluster = own THEN n END) AS n,
              max(CASE WHEN cluster = own AND n > 1 THEN s / (n - 1) END) AS a,
              min(CASE WHEN cluster <> own THEN s / n END) AS b FROM pc GROUP BY record_id),
sil AS (SELECT avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) AS s FROM ab)
"""


@register("m6_silhouette_squared", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_SQUARED}
SELECT round(s, 6) AS silhouette FROM sil
""")
def m6_silhouette_squared(spark, sf):
    s = EV.silhouette(_emb_points(spark, sf), "squared_euclidean")
    return spark.createDataFrame([(round(s, 6),)], "silhouette double")


@register("m8_run_stats", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_SQUARED}
SELECT 'given' AS method, 'given' AS method_effective,
       CAST((SELECT count(DISTINCT cluster) FROM eassignments WHERE cluster >= 0) AS INTEGER) AS n_clusters,
       (SELECT count(*) FROM eassignments WHERE cluster = -1) AS n_noise, round(s, 6) AS silhouette FROM sil
""")
def m8_run_stats(spark, sf):
    """The statistics of the embeddings' own labelling."""
    a = B.emb_assignments(spark, sf)
    n = R.n_clusters_noise(a).first()
    run = CL.ClusterRun(a, "given", "given", n["n_clusters"], n["n_noise"])
    sil = EV.silhouette(_emb_points(spark, sf), "squared_euclidean", n_clusters=run.n_clusters)
    return run.run_stats(spark, round(sil, 6))


# ---------------------------------------------------------------------------
# Grid shaping over the conversations / lineitem sheet bindings
# ---------------------------------------------------------------------------

from shoal.operators import grid as G  # noqa: E402


def _norm_sql(e: str) -> str:
    return f"trim(regexp_replace(coalesce({e}, ''), '@WS@+', ' ', 'g'))"


def _nonblank_sql(e: str) -> str:
    return f"({e} IS NOT NULL AND {_STRIP.format(e)} <> '')"


def _join_non_empty_sql(lst: str) -> str:
    nl = f"list_transform(coalesce({lst}, []), lambda v: {_norm_sql('v')})"
    return (f"array_to_string(list_filter({nl}, lambda x, i: x <> '' AND list_position({nl}, x) = i), ' ')")


_ORACLE_SCORES = f"""
files AS (SELECT DISTINCT file FROM cells),
candf AS (
  SELECT file, row, col, value, {_nonblank_sql('value')} AS nb, {_ORACLE_CATEGORY.format('value')} AS cat
  FROM cells WHERE col BETWEEN 16 AND 22 AND row BETWEEN 7 AND 206
),
cagg AS (
  SELECT file, col, count(*) FILTER (WHERE nb) AS ne, count(*) FILTER (WHERE nb AND cat IS NOT NULL) AS mt,
         list({_STRIP.format('value')} ORDER BY row) FILTER (WHERE nb AND cat IS NOT NULL) AS ex
  FROM candf GROUP BY file, col
),
scores AS (
  SELECT f.file, CAST(g.c AS INTEGER) AS col,
         CAST(coalesce(mt, 0) AS DOUBLE) / 200 AS match_rate,
         CAST(coalesce(ne, 0) AS DOUBLE) / 200 AS non_empty_rate,
         (CAST(coalesce(mt, 0) AS DOUBLE) / 200) * CAST(0.8 AS DOUBLE)
           + (CAST(coalesce(ne, 0) AS DOUBLE) / 200) * CAST(0.2 AS DOUBLE) AS score,
         coalesce(ex[1:5], []) AS examples,
         CAST(coalesce(mt, 0) AS BIGINT) AS matched_count, CAST(coalesce(ne, 0) AS BIGINT) AS non_empty_count,
         CAST(200 AS BIGINT) AS total
  FROM files f CROSS JOIN generate_series(16, 22) AS g(c) LEFT JOIN cagg a ON a.file = f.file AND a.col = g.c
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY score DESC, col) AS INTEGER) AS rank FROM scores),
best AS (SELECT * FROM ranked WHERE rank = 1)
"""

_ORACLE_GRID = f"""
rws AS (
  SELECT c.file, c.row,
         max(CASE WHEN c.col = 5 THEN c.value END) AS e,
         max(CASE WHEN c.col = 6 THEN c.value END) AS f,
         max(CASE WHEN c.col = b.col THEN c.value END) AS catv,
         list(c.value ORDER BY c.col) FILTER (WHERE c.col BETWEEN 6 AND 15) AS stl,
         list(c.value ORDER BY c.col) FILTER (WHERE c.col BETWEEN 7 AND 15) AS dtl
  FROM cells c LEFT JOIN best b ON b.file = c.file
  WHERE c.row BETWEEN 7 AND 207 GROUP BY c.file, c.row
),
rws2 AS (
  SELECT file, row,
         coalesce(regexp_matches(e, '{TX.SUMMARY_MARKER}'), false) AS is_summary,
         coalesce(regexp_matches(f, '{TX.DETAIL_MARKER}'), false)
           AND NOT coalesce(regexp_matches(e, '{TX.SUMMARY_MARKER}'), false) AS is_detail,
         {_ORACLE_CATEGORY.format('catv')} AS cat,
         {_join_non_empty_sql('stl')} AS summary_text,
         {_join_non_empty_sql('dtl')} AS detail_text
  FROM rws
),
st AS (
  SELECT *,
         last_value(cat IGNORE NULLS) OVER w AS category_in_force,
         (last_value(CASE WHEN is_summary OR (is_detail AND cat IS NOT NULL) THEN {{'c': cat}} END IGNORE NULLS) OVER w).c
           AS category_nofill,
         coalesce(last_value(CASE WHEN is_summary THEN summary_text END IGNORE NULLS) OVER w, '') AS summary_in_force,
         min(CASE WHEN is_summary THEN row END) OVER wa AS ns,
         min(CASE WHEN is_detail THEN row END) OVER wa AS nd
  FROM rws2
  WINDOW w AS (PARTITION BY file ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wa AS (PARTITION BY file ORDER BY row RANGE BETWEEN 1 FOLLOWING AND 49 FOLLOWING)
),
st2 AS (SELECT *, (nd IS NOT NULL AND (ns IS NULL OR nd < ns)) AS has_detail FROM st),
ord AS (SELECT file, row_number() OVER (ORDER BY file) AS file_no FROM (SELECT DISTINCT file FROM cells)),
fx AS (
  SELECT file, {_norm_sql("max(CASE WHEN row = 4 AND col = 4 THEN value END)")} AS store,
         {_norm_sql("max(CASE WHEN row = 4 AND col = 14 THEN value END)")} AS block
  FROM cells GROUP BY file
),
grecs AS (
  SELECT CAST(o.file_no * 1000 + s.row AS BIGINT) AS record_id, s.file AS source_file, s.row,
         coalesce(fx.store, '') AS store, coalesce(fx.block, '') AS block,
         CASE WHEN is_summary THEN summary_text ELSE summary_in_force END AS summary,
         CASE WHEN is_summary THEN '' ELSE detail_text END AS detail,
         coalesce(category_in_force, '') AS category,
         {_ORACLE_CATEGORY_NAME.format('category_in_force')} AS category_name
  FROM st2 s LEFT JOIN fx USING (file) LEFT JOIN ord o USING (file)
  WHERE (is_summary AND NOT has_detail AND summary_text <> '') OR (is_detail AND detail_text <> '')
)
"""


def _conv_filled(spark, sf, step=1):
    return G.fill_merged(B.conv_cells(spark, sf, step), B.conv_merges(spark, sf, step))


def _conv_states(spark, sf, params=G.GridParams(), step=1):
    c = _conv_filled(spark, sf, step)
    best = G.best_column(G.score_columns(c, params))
    return G.record_states(G.sheet_rows(c, best, params), params)


@register("g1_fill_merged", f"""
WITH {B.ORACLE_CONV_CELLS}
SELECT file, row, CAST(col AS INTEGER) AS col, value FROM cells WHERE row >= 7
""")
def g1_fill_merged(spark, sf):
    return _conv_filled(spark, sf).where(F.col("row") >= 7).select("file", "row", "col", "value")


@register("g2_fixed_cells", f"""
WITH {B.ORACLE_CONV_CELLS}
SELECT file, {_norm_sql("max(CASE WHEN row = 4 AND col = 4 THEN value END)")} AS store,
       {_norm_sql("max(CASE WHEN row = 4 AND col = 14 THEN value END)")} AS block
FROM cells GROUP BY file
""")
def g2_fixed_cells(spark, sf):
    return G.fixed_cells(_conv_filled(spark, sf))


def _scores_out(df):
    return df.select("file", "col", F.round("match_rate", 6).alias("match_rate"),
                     F.round("non_empty_rate", 6).alias("non_empty_rate"), F.round("score", 6).alias("score"),
                     F.array_join("examples", SEP).alias("examples"), "matched_count", "non_empty_count", "total")


_SCORES_SELECT = ("file, col, round(match_rate, 6) AS match_rate, round(non_empty_rate, 6) AS non_empty_rate, "
                  "round(score, 6) AS score, array_to_string(examples, ' | ') AS examples, "
                  "matched_count, non_empty_count, total")


@register("g3_score_columns", f"""
WITH {B.ORACLE_LINEITEM_CELLS}, {_ORACLE_SCORES}
SELECT {_SCORES_SELECT} FROM scores
""")
def g3_score_columns(spark, sf):
    return _scores_out(G.score_columns(B.lineitem_cells(spark, sf)))


@register("g4_best_column", f"""
WITH {B.ORACLE_LINEITEM_CELLS}, {_ORACLE_SCORES}
SELECT file, col, round(score, 6) AS score FROM best
""")
def g4_best_column(spark, sf):
    b = G.best_column(G.score_columns(B.lineitem_cells(spark, sf)))
    return b.select("file", "col", F.round("score", 6).alias("score"))


@register("g5_rank_columns", f"""
WITH {B.ORACLE_LINEITEM_CELLS}, {_ORACLE_SCORES}
SELECT file, col, rank FROM ranked WHERE rank <= 5
""")
def g5_rank_columns(spark, sf):
    r = G.rank_columns(G.score_columns(B.lineitem_cells(spark, sf)))
    return r.where(F.col("rank") <= 5).select("file", "col", "rank")


@register("g6_column_examples", f"""
WITH {B.ORACLE_LINEITEM_CELLS}, {_ORACLE_SCORES}
SELECT file, col, array_to_string(examples, ' | ') AS examples FROM scores WHERE len(examples) > 0
""")
def g6_column_examples(spark, sf):
    s = G.score_columns(B.lineitem_cells(spark, sf))
    return s.where(F.size("examples") > 0).select("file", "col", F.array_join("examples", SEP).alias("examples"))


@register("g7_low_score_warning", f"""
WITH {B.ORACLE_LINEITEM_CELLS}, {_ORACLE_SCORES}
SELECT file, col, round(score, 6) AS score FROM best WHERE score < 0.01
""")
def g7_low_score_warning(spark, sf):
    w = G.low_score_warnings(G.best_column(G.score_columns(B.lineitem_cells(spark, sf))))
    return w.select("file", "col", F.round("score", 6).alias("score"))


@register("g8_manual_column", f"""
WITH {B.ORACLE_LINEITEM_CELLS}, {_ORACLE_SCORES}
SELECT {_SCORES_SELECT} FROM scores WHERE col = 17
""")
def g8_manual_column(spark, sf):
    return _scores_out(G.score_columns(B.lineitem_cells(spark, sf), G.GridParams(manual_column="Q")))


@register("g9_is_summary_row", f"""
WITH {B.ORACLE_CONV_CELLS}, {_ORACLE_SCORES}, {_ORACLE_GRID}
SELECT file, row, is_summary FROM rws2
""")
def g9_is_summary_row(spark, sf):
    return _conv_states(spark, sf).select("file", "row", "is_summary")


@register("g10_is_detail_row", f"""
WITH {B.ORACLE_CONV_CELLS}, {_ORACLE_SCORES}, {_ORACLE_GRID}
SELECT file, row, is_detail FROM rws2
""")
def g10_is_detail_row(spark, sf):
    return _conv_states(spark, sf).select("file", "row", "is_detail")


@register("g11_extract_category", f"""
WITH {B.ORACLE_CONV_CELLS}, {_ORACLE_SCORES}, {_ORACLE_GRID}
SELECT file, row, cat FROM rws2
""")
def g11_extract_category(spark, sf):
    return _conv_states(spark, sf).select("file", "row", "cat")


@register("g12_ffill_category", f"""
WITH {B.ORACLE_CONV_CELLS}, {_ORACLE_SCORES}, {_ORACLE_GRID}
SELECT file, row, category_in_force FROM st2
""")
def g12_ffill_category(spark, sf):
    return _conv_states(spark, sf).select("file", "row", "category_in_force")


@register("g13_nofill_category", f"""
WITH {B.ORACLE_CONV_CELLS}, {_ORACLE_SCORES}, {_ORACLE_GRID}
SELECT file, row, category_nofill AS category_in_force FROM st2
""")
def g13_nofill_category(spark, sf):
    return _conv_states(spark, sf, G.GridParams(inherit_category=False)).select("file", "row", "category_in_force")


@register("g14_ffill_summary", f"""
WITH {B.ORACLE_CONV_CELLS}, {_ORACLE_SCORES}, {_ORACLE_GRID}
SELECT file, row, summary_in_force FROM st2
""")
def g14_ffill_summary(spark, sf):
    return _conv_states(spark, sf).select("file", "row", "summary_in_force")


@register("g15_join_non_empty", f"""
WITH {B.ORACLE_CONV_CELLS}, {_ORACLE_SCORES}, {_ORACLE_GRID}
SELECT file, row, summary_text, detail_text FROM rws2
""")
def g15_join_non_empty(spark, sf):
    return _conv_states(spark, sf).select("file", "row", "summary_text", "detail_text")


@register("g16_has_detail", f"""
WITH {B.oracle_conv_cells(30)}, {_ORACLE_SCORES}, {_ORACLE_GRID}
SELECT file, row, has_detail FROM st2 WHERE is_summary
""")
def g16_has_detail(spark, sf):
    """Turns lie 30 rows apart: the next one is within the look-ahead, the one after it is not."""
    return _conv_states(spark, sf, step=30).where(F.col("is_summary")).select("file", "row", "has_detail")


@register("g17_emit_records", f"""
WITH {B.ORACLE_CONV_CELLS}, {_ORACLE_SCORES}, {_ORACLE_GRID}
SELECT * FROM grecs
""")
def g17_emit_records(spark, sf):
    recs = G.extract_records(B.conv_cells(spark, sf), B.conv_merges(spark, sf))
    return recs.drop("document_text")


@register("g18_row_bounds", f"""
WITH {B.oracle_conv_cells(50)}, {_ORACLE_SCORES}, {_ORACLE_GRID}
SELECT file, CAST(count(*) AS BIGINT) AS rows_scanned, CAST(max(row) AS INTEGER) AS last_row FROM rws2 GROUP BY file
""")
def g18_row_bounds(spark, sf):
    """Turns lie 50 rows apart, so turn 4 is in the last row read and later ones are beyond it."""
    s = _conv_states(spark, sf, step=50)
    return s.groupBy("file").agg(F.count(F.lit(1)).alias("rows_scanned"), F.max("row").cast("int").alias("last_row"))


@register("g19_category_name", f"""
WITH {B.ORACLE_CONV_CELLS}, {_ORACLE_SCORES}, {_ORACLE_GRID}
SELECT record_id, category, category_name FROM grecs
""")
def g19_category_name(spark, sf):
    recs = G.extract_records(B.conv_cells(spark, sf), B.conv_merges(spark, sf))
    return recs.select("record_id", "category", "category_name")


# ---------------------------------------------------------------------------
# Prompts, generation, parsing, relabel.  The generator is extractive: it
# answers with the prompt's own frequent words, so SQL can say what it answers.
# ---------------------------------------------------------------------------

def extractive_generator():
    """A generator factory: label = the prompt's line of frequent words; fails when that is empty."""
    def answer(prompt: str, max_tokens: int) -> str:
        lines = prompt.split("\n")
        at = [i for i, line in enumerate(lines) if line.startswith(("【頻出キーワード】", "【頻出語】"))][-1]
        words = lines[at + 1].strip()
        if not words:
            raise RuntimeError("no words to label")
        return f"{L.LABEL_SECTION}\n{words[:max_tokens]}\n{L.DESCRIPTION_SECTION}\n{len(prompt)} chars of prompt"
    return answer


def _cards_with_samples(spark, sf):
    return L.cluster_cards(B.clustered_records(spark, sf), with_samples=True, **WORDS)


_LP = L.LABEL_PROMPT.replace("'", "''")
_LP_HEAD = _LP.split("{samples}")[0]
_LP_MID = _LP.split("{samples}")[1].split("{words}")[0]
_LP_TAIL = _LP.split("{words}")[1]


_RP = L.RELABEL_PROMPT.replace("'", "''")
_RP_PARTS = [_RP.split("{previous}")[0], _RP.split("{previous}")[1].split("{samples}")[0],
             _RP.split("{samples}")[1].split("{words}")[0], _RP.split("{words}")[1]]
_ORACLE_PROMPTS = f"""
sm AS (SELECT cluster, string_agg('- ' || t, chr(10) ORDER BY rn) AS s FROM smp WHERE rn <= 5 GROUP BY cluster),
wd AS (SELECT cluster, string_agg(word, ', ' ORDER BY rank) AS w FROM top GROUP BY cluster),
pr AS (
  SELECT c.cluster, coalesce(sm.s, '') AS s, coalesce(wd.w, '') AS w,
         '{_LP_HEAD}' || coalesce(sm.s, '') || '{_LP_MID}' || coalesce(wd.w, '') || '{_LP_TAIL}' AS prompt
  FROM (SELECT DISTINCT cluster FROM crec WHERE cluster <> -1) c LEFT JOIN sm USING (cluster) LEFT JOIN wd USING (cluster)
),
gen AS (
  SELECT *, CASE WHEN w <> '' THEN '{L.LABEL_SECTION}' || chr(10) || substr(w, 1, {L.LABEL_MAX_TOKENS}) || chr(10) ||
                '{L.DESCRIPTION_SECTION}' || chr(10) || CAST(length(prompt) AS VARCHAR) || ' chars of prompt' END AS response
  FROM pr
)
"""


@register("l5_label_prompts", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_PROMPTS}
SELECT cluster, prompt FROM pr
""")
def l5_label_prompts(spark, sf):
    return L.label_prompts(_cards_with_samples(spark, sf))


@register("l6_generate_batch", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_PROMPTS}
SELECT cluster, response, CASE WHEN response IS NULL THEN 'RuntimeError: no words to label' END AS error FROM gen
""")
def l6_generate_batch(spark, sf):
    return L.generate(L.label_prompts(_cards_with_samples(spark, sf)), extractive_generator) \
        .select("cluster", "response", "error")


@register("l7_parse_response", f"""
WITH r AS (
  SELECT CAST(doc_id AS INTEGER) AS cluster,
         CASE doc_id % 4 WHEN 0 THEN '{L.LABEL_SECTION} ' || source || chr(10) || '{L.DESCRIPTION_SECTION}' || chr(10) || text
              WHEN 1 THEN text WHEN 2 THEN 'x {L.LABEL_SECTION}' || lang ELSE '{L.DESCRIPTION_SECTION} ' || text END AS response
  FROM documents),
p AS (SELECT cluster, {_STRIP.format("response")} AS whole,
             {_STRIP.format(f"regexp_extract(response, '(?s){L.LABEL_SECTION}@WS@*([^【]+)', 1)")} AS lab,
             {_STRIP.format(f"regexp_extract(response, '(?s){L.DESCRIPTION_SECTION}@WS@*([^【]+)', 1)")} AS des FROM r)
SELECT cluster, CASE WHEN lab <> '' THEN lab ELSE '{L.LABEL_PREFIX}' || CAST(cluster AS VARCHAR) END AS label,
       CASE WHEN des <> '' THEN des ELSE substr(whole, 1, {L.DESCRIPTION_FALLBACK_CHARS}) END AS description FROM p
""")
def l7_parse_response(spark, sf):
    """Responses made of table columns: both sections, none, the label only, the description only."""
    d, k = _docs(spark, sf), F.col("doc_id") % 4
    response = F.when(k == 0, F.concat(F.lit(L.LABEL_SECTION + " "), F.col("source"),
                                       F.lit("\n" + L.DESCRIPTION_SECTION + "\n"), F.col("text"))) \
        .when(k == 1, F.col("text")).when(k == 2, F.concat(F.lit("x " + L.LABEL_SECTION), F.col("lang"))) \
        .otherwise(F.concat(F.lit(L.DESCRIPTION_SECTION + " "), F.col("text")))
    r = d.select(F.col("doc_id").cast("int").alias("cluster"), response.alias("response"))
    lab, desc = L.parse_response(F.col("cluster"), F.col("response"))
    return r.select("cluster", lab.alias("label"), desc.alias("description"))


@register("l8_relabel", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_WORDS}, {_ORACLE_SAMPLES}, {_ORACLE_CARDS}, {_ORACLE_PROMPTS},
first AS (
  SELECT c.cluster, CASE WHEN g.response IS NULL THEN c.label ELSE substr(g.w, 1, {L.LABEL_MAX_TOKENS}) END AS label,
         CASE WHEN g.response IS NULL THEN c.description ELSE CAST(length(g.prompt) AS VARCHAR) || ' chars of prompt' END AS description,
         c.count, g.s, g.w
  FROM cards c LEFT JOIN gen g USING (cluster)
)
SELECT cluster, CASE WHEN cluster NOT IN (1, 2, 3) THEN label
         WHEN w = '' THEN '{L.LABEL_PREFIX}' || CAST(cluster AS VARCHAR) || '{L.RELABEL_FAILED_SUFFIX}'
         ELSE '{L.LABEL_SECTION}' || chr(10) || substr(w, 1, {L.RELABEL_MAX_TOKENS}) || chr(10) || '{L.DESCRIPTION_SECTION}' || chr(10) ||
              CAST(length('{_RP_PARTS[0]}' || label || '{_RP_PARTS[1]}' || s || '{_RP_PARTS[2]}' || w || '{_RP_PARTS[3]}') AS VARCHAR)
              || ' chars of prompt' END AS label, description, count
FROM first
""")
def l8_relabel(spark, sf):
    from shoal.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    # one row for each cluster, used several times: kept, so that the texts are read and the generator is asked once
    cards = L.generated_cards(_cards_with_samples(spark, sf).checkpoint(), extractive_generator).checkpoint()
    out = L.relabel(cards, [1, 2, 3], extractive_generator)
    return out.select("cluster", "label", "description", "count")


# ---------------------------------------------------------------------------
# File status, files without the sheet, vocabulary fallback
# ---------------------------------------------------------------------------

from shoal.sources import workbook as WB  # noqa: E402

_OTHER_SHEET = "作成例"


def _conv_files(spark, sf):
    """One file per conversation: with the target sheet, without it, or not readable."""
    return read_table(spark, sf, "conversations").select("conv_id").distinct()


@register("s4_file_status", f"""
WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS file,
       CASE conv_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'skipped' ELSE 'error' END AS status,
       CASE WHEN conv_id % 3 = 0 THEN n END AS record_count,
       CASE conv_id % 3
         WHEN 1 THEN replace(replace('{WB.MISSING_SHEET}', '{{file}}', CAST(conv_id AS VARCHAR)), '{{sheet}}', '{G.TARGET_SHEET}')
         WHEN 2 THEN replace(replace('{WB.READ_ERROR}', '{{file}}', CAST(conv_id AS VARCHAR)), '{{error}}', 'BadZipFile') END AS message
FROM c
""")
def s4_file_status(spark, sf):
    k, file = F.col("conv_id") % 3, F.col("conv_id").cast("string").alias("file")
    decoded = _conv_files(spark, sf).select(
        F.when(k == 2, F.lit("error")).otherwise(F.lit("sheets")).alias("kind"), file,
        F.when(k == 2, F.lit("BadZipFile")).when(k == 1, F.lit(_OTHER_SHEET))
        .otherwise(F.lit(_OTHER_SHEET + "\t" + G.TARGET_SHEET)).alias("message"))
    records = read_table(spark, sf, "conversations").where(k == 0).select(F.col("conv_id").cast("string").alias("source_file"))
    return WB.file_status(WB.WorkbookScan(decoded), records)


@register("j7_files_without_sheet", """
SELECT DISTINCT CAST(conv_id AS VARCHAR) AS file FROM conversations WHERE conv_id % 3 <> 0
""")
def j7_files_without_sheet(spark, sf):
    files = _conv_files(spark, sf).select(F.col("conv_id").cast("string").alias("file"))
    sheet = F.when(F.col("file").cast("bigint") % 3 == 0, F.lit(G.TARGET_SHEET)).otherwise(F.lit(_OTHER_SHEET))
    cells = B.conv_cells(spark, sf).withColumn("sheet", sheet)
    return G.files_without_sheet(files, cells)


@register("t6_tfidf_fallback", f"""
WITH {B.ORACLE_RECORDS},
tok AS (SELECT record_id, unnest(regexp_extract_all(lower(document_text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM docrec),
tf AS (SELECT record_id, term, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM tf GROUP BY term),
v AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM docrec)) / (1.0::DOUBLE + df)) + 1 AS idf FROM st ORDER BY ctf DESC, term LIMIT 500),
w AS (SELECT record_id, term, tf * idf AS w FROM tf JOIN v USING (term))
SELECT record_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY record_id)), 6) AS weight FROM w
""")
def t6_tfidf_fallback(spark, sf):
    """The fallback over the whole texts: a least document frequency that no term reaches leaves the first vocabulary empty."""
    d = _doc_recs(spark, sf)
    t = FT.tfidf_long(d, params=FT.TfidfParams(min_df=d.count() + 1, max_df=10 ** 12))
    return t.withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------------------
# S6, T10
# ---------------------------------------------------------------------------

from shoal.sources.tables import append_sources  # noqa: E402


@register("s6_append_files", f"""
WITH {B.ORACLE_RECORDS}, {B.ORACLE_CONV_CELLS}, {_ORACLE_SCORES}, {_ORACLE_GRID}
SELECT record_id * 2 AS record_id, store, category_name, 'documents' AS source FROM records
UNION ALL
SELECT record_id * 2 + 1, store, category_name, 'workbooks' AS source FROM grecs
""")
def s6_append_files(spark, sf):
    docs = B.doc_records(spark, sf).select("record_id", "store", "category_name", F.lit("documents").alias("source"))
    grid = G.extract_records(B.conv_cells(spark, sf), B.conv_merges(spark, sf)).select(
        "record_id", "store", "category_name", F.lit("workbooks").alias("source"))
    return append_sources([docs, grid])


@register("t10_cjk_runs", f"""
SELECT doc_id AS record_id, CAST(len(r) AS INTEGER) AS n_runs, array_to_string(r, ' ') AS runs
FROM (SELECT doc_id, regexp_extract_all(translate(text, 'aeiounrt', 'アイウエオ研修店'), '{TX.CJK_RUN}') AS r FROM documents)
""")
def t10_cjk_runs(spark, sf):
    """Some letters are turned into kana and kanji first, so that texts hold runs."""
    r = _docs(spark, sf).select(F.col("doc_id").alias("record_id"),
                                F.translate("text", "aeiounrt", "アイウエオ研修店").alias("t")) \
        .select("record_id", TX.cjk_runs("t").alias("r"))
    return r.select("record_id", F.size("r").alias("n_runs"), F.array_join("r", " ").alias("runs"))


# ---------------------------------------------------------------------------
# Exact nearest neighbours
# ---------------------------------------------------------------------------

from shoal.operators import density as DN  # noqa: E402
from shoal.operators import layout as LY  # noqa: E402
from shoal.operators import neighbors as NB  # noqa: E402
from shoal.operators import spanning as SP  # noqa: E402


@register("m2a_knn_cosine", """
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id AS record_id, b.id AS neighbor_id, 1 - list_cosine_similarity(a.v, b.v) AS dist
      FROM e a CROSS JOIN e b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY dist, neighbor_id) AS rank FROM d)
SELECT record_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(dist, 6) AS dist FROM r WHERE rank <= 15
""")
def m2a_knn_cosine(spark, sf):
    emb = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding")
    nn = NB.knn(emb, 15, vector_col="embedding", metric="cosine", include_self=False)
    return nn.withColumn("dist", F.round("dist", 6))


_ORACLE_KNN2 = """
pts AS (SELECT record_id, x, y FROM epoints),
d2 AS (SELECT a.record_id, b.record_id AS neighbor_id,
              sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
       FROM pts a CROSS JOIN pts b),
r2 AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY dist, neighbor_id) AS rk FROM d2),
core AS (SELECT record_id, max(dist) AS core FROM r2 WHERE rk <= 3 GROUP BY record_id),
r3 AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY dist, neighbor_id) AS rk
       FROM d2 WHERE record_id <> neighbor_id)
"""


@register("m4a_core_distance", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_KNN2}
SELECT record_id, round(core, 6) AS core FROM core
""")
def m4a_core_distance(spark, sf):
    c = NB.core_distances(B.emb_points(spark, sf), 3)
    return c.select("record_id", F.round("core", 6).alias("core"))


@register("m4b_mutual_reach", f"""
WITH {B.ORACLE_RECORDS}, {_ORACLE_KNN2}
SELECT r3.record_id, r3.neighbor_id, round(greatest(ca.core, cb.core, r3.dist), 6) AS mreach
FROM r3 JOIN core ca ON ca.record_id = r3.record_id JOIN core cb ON cb.record_id = r3.neighbor_id
WHERE r3.rk <= 3
""")
def m4b_mutual_reach(spark, sf):
    m = NB.mutual_reachability(B.emb_points(spark, sf), 3)
    return m.select("record_id", "neighbor_id", F.round("mreach", 6).alias("mreach"))


# The spanning tree and the density clusters, edge by edge in one recursion over the candidate edges.
_ORACLE_TREE = """gpts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY record_id) AS i, record_id, x, y FROM epoints),
gd AS (SELECT p.i AS u, q.i AS v, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM gpts p CROSS JOIN gpts q),
gcore AS (SELECT u, max(d) AS core FROM (SELECT u, d, row_number() OVER (PARTITION BY u ORDER BY d, v) AS r FROM gd) WHERE r <= 3 GROUP BY u),
gboth AS MATERIALIZED (SELECT gd.u, gd.v, greatest(cu.core, cv.core, gd.d) AS w
          FROM gd JOIN gcore cu ON cu.u = gd.u JOIN gcore cv ON cv.u = gd.v WHERE gd.u <> gd.v),
gm AS MATERIALIZED (SELECT u AS a, v AS b, w FROM gboth WHERE u < v),
-- an edge is not in the tree if a third point is closer to both ends
gout AS MATERIALIZED (SELECT DISTINCT gm.a, gm.b FROM gm JOIN gboth p ON p.u = gm.a AND p.w < gm.w JOIN gboth q ON q.u = gm.b AND q.v = p.v AND q.w < gm.w),
gcand AS MATERIALIZED (SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS k FROM gm ANTI JOIN gout USING (a, b)),
"""

# For each label its size, cluster, sum of 1 / distance of the points that left, and best choice below.
_ORACLE_CLUSTERS = """gstart AS MATERIALIZED (SELECT list(i ORDER BY i) AS lab, list(CAST(1 AS BIGINT) ORDER BY i) AS sz, list(CAST(NULL AS VARCHAR) ORDER BY i) AS cl,
                  list(CAST(0 AS DOUBLE) ORDER BY i) AS lam, list(CAST('-infinity' AS DOUBLE) ORDER BY i) AS inn,
                  list(CAST(NULL AS VARCHAR) ORDER BY i) AS att, list(record_id ORDER BY i) AS ids FROM gpts),
gwalk AS (
  SELECT CAST(0 AS BIGINT) AS k, lab, sz, cl, lam, inn, att, ids, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b,
         CAST(NULL AS DOUBLE) AS w, CAST([] AS STRUCT(cluster VARCHAR, parent VARCHAR, size BIGINT, stability DOUBLE, take BOOLEAN)[]) AS closed
  FROM gstart
  UNION ALL
  SELECT k,
         CASE WHEN same THEN lab ELSE list_transform(lab, lambda x: CASE WHEN x = hi THEN lo ELSE x END) END,
         CASE WHEN same THEN sz ELSE list_transform(sz, lambda x, j: CASE WHEN j = lo THEN sx + sy ELSE x END) END,
         CASE WHEN same THEN cl ELSE list_transform(cl, lambda x, j: CASE WHEN j = lo THEN zc ELSE x END) END,
         CASE WHEN same THEN lam ELSE list_transform(lam, lambda x, j: CASE WHEN j = lo THEN zl ELSE x END) END,
         CASE WHEN same THEN inn ELSE list_transform(inn, lambda x, j: CASE WHEN j = lo THEN zi ELSE x END) END,
         CASE WHEN same OR zc IS NULL THEN att ELSE list_transform(att, lambda x, j: CASE WHEN x IS NULL AND (lab[j] = lo OR lab[j] = hi) THEN zc ELSE x END) END,
         ids, CASE WHEN same THEN NULL ELSE a END, CASE WHEN same THEN NULL ELSE b END, w,
         CASE WHEN NOT same AND cx IS NOT NULL AND cy IS NOT NULL THEN
           [{'cluster': cx, 'parent': name, 'size': sx, 'stability': lx - sx * l, 'take': lx - sx * l >= ix},
            {'cluster': cy, 'parent': name, 'size': sy, 'stability': ly - sy * l, 'take': ly - sy * l >= iy}] ELSE [] END
  FROM (
    SELECT *, CASE WHEN cx IS NOT NULL AND cy IS NOT NULL THEN name ELSE coalesce(cx, cy, CASE WHEN sx + sy >= 5 THEN name END) END AS zc,
           CASE WHEN (cx IS NULL) = (cy IS NULL) THEN (sx + sy) * l WHEN cx IS NOT NULL THEN lx + sy * l ELSE ly + sx * l END AS zl,
           CASE WHEN cx IS NOT NULL AND cy IS NOT NULL THEN greatest(lx - sx * l, ix) + greatest(ly - sy * l, iy)
                WHEN cx IS NOT NULL THEN ix WHEN cy IS NOT NULL THEN iy ELSE CAST('-infinity' AS DOUBLE) END AS zi
    FROM (
      SELECT *, sz[lo] AS sx, sz[hi] AS sy, cl[lo] AS cx, cl[hi] AS cy, lam[lo] AS lx, lam[hi] AS ly, inn[lo] AS ix, inn[hi] AS iy
      FROM (
        SELECT g.k + 1 AS k, lab, sz, cl, lam, inn, att, ids, c.a, c.b, c.w, 1 / c.w AS l, lab[c.a] = lab[c.b] AS same,
               least(lab[c.a], lab[c.b]) AS lo, greatest(lab[c.a], lab[c.b]) AS hi, ids[c.a] || ':' || ids[c.b] AS name
        FROM gwalk g JOIN gcand c ON c.k = g.k + 1)))
),
glast AS (SELECT * FROM gwalk ORDER BY k DESC LIMIT 1),
gclosed AS (SELECT c.* FROM (SELECT unnest(closed) AS c FROM gwalk)
            UNION ALL SELECT cl[1], NULL, sz[1], lam[1], false FROM glast WHERE cl[1] IS NOT NULL),
gcover AS (SELECT cluster, CAST(NULL AS VARCHAR) AS cover FROM gclosed WHERE parent IS NULL
           UNION ALL SELECT c.cluster, coalesce(p.cover, CASE WHEN c.take THEN c.cluster END) FROM gclosed c JOIN gcover p ON p.cluster = c.parent),
gspot AS (SELECT unnest(ids) AS record_id, unnest(att) AS cluster FROM glast),
gfound AS (SELECT s.record_id, g.cover AS cluster FROM gspot s LEFT JOIN gcover g USING (cluster)),
gnumber AS (SELECT cluster, row_number() OVER (ORDER BY min(record_id)) - 1 AS number FROM gfound WHERE cluster IS NOT NULL GROUP BY cluster)
"""


@register("m4c_min_span_forest", f"""
WITH RECURSIVE {B.ORACLE_RECORDS}, {_ORACLE_TREE} {_ORACLE_CLUSTERS}
SELECT ids[a] AS a, ids[b] AS b, round(w, 6) AS w FROM gwalk WHERE a IS NOT NULL
""")
def m4c_min_span_forest(spark, sf):
    t = NB.spanning_forest(B.emb_points(spark, sf), 3)
    return t.select("a", "b", F.round("w", 6).alias("w"))


@register("m4d_condense_select", f"""
WITH RECURSIVE {B.ORACLE_RECORDS}, {_ORACLE_TREE} {_ORACLE_CLUSTERS}
SELECT c.cluster, c.parent, c.size, round(c.stability, 6) AS stability, coalesce(g.cover, '') = c.cluster AS taken
FROM gclosed c JOIN gcover g USING (cluster)
""")
def m4d_condense_select(spark, sf):
    """The condensed tree of the embeddings' points: every cluster with its parent, size, stability and whether it is taken."""
    tree = SP.spanning_tree(B.emb_points(spark, sf), 3)
    return DN.condensed_tree(tree, 5)[0].withColumn("stability", F.round("stability", 6))


@register("m4_density", f"""
WITH RECURSIVE {B.ORACLE_RECORDS}, {_ORACLE_TREE} {_ORACLE_CLUSTERS}
SELECT record_id, CAST(coalesce(number, -1) AS INTEGER) AS cluster FROM gfound LEFT JOIN gnumber USING (cluster)
""")
def m4_density(spark, sf):
    return DN.density(B.emb_points(spark, sf)).assignments


@register("m5_noise_fallback", f"""
WITH RECURSIVE {B.ORACLE_RECORDS}, {_ORACLE_TREE} {_ORACLE_CLUSTERS},
st AS (SELECT count(*) AS n, count(*) FILTER (WHERE cluster IS NULL) AS noise, count(DISTINCT cluster) AS k FROM gfound)
SELECT 'hdbscan' AS method, CASE WHEN noise > n * 0.5 THEN 'kmeans' ELSE 'hdbscan' END AS method_effective,
       CAST(CASE WHEN noise > n * 0.5 THEN 8 ELSE k END AS INTEGER) AS n_clusters,
       CAST(CASE WHEN noise > n * 0.5 THEN 0 ELSE noise END AS BIGINT) AS n_noise FROM st
""")
def m5_noise_fallback(spark, sf):
    """Density clustering of the embeddings' points, with the switch to k-means on the measured noise."""
    run = CL.cluster_points(B.emb_points(spark, sf).checkpoint(), use_density=True)
    return run.run_stats(spark, None).drop("silhouette")


@register("m5_noise_rule", f"""
WITH {B.ORACLE_RECORDS}
SELECT count(*) AS n, count(*) FILTER (WHERE cluster = -1) AS n_noise,
       (count(*) FILTER (WHERE cluster = -1)) > count(*) * 0.5 AS fallback
FROM assignments
""")
def m5_noise_rule(spark, sf):
    """M5 rule on a labelling: fall back to k-means when noise > 50 % (strict)."""
    s = R.n_clusters_noise(B.doc_assignments(spark, sf)).first()
    n = B.doc_assignments(spark, sf).count()
    return spark.createDataFrame([(n, s["n_noise"], CL.too_much_noise(s["n_noise"], n))],
                                 "n bigint, n_noise bigint, fallback boolean")


# ---------------------------------------------------------------------------
# The neighbour graph and its layout
# ---------------------------------------------------------------------------

NEIGHBOURS = 15


def _emb_near(spark, sf):
    emb = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding")
    return NB.knn(emb, NEIGHBOURS - 1, vector_col="embedding", metric="cosine", include_self=False)


@register("m2b_fuzzy_graph", f"""
WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id AS i, b.id AS j, 1 - list_cosine_similarity(a.v, b.v) AS d FROM e a CROSS JOIN e b WHERE a.id <> b.id),
r AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM d) WHERE rk <= {NEIGHBOURS - 1}),
rho AS MATERIALIZED (SELECT i, coalesce(min(CASE WHEN d > 0 THEN d END), 0) AS rho, sum(greatest(d, 0)) / {NEIGHBOURS} AS mean FROM r GROUP BY i),
gaps AS MATERIALIZED (SELECT r.i, list(greatest(r.d - rho.rho, 0) ORDER BY rk) AS g FROM r JOIN rho USING (i) GROUP BY r.i),
half AS (
  SELECT i, g, 0 AS n, CAST(0 AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, CAST(1 AS DOUBLE) AS mid FROM gaps
  UNION ALL
  SELECT i, g, n + 1, nlo, nhi, CASE WHEN nhi IS NULL THEN mid * 2 ELSE (nlo + nhi) / 2 END
  FROM (SELECT i, g, n, mid, CASE WHEN over THEN lo ELSE mid END AS nlo, CASE WHEN over THEN mid ELSE hi END AS nhi
        FROM (SELECT *, list_sum(list_transform(g, lambda x: exp(-x / mid))) > log2({NEIGHBOURS}) AS over FROM half))
  WHERE n < {LY.HALVINGS}
),
sc AS (SELECT half.i, greatest(half.mid, {LY.LEAST_SCALE} * rho.mean) AS s, rho.rho FROM half JOIN rho USING (i) WHERE n = {LY.HALVINGS}),
w AS (SELECT r.i, r.j, exp(-greatest(r.d - sc.rho, 0) / sc.s) AS w FROM r JOIN sc USING (i)),
p AS (SELECT least(i, j) AS a, greatest(i, j) AS b, coalesce(max(CASE WHEN i < j THEN w END), 0) AS x,
             coalesce(max(CASE WHEN i > j THEN w END), 0) AS y FROM w GROUP BY ALL)
SELECT a, b, round(x + y - x * y, 6) AS w FROM p
""")
def m2b_fuzzy_graph(spark, sf):
    g = LY.fuzzy_graph(_emb_near(spark, sf), NEIGHBOURS)
    return g.select("a", "b", F.round("w", 6).alias("w"))


@register("m2c_layout_epochs")
def m2c_layout_epochs(spark, sf):
    """The layout of the embeddings from their neighbour graph, started at two fixed projections."""
    pts = LY.layout_epochs(LY.fuzzy_graph(_emb_near(spark, sf), NEIGHBOURS).checkpoint(), B.emb_points(spark, sf))
    return pts.select("record_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
