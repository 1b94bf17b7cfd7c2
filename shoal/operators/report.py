"""Summary tables, crosstabs, centroids and chart tables.

Tables with one row per cluster (cards, sizes, centroids) are small; joins
against them are left to AQE, which turns them into broadcast joins when
the measured side is small and keeps a shuffle join when it is not (a
density clustering can produce many clusters).  Totals are scalars
used as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions import text as TX
from shoal.operators import labels as L

# ---------------------------------------------------------------------------
# Fixed values that must match the reference's behaviour.
NOISE_NAME = "ノイズ"                           # label of -1 without a card table
OPTION_PREFIX = "クラスタ"                      # cluster picker default "クラスタ{id}" (no space)
# Colour cycle for non-noise clusters (ColorBrewer Set2 then Set3), and noise.
PALETTE = [
    "rgb(102,194,165)", "rgb(252,141,98)", "rgb(141,160,203)", "rgb(231,138,195)",
    "rgb(166,216,84)", "rgb(255,217,47)", "rgb(229,196,148)", "rgb(179,179,179)",
    "rgb(141,211,199)", "rgb(255,255,179)", "rgb(190,186,218)", "rgb(251,128,114)",
    "rgb(128,177,211)", "rgb(253,180,98)", "rgb(179,222,105)", "rgb(252,205,229)",
    "rgb(217,217,217)", "rgb(188,128,189)", "rgb(204,235,197)", "rgb(255,237,111)",
]
NOISE_COLOR = "rgba(128, 128, 128, 0.5)"
DIM_OPACITY = 0.2
# Export headers of the record columns and the two cluster columns.
EXPORT_HEADERS = {
    "store": "店舗名",
    "block": "ブロック番号",
    "summary": "取り組み宣言（概要）",
    "detail": "取り組み宣言（詳細）",
    "category": "カテゴリ",
    "category_name": "カテゴリ名",
}
CLUSTER_NUMBER_HEADER = "クラスタ番号"
CLUSTER_NAME_HEADER = "クラスタ名"
DISPLAY_COLUMNS = ["store", "block", "category", "category_name", "summary", "detail"]
PREVIEW_ROWS = 50
# ---------------------------------------------------------------------------

NULL_COLUMN = "null"     # crosstab column of rows whose column value is null


# -- J1 / J2 / P10 -----------------------------------------------------------

def attach_labels(records: DataFrame, assignments: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Records with their cluster (and point) by ``record_id``."""
    out = records.join(assignments, "record_id")
    return out.join(points, "record_id") if points is not None else out


def cluster_label(cluster: Column, card_label: Column | None = None) -> Column:
    """P10: with a card table, its label or クラスタ {id}; without, ノイズ / クラスタ {id}."""
    if card_label is not None:
        return F.coalesce(card_label, L.default_label(cluster))
    return F.when(cluster == -1, F.lit(NOISE_NAME)).otherwise(L.default_label(cluster))


def attach_card(df: DataFrame, cards: DataFrame | None, cluster_col: str = "cluster") -> DataFrame:
    """Add ``cluster_label`` from the cards (left join on the cluster id)."""
    if cards is None:
        return df.withColumn("cluster_label", cluster_label(F.col(cluster_col)))
    c = cards.select(F.col("cluster").alias("_cid"), F.col("label").alias("_card_label"))
    j = df.join(c, F.col(cluster_col) == F.col("_cid"), "left")
    return j.withColumn("cluster_label", cluster_label(F.col(cluster_col), F.col("_card_label"))) \
        .drop("_cid", "_card_label")


# -- P8 / P9 / P11 / P12 / P13 -------------------------------------------------

def drop_internal(df: DataFrame) -> DataFrame:
    """Drop columns whose name starts with ``_``."""
    return df.select([F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def display_columns(df: DataFrame, wanted: list[str] = DISPLAY_COLUMNS) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select([c for c in wanted if c in df.columns])


def highlight_opacity(cluster: Column, highlight: int | None) -> Column:
    """1.0 for the chosen cluster (or when none is chosen), else 0.2."""
    if highlight is None:
        return F.lit(1.0)
    return F.when(cluster == highlight, F.lit(1.0)).otherwise(F.lit(DIM_OPACITY))


def cluster_colors(assignments: DataFrame, palette: list[str] = PALETTE) -> DataFrame:
    """``(cluster, color)``: non-noise ids in id order cycle through the palette.

    The distinct ids are numbered by a range sort and partition offsets, so many
    clusters neither meet in one task nor in one array.
    """
    from shoal.operators.grid import numbered
    ids = assignments.select(F.col("cluster").cast("int").alias("cluster")).distinct()
    ranked = numbered(ids.where(F.col("cluster") != -1), "cluster", "_i")
    pal = F.array(*[F.lit(p) for p in palette])
    colored = ranked.select("cluster", F.element_at(pal, F.pmod(F.col("_i") - 1, F.lit(len(palette))).cast("int") + 1)
                            .alias("color"))
    noise = ids.where(F.col("cluster") == -1).select("cluster", F.lit(NOISE_COLOR).alias("color"))
    return colored.unionByName(noise)


def cluster_options(assignments: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """``"{id}: {label}"`` for every non-noise id (sort by ``cluster`` to display)."""
    ids = assignments.select(F.col("cluster").cast("int").alias("cluster")).distinct() \
        .where(F.col("cluster") != -1)
    if cards is not None:
        ids = ids.join(cards.select("cluster", "label"), "cluster", "left")
        lab = F.coalesce(F.col("label"), F.concat(F.lit(OPTION_PREFIX), F.col("cluster").cast("string")))
    else:
        lab = F.concat(F.lit(OPTION_PREFIX), F.col("cluster").cast("string"))
    return ids.select("cluster", F.format_string("%d: %s", F.col("cluster"), lab).alias("option"))


# -- A1-A11 --------------------------------------------------------------------

def summary_stats(df: DataFrame) -> DataFrame:
    """A1: total, clusters (excl. -1), noise, noise ratio (0 when empty), unique stores.

    Counts per (cluster, store) come first, so the distinct counts see few rows.
    """
    pre = df.groupBy("cluster", "store").agg(F.count(F.lit(1)).alias("_n"))
    agg = pre.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_records"),
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster") == -1, F.col("_n"))), F.lit(0)).alias("n_noise"),
        F.count_distinct("store").alias("unique_stores"))
    return agg.withColumn("noise_ratio", F.when(F.col("total_records") > 0,
                                                F.col("n_noise") / F.col("total_records")).otherwise(F.lit(0.0)))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A2 / A3: ``(value, n)``; display order is ``n desc, value``."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def import_metrics(df: DataFrame) -> DataFrame:
    """A4: rows, distinct stores, distinct category names, summary-only rows (pre-aggregated as A1)."""
    pre = df.groupBy("store", "category_name").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("detail") == "").alias("_s"))
    return pre.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                   F.count_distinct("store").alias("stores"),
                   F.count_distinct("category_name").alias("categories"),
                   F.coalesce(F.sum("_s"), F.lit(0)).alias("summary_only"))


def cluster_sizes(assignments: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """A5: rows per cluster (noise included) with its share and display name."""
    sizes = assignments.groupBy(F.col("cluster").cast("int").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    total = assignments.count()  # one scalar, used as a literal (no join)
    out = sizes.withColumn("share", F.col("n") / F.lit(float(total)) if total else F.lit(0.0))
    return attach_card(out, cards).withColumnRenamed("cluster_label", "name")


def cluster_stats(df: DataFrame) -> DataFrame:
    """Per cluster: count, distinct stores, category-name -> count map."""
    per_cat = df.groupBy("cluster", "category_name").agg(F.count(F.lit(1)).alias("n"))
    dist = per_cat.groupBy("cluster").agg(
        F.sum("n").alias("count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category_name", "n")))).alias("category_dist"))
    stores = df.groupBy("cluster").agg(F.count_distinct("store").alias("store_count"))
    return dist.join(stores, "cluster")


#: Column for the values that a crosstab doesn't list.
OTHER_COLUMN = "other values"


def crosstab(df: DataFrame, row_col: str, col_col: str, values: list[str], rest: bool = False) -> DataFrame:
    """Zero-filled counts of ``row_col`` x ``col_col``, one column per listed value.

    A null column value is counted under ``NULL_COLUMN`` if that is listed.  With
    ``rest``, values not listed are counted under ``OTHER_COLUMN`` and all rows under
    ``total``; without, they are left out.  Where the values aren't known, use :func:`crosstab_long`.
    """
    col = F.coalesce(F.col(col_col).cast("string"), F.lit(NULL_COLUMN))
    counts = [F.count_if(col == v).alias(v) for v in values]
    if rest:
        counts += [F.count_if(~col.isin(values)).alias(OTHER_COLUMN), F.count(F.lit(1)).alias("total")]
    return df.groupBy(row_col).agg(*counts)


def crosstab_long(df: DataFrame, row_col: str, col_col: str, values: list[str] | None = None) -> DataFrame:
    """A7 / A9 in long form ``(row, column, n)``; a null column value is named ``NULL_COLUMN``.

    With ``values`` each row value has all of them, zero-filled, and values not listed
    are left out; without, only the pairs that occur.
    """
    col = F.coalesce(F.col(col_col).cast("string"), F.lit(NULL_COLUMN))
    n = df.groupBy(row_col, col.alias(col_col)).agg(F.count(F.lit(1)).alias("n"))
    if values is None:
        return n
    found = n.where(F.col(col_col).isin(values)).groupBy(row_col).agg(
        F.map_from_entries(F.collect_list(F.struct(col_col, "n"))).alias("_n"))     # at most one entry for each value
    return df.select(row_col).distinct().withColumnRenamed(row_col, "_r") \
        .join(found, F.col("_r").eqNullSafe(F.col(row_col)), "left") \
        .select(F.col("_r").alias(row_col), "_n", F.explode(F.array(*map(F.lit, values))).alias(col_col)) \
        .select(row_col, col_col, F.coalesce(F.element_at("_n", F.col(col_col)), F.lit(0)).cast("bigint").alias("n"))


def centroids(points_with_cluster: DataFrame) -> DataFrame:
    """A10: mean x, y per cluster, noise included."""
    return points_with_cluster.groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def n_clusters_noise(assignments: DataFrame) -> DataFrame:
    """Distinct labels excluding -1, and the count of -1."""
    return assignments.agg(
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
        F.count_if(F.col("cluster") == -1).alias("n_noise"))


# -- W4 / W5 / W6 --------------------------------------------------------------

def random_per_cluster(df: DataFrame, n: int = 3, seed: int = 42, key: Column | None = None) -> DataFrame:
    """``n`` pseudo-random rows per cluster, fixed seed (hash order, then id)."""
    from pyspark.sql import Window
    k = key if key is not None else F.xxhash64(F.lit(seed), F.col("record_id"))
    w = Window.partitionBy("cluster").orderBy(k, F.col("record_id"))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def lcg_key(seed: int = 42) -> Column:
    """A hash both engines compute identically (for the oracle variant of W4)."""
    return ((F.col("record_id") % 4294967291) * 48271 + seed) % 2147483647


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` records (a top-k by record order)."""
    return display_columns(df.orderBy("record_id").limit(n), ["record_id"] + DISPLAY_COLUMNS)


def ordered_cards(cards: DataFrame) -> DataFrame:
    """Cards by cluster id."""
    return cards.orderBy("cluster")


# -- C1-C3 ---------------------------------------------------------------------

def scatter_table(records: DataFrame, assignments: DataFrame, points: DataFrame,
                  cards: DataFrame | None = None, highlight: int | None = None,
                  max_text_length: int = 100) -> DataFrame:
    """Point, label, colour, opacity and the five hover fields per record."""
    hover = records.select(                      # cut first: no whole text goes through a join
        "record_id", F.col("store").alias("hover_store"), F.col("block").alias("hover_block"),
        F.col("category_name").alias("hover_category"),
        TX.hover_truncate("summary", max_text_length).alias("hover_summary"),
        TX.hover_truncate("detail", max_text_length).alias("hover_detail"))
    base = attach_card(attach_labels(hover, assignments, points), cards)
    base = base.join(cluster_colors(assignments), "cluster", "left")
    return base.select(
        "record_id", "x", "y", "cluster", "cluster_label", "color",
        highlight_opacity(F.col("cluster"), highlight).alias("opacity"),
        "hover_store", "hover_block", "hover_category", "hover_summary", "hover_detail")


def annotation_table(points_with_cluster: DataFrame, cards: DataFrame | None = None,
                     highlight: int | None = None) -> DataFrame:
    """Centroid + label per cluster; only the highlighted one when set.

    Without a card table, noise is named ノイズ; with one, a missing card
    falls back to クラスタ {id}.
    """
    c = centroids(points_with_cluster)
    if highlight is not None:
        c = c.where(F.col("cluster") == highlight)
    return attach_card(c, cards).withColumnRenamed("cluster_label", "text")


def report_cards(cards: DataFrame, max_length: int = 200) -> DataFrame:
    """Cards by id with each representative text cut by P2 at ``max_length``."""
    return cards.withColumn("representative_texts",
                            F.transform("representative_texts", lambda t: TX.truncate_text(t, max_length)))


# -- S7 query form -------------------------------------------------------------

def export_frame(df: DataFrame, assignments: DataFrame | None = None, cards: DataFrame | None = None,
                 include_cluster: bool = True, headers: dict[str, str] | None = None) -> DataFrame:
    """S7 (projection): drop ``_`` columns, add the cluster number and name."""
    out = drop_internal(df)
    if include_cluster and assignments is not None:
        out = out.join(assignments, "record_id", "left")     # a record without a cluster is exported too
        if cards is not None:
            out = attach_card(out, cards).withColumnRenamed("cluster_label", CLUSTER_NAME_HEADER)
        out = out.withColumnRenamed("cluster", CLUSTER_NUMBER_HEADER)
    if headers:
        out = out.select([F.col(f"`{c}`").alias(headers.get(c, c)) for c in out.columns])
    return out
