"""Grid shaping: sparse sheet cells -> records.

Input is a sparse long table ``cells(file, sheet, row, col, value STRING)``
(an absent row is an empty cell) plus ``merges(file, sheet, min_row,
min_col, max_row, max_col)``.  Everything is equi-joins, grouped aggregates
and windows partitioned by file: one sheet is at most ``first_row +
scan_rows`` rows, so no window partition or collected array grows with the
number of files.

The record state machine (running category, running summary text,
look-ahead for a detail marker) becomes three window frames over the row
number: ``rowsBetween(unboundedPreceding, 0)`` for the running values and
``rangeBetween(1, horizon)`` for the look-ahead, so absent sparse rows do
not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import text as TX

# ---------------------------------------------------------------------------
# Fixed values that must match the reference's behaviour.
TARGET_SHEET = "提出用"
STORE_CELL = (4, 4)          # D4
BLOCK_CELL = (4, 14)         # N4
SUMMARY_MARKER_COL = 5       # E
DETAIL_MARKER_COL = 6        # F
SUMMARY_TEXT_COLS = (6, 15)  # F..O
DETAIL_TEXT_COLS = (7, 15)   # G..O
CANDIDATE_COLS = (16, 22)    # P..V
FIRST_ROW = 7
SCAN_ROWS = 200              # scoring rows 7..206; extraction rows 7..207
LOOKAHEAD = 49               # rows after a summary searched for a detail marker
MATCH_WEIGHT = 0.8
NON_EMPTY_WEIGHT = 0.2
MAX_EXAMPLES = 5
LOW_SCORE = 0.01
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class GridParams:
    sheet: str = TARGET_SHEET
    first_row: int = FIRST_ROW
    scan_rows: int = SCAN_ROWS
    candidate_cols: tuple[int, int] = CANDIDATE_COLS
    lookahead: int = LOOKAHEAD
    inherit_category: bool = True
    manual_column: str | None = None

    @property
    def last_scored_row(self) -> int:
        return self.first_row + self.scan_rows - 1

    @property
    def last_extracted_row(self) -> int:
        return self.first_row + self.scan_rows


def column_index(letters: str) -> int:
    """Spreadsheet column letters -> 1-based index (``R`` -> 18, ``AA`` -> 27)."""
    n = 0
    for ch in letters.strip().upper():
        n = n * 26 + (ord(ch) - ord("A") + 1)
    return n


# -- S3 / J7 --------------------------------------------------------------------

def select_sheet(cells: DataFrame, sheet: str = TARGET_SHEET) -> DataFrame:
    """S3: the cells of the target sheet only."""
    return cells.where(F.col("sheet") == sheet)


def files_without_sheet(files: DataFrame, cells: DataFrame, sheet: str = TARGET_SHEET) -> DataFrame:
    """Files (``file`` column) that have no target sheet (left anti join)."""
    have = cells.where(F.col("sheet") == sheet).select("file").distinct()
    return files.join(have, "file", "left_anti")


# -- G1 / J4 --------------------------------------------------------------------

#: Ranges are clipped to these bounds before they are exploded, whatever the sheet's own size.
LAST_FILLED_COL = CANDIDATE_COLS[1]


def fill_merged(cells: DataFrame, merges: DataFrame, last_row: int | None = None,
                last_col: int = LAST_FILLED_COL) -> DataFrame:
    """G1: every cell of a merged range takes the range's top-left value (even empty).

    The ranges are exploded to ``(file, sheet, row, col)`` keys, so the
    containment test is an equi-join (no nested-loop join).  Nothing reads cells
    below ``last_row`` (by default the last extracted one) or right of ``last_col``,
    so a range over whole columns is cut there; its top-left value is its own.
    """
    last_row = GridParams().last_extracted_row if last_row is None else last_row
    keys = ["file", "sheet", "row", "col"]
    merges = merges.where((F.col("min_row") <= last_row) & (F.col("min_col") <= last_col)) \
        .withColumn("max_row", F.least("max_row", F.lit(last_row))) \
        .withColumn("max_col", F.least("max_col", F.lit(last_col)))
    tl = cells.select("file", "sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"),
                      F.col("value").alias("_tl"))
    m = merges.join(tl, ["file", "sheet", "min_row", "min_col"], "left")
    covered = m.select("file", "sheet", "_tl",
                       F.explode(F.sequence("min_row", "max_row")).alias("row"),
                       F.sequence("min_col", "max_col").alias("_cols")) \
        .select("file", "sheet", "row", F.explode("_cols").alias("col"), F.col("_tl").alias("value"))
    covered = covered.select(*keys, "value").dropDuplicates(keys)
    kept = cells.join(covered.select(*keys), keys, "left_anti")
    return kept.unionByName(covered.where(F.col("value").isNotNull()))


# -- G2 -------------------------------------------------------------------------

def fixed_cells(cells: DataFrame) -> DataFrame:
    """``(file, store, block)`` from D4 and N4, normalised."""
    def at(rc):
        return F.max(F.when((F.col("row") == rc[0]) & (F.col("col") == rc[1]), F.col("value")))
    g = cells.groupBy("file").agg(at(STORE_CELL).alias("_s"), at(BLOCK_CELL).alias("_b"))
    return g.select("file", TX.normalize_text("_s").alias("store"), TX.normalize_text("_b").alias("block"))


# -- G3-G8 ----------------------------------------------------------------------

def score_columns(cells: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """G3 + G6 + A13: per file and candidate column, over rows first..first+scan-1.

    ``(file, col, match_rate, non_empty_rate, score, examples, matched_count,
    non_empty_count, total)``; the denominator is always ``scan_rows``.
    """
    lo, hi = params.candidate_cols
    if params.manual_column:
        lo = hi = column_index(params.manual_column)
    rows = cells.where(F.col("col").between(lo, hi)
                       & F.col("row").between(params.first_row, params.last_scored_row))
    nonblank = ~TX.is_blank(F.col("value"))
    matched = nonblank & TX.extract_category(F.col("value")).isNotNull()
    agg = rows.groupBy("file", "col").agg(
        F.count_if(nonblank).alias("non_empty_count"),
        F.count_if(matched).alias("matched_count"),
        F.slice(F.array_sort(F.collect_list(F.when(matched, F.struct("row", TX.strip_ws(F.col("value")).alias("v"))))),
                1, MAX_EXAMPLES).alias("_ex"))
    files = cells.select("file").distinct()
    grid = files.select("file", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("col"))
    j = grid.join(agg, ["file", "col"], "left")
    total = float(params.scan_rows)
    mc = F.coalesce(F.col("matched_count"), F.lit(0))
    nc = F.coalesce(F.col("non_empty_count"), F.lit(0))
    return j.select(
        "file", F.col("col").cast("int").alias("col"),
        (mc / F.lit(total)).alias("match_rate"),
        (nc / F.lit(total)).alias("non_empty_rate"),
        ((mc / F.lit(total)) * F.lit(MATCH_WEIGHT) + (nc / F.lit(total)) * F.lit(NON_EMPTY_WEIGHT)).alias("score"),
        F.coalesce(F.transform("_ex", lambda s: s["v"]), F.array().cast("array<string>")).alias("examples"),
        mc.cast("bigint").alias("matched_count"), nc.cast("bigint").alias("non_empty_count"),
        F.lit(params.scan_rows).cast("bigint").alias("total"))


def rank_columns(scores: DataFrame) -> DataFrame:
    """Candidates by score desc (ties: leftmost first) with their rank."""
    w = Window.partitionBy("file").orderBy(F.col("score").desc(), F.col("col").asc())
    return scores.withColumn("rank", F.row_number().over(w).cast("int"))


def best_column(scores: DataFrame) -> DataFrame:
    """The highest score per file, strict so ties go to the leftmost column."""
    return rank_columns(scores).where(F.col("rank") == 1).drop("rank")


def low_score_warnings(best: DataFrame) -> DataFrame:
    """Files whose best score is below 0.01."""
    return best.where(F.col("score") < LOW_SCORE).select("file", "col", "score")


# -- G9-G19 ---------------------------------------------------------------------

def _cells_in(lo: int, hi: int) -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("col").between(lo, hi), F.struct("col", "value"))))


def sheet_rows(cells: DataFrame, category_col: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """One row per non-empty sheet row in the extraction range with markers,
    category value and the two text cell lists (G9-G11, G15, G18)."""
    last = params.last_extracted_row
    c = cells.where(F.col("row").between(params.first_row, last)).join(
        category_col.select("file", F.col("col").alias("_catcol")), "file", "left")
    g = c.groupBy("file", "row").agg(
        F.max(F.when(F.col("col") == SUMMARY_MARKER_COL, F.col("value"))).alias("e"),
        F.max(F.when(F.col("col") == DETAIL_MARKER_COL, F.col("value"))).alias("f"),
        F.max(F.when(F.col("col") == F.col("_catcol"), F.col("value"))).alias("catv"),
        _cells_in(*SUMMARY_TEXT_COLS).alias("_st"),
        _cells_in(*DETAIL_TEXT_COLS).alias("_dt"))
    is_sum = TX.is_summary_row(F.col("e"))
    return g.select(
        "file", "row",
        is_sum.alias("is_summary"),
        (TX.is_detail_row(F.col("f")) & ~is_sum).alias("is_detail"),
        TX.extract_category(F.col("catv")).alias("cat"),
        TX.join_non_empty(F.transform("_st", lambda s: s["value"])).alias("summary_text"),
        TX.join_non_empty(F.transform("_dt", lambda s: s["value"])).alias("detail_text"))


def record_states(rows: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """G12/G13 category in force, G14 summary in force, G16 has-detail look-ahead."""
    w_run = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    w_ahead = Window.partitionBy("file").orderBy("row").rangeBetween(1, params.lookahead)
    if params.inherit_category:
        cat = F.last("cat", ignorenulls=True).over(w_run)
    else:
        # a summary resets to its own (maybe null) category; a detail only overrides
        # when it has one -- the struct keeps a null reset visible to ignorenulls.
        setter = F.when(F.col("is_summary") | (F.col("is_detail") & F.col("cat").isNotNull()),
                        F.struct(F.col("cat").alias("c")))
        cat = F.last(setter, ignorenulls=True).over(w_run)["c"]
    summary_in_force = F.coalesce(F.last(F.when(F.col("is_summary"), F.col("summary_text")),
                                         ignorenulls=True).over(w_run), F.lit(""))
    next_summary = F.min(F.when(F.col("is_summary"), F.col("row"))).over(w_ahead)
    next_detail = F.min(F.when(F.col("is_detail"), F.col("row"))).over(w_ahead)
    has_detail = next_detail.isNotNull() & (next_summary.isNull() | (next_detail < next_summary))
    return rows.select("*", cat.alias("category_in_force"), summary_in_force.alias("summary_in_force"),
                       has_detail.alias("has_detail"))


def emit_records(states: DataFrame, fixed: DataFrame, ordinals: DataFrame,
                 params: GridParams = GridParams()) -> DataFrame:
    """G17 + G19: summary rows without a following detail, and detail rows, with text.

    ``record_id = file ordinal * stride + row`` keeps (file, row) order; the stride (1000 by
    default) is over the last extracted row, so no two files share an id.
    """
    stride = 1000
    while stride <= params.last_extracted_row:
        stride *= 10
    summary_rec = F.col("is_summary") & ~F.col("has_detail") & (F.col("summary_text") != "")
    detail_rec = F.col("is_detail") & (F.col("detail_text") != "")
    r = states.where(summary_rec | detail_rec)
    r = r.join(fixed, "file", "left").join(ordinals, "file", "left")
    cat = F.col("category_in_force")
    return r.select(
        (F.col("file_no") * stride + F.col("row")).cast("bigint").alias("record_id"),
        F.col("file").alias("source_file"), F.col("row").cast("int").alias("row"),
        F.coalesce("store", F.lit("")).alias("store"), F.coalesce("block", F.lit("")).alias("block"),
        F.when(F.col("is_summary"), F.col("summary_text")).otherwise(F.col("summary_in_force")).alias("summary"),
        F.when(F.col("is_summary"), F.lit("")).otherwise(F.col("detail_text")).alias("detail"),
        F.coalesce(cat, F.lit("")).alias("category"),
        TX.category_name(cat).alias("category_name"))


def numbered(rows: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct ``rows(col)`` with their 1-based rank in order, computed without a global window.

    The values are range-sorted across partitions and checkpointed (so the
    partition boundaries cannot change between the two passes); the
    per-partition counts -- one row per partition -- give each partition's
    offset, and a value's number is that offset plus its index in the partition.
    """
    from shoal.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(rows.sparkSession)
    at = rows.select(col).orderBy(col).withColumn("_pid", F.spark_partition_id()).checkpoint()
    counts = at.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect()
    offsets, acc = {}, 0
    for r in sorted(counts, key=lambda r: r["_pid"]):
        offsets[r["_pid"]] = acc
        acc += r["_n"]
    off = F.create_map(*[x for pid, o in offsets.items() for x in (F.lit(pid), F.lit(o))]) if offsets \
        else F.create_map(F.lit(0), F.lit(0))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(col))
    return at.select(col, (F.element_at(off, F.col("_pid")) + local).cast("bigint").alias(out))


def file_ordinals(cells: DataFrame) -> DataFrame:
    """``(file, file_no)``: 1-based rank in file-name order."""
    return numbered(cells.select("file").distinct(), "file", "file_no")


def filled_sheet(cells: DataFrame, merges: DataFrame | None = None, params: GridParams = GridParams()) -> DataFrame:
    """S3 + G1: the target sheet's cells within the bounds, merges filled, written once for all consumers."""
    from shoal.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(cells.sparkSession)
    c = select_sheet(cells, params.sheet)
    if merges is not None:
        c = fill_merged(c, merges.where(F.col("sheet") == params.sheet), params.last_extracted_row,
                        max(params.candidate_cols[1], LAST_FILLED_COL,
                            column_index(params.manual_column) if params.manual_column else 0))
    return c.where(F.col("row") <= params.last_extracted_row).checkpoint()


def extract_filled(c: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """G2-G19 on a filled sheet: canonical records (with ``document_text``, P5)."""
    best = best_column(score_columns(c, params))
    states = record_states(sheet_rows(c, best, params), params)
    recs = emit_records(states, fixed_cells(c), file_ordinals(c), params)
    return recs.withColumn("document_text", TX.document_text("category_name", "summary", "detail"))


def extract_records(cells: DataFrame, merges: DataFrame | None = None,
                    params: GridParams = GridParams()) -> DataFrame:
    """S3 + G1-G19: sheet cells -> canonical records (with ``document_text``, P5)."""
    return extract_filled(filled_sheet(cells, merges, params), params)
