"""Edge goldens for the record state machine (FIXTURES §5), built as cells."""
from shoal.operators import grid as G

SHEET = G.TARGET_SHEET


def _records(spark, cells, merges=(), params=G.GridParams()):
    c = spark.createDataFrame([("f.xlsx", SHEET, r, col, v) for r, col, v in cells],
                              "file string, sheet string, row int, col int, value string")
    m = spark.createDataFrame([("f.xlsx", SHEET, *mm) for mm in merges],
                              "file string, sheet string, min_row int, min_col int, max_row int, max_col int")
    return G.extract_records(c, m, params).orderBy("row").collect()


def test_summary_without_detail(spark):
    recs = _records(spark, [(7, 5, "1."), (7, 6, "only summary"), (8, 5, "2."), (8, 6, "next"), (9, 6, "(1)"),
                            (9, 7, "d")])
    assert [(r["row"], r["summary"], r["detail"]) for r in recs] == [(7, "only summary", ""), (9, "next", "d")]


def test_summary_with_textless_detail_gives_nothing(spark):
    recs = _records(spark, [(7, 5, "1."), (7, 6, "s"), (8, 6, "(1)")])
    assert recs == []


def test_lookahead_horizon(spark):
    near = _records(spark, [(7, 5, "1."), (7, 6, "s"), (56, 6, "(1)"), (56, 7, "d")])
    assert [(r["row"], r["detail"]) for r in near] == [(56, "d")]
    far = _records(spark, [(7, 5, "1."), (7, 6, "s"), (57, 6, "(1)"), (57, 7, "d")])
    assert [(r["row"], r["summary"], r["detail"]) for r in far] == [(7, "s", ""), (57, "s", "d")]


def test_detail_before_summary(spark):
    recs = _records(spark, [(7, 6, "(1)"), (7, 7, "d")])
    assert [(r["summary"], r["detail"]) for r in recs] == [("", "d")]


def test_inherit_category(spark):
    cells = [(7, 18, "【B】"), (8, 5, "1."), (8, 6, "s"), (9, 6, "(1)"), (9, 7, "d")]
    on = _records(spark, cells)
    assert [(r["category"], r["category_name"]) for r in on] == [("B", "利益")]
    off = _records(spark, cells, params=G.GridParams(inherit_category=False))
    assert [(r["category"], r["category_name"]) for r in off] == [("", "未分類")]


def test_vertical_merge_in_marker_column(spark):
    recs = _records(spark, [(7, 5, "1."), (7, 6, "a"), (8, 6, "b"), (9, 6, "c")], merges=[(7, 5, 9, 5)])
    assert [(r["row"], r["summary"]) for r in recs] == [(7, "a"), (8, "b"), (9, "c")]


def test_row_bounds(spark):
    recs = _records(spark, [(207, 6, "(1)"), (207, 7, "in"), (208, 6, "(2)"), (208, 7, "out")])
    assert [r["detail"] for r in recs] == ["in"]


def test_column_ties_and_no_category(spark):
    c = spark.createDataFrame([("f", SHEET, 7, 17, "A"), ("f", SHEET, 7, 19, "b")],
                              "file string, sheet string, row int, col int, value string")
    best = G.best_column(G.score_columns(c)).first()
    assert best["col"] == 17
    c2 = spark.createDataFrame([("g", SHEET, 7, 5, "x")], "file string, sheet string, row int, col int, value string")
    b2 = G.best_column(G.score_columns(c2)).first()
    assert (b2["col"], b2["score"]) == (16, 0.0)
    assert G.low_score_warnings(G.best_column(G.score_columns(c2))).count() == 1


def test_column_letters():
    assert G.column_index("R") == 18 and G.column_index("AA") == 27
