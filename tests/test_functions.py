"""Scalar goldens (FIXTURES §4) for the Column functions."""
from pyspark.sql import functions as F

from shoal.functions import text as T


def _eval(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_summary_marker(spark):
    vals = ["1.", " １２． ", "　1.", "1", "1.0", "(1)", None]
    assert _eval(spark, vals, T.is_summary_row) == [True, True, True, False, False, False, False]


def test_detail_marker(spark):
    vals = ["(1)", "（２）", "(3）", "1)", "(a)", None]
    assert _eval(spark, vals, T.is_detail_row) == [True, True, True, False, False, False]


def test_extract_category(spark):
    vals = ["【a】x", " C ", "e", "F", "A x", "【F】", "", None, "　【b】"]
    assert _eval(spark, vals, T.extract_category) == ["A", "C", "E", None, None, None, None, None, "B"]


def test_category_name(spark):
    assert _eval(spark, ["A", None, "Z", "e"], T.category_name) == ["使命", "未分類", "未分類", "コストコントロール"]


def test_join_non_empty(spark):
    df = spark.createDataFrame([(["a", None, " a ", "b  c", ""],)], "arr array<string>")
    assert df.select(T.join_non_empty("arr")).first()[0] == "a b c"


def test_normalize_text(spark):
    assert _eval(spark, [" x\n\n y ", None, "　a\x1cb "], T.normalize_text) == ["x y", "", "a b"]


def test_truncations(spark):
    s101, s100 = "x" * 101, "y" * 100
    assert _eval(spark, [s101, s100], lambda c: T.truncate_text(c, 100)) == ["x" * 97 + "...", s100]
    assert _eval(spark, [s101, None, ""], lambda c: T.hover_truncate(c, 100)) == ["x" * 100 + "...", "", ""]
    assert _eval(spark, ["x" * 300], lambda c: T.clip(c, 200)) == ["x" * 200]


def test_normalize_number(spark):
    assert _eval(spark, ["１２a"], T.normalize_number) == ["12a"]


def test_document_text(spark):
    df = spark.createDataFrame([("c", "s", " d "), ("c", "s", " "), ("c", "", "")], "c string, s string, d string")
    got = [r[0] for r in df.select(T.document_text("c", "s", "d")).collect()]
    assert got == ["d", "s", "c"]


def test_blank_to_space(spark):
    assert _eval(spark, ["", " 　", "a"], T.blank_to_space) == [" ", " ", "a"]


def test_cjk_runs(spark):
    assert _eval(spark, ["センター研修"], T.cjk_runs) == [["センタ", "研修"]]


def test_word_tokens(spark):
    assert _eval(spark, ["Hello, a wörld_x 42!"], T.word_tokens) == [["hello", "wörld_x", "42"]]
