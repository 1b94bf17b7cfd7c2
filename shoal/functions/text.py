"""Scalar Column expressions over text cells and record fields.

All of these are JVM-side expressions (regexp / string / array functions),
so they stay inside whole-stage code generation; no Python UDF is involved.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must match the reference's behaviour.
#
# Whitespace as Python's str.isspace() sees it (used by its \s, split and
# strip): TAB LF VT FF CR, FS GS RS US (0x1c-0x1f), SPACE, NEL (0x85),
# NBSP (0xa0), OGHAM SPACE MARK (0x1680), EN QUAD..HAIR SPACE (0x2000-0x200a),
# LINE SEP (0x2028), PARA SEP (0x2029), NARROW NBSP (0x202f),
# MEDIUM MATH SPACE (0x205f), IDEOGRAPHIC SPACE (0x3000).
WS_CLASS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The same characters one by one.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
            + "\u2028\u2029\u202f\u205f\u3000")
# Summary marker (column E): digits, ASCII or full-width, then a dot.
SUMMARY_MARKER = r"^WS*[0-9０-９]+[.．]WS*$".replace("WS", WS_CLASS)
# Detail marker (column F): digits in ASCII or full-width parentheses.
DETAIL_MARKER = r"^WS*[(（][0-9０-９]+[)）]WS*$".replace("WS", WS_CLASS)
# Category cell: 【A】..【E】 prefix (any case) or the bare letter.
CATEGORY_BRACKET = r"^【([A-Ea-e])】"
CATEGORY_LETTER = r"^[A-Ea-e]$"
# Category letter -> name, and the name for a missing or unknown letter.
CATEGORY_NAMES = {
    "A": "使命",
    "B": "利益",
    "C": "能力開発",
    "D": "実現力",
    "E": "コストコントロール",
}
UNCATEGORISED = "未分類"
# Japanese fallback word pattern: runs of kanji, hiragana and katakana
# (the long-vowel mark and the iteration mark are outside these ranges).
CJK_RUN = r"[一-龥ぁ-んァ-ン]+"
# Vectoriser token: a maximal run of two or more word characters.
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"
FULLWIDTH_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"
ELLIPSIS = "..."
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace (from the ends: a pattern would try every space of the text)."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


NON_WS_CLASS = "[^" + WS_CLASS[1:]


def is_blank(c) -> Column:
    """True for null or whitespace-only text (stops at the first non-space character)."""
    return F.coalesce(~_col(c).rlike(NON_WS_CLASS), F.lit(True))


def normalize_text(c) -> Column:
    """Null -> '', every whitespace run (newlines included) -> one space, strip."""
    collapsed = F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"{WS_CLASS}+", " ")
    return F.trim(collapsed)


def truncate_text(c, max_length: int = 100) -> Column:
    """Keep at most ``max_length`` characters, the last three being '...'."""
    t = _col(c)
    return (F.when(F.length(t) <= max_length, t)
            .otherwise(F.concat(F.substring(t, 1, max_length - 3), F.lit(ELLIPSIS))))


def hover_truncate(c, max_length: int = 100) -> Column:
    """null/empty -> ''; longer text -> first ``max_length`` chars + '...'."""
    t = _col(c)
    return (F.when(t.isNull() | (t == ""), F.lit(""))
            .when(F.length(t) > max_length,
                  F.concat(F.substring(t, 1, max_length), F.lit(ELLIPSIS)))
            .otherwise(t))


def normalize_number(c) -> Column:
    """Full-width digits -> ASCII digits."""
    return F.translate(_col(c), FULLWIDTH_DIGITS, ASCII_DIGITS)


def document_text(category_name, summary, detail) -> Column:
    """P5: stripped detail, else stripped summary, else the category name."""
    d, s = strip_ws(F.coalesce(_col(detail), F.lit(""))), strip_ws(F.coalesce(_col(summary), F.lit("")))
    return (F.when(d != "", d).when(s != "", s).otherwise(_col(category_name)))


def blank_to_space(c) -> Column:
    """A blank document becomes a single space before vectorising."""
    t = _col(c)
    return F.when(is_blank(t), F.lit(" ")).otherwise(t)


def clip(c, n: int = 200) -> Column:
    """First ``n`` characters, no ellipsis."""
    return F.substring(_col(c), 1, n)


def is_summary_row(c) -> Column:
    """Marker ``1.`` / ``１２．`` in the E cell; null -> false."""
    return F.coalesce(_col(c).rlike(SUMMARY_MARKER), F.lit(False))


def is_detail_row(c) -> Column:
    """Marker ``(1)`` / ``（２）`` in the F cell; null -> false."""
    return F.coalesce(_col(c).rlike(DETAIL_MARKER), F.lit(False))


def extract_category(c) -> Column:
    """【A】-prefixed or bare A-E (any case) -> upper-case letter, else null."""
    v = strip_ws(_col(c))
    bracket = F.nullif(F.upper(F.regexp_extract(v, CATEGORY_BRACKET, 1)), F.lit(""))
    bare = F.when(v.rlike(CATEGORY_LETTER), F.upper(v))
    return F.coalesce(bracket, bare)


def category_name(c, names: dict | None = None) -> Column:
    """Letter -> category name; null or unknown -> 未分類."""
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable((names or CATEGORY_NAMES).items())])
    return F.coalesce(F.element_at(mapping, F.upper(_col(c))), F.lit(UNCATEGORISED))


def join_non_empty(arr) -> Column:
    """Normalise each cell, drop blanks, drop repeats (first kept), join by space."""
    normed = F.transform(_col(arr), lambda x: normalize_text(x))
    return F.array_join(F.array_distinct(F.filter(normed, lambda x: x != "")), " ")


def cjk_runs(c, pattern: str = CJK_RUN) -> Column:
    """The fallback word runs of a text (pattern is a parameter)."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(pattern), 0)


def word_tokens(c) -> Column:
    """Lower-cased runs of two or more word characters, in text order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(WORD_TOKEN), 0)
