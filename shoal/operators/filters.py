"""Record filters and their option lists (F1-F8, F10; F9 lives with the word counts).

All filters are one conjunctive ``Column`` predicate, so Catalyst pushes the
parts that touch source columns down to the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The document-type choices as the reference's UI names them.
DOC_TYPE_LABELS = {"両方": "both", "概要のみ": "summary_only", "詳細のみ": "detail_only"}
# ---------------------------------------------------------------------------


@dataclass
class FilterSpec:
    """Filter state: empty lists mean no filter on that column."""

    stores: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    blocks: list[str] = field(default_factory=list)
    doc_type: str = "both"


def filter_in(col: str, values: list[str]) -> Column:
    """``col IN values``; an empty list keeps everything."""
    return F.col(col).isin(list(values)) if values else F.lit(True)


def doc_type_predicate(doc_type: str, detail_col: str = "detail") -> Column:
    """summary-only = empty detail, detail-only = non-empty detail, else all."""
    kind = DOC_TYPE_LABELS.get(doc_type, doc_type)
    if kind == "summary_only":
        return F.col(detail_col) == ""
    if kind == "detail_only":
        return F.col(detail_col) != ""
    return F.lit(True)


def filter_predicate(spec: FilterSpec) -> Column:
    return (filter_in("store", spec.stores) & filter_in("category_name", spec.categories)
            & filter_in("block", spec.blocks) & doc_type_predicate(spec.doc_type))


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """the AND of F1-F4."""
    return df.where(filter_predicate(spec))


def filter_report(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """F5 report: ``(kept, total)`` in one conditional aggregate (one pass)."""
    return df.agg(F.count_if(filter_predicate(spec)).alias("kept"), F.count(F.lit(1)).alias("total"))


def filter_options(df: DataFrame, col: str) -> DataFrame:
    """the distinct values of ``col`` (sort with ``orderBy`` when displaying)."""
    return df.select(F.col(col).alias("value")).distinct()


def drop_noise(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """keep clustered rows (label >= 0)."""
    return df.where(F.col(cluster_col) >= 0)


def cluster_members(df: DataFrame, cluster_id: int, cluster_col: str = "cluster") -> DataFrame:
    """F8: rows of one cluster (for all clusters at once, group by the cluster instead)."""
    return df.where(F.col(cluster_col) == cluster_id)


def analyser_word_ok(word: Column, stopwords: list[str], min_length: int = 2) -> Column:
    """F9 (analyser path): length, stopword, not all digits, not all ASCII letters."""
    return ((F.length(word) >= min_length) & ~word.isin(stopwords)
            & ~word.rlike(r"^\p{Nd}+$") & ~word.rlike(r"^[a-zA-Z]+$"))


class TooFewRecords(ValueError):
    pass


def require_min_rows(df: DataFrame, n: int = 3) -> None:
    """refuse to cluster fewer than ``n`` documents (reads at most ``n`` rows)."""
    got = df.limit(n).count()
    if got == 0:
        raise TooFewRecords("no records to cluster")
    if got < n:
        raise TooFewRecords(f"clustering needs at least {n} records, got {got}")


def require_nonempty(df: DataFrame, message: str) -> DataFrame:
    """Fail with an explanatory message when no record came out."""
    if df.isEmpty():
        raise TooFewRecords(message)
    return df
