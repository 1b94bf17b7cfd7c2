"""Plan guards: no cross joins or row-at-a-time Python in the registered queries;
filters and projections reach the Parquet scan."""
import pytest

from shoal.plans.queries import QUERIES
from tests.conftest import SF01

# queries that run models or user callables (their plans are checked elsewhere)
RUNS_MODELS = {"m1_pca2", "m3_kmeans", "m7_fit", "m8_run_stats", "l6_generate_batch", "l7_parse_response",
               "l8_relabel", "m4c_min_span_forest"}


def _plan(spark, name):
    return QUERIES[name](spark, SF01)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_MODELS))
def test_no_cross_join_or_row_udf(spark, name):
    p = _plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in p, f"{name}: {bad}"


def test_pushdown_and_pruning(spark):
    p = _plan(spark, "f1_filter_stores")
    assert "PushedFilters: [In(source" in p or "In(source" in p
    assert "ReadSchema: struct<doc_id:bigint,quality:int>" in p


def test_top_k_per_group_is_a_group_limit(spark):
    assert "WindowGroupLimit" in _plan(spark, "w1_top_words")


def test_terms_are_counted_without_sorting_them(spark):
    """A row's terms are not sorted; repeated and null ids are rows like others, rows without terms count nothing."""
    from shoal.operators import features as FT
    rows = [(1, ["b", "a", "b"]), (1, ["a"]), (None, ["b"]), (None, []), (2, ["a b", "a", "a"])]
    got = FT.term_stats(spark.createDataFrame(rows, "record_id long, terms array<string>"))
    assert {tuple(r) for r in got.collect()} == {("a", 3, 4), ("b", 2, 3), ("a b", 1, 1)}
    assert "sort_array" not in got._jdf.queryExecution().optimizedPlan().toString()
