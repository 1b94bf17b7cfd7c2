import math

from shoal.llm import mixing as M
from tests.llm.fixtures import edge_docs


def docs_of(spark, sizes):
    rows = [(f"{s}{i}" if s else None, s) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id bigint, text string, source string")


def test_sources_reach_their_weights(spark):
    docs = docs_of(spark, {"a": 6000, "b": 300, "c": 100})
    got = {r["src"]: r["n"] for r in M.replicate(docs, {"a": 1, "b": 2, "c": 1}, target_rows=8000)
           .groupBy("src").count().withColumnRenamed("count", "n").collect()}
    for s, want in {"a": 2000, "b": 4000, "c": 2000}.items():
        assert abs(got[s] - want) < 6 * math.sqrt(want)


def test_counts_are_poisson(spark):
    docs = docs_of(spark, {"a": 20_000})
    n = M.replicate(docs, target_rows=30_000).groupBy("doc_id").count().groupBy("count").count().toDF("k", "n").collect()
    for r in n:
        want = 20_000 * math.exp(-1.5) * 1.5 ** r["k"] / math.factorial(r["k"])
        assert abs(r["n"] - want) < 6 * math.sqrt(want) + 3


def test_a_large_mean_is_drawn_in_parts(spark):
    docs = docs_of(spark, {"a": 50, "b": 1000})
    got = [r["n"] for r in M.replicate(docs, {"a": 1}, target_rows=50 * 300).groupBy("doc_id").count().toDF("d", "n").collect()]
    assert len(got) == 50 and all(200 < n < 400 for n in got) and abs(sum(got) / 50 - 300) < 12


def test_draws_do_not_depend_on_other_rows_or_partitions(spark):
    docs = docs_of(spark, {"a": 500})
    one = sorted(map(tuple, M.replicate(docs, target_rows=500).select("doc_id", "copy", "place").collect()))
    two = sorted(map(tuple, M.replicate(docs.repartition(7), target_rows=500).select("doc_id", "copy", "place").collect()))
    assert one == two


def test_sources_without_a_broadcast(spark, monkeypatch):
    docs = docs_of(spark, {"a": 200, "b": 100, None: 50})
    want = sorted(map(tuple, M.replicate(docs).select("doc_id", "copy").collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, M.replicate(docs).select("doc_id", "copy").collect())) == want


def test_edge_cases(spark):
    docs = edge_docs(spark)
    out = M.mix(docs, target_rows=200)
    assert out.columns == docs.columns
    rows = out.collect()
    # each of the four sources, null among them, weighs the same
    by = {}
    for r in rows:
        by[r["source"]] = by.get(r["source"], 0) + 1
    assert set(by) == {"a", "b", "c", None} and all(n > 10 for n in by.values())
    assert {str(r["doc_id"]) for r in rows} >= {"3", "None"}
    assert M.mix(edge_docs(spark, [])).count() == 0
    assert M.mix(docs, {"b": 1.0}).where("source <> 'b' or source is null").count() == 0
