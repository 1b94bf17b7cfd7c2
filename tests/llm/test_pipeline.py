"""Each stage against a brute-force version, on what the stage before kept."""
import corpus_pipeline as P
from shoal.llm import decontam, langid, mixing
from tests.conftest import SF001
from tests.llm.fixtures import classes, edge_docs
from tests.llm.test_simhash import plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "near_dedup", "decontamination", "mixture", "shards"]

    # language
    kept = P.language(spark, docs, SF001).persist()
    assert kept.columns == COLUMNS
    every = docs.orderBy("doc_id").collect()
    langs, scores = langid.predict(langid.fit(docs), [r["text"].encode() for r in every])
    close = {r["doc_id"] for r, s in zip(every, scores) if abs(s - P.MIN_LANG_SCORE) < 1e-4}
    want = {r["doc_id"] for r, x, s in zip(every, langs, scores) if x != "und" and s >= P.MIN_LANG_SCORE}
    assert {r["doc_id"] for r in kept.collect()} ^ want <= close and len(want) > 0.95 * len(every)

    # near-duplicates
    rows = kept.orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"], P.SHINGLE) for r in rows]
    group = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= P.MAX_BITS])
    single = P.near_dedup(spark, kept, SF001).persist()
    assert single.columns == COLUMNS
    assert sorted(tuple(r) for r in single.collect()) == sorted(tuple(rows[i]) for i in set(group))

    # contaminated documents
    items = [decontam.words(r["text"].encode()).tolist() for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    clean = P.decontamination(spark, single, SF001).persist()
    assert clean.columns == COLUMNS

    def holds(text):
        ids = decontam.words(text.encode()).tolist()
        return any(decontam.edit_in(p, ids, m)[0] <= m for p in items for m in [int(decontam.MAX_EDIT * len(p))])
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect() if not holds(r["text"])}

    # mixture
    mixed = P.mixture(spark, clean, SF001).persist()
    assert mixed.columns == COLUMNS
    counts = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    drawn = {r["doc_id"]: r["copies"] for r in mixing.replicate(clean).select("doc_id", "copies").distinct().collect()}
    assert counts == drawn

    # shards
    out = P.shards(spark, mixed, SF001)
    assert out.columns == [*COLUMNS, "shard"]
    got = out.collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(tuple(r) for r in mixed.collect())
    size = [sum(len(r["text"].encode()) + 1 for r in got if r["shard"] == s) for s in range(P.SHARDS)]
    of_text = {}
    for r in got:
        of_text.setdefault(r["text"], set()).add(r["shard"])
    largest = max(sum(len(t.encode()) + 1 for r in got if r["text"] == t) for t in of_text)
    assert max(size) - min(size) <= 2 * largest and all(len(s) == 1 for s in of_text.values())


def test_stages_on_edge_cases(spark):
    docs = edge_docs(spark)
    for name, stage in P.STAGES:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, SF001)
            assert [c for c in out.columns if c != "shard"] == [c for c in docs.columns if c != "shard"], name
            out.collect()


def test_run_is_the_stages_one_after_another(spark):
    out = P.run(spark, SF001)
    assert out.columns == [*COLUMNS, "shard"] and out.count() > 100
