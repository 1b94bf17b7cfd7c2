"""External-model hooks with deterministic callables: embeddings, analyser, generation."""
import numpy as np
from pyspark.sql import functions as F

from shoal.operators import features as FT
from shoal.operators import labels as L


def _hash_embedder():
    def fn(texts):
        return [np.frombuffer(np.random.default_rng(abs(hash(t)) % 2**32).bytes(32), dtype=np.float32)[:4]
                .tolist() for t in texts]
    return fn


def test_embed_one_vector_per_row(spark):
    df = spark.createDataFrame([(i, f"text {i}" if i % 3 else "  ") for i in range(20)], "record_id long, document_text string")
    out = FT.embed(df, _hash_embedder, batch_size=7)
    rows = out.collect()
    assert len(rows) == 20 and all(r["features"].size == 4 for r in rows)


def test_choose_features_falls_back_to_tfidf(spark):
    df = spark.createDataFrame([(1, "aa bb cc"), (2, "aa bb dd"), (3, "aa cc dd")], "record_id long, document_text string")
    _, kind = FT.choose_features(df, use_external=True, make_embedder=_hash_embedder, supports_embedding=False)
    assert kind.startswith("tfidf")


def test_tfidf_fallback_vocabulary(spark):
    # three distinct words, each in one document: min_df=2 prunes everything -> fallback
    df = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "record_id long, document_text string")
    m = FT.fit_tfidf(df)
    assert m.used_fallback and m.vocabulary == ["alpha", "beta", "gamma"]
    v = m.transform(df).collect()
    assert all(abs(float(np.linalg.norm(r["features"].toArray())) - 1.0) < 1e-9 for r in v)


def test_analyser_words(spark):
    df = spark.createDataFrame([(1, "研修 会 実施 AB 12 店舗")], "record_id long, document_text string")

    def tok(texts):
        return [[(w, "名詞") for w in t.split()] for t in texts]
    out = FT.analyser_words(df, lambda: tok).first()["words"]
    assert out == ["研修", "店舗"]


def test_generation_fallback_and_parse(spark):
    cards = spark.createDataFrame(
        [(1, "a・b", "d", ["x"], ["a", "b"], 2, ["x"]), (2, "クラスタ 2", "d2", ["y"], [], 1, ["y"])],
        "cluster int, label string, description string, representative_texts array<string>, "
        "frequent_words array<string>, count bigint, sample_texts array<string>")

    def gen(prompt, max_tokens):
        if "- x" in prompt:
            return "【ラベル】 新ラベル\n【特徴説明】 説明文"
        raise RuntimeError("down")
    out = {r["cluster"]: r for r in L.generated_cards(cards, lambda: gen).collect()}
    assert (out[1]["label"], out[1]["description"]) == ("新ラベル", "説明文")
    assert out[2]["label"] == "クラスタ 2"
    re = {r["cluster"]: r["label"] for r in L.relabel(cards, [1, 2], lambda: gen).collect()}
    assert re[2] == "クラスタ 2 (v2)" and re[1].startswith("【ラベル】")
    free = spark.createDataFrame([(4, "free text")], "cluster int, response string")
    lab, desc = L.parse_response(F.col("cluster"), F.col("response"))
    assert free.select(lab, desc).first()[:] == ("クラスタ 4", "free text")


def _records(spark, n, parts):
    rows = [(i, f"研修 店舗 販売 group{i % 3} word{i % 5} more{i % 7}") for i in range(n)]
    return spark.createDataFrame(rows, "record_id long, document_text string").repartition(parts)


def test_generator_runs_once_for_each_prompt(spark):
    """Whatever the number of splits, later uses of the cards call no model."""
    from shoal.operators import report as R
    from shoal.plans.pipeline import PipelineConfig, fit

    for parts in (1, 16):
        calls = spark.sparkContext.accumulator(0)

        def make(calls=calls):
            def answer(prompt, max_tokens):
                calls.add(1)
                return "【ラベル】 L\n【特徴説明】 D"
            return answer
        res = fit(_records(spark, 60, parts), PipelineConfig(k=4, restarts=1, word_pattern=r"\w+", make_generator=make))
        assert calls.value == 4
        R.report_cards(res.cards).collect()
        R.annotation_table(res.points.join(res.assignments, "record_id"), res.cards).collect()
        assert calls.value == 4 and {r["label"] for r in res.cards.collect()} == {"L"}


def test_cards_from_analyser_words(spark):
    from shoal.plans.pipeline import PipelineConfig, fit

    def make():
        return lambda texts: [[(w.upper(), "名詞") for w in t.split() if w.startswith("word")] for t in texts]
    res = fit(_records(spark, 40, 4), PipelineConfig(k=2, restarts=1, make_tokenizer=make))
    words = {w for r in res.cards.collect() for w in r["frequent_words"]}
    assert words == {f"WORD{i}" for i in range(5)}


def test_long_and_vector_fallback_agree(spark):
    df = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "record_id long, document_text string")
    assert sorted((r["term"], r["weight"]) for r in FT.tfidf_long(df).collect()) == [("alpha", 1.0), ("beta", 1.0), ("gamma", 1.0)]


def test_crosstab_counts_nulls_and_fills_zeros(spark):
    from shoal.operators import report as R
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x")], "r string, c string")
    wide = {r["r"]: (r["x"], r["null"], r["y"]) for r in R.crosstab(df, "r", "c", ["x", "null", "y"]).collect()}
    assert wide == {"a": (1, 1, 0), None: (1, 0, 0)}
    long = {(r["r"], r["c"]): r["n"] for r in R.crosstab_long(df, "r", "c", ["x", "null"]).collect()}
    assert long == {("a", "x"): 1, ("a", "null"): 1, (None, "x"): 1, (None, "null"): 0}


def test_pruned_vocabulary_is_the_whole_one(spark):
    """Counting only bigrams of frequent words changes nothing, for small and large vocabularies, ties included."""
    from shoal.operators import features as FT
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS record_id", "text AS document_text")
    toks, n = FT.tokens(docs), docs.count()
    for most in (5, 60, 400, 10 ** 6):
        for min_df in (1, 3):
            p = FT.TfidfParams(max_features=most, min_df=min_df)
            assert FT.pruned_vocabulary(toks, n, p).collect() == FT.vocabulary(FT.terms(docs), n, p).collect()


def test_crosstab_columns_add_up(spark):
    from shoal.operators import report as R
    df = spark.createDataFrame([("x", "a"), ("x", None), ("y", "q"), ("y", "b"), ("y", "z")], "r string, c string")
    got = {r["r"]: r.asDict() for r in R.crosstab(df, "r", "c", ["a", "b", R.NULL_COLUMN], rest=True).collect()}
    assert got["y"] == {"r": "y", "a": 0, "b": 1, R.NULL_COLUMN: 0, R.OTHER_COLUMN: 2, "total": 3}
    assert all(sum(v for k, v in r.items() if k not in ("r", "total")) == r["total"] for r in got.values())


def test_fit_with_density_and_neighbour_layout(spark):
    from shoal.plans.pipeline import PipelineConfig, fit
    words = ["apple pear plum cherry", "engine wheel brake clutch", "river lake ocean stream"]
    rows = [(i, " ".join([words[i % 3]] * 3) + f" extra{i % 7} note{i % 5}") for i in range(60)]
    records = spark.createDataFrame(rows, "record_id long, document_text string")
    res = fit(records, PipelineConfig(use_density=True, layout="neighbours", word_pattern=r"\p{L}+", restarts=2))
    stats = res.run_stats.first()
    assert res.layout == "neighbours" and stats["method"] == "hdbscan" and res.points.count() == 60
    assert stats["n_clusters"] >= 2 and res.cards.count() >= stats["n_clusters"]
