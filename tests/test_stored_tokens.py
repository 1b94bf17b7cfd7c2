"""Tokens that are read several times lie in a written table, not in the executors' memory."""
from shoal.operators import features as FT

ROWS = [(1, "Alpha beta\n alpha"), (2, "  "), (3, None), (None, "beta gamma_1 x"), (1, "beta alpha beta"), (5, "été 12 été")]
SCHEMA = "record_id long, document_text string"


def kept(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_no_tokens_are_cached_while_a_vocabulary_is_counted(spark, monkeypatch):
    df, before, seen = spark.createDataFrame(ROWS, SCHEMA), kept(spark), []
    real = FT.pruned_vocabulary
    monkeypatch.setattr(FT, "pruned_vocabulary", lambda toks, *a: seen.append((kept(spark) - before, toks)) or real(toks, *a))
    vocab, dfs, n, fallback = FT.fit_vocabulary(df)
    assert [more for more, _ in seen] == [0]
    assert "Scan parquet" in seen[0][1]._jdf.queryExecution().executedPlan().toString()
    assert (dict(zip(vocab, dfs)), n, fallback) == ({"alpha": 2, "beta": 3, "alpha beta": 2, "beta alpha": 2}, 6, False)

    def rows(d):
        return sorted((repr(r["record_id"]), r["_tok"]) for r in d.collect())
    assert rows(seen[0][1]) == rows(FT.tokens(df)) and (repr(2), []) in rows(seen[0][1])


def test_the_fitted_frame_is_vectorised_from_its_stored_tokens(spark):
    df, again = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(ROWS, SCHEMA)
    model = FT.fit_tfidf(df)
    mine, other = model.transform(df), model.transform(again)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (mine, other, model.transform(df, keep=("document_text",)))]
    assert [p.count("regexp_extract_all") for p in plans][0] == 0 and all("regexp_extract_all" in p for p in plans[1:])

    def rows(d):
        return sorted((repr(r["record_id"]), r["features"].toArray().tolist()) for r in d.collect())
    assert rows(mine) == rows(other) and len(rows(mine)) == len(ROWS)
