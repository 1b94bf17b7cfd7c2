import numpy as np
import pytest

from shoal.llm import toxicity as X
from shoal.llm.common import held_out
from tests.llm.fixtures import LONG, edge_docs


def plain_grams(text):
    """The grams of a folded text, by slicing."""
    t = X.folded(text)
    return [t[i:i + n] for n in X.GRAMS for i in range(len(t) - n + 1) if b" " not in t[i + 1:i + n - 1]]


@pytest.mark.parametrize("text", [b"", b"a", b"The fool, again!", "Éa b\nccc".encode(), b"x" * 40])
def test_bags_hold_the_grams_of_words(text):
    bags = X.bags(text)
    grams = plain_grams(text)
    assert sum(int(n.sum()) for _, n in bags) == len(grams)
    assert {int(b) for bag, _ in bags for b in bag} == {
        int(x[0]) for g in set(grams) for x in [next(b for b, _ in X.grams(np.frombuffer(g, np.uint8)) if len(b) == 1)]}


def test_odds_are_the_mean_of_the_passages_odds():
    weights = np.random.default_rng(3).normal(size=X.BUCKETS).astype(np.float32)
    texts = [LONG.encode(), b"", b"some words here", None, b"a"]
    got = X.log_odds(texts, weights, 0.5)
    for t, z in zip(texts, got):
        means = [float((weights[b] * n).sum() / n.sum()) for b, n in X.bags(t)]
        want = np.log(np.mean(np.exp(means))) if means else 0.0
        assert abs(z - 0.5 - want) < 1e-3


def test_one_toxic_passage_shows_in_a_long_text():
    weights = np.zeros(X.BUCKETS, np.float32)
    for b, _ in X.bags(b"idiot"):
        weights[b] = 30
    clean = b"a kind soul walks home " * 500
    z = X.log_odds([clean, clean + b" idiot " + clean], weights, -4.0)
    assert z[0] < 0 < z[1]


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def held_out_shares(docs, labels):
    """Held-out documents, shares of toxic ones found and of others flagged, and how often a toxic one scores higher."""
    model = X.fit(docs, labels)
    got = X.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").where("held_out").collect()
    scores, flagged, toxic = (np.array([r[c] for r in got]) for c in ("score", "predicted", "toxic"))
    order = (scores[toxic == 1][:, None] > scores[toxic == 0][None, :]).mean()
    return len(got), flagged[toxic == 1].mean(), flagged[toxic == 0].mean(), order


def test_held_out_accuracy(tables):
    n, found, false, order = held_out_shares(*tables)
    assert n > 600 and found > 0.85 and false < 0.03 and order > 0.95


def test_held_out_accuracy_of_a_small_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    n, found, false, order = held_out_shares(docs, labels)
    assert n > 50 and found > 0.5 and false < 0.1 and order > 0.9


def test_sample_is_bounded_in_whole_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "idiot fool " * (5000 if i == 3 else 5)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(X, "train", lambda rows: seen.extend(rows) or X.Model(np.zeros((X.BUCKETS, X.DIM)), np.zeros(X.DIM), 0.0))
    X.fit(docs, labels, most_bytes=2000)
    learned = docs.where(~held_out("doc_id")).where("doc_id <> 3").count()
    assert len(seen) == learned and all(len(r.sizes) for r in seen)
    seen.clear()
    X.fit(docs, labels, most_bytes=1 << 20)
    total = sum(int(r.counts.sum()) for r in seen)
    assert total == sum(len(plain_grams(r["text"].encode())) for r in docs.where(~held_out("doc_id")).collect())


def test_misspellings_share_grams():
    bad, good = [b"you idiot fool", b"such an idiot", b"idiot you are"], [b"you kind soul", b"such an honour", b"friend you are"]
    rows = [X.sample(X.bags(t), y) for y, ts in ((1, bad), (0, good)) for t in ts]
    m = X.train(rows * 10, steps=300)
    z = X.log_odds([b"you idiott", b"you friendd"], m.bucket_scores(), m.b)
    assert z[0] > z[1]


def test_edge_cases(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (8, 0), (8, 1), (9, 2), (11, 0)], "doc_id bigint, toxic int")
    model = X.fit(docs, labels)
    got = X.score(docs, model).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    bias = {round(r["score"], 9) for r in got if r["doc_id"] in (4, 5, 6)}
    assert len(bias) == 1
    assert X.score(edge_docs(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = edge_docs(spark)
    none = X.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert not none.fitted and {r["predicted"] for r in X.score(docs, none).collect()} == {0}
    some = docs.where(~held_out("doc_id")).first()["doc_id"]
    one = X.fit(docs, spark.createDataFrame([(some, 1)], "doc_id bigint, toxic int"))
    assert {r["predicted"] for r in X.score(docs, one).collect()} == {1}
