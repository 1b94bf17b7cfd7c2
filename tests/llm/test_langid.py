import numpy as np
import pytest

from shoal.llm import langid as L
from shoal.llm.common import held_out
from tests.conftest import SF01
from tests.llm.fixtures import LONG, edge_docs


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(f"{SF01}/documents.parquet"))


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    m = L.Model(["a", "b", "c"], [rng.normal(size=(256, 9)) for _ in "fb"], [rng.normal(size=(3, 9)) for _ in "fb"],
                rng.normal(size=(6, 3)), rng.normal(size=3))
    lanes, lens, target = rng.integers(0, 6, (4, 7)).astype(np.uint8), np.array([7, 5, 7, 1]), np.array([0, 1, 2, 1])
    params = [*m.W, *m.U, m.O, m.o]

    # in double precision, so that differences are exact enough
    def probs():
        n = 3
        out = []
        for side in (0, 1):
            h, states = np.zeros((4, n)), [None] * 7
            for k in range(7) if side == 0 else range(6, -1, -1):
                x, a = m.W[side][lanes[:, k]], h @ m.U[side]
                s = lambda v: v / (1 + np.abs(v))
                g = 0.5 + 0.5 * s(x[:, :6] + a[:, :6])
                c = s(x[:, 6:] + g[:, 3:] * a[:, 6:])
                h = g[:, :3] * h + (1 - g[:, :3]) * c
                states[k] = h
            out.append(np.stack(states))
        z = out[0] @ m.O[:n] + out[1] @ m.O[n:] + m.o
        p = np.exp(z - z.max(2, keepdims=True))
        return p / p.sum(2, keepdims=True)

    def loss():
        p = probs()[:, np.arange(4), target]
        return -(np.log(p) * (np.arange(7)[:, None] < lens)).sum() / lens.sum()

    single = L.Model(m.langs, [w.astype(np.float32) for w in m.W], [u.astype(np.float32) for u in m.U],
                     m.O.astype(np.float32), m.o.astype(np.float32))
    grads = L._gradients(single, lanes, lens, target)
    for p, g in zip(params, grads):
        for at in {tuple(rng.integers(0, s) for s in p.shape) for _ in range(12)}:
            if p.shape[0] == 256:
                at = (int(lanes.ravel()[at[0] % 28]), at[1])
            old, eps = p[at], 1e-5
            p[at] = old + eps
            up = loss()
            p[at] = old - eps
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-3


def test_every_byte_is_labelled_and_pooled(model):
    texts = [LONG.encode(), b"", b"short", "über".encode()]
    p = L.pooled(model, texts)
    lanes, lens, owner = L.segments(texts)
    every = L.label_positions(model, lanes)
    assert every.shape == (len(lanes), L.SEGMENT, len(model.langs)) and np.allclose(every.sum(2), 1, atol=1e-4)
    for i, t in enumerate(texts):
        rows = [every[k, :lens[k]] for k in np.flatnonzero(owner == i)]
        want = np.concatenate(rows).sum(0, dtype=float) / max(1, len(t))
        assert np.allclose(p[i], want, atol=1e-4)
    assert np.allclose(p[0], L.pooled(model, texts[:1])[0], atol=1e-5)          # neighbours don't matter


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_training_rows_are_labelled_and_not_held_out(spark):
    docs = edge_docs(spark)
    rows = L.training_rows(docs, per_lang=3)
    texts = {(r["text"] or "").encode() for r in docs.where(~held_out("doc_id") & docs.lang.isNotNull()).collect()}
    assert rows and all(any(w in t for t in texts) and len(w) <= L.SEGMENT for w, _ in rows)
    assert max(sum(lang == x for _, lang in rows) for x in ("en", "de")) <= 3


def test_edge_cases(spark, model):
    docs = edge_docs(spark)
    got = L.identify(docs, model).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i in (4, 5, 6, 7):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[3]["lang_pred"] == "de" and by[9]["lang_pred"] != "und"
    kept = L.keep_known(docs, model, 0.3)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, None, 8, 9, 10, 11}
    assert L.identify(edge_docs(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = edge_docs(spark, [(1, "some text", None, "a"), (2, None, "en", "a")])
    m = L.fit(docs)
    assert m.langs == [] and {r["lang_pred"] for r in L.identify(docs, m).collect()} == {"und"}
    one = L.train([(b"only one", "xx")])
    assert L.predict(one, [b"abc", b"12"]) == (["xx", "und"], [1.0, 0.0])
