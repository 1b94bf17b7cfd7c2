import math
import zlib
from collections import Counter

import numpy as np
import pytest

from shoal.llm import lm as L
from tests.conftest import SF01, SF001
from tests.llm.fixtures import LONG, edge_docs


@pytest.fixture(scope="module")
def enc():
    with open(L.VOCABULARY, "rb") as f:
        return L.subwords(f.read())


def toy(enc, seed=1):
    counts = np.random.default_rng(seed).integers(0, 50, enc.size)
    return L._setting(counts, enc.end)


def test_gradients():
    m = L._setting(np.random.default_rng(0).integers(0, 50, 5000), 4999)
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y, c = rng.integers(0, L.INPUTS, (3, L.WINDOW)), rng.integers(0, L.SLOTS, (3, L.STEP)), rng.random((3, L.STEP)) < 0.8
    _, g = L._gradients(p, x, y, c)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        p[k][at] += 1e-5
        up = L._gradients(p, x, y, c)[0]
        p[k][at] -= 2e-5
        down = L._gradients(p, x, y, c)[0]
        p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_probabilities_of_all_subwords_sum_to_one(enc):
    m = toy(enc)
    h = np.random.default_rng(3).normal(size=(1, L.DIM)).astype(np.float32)
    every = np.arange(enc.size)
    logs = L._log_p(m.p, np.repeat(h, enc.size, 0), m.slot[every]) / math.log(10) + m.tail
    assert abs((10.0 ** logs).sum() - 1) < 1e-3


def plain(m, ids, start, end):
    """Each place on its own: its window, one query, no batches."""
    p, total = {k: v.astype(np.float64) for k, v in m.p.items()}, 0.0
    before = [start] * (L.WINDOW - L.STEP) + [end] + list(ids[:-1])
    for t, target in enumerate(ids):
        first = t // L.STEP * L.STEP
        x = before[first:t + L.WINDOW - L.STEP + 1]
        h = p["E"][m.source[x]] + p["P"][:len(x)]
        a = h[-1] @ p["A"] @ h.T / math.sqrt(L.DIM)
        a = np.exp(a - a.max())
        r = h[-1] + (a / a.sum()) @ h @ p["V"]
        r = r + np.maximum(r @ p["W"] + p["w"], 0) @ p["U"]
        slot = m.slot[target]
        for z, k in ((r @ p["C"] + p["c"], slot // L.MEMBERS),
                     (r @ p["M"][slot // L.MEMBERS] + p["m"][slot // L.MEMBERS], slot % L.MEMBERS)):
            total += (z[k] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10)
        total += m.tail[target]
    return total


def test_windows_score_each_subword_once(enc):
    m = toy(enc)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, enc.size, n).tolist() + [enc.end] for n in (0, 1, L.STEP - 1, L.STEP, L.WINDOW, 500, 3)]
    got = L.log10_p(m, np.concatenate(texts).astype(np.int64), np.array([len(t) for t in texts]), enc.start, enc.end)
    for t, s in zip(texts, got):
        assert abs(plain(m, t, enc.start, enc.end) - s) < 1e-3 * len(t)
    assert L.log10_p(m, np.zeros(0, np.int64), np.zeros(0, np.int64), enc.start, enc.end).tolist() == []


def test_later_subwords_do_not_change_earlier_scores(enc):
    m = toy(enc)
    rng = np.random.default_rng(5)
    x = m.source[rng.integers(0, enc.size, (1, L.WINDOW))]
    y = x.copy()
    y[0, -1] = (y[0, -1] + 1) % L.INPUTS
    a, b = L._hidden(m.p, x), L._hidden(m.p, y)
    assert np.array_equal(a[:-1], b[:-1]) and not np.array_equal(a[-1], b[-1])


def test_subwords_spell_the_words(enc):
    import base64
    with open(L.VOCABULARY, "rb") as f:
        back = {int(n): base64.b64decode(t) for t, n in map(bytes.split, f.read().splitlines())}
    for t in ("", "Hello, World! it's 2024", "日本語 テキスト ünïcode", "x" * 1000 + " 12345678901234567890", "a b"):
        words = L.words_of(t.encode())
        ids = enc.of_words(words)
        assert ids[-1] == enc.end and b"".join(back[i] for i in ids[:-1]) == b"".join(b" " + w for w in words)


def test_model_learns_what_follows_what():
    m = L._setting(np.random.default_rng(0).integers(1, 9, 300), 299)
    rng = np.random.default_rng(4)
    deal = rng.permutation(200)
    seq = np.zeros((600, L.WINDOW + 1), np.int64)
    seq[:, 0] = rng.integers(0, 200, 600)
    for t in range(L.WINDOW):
        seq[:, t + 1] = deal[seq[:, t]]
    losses = L.train(m, seq[:, :-1], seq[:, L.WINDOW - L.STEP + 1:], np.ones((600, L.STEP), bool), steps=400)
    assert min(losses) < 0.4 * losses[0]


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    return {r["doc_id"]: r["text"] for r in docs.collect()}, L.score(docs, L.fit(docs, steps=50)).collect()


def test_baseline_is_that_of_plain_counts(small):
    texts, got = small
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in [*L.words_of(t.encode()), "end"])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for r in got:
        tokens = [*L.words_of(texts[r["doc_id"]].encode()), "end"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)) < 1e-6 * len(tokens)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) and r["score"] < 0


def test_infrequent_words_are_joined(spark, small, monkeypatch):
    """With no word frequent, all counts come from the join: the same baseline."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    monkeypatch.setattr(L, "FREQUENT", 0)
    t = L.fit(docs, steps=1)
    assert not t.frequent
    want = {r["doc_id"]: (r["n_known"], round(r["base_score"], 5)) for r in small[1]}
    assert {r["doc_id"]: (r["n_known"], round(r["base_score"], 5)) for r in L.score(docs, t).collect()} == want


def test_held_out_texts_score_above_counts_of_their_subwords(spark, enc):
    """Per subword, well above the subwords' shares in the training texts."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    t = L.fit(docs)
    got = {r["doc_id"]: r["score"] for r in L.score(docs, t).where("held_out").collect()}
    texts = {r["doc_id"]: enc.of_words(L.words_of((r["text"] or "").encode())) for r in docs.collect()}
    counts = np.full(enc.size, 0.5)
    for i, ids in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts += np.bincount(ids, minlength=enc.size)
    logs = np.log10(counts / counts.sum())
    plain = sum(logs[texts[i]].sum() for i in got)
    places = sum(len(texts[i]) for i in got)
    assert (sum(got.values()) - plain) / places > 0.4


def test_edge_cases(spark):
    docs = edge_docs(spark)
    t = L.fit(docs, steps=5)
    got = L.score(docs, t).collect()
    assert len(got) == docs.count()
    empty = {(r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in got if r["doc_id"] in (4, 5, 6)}
    assert len(empty) == 1 and next(iter(empty))[0] == 1
    assert next(r["n_tokens"] for r in got if r["doc_id"] == 9) == len(LONG.split()) + 1
    assert all(r["held_out"] for r in got if r["doc_id"] is None) and all(math.isfinite(r["score"]) for r in got)
    assert L.score(edge_docs(spark, []), t).count() == 0


def test_nothing_to_learn_from(spark):
    t = L.fit(edge_docs(spark, []))
    assert (t.tokens, t.distinct, t.losses) == (0, 0, [])
    got = L.score(edge_docs(spark), t).collect()
    assert {r["base_score"] for r in got} == {0.0} and {r["n_known"] for r in got} == {0}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_words_of_all_texts():
    import pyarrow as pa
    texts = [b" A b\tC ", None, b"", b"   ", "Ü x\x0by\x0c É日本\r\n".encode(), b"\xff\xfe Q", b"a a a"]
    words, number = L.all_words(pa.array(texts, pa.binary()))
    assert words.to_pylist() == [w for t in texts for w in L.words_of(t)]
    assert number.tolist() == [len(L.words_of(t)) for t in texts]


def test_learns_from_every_window_of_every_training_document(spark, enc, monkeypatch):
    """However few windows training starts from: all are learned from, and what only other documents teach is known."""
    monkeypatch.setattr(L, "TRAIN_WINDOWS", 40)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    follow = dict(zip(words, rng.permutation(words)))

    def text():
        out = [str(rng.choice(words))]
        while len(out) < 300:
            out.append(follow[out[-1]])
        return " ".join(out)
    rows = [(i, text()) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    t = L.fit(docs, steps=20)
    want = sum(-(-len(enc.of_words(L.words_of(x.encode()))) // L.STEP) for i, x in rows if zlib.crc32(str(i).encode()) % 10)
    assert t.windows == want
    monkeypatch.setattr(L, "learn", lambda *a: 0)
    begun = L.fit(docs, steps=20)
    a, b = ({r["doc_id"]: r["score"] for r in L.score(docs, x).where("held_out").collect()} for x in (t, begun))
    assert sum(a.values()) > 0.99 * sum(b.values())


def test_words_encoded_in_one_call_are_those_encoded_one_by_one(enc):
    import pyarrow as pa
    texts = [b"", b"  ", None, "Ü é日本\u0085x   end".encode(), b"\xff\xfe a\xe2\x82 b " + b"x" * 200 + b" q", b"z" * 65, b"a b a " + b"y" * 300]
    for some in (texts, texts[:3], texts[5:6], []):
        words, number = L.all_words(pa.array(some, pa.binary()))
        words = words.dictionary_encode()
        got = enc.of_texts(words.dictionary, words.indices.to_numpy(), number)
        want = [enc.of_words(L.words_of(t)) for t in some]
        for a, b in ((got, want), (got.slice(1), want[1:])):
            ids, size = L.unpacked(a, enc.size)
            assert (ids.tolist(), size.tolist()) == ([i for x in b for i in x], [len(x) for x in b])


def test_texts_are_encoded_once(spark, enc, monkeypatch):
    """Training and scoring read the ids that one pass over the texts wrote."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    calls, encode = [], L.encode
    monkeypatch.setattr(L, "encode", lambda *a: calls.append(1) or encode(*a))
    monkeypatch.setattr(L, "documents", lambda *a: docs)
    steps = L.fit.__defaults__
    monkeypatch.setattr(L.fit, "__defaults__", (*steps[:-1], 20))
    got = {r["doc_id"]: r["score"] for r in L.op12_lm_scoring(spark, "").collect()}
    assert len(calls) == 1 and len(got) == docs.count() and all(s < 0 for s in got.values())
    t = L.fit(docs, steps=5)
    want = {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in L.score(docs, t).collect()}
    assert {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in L.score_rows(t.rows, t).collect()} == want
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in t.rows.collect():
        assert np.frombuffer(r["ids"], np.uint16).tolist() == enc.of_words(L.words_of((texts[r["doc_id"]] or "").encode()))
