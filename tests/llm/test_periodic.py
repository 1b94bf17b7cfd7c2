import hashlib
import time
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shoal.llm import periodic as P
from tests.conftest import SF001
from tests.llm.fixtures import LONG, edge_docs, simple_docs


def plain(ids):
    """Runs from the definition: maximal stretches for each lag, kept if no smaller lag holds all over them."""
    n, out = len(ids), []
    for q in range(1, n // P.REPEATS + 1):
        i = q
        while i < n:
            if ids[i] != ids[i - q]:
                i += 1
                continue
            a = i - q
            while i < n and ids[i] == ids[i - q]:
                i += 1
            if i - a >= max(P.MIN_LENGTH, P.REPEATS * q) and not any(
                    all(ids[t] == ids[t - d] for t in range(a + d, i)) for d in range(1, q)):
                out.append((a, i - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=9),
       st.integers(1, 12), st.lists(st.integers(0, 3), max_size=12), st.integers(0, 8))
def test_runs_are_those_of_the_definition(head, word, times, tail, cut):
    ids = np.array(head + word * times + word[:cut] + tail + head, np.int64)
    assert P.runs_of(ids) == plain(ids.tolist())


def test_runs_of_random_words():
    rng = np.random.default_rng(4)
    for _ in range(1500):
        ids = rng.integers(0, rng.integers(1, 4), rng.integers(0, 60))
        assert P.runs_of(ids) == plain(ids.tolist())


def test_long_and_nested_runs_take_few_steps():
    began = time.process_time()
    assert P.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    unit = np.r_[np.zeros(50, int), 1, 2]
    got = P.runs_of(np.tile(unit, 2000))
    assert got[:2] == [(0, 50, 1), (0, 104_000, 52)] and len(got) == 2001
    odd = P.runs_of(np.concatenate([np.r_[np.zeros(50, int), i] for i in range(1, 3000)]))
    assert len(odd) == 2999 and {r[1:] for r in odd} == {(50, 1)}
    assert time.process_time() - began < 30


def test_collapse_keeps_one_period():
    words = b"x a b a b a b a b y z z z z z z".split()
    runs = P.runs_of(P.numbers(words))
    assert runs == [(1, 8, 2), (10, 6, 1)] and P.collapse(words, runs) == b"x a b y z".split()


def test_repeated_tail_follows_its_rule():
    text = b" ".join(b"w%d" % i for i in range(97))
    for i in [*range(200), None, -5]:
        words, got = text.split(), P.repeated_tail(i, text)
        h = zlib.crc32(b"" if i is None else str(i).encode())
        if h % 10:
            assert got == words
            continue
        a, p = h // 10 % 97, 0
        p = 1 + (97 - a) // (3 + h // 10 % 8)
        assert got == [words[k] if k < a else words[a + (k - a) % p] for k in range(97)]


def wanted(doc_id, text):
    """The contract's columns by brute force."""
    words = P.repeated_tail(doc_id, (text or "").encode())
    seen = {}
    runs = plain([seen.setdefault(w, len(seen)) for w in words])
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_is_that_of_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = P.op11_periodic_runs(spark, SF001).collect()
    assert len(got) == len(texts)
    short = [r for r in got if len(texts[r["doc_id"]].split()) <= 400]
    assert len(short) > 100 and any(r["n_runs"] for r in short)
    for r in short:
        assert tuple(r[c] for c in COLUMNS) == wanted(r["doc_id"], texts[r["doc_id"]])


def test_edge_cases(spark):
    docs = edge_docs(spark)
    got = P.periodic_runs(docs).collect()
    assert len(got) == docs.count()
    assert {(r["n_words"], tuple(r["runs"]), r["collapsed"]) for r in got if r["doc_id"] in (4, 5, 6)} == {(0, (), "")}
    assert next(r["collapsed"] for r in got if r["doc_id"] == 9) == LONG
    assert sum(r["collapsed"] == "a repeated row" for r in got) == 2
    assert P.periodic_runs(edge_docs(spark, [])).count() == 0


def test_digests_of_a_document_without_runs_are_not_null(spark, tmp_path):
    simple_docs(spark, [None, "", "one two", "ha " * 9]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in P.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert {i: tuple(r[c] for c in COLUMNS) for i, r in rows.items()} == {
        i: wanted(i, t) for i, t in enumerate([None, "", "one two", "ha " * 9])}
