import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shoal.llm import suffix as S
from tests.llm.fixtures import LONG, edge_docs, simple_docs


def plain(texts, length):
    """Removed runs of each text, by counting every string of ``length`` bytes."""
    n = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    return [S.joined([(i, i + length) for i in range(len(t) - length + 1) if n[t[i:i + length]] > 1]) for t in texts]


def kept(text, spans):
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2]))


@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(c % 2 for c in b)), min_size=1, max_size=30), st.integers(0, 6))
@settings(max_examples=300, deadline=None)
def test_deep_shallow_sort(strings, shallow):
    order = S.deep_shallow_sort(strings, shallow)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


def test_common_prefix():
    assert S.common(b"abcdef", b"abcxef") == 3 and S.common(b"ab", b"abc") == 2 and S.common(b"", b"a") == 0


def mixtures(rng, n):
    base = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(0, 300))) for _ in range(5)] + [b"ab " * 60, b"z" * 150]
    out = []
    for _ in range(n):
        t = b""
        for _ in range(rng.randint(0, 5)):
            s = rng.choice(base)
            i = rng.randint(0, len(s))
            t += s[i:rng.randint(i, len(s))]
            if rng.random() < 0.3:
                t += bytes([rng.choice(b"xyz")])
        out.append(t)
    return out


@pytest.mark.parametrize("length, piece", [(40, 1 << 20), (25, 37)])
def test_removed_bytes_match_brute_force(spark, monkeypatch, length, piece):
    texts = mixtures(random.Random(length), 120)
    monkeypatch.setattr(S, "PIECE", piece)
    got = {r["doc_id"]: r for r in S.remove_repeats(simple_docs(spark, [t.decode() for t in texts]), length=length).collect()}
    for i, (t, spans) in enumerate(zip(texts, plain(texts, length))):
        rest = kept(t, spans)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (
            len(t), len(t) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()), i


def test_large_groups_are_settled_window_by_window(spark, monkeypatch):
    rng = random.Random(8)
    passage = bytes(rng.choice(b"abcdefgh") for _ in range(90))
    texts = [bytes(rng.choice(b"ABCDEF") for _ in range(30)) + passage + bytes(rng.choice(b"ABCDEF") for _ in range(30))
             for _ in range(40)]
    monkeypatch.setattr(S, "MAX_GROUP", 3)
    got = {r["doc_id"]: r["n_removed"] for r in S.remove_repeats(simple_docs(spark, [t.decode() for t in texts]), length=40).collect()}
    assert got == {i: sum(b - a for a, b in s) for i, s in enumerate(plain(texts, 40))}


def test_edge_cases(spark):
    docs = edge_docs(spark)
    rows = docs.select("doc_id", "text").collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in S.remove_repeats(docs).collect())
    texts = [(r["text"] or "").encode() for r in rows]
    want = sorted((str(r["doc_id"]), len(t), sum(b - a for a, b in s)) for r, t, s in zip(rows, texts, plain(texts, 400)))
    assert got == want and max(n for _, _, n in got) == len(LONG.encode())
    assert S.remove_repeats(edge_docs(spark, [])).count() == 0
