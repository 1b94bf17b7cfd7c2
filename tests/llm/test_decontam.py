import random
import string

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shoal.llm import decontam as D
from tests.llm.fixtures import edge_docs, simple_docs


def plain_distance(pattern, text):
    """The smallest edit distance of the pattern to any run of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=20), st.integers(0, 12))
@settings(max_examples=400, deadline=None)
def test_edit_distance_is_exact(pattern, text, most):
    want = plain_distance(pattern, text)
    got, end = D.edit_in(pattern, text, most)
    assert got == min(want, most + 1)
    if want <= most:
        assert want == min(plain_distance(pattern, text[k:end]) for k in range(end + 1))


def corpus(seed, n_items=60, n_docs=400, changes=0.0):
    """Items, and documents of which half hold an item with a share of its words changed."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 7))) for _ in range(800)]
    weights = [1 / (i + 1) for i in range(800)]
    say = lambda k: rng.choices(vocabulary, weights, k=k)
    items = [say(rng.choice([6, 9, 14, 15, 30, 60])) for _ in range(n_items)]
    docs, truth = [], set()
    for d in range(n_docs):
        words = say(rng.randint(0, 120))
        if d % 2:
            i = rng.randrange(n_items)
            copy = list(items[i])
            for k in rng.sample(range(len(copy)), int(changes * len(copy))):
                if (kind := rng.randrange(3)) == 0:
                    copy[k] = "changed" + str(k)
                elif kind == 1:
                    copy[k] = copy[k] + " added"
                else:
                    copy[k] = ""
            at = rng.randint(0, len(words))
            words[at:at] = copy
            truth.add((d, i))
        docs.append(", ".join(w for w in words if w).upper())
    return [" ".join(i) for i in items], docs, truth


def test_exact_copies_are_all_found_and_nothing_else():
    items, docs, truth = corpus(1)
    index = D.Index([(i, t.encode()) for i, t in enumerate(items)])
    got = {(d, k): dist for d, k, dist, _ in D.find(index, [t.encode() for t in docs])}
    assert truth <= set(got) and all(got[x] == 0 for x in truth)
    ids = [D.words(t.encode()).tolist() for t in docs]
    pats = [D.words(t.encode()).tolist() for t in items]
    for (d, k), dist in got.items():                          # every match is exact
        assert dist == plain_distance(pats[k], ids[d]) <= int(D.MAX_EDIT * len(pats[k]))


def test_recall_of_edited_copies_against_brute_force():
    items, docs, _ = corpus(2, changes=D.DESIGN_EDIT)
    index = D.Index([(i, t.encode()) for i, t in enumerate(items)])
    got = {(d, k) for d, k, _, _ in D.find(index, [t.encode() for t in docs])}
    ids = [D.words(t.encode()).tolist() for t in docs]
    want = {(d, k) for k, t in enumerate(items) for d in range(len(docs)) if len(p := D.words(t.encode()).tolist())
            and D.edit_in(p, ids[d], int(D.MAX_EDIT * len(p)))[0] <= int(D.MAX_EDIT * len(p))}
    assert got <= want and len(got) >= 0.9 * len(want)


def edited(rng, words, edits):
    """A copy with just so many edits, spread evenly: the worst case for windows."""
    at = {int((i + 0.5) * len(words) / edits) for i in range(edits)}
    out = []
    for i, w in enumerate(words):
        kind = rng.randrange(3) if i in at else None
        out += [w] if kind is None else [f"changed{i}"] if kind == 0 else [w, f"added{i}"] if kind == 1 else []
    return out


def test_recall_at_the_largest_distance_for_every_item_length():
    rng = random.Random(5)
    for n in [*range(1, 41), 59, 60, 97, 200]:
        items = [[f"w{rng.randrange(3000)}" for _ in range(n)] for _ in range(40)]
        fill = lambda: [f"w{rng.randrange(3000)}" for _ in range(rng.randint(0, 30))]
        docs = [[*fill(), *edited(rng, i, int(D.MAX_EDIT * n)), *fill()] for i in items]
        index = D.Index([(i, " ".join(w).encode()) for i, w in enumerate(items)])
        got = {(d, k): dist for d, k, dist, _ in D.find(index, [" ".join(w).encode() for w in docs])}
        ids = [D.words(" ".join(w).encode()).tolist() for w in docs]
        want = {(d, k): dist for k, p in enumerate(index.words) for d in range(len(docs))
                if (dist := D.edit_in(p.tolist(), ids[d], int(D.MAX_EDIT * n))[0]) <= int(D.MAX_EDIT * n)}
        assert all((i, i) in want for i in range(len(items))) and got == want, n


def test_a_window_has_one_key_wherever_it_stands():
    ids = np.random.default_rng(0).integers(1, 50, 200).astype(np.uint32)
    shape = D.Shape(12, 4)
    one = D.keys(ids, np.arange(100), np.full(100, 200), shape, 1)
    two = D.keys(np.concatenate([ids[:7], ids]), np.arange(100) + 7, np.full(100, 207), shape, 1)
    assert (one == two).all()


def test_matches_and_filter(spark):
    items, docs, truth = corpus(3, n_items=20, n_docs=80)
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id bigint, text string, doc_id string")
    frame = simple_docs(spark, docs)
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(frame, bench).collect()}
    assert truth <= got
    left = {r["doc_id"] for r in D.decontaminate(frame, bench).collect()}
    assert left == set(range(80)) - {d for d, _ in got}


def test_items_in_several_blocks_give_the_same(spark, monkeypatch):
    items, docs, _ = corpus(4, n_items=20, n_docs=60)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    frame = simple_docs(spark, docs)
    want = sorted(map(tuple, D.matches(frame, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 700)
    assert sorted(map(tuple, D.matches(frame, bench).collect())) == want
    monkeypatch.setattr(D, "WORDS_AT_ONCE", 100)
    assert sorted(map(tuple, D.matches(frame, bench).collect())) == want


def test_edge_cases(spark):
    docs = edge_docs(spark)
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "a repeated row"), (4, "!!!")],
                                  "item_id bigint, text string")
    got = sorted(str((r["doc_id"], r["item_id"])) for r in D.matches(docs, bench).collect())
    assert got == sorted(["(1, 1)", "(2, 1)", "(8, None)", "(8, None)"])
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert D.matches(edge_docs(spark, []), bench).count() == 0
    assert D.matches(docs, bench.limit(0)).count() == 0 and D.decontaminate(docs, bench.limit(0)).count() == docs.count()
