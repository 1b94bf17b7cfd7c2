import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shoal.llm import simhash as S
from shoal.llm.common import components
from tests.llm.fixtures import LONG, classes, edge_docs, simple_docs


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aBÉ \t\nß\x85 ", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_matches_its_definition(text):
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_of_a_long_text_is_counted_in_parts(monkeypatch):
    whole = S.fingerprint(LONG.encode())
    monkeypatch.setattr(S, "SHINGLES_AT_ONCE", 777)
    assert S.fingerprint(LONG.encode()) == whole == plain_fingerprint(LONG)


def test_links_join_exactly_the_pairs_within_the_radius(spark):
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(x)
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for bits in (0, 3, 5):
        want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i)
                                  if (fps[i] ^ fps[j]).bit_count() <= bits])
        got = [(r["a"], r["b"]) for r in S.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), bits).collect()]
        at = {f: i for i, f in enumerate(signed)}
        assert classes(len(fps), [(at[a], at[b]) for a, b in got]) == want
        assert len(got) <= 40 * len(fps)


def test_a_tile_emits_a_forest(monkeypatch):
    import numpy as np
    monkeypatch.setattr(S, "HOME_SIDE", 4)
    monkeypatch.setattr(S, "VISIT_SIDE", 8)
    fps = np.array(sorted({(1 << i) | (1 << j) for i in range(8) for j in range(8)}), np.uint64)
    forest = S._Forest()
    S._link_tile(forest, fps, fps, 3, True)
    assert len(forest.edges) == len(fps) - 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_groups_of_edge_cases(spark):
    got = S.simhash_groups(edge_docs(spark)).collect()
    assert len(got) == 14
    fp = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    empty = "0" * 16
    # null, empty and blank texts have fingerprint 0 and are one group, ids passed over where null
    assert fp[4, empty] == fp[5, empty] == fp[6, empty] == fp[None, empty] == 4
    by_id = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by_id[1] == by_id[2] == 1 and by_id[8] == 8 and by_id[9] == by_id[10] == 9
    assert S.simhash_groups(edge_docs(spark, [])).count() == 0


def test_dedup_keeps_one_row_of_each_group(spark):
    docs = edge_docs(spark)
    kept = S.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "7", "None", "8", "9", "11"])


def test_dedup_with_null_ids_and_one_id_on_two_texts(spark):
    texts = ["the first text is about ships and the sea", "the second one tells of mountains in winter",
             "a third speaks about bread, salt and wine", "a fourth is on the history of small towns"]
    docs = edge_docs(spark, [(None, texts[0], "en", "a"), (None, texts[1], "en", "a"), (None, texts[1], "en", "a"),
                             (None, texts[2], "en", "a"), (5, texts[2], "en", "a"),          # a copy with an id: this stays
                             (5, texts[3], "en", "a"), (7, texts[3].upper(), "en", "a"), (5, texts[3], "en", "a"),
                             (9, None, "en", "a"), (None, "", "en", "a")])
    fp = {i: S.fingerprint(t.encode()) for i, t in enumerate(texts)}
    assert all((fp[i] ^ fp[j]).bit_count() > S.MAX_BITS for i in fp for j in range(i))
    kept = [(r["doc_id"], r["text"]) for r in S.simhash_dedup(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (9, None)]))
    assert S.simhash_dedup(docs.limit(0)).count() == 0


def test_equal_texts_share_a_class(spark):
    got = {r["doc_id"]: r["component_id"] for r in S.simhash_groups(simple_docs(spark, ["same text here"] * 300 + ["else"])).collect()}
    assert set(got.values()) == {0, 300} and got[300] == 300
