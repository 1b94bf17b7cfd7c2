import hashlib
import random

from shoal.llm import exact as E
from tests.llm.fixtures import edge_docs, simple_docs


def plain(rows):
    """(doc_id, keep_id, group size, digest) by equality of whole texts."""
    norm = [(i, t or "", "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")) for i, t in rows]
    groups = {}
    for i, t, s in norm:
        groups.setdefault(s, []).append((-len(t), i is None, i or 0, i))
    return sorted((str(i), str(min(groups[s], key=lambda x: x[:3])[3]), len(groups[s]), hashlib.sha256(s.encode()).hexdigest())
                  for i, _, s in norm)


def check(docs, rows, **kw):
    got = E.exact_dedup(docs, **kw).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == plain(rows)
    digests = [r["text_sha256"] for r in got if r["kept"]]
    assert len(digests) == len(set(digests)) == len({r["text_sha256"] for r in got})


def test_edge_cases(spark):
    docs = edge_docs(spark)
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert E.exact_dedup(edge_docs(spark, [])).count() == 0


def test_small_blocks_against_plain_equality(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 14))) for _ in range(150)] + ["ab" * 40, "ab" * 40 + "a"]
    check(simple_docs(spark, texts), list(enumerate(texts)), block=2)


def test_frequent_blocks_are_named_apart(spark, monkeypatch):
    monkeypatch.setattr(E, "HEAVY_ROWS", 3)
    texts = ["abcdef"] * 30 + ["abcdxx"] * 20 + [f"t{i}" for i in range(30)]
    check(simple_docs(spark, texts), list(enumerate(texts)), block=2)


def test_names_are_equal_only_for_equal_keys(spark):
    rows = spark.createDataFrame([(i, f"k{i % 50}") for i in range(400)], "id int, k string")
    got = E.assign_names(rows, ["k"], 400, buckets=3).collect()
    assert len(got) == 400
    assert len({(r["k"], r["name"]) for r in got}) == len({r["name"] for r in got}) == 50


def test_main_path_is_native(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(E, "materialise", lambda df, tag, **k: seen.append(df._jdf.queryExecution().toString()) or df.checkpoint())
    E.exact_dedup(simple_docs(spark, ["a", "b"])).collect()
    assert seen and not any(w in p for p in seen for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
