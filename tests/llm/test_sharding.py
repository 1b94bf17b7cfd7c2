import random
import zlib

from shoal.llm import sharding as K
from tests.llm.fixtures import edge_docs


def docs_of(spark, n, hot=0):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randint(0, 400), rng.choice(["en", "de", None]), f"s{rng.randrange(5)}") for i in range(n)]
    rows += [(n + i, "hot text", "en", "s0") for i in range(hot)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), rows


def test_shards_are_near_equal_and_slots_gapless(spark):
    docs, rows = docs_of(spark, 2000)
    got = K.kd_shard(docs, n_shards=16).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2000))
    text = {i: t for i, t, *_ in rows}
    size, slots, of_text = {}, {}, {}
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        of_text.setdefault(raw, set()).add(r["shard"])
    assert set(size) == set(range(16))
    assert max(size.values()) - min(size.values()) <= 2 * 401 + 0.02 * sum(size.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_a_group_over_a_shard_goes_in_pieces(spark):
    docs, rows = docs_of(spark, 300, hot=20_000)
    got = K.kd_shard(docs, n_shards=4).collect()
    size = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert len(got) == 20_300 and max(size) <= 1.6 * min(size)


def test_target_bytes_decides_the_number_of_leaves(spark):
    docs, rows = docs_of(spark, 400)
    total = sum(len(t) + 1 for _, t, *_ in rows)
    got = K.kd_shard(docs, target_bytes=total // 5 + 1)
    assert {r["shard"] for r in got.select("shard").distinct().collect()} == set(range(5))


def test_edge_cases(spark):
    docs = edge_docs(spark)
    got = K.kd_shard(docs, n_shards=3)
    assert got.count() == docs.count() and got.where("shard not between 0 and 2").count() == 0
    wide = K.shard_documents(docs, 3)
    assert wide.count() == docs.count() and wide.schema["shard"].dataType.simpleString() == "int"
    assert wide.drop("shard").columns == [c for c in docs.columns if c != "shard"]
    assert K.kd_shard(edge_docs(spark, []), n_shards=4).count() == 0
    assert K.shard_documents(edge_docs(spark, []), 4).count() == 0


def test_main_path_is_native(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(K, "materialise", lambda df, tag, **k: seen.append(df._jdf.queryExecution().toString()) or df.checkpoint())
    K.kd_shard(docs_of(spark, 50)[0], n_shards=4).collect()
    assert seen and not any(w in p for p in seen for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
