"""The registered queries over whole tables: against DuckDB where SQL can express them, else by brute force."""
import hashlib
import zlib

import pytest

from shoal.llm import decontam, langid
from shoal.llm.queries import ORACLE, QUERIES
from tests.compare import compare, duck_connect
from tests.conftest import SF001, SF01
from tests.llm.fixtures import classes
from tests.llm.test_pii import plain as plain_spans
from tests.llm.test_simhash import plain_fingerprint
from tests.llm.test_suffix import kept, plain as plain_repeats


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF01)


def rows(spark, name):
    return QUERIES[name](spark, SF001).collect()


def test_one_query_for_each_operator():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF01), con, ORACLE[name])
    assert ok, msg


def test_op1(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op1_simhash")}
    ids = sorted(docs)
    fps = [plain_fingerprint(docs[i]["text"]) for i in ids]
    want = classes(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert {i: (got[i]["fingerprint"], got[i]["component_id"]) for i in got} == {
        i: (f"{fps[k]:016x}", ids[want[k]]) for k, i in enumerate(ids)}


def test_op3(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op3_language_id")}
    assert set(got) == set(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    langs = {r["lang"] for r in docs.values()}
    assert all(r["lang_pred"] in langs | {"und"} and 0 <= r["score"] <= 1 for r in got.values())
    assert all((r["lang_pred"] == "und") == (not langid.has_letter(docs[i]["text"].encode())) for i, r in got.items())


def test_op4(spark, docs):
    for r in rows(spark, "op4_pii"):
        want = plain_spans(docs[r["doc_id"]]["text"])
        listed = [f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in want[k]]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(v) for v in want.values()]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(","))


def test_op5(spark, docs):
    items = {r["item_id"]: decontam.words(r["text"].encode()).tolist()
             for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()}
    want = set()
    for i, d in docs.items():
        text = decontam.words(d["text"].encode()).tolist()
        for k, p in items.items():
            most = int(decontam.MAX_EDIT * len(p))
            dist, _ = decontam.edit_in(p, text, most)
            if dist <= most:
                want.add((i, k, dist))
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in rows(spark, "op5_decontamination")}
    assert got <= want and len(got) >= 0.9 * len(want) and {x for x in want if x[2] == 0} <= got


def test_op8(spark, docs):
    got = rows(spark, "op8_toxicity")
    assert {r["doc_id"] for r in got} == set(docs)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_op9(spark, docs):
    ids = sorted(docs)
    texts = [docs[i]["text"].encode() for i in ids]
    got = {r["doc_id"]: r for r in rows(spark, "op9_suffix_dedup")}
    for i, t, spans in zip(ids, texts, plain_repeats(texts, 400)):
        rest = kept(t, spans)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (
            len(t), len(t) - len(rest), len(spans), hashlib.sha256(rest).hexdigest())


def test_op10(spark, docs):
    got = rows(spark, "op10_kd_sharding")
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    of_text, slots, size = {}, {}, dict.fromkeys(range(16), 0)
    for r in got:
        raw = docs[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        of_text.setdefault(raw, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in of_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(len(t) + 1 for t in of_text)
