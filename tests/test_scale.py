"""What lets queries grow: hash tables instead of sorts, one look at a block's components, few copies of vectors."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shoal.functions import text as TX
from shoal.operators import features as FT
from shoal.operators import labels as L
from shoal.operators import neighbors as NB
from shoal.operators import spanning as SP


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_without_sorting_occurrences(spark):
    rows = [(None, 0, "bb aa"), (-5, 0, "cc aa"), (-5, 0, "aa dd aa"), (9, 0, "dd bb"), (2 ** 62, 1, "x yy"), (-(2 ** 63), 1, "yy zz")]
    df = spark.createDataFrame(rows, "record_id long, cluster int, document_text string")
    counts = L.word_counts(df, pattern=r"\p{L}+", stopwords=[])
    assert "SortAggregate" not in plan(counts)
    got = {(r["cluster"], r["word"]): (r["n"], r["first"]["order"], r["first"]["pos"]) for r in counts.collect()}
    assert got == {(0, "aa"): (4, None, 1), (0, "bb"): (2, None, 0), (0, "cc"): (1, -5, 0), (0, "dd"): (2, -5, 1),
                   (1, "yy"): (2, -(2 ** 63), 0), (1, "zz"): (1, -(2 ** 63), 1)}
    named = L.word_counts(df.withColumn("record_id", F.col("record_id").cast("string")), pattern=r"\p{L}+", stopwords=[])
    assert named.where("word = 'aa'").first()["n"] == 4


def test_strip_looks_at_the_ends_only(spark):
    ends = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    texts = ["", ends, f"{ends}a{ends}b{ends}", "a\n", "​a", f"é{ends}", "a" + " " * 50 + "b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", TX.strip_ws("t").alias("s"))
    assert "regexp" not in plan(df)
    assert {r["i"]: r["s"] for r in df.collect()} == {i: t if t is None else t.strip() for i, t in enumerate(texts)}


def test_terms_are_sorted_natively(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["b"])], "record_id long, terms array<string>")
    stats = FT.term_stats(df)
    assert "array_sort" not in plan(stats)
    assert {tuple(r) for r in stats.collect()} == {("a", 1, 1), ("b", 2, 3)}


class Shared:
    def __init__(self, value):
        self.value = value


def test_a_block_asks_for_all_its_components_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 1, (2, 300))
    block = pd.DataFrame({"block": 0, "record_id": np.arange(300), "x": x, "y": y, "core": rng.uniform(0, 0.2, 300), "lb": 0.0,
                          "comp": np.arange(300) // 2, "home": 0})
    low = np.stack(np.meshgrid(np.arange(-4, 5), np.arange(-4, 5)), -1).reshape(-1, 2).astype(float)
    low = np.concatenate([[[0, 0]], low[(low != 0).any(1)]])
    boxes = np.column_stack([np.arange(81), low[:, 0], low[:, 0] + 1, low[:, 1], low[:, 1] + 1, np.full(81, 0.05), np.full(81, 0.3)])
    whole, filled = np.arange(81) % 5 == 1, np.arange(81)
    bounds = pd.DataFrame({"of_block": 0, "of_comp": np.arange(150), "u": rng.uniform(0, 0.6, 150)})
    calls = []
    real = SP.box_distance
    monkeypatch.setattr(SP, "box_distance", lambda *a: calls.append(1) or real(*a))
    got = SP._visits(Shared((boxes, whole, filled)))(block, bounds)
    want = set()
    for r in block.itertuples():
        u = bounds["u"][r.comp]
        for t, x0, x1, y0, y1, c0, _ in boxes[1:]:
            d = np.hypot(max(x0 - r.x, r.x - x1, 0), max(y0 - r.y, r.y - y1, 0))
            if r.core <= u and c0 <= u and d <= u and not (whole[int(t)] and filled[int(t)] == r.comp):
                want.add((int(t), r.record_id))
    assert {(t, i) for t, i in zip(got["target"], got["record_id"])} == want and want
    assert len(calls) == 1


def test_blocks_are_not_put_in_one_task(spark):
    df = spark.range(100).select((F.col("id") % 20).alias("block"), "id")
    out = SP.by_block(df, 20, "block").groupBy("block").applyInPandas(lambda g: g.assign(n=len(g)), "block long, id long, n long")
    assert out.rdd.getNumPartitions() == 20 and {r["n"] for r in out.collect()} == {5}


def test_vectors_are_copied_few_times(spark):
    assert NB._sides(2000, 64, 2048) == 1 and NB._sides(100_000, 64, 2048) == NB._sides(700_000, 64, 2048) == NB.SIDES
    assert NB._sides(10_000_000, 64, 2048) == 153
    rng = np.random.default_rng(1)
    d = rng.integers(0, 6, (40, 30)).astype(float)
    d[3, 4:] = np.nan
    d[4] = np.inf
    for k in (1, 5, 30, 40):
        rows, cols = NB._least(d, k)
        want = np.argsort(d, axis=1, kind="stable")[:, :k]
        n = np.isfinite(np.take_along_axis(d, want, 1))
        ok = np.isfinite(d[rows, cols])
        assert list(zip(rows[ok], cols[ok])) == [(i, c) for i in range(40) for c, f in zip(want[i], n[i]) if f]


def test_every_pair_of_vector_blocks_meets(spark):
    v = np.random.default_rng(2).normal(size=(400, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "record_id long, v array<double>")
    near = NB.knn(df, 5, vector_col="v", metric="cosine", include_self=False, block_size=40)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    assert {(r["record_id"], r["rank"]): r["neighbor_id"] for r in near.collect()} == {
        (i, k + 1): int(j) for i in range(400) for k, j in enumerate(np.argsort(d[i])[:5])}


def test_relabel_reads_the_texts_once(spark):
    from shoal.plans.queries import QUERIES
    from tests.conftest import SF001
    assert "parquet" not in QUERIES["l8_relabel"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert QUERIES["l8_relabel"](spark, SF001).count() == 11
