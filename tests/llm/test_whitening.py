import numpy as np
import pyarrow as pa
import pytest

from shoal.llm import whitening as W
from tests.conftest import SF01

CLASH = ["n", "d", "low", "high", "whitened", "component", "at", "i", "v", "_v", "_k0"]


def plain(vectors):
    """Numbers, deviations, variances and the covariance, in Python integers and numpy."""
    x = [[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for v in vectors]
    n = len(x)
    s = [sum(col) for col in zip(*x)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    c = np.array([[float(n * a - b) / n for a, b in zip(row, s)] for row in x])
    return x, dev, c


@pytest.mark.parametrize("wide", [1, 7, 16, 17, 40, 62])
def test_popcounts_give_the_sums_of_products(wide):
    rng = np.random.default_rng(wide)
    x = rng.integers(0, 1 << wide, size=(333, 4), dtype=np.int64)
    x[:, 2] = 1
    bits = [max(1, int(c.max()).bit_length()) for c in x.T]
    total, cross = W.scatter(x.view(np.uint64), bits)
    part = [(d, W.LIMB * p) for d, many in enumerate(bits) for p in range(-(-many // W.LIMB))]
    cut = [[(int(v) >> p) % (1 << W.LIMB) for v in x[:, d]] for d, p in part]
    assert total.tolist() == [sum(c) for c in cut]
    for i in range(len(part)):
        assert cross[i, i:].tolist() == [sum(a * b for a, b in zip(cut[i], cut[j])) for j in range(i, len(part))]


def test_usable_rows_of_a_batch():
    col = pa.array([[1.0, 2.0], None, [], [3.0, None], [float("inf"), 1.0], [float("nan"), 1.0], [5.0], [7.0, 8.0]], pa.list_(pa.float64()))
    assert {m.shape[1]: (rows.tolist(), m.tolist()) for rows, m in W.usable(col)} == {
        1: ([6], [[5.0]]), 2: ([0, 7], [[1.0, 2.0], [7.0, 8.0]])}
    part = col.slice(1)
    assert [(rows.tolist(), m.tolist()) for rows, m in W.usable(part, 2)] == [([6], [[7.0, 8.0]])]


def test_query_is_that_of_plain_integers(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()}
    got = W.op13_whitening(spark, SF01).toPandas()
    ids = sorted(rows)
    _, dev, c = plain([rows[i] for i in ids])
    n = len(ids)
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    assert len(got) == 32 * n and set(got["n"]) == {n} and got["component"].max() == 32
    assert got[got["component"] == 1].set_index("vec_id")["deviation"].loc[ids].tolist() == dev
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = c @ axes / np.sqrt(values)
    want *= np.sign((w * want).sum(0))                        # either sign
    assert np.abs(w - want).max() < 1e-8
    share = got[got["vec_id"] == ids[0]].sort_values("component")["explained"].to_numpy()
    assert np.allclose(share, values / np.trace(c.T @ c / n), rtol=1e-10)
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9 and set(got["identity_error"]) == {got["identity_error"][0]}
    assert abs(got["identity_error"][0] - np.abs(w.T @ w / n - np.outer(w.mean(0), w.mean(0)) - np.eye(32)).max()) < 1e-9


def vectors(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(i, v, *["clash"] * len(CLASH)) for i, v in rows],
                                 f"vec_id bigint, embedding {kind}, " + ", ".join(f"`{c}` string" for c in CLASH))


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    some = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("-inf")] * 3),
           (55, [1.0, 2.0]), (None, [0.5, 0.25, 1.0]), (56, [9.0, 9.0, 9.0]), (56, [9.0, 9.0, 9.0])]
    got = W.components_of(vectors(spark, some + odd)).toPandas()
    good = [v for _, v in some] + [v for i, v in odd if i is None or i == 56]
    _, dev, _ = plain(good)
    assert len(got) == 3 * len(good) and set(got["n"]) == {len(good)} and got["vec_id"].isna().sum() == 3
    assert sorted(got[got["component"] == 2]["deviation"].tolist()) == sorted(dev)
    assert abs(got[got["vec_id"] == 0]["explained"].sum() - 1) < 1e-12 and got["identity_error"].max() < 1e-12
    for rows in ([], odd[:5], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):     # nothing usable, or no variance
        assert W.components_of(vectors(spark, rows)).count() == 0


def test_flat_and_far_dimensions(spark):
    flat = W.components_of(vectors(spark, [(i, [float(i % 3), 1.0, float(i)]) for i in range(10)], "array<float>"))
    assert flat.count() == 20                                 # the middle one has no variance
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.5, 3.0]), (4, [0.25, 7.0])]
    far = {r["vec_id"]: r for r in W.components_of(vectors(spark, rows)).collect()}
    assert far[1]["deviation"] is None and far[3]["deviation"] is not None and far[3]["identity_error"] < 1e-9


def test_same_result_however_the_rows_are_dealt(spark):
    rows = spark.read.parquet(f"{SF01}/embeddings.parquet")
    one, many = W.fit(rows.coalesce(1)), W.fit(rows.repartition(7))
    assert (one.sums, one.low, one.n) == (many.sums, many.low, many.n) and (one.values == many.values).all()
