import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.operators import evaluate as E
from shoal.operators import silhouette_tree as S


def plain(pts):
    """Euclidean silhouettes from all distances."""
    ids, xy, lab = [p[0] for p in pts], np.array([p[1:3] for p in pts], float), np.array([p[3] for p in pts])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    out = {}
    for i, name in enumerate(ids):
        same = (lab == lab[i]).sum()
        others = [d[i, lab == c].mean() for c in set(lab.tolist()) - {lab[i]}]
        a = d[i, lab == lab[i]].sum() / (same - 1) if same > 1 else None
        out[name] = 0.0 if a is None or not others or max(a, min(others)) == 0 else (min(others) - a) / max(a, min(others))
    return out


def blobs(n=900, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-40, 40, (5, 2))
    lab = rng.integers(0, 5, n)
    xy = centres[lab] + rng.normal(0, 1.5, (n, 2))
    xy[::97] *= 6                                                        # some lie far out
    return [(i, float(x), float(y), int(c) * 3) for i, ((x, y), c) in enumerate(zip(xy, lab))]


SCHEMA = "record_id long, x double, y double, cluster int"


@pytest.mark.parametrize("tolerance", [0.0, 0.02, 0.2])
def test_plain_silhouettes_lie_within_the_bound(spark, tolerance):
    pts = blobs()
    got = S.silhouette_bounds(spark.createDataFrame(pts, SCHEMA), tolerance, block_size=20).collect()
    want = plain(pts)
    assert len(got) == len(pts)
    assert all(abs(r["s"] - want[r["record_id"]]) <= r["bound"] + 1e-9 for r in got)
    bounds = np.array([r["bound"] for r in got])
    assert bounds.max() < 1e-9 if tolerance == 0 else 0 < bounds.mean() < 4 * tolerance


def test_near_blocks_do_not_grow_with_the_points():
    rng = np.random.default_rng(0)
    met = {}
    for side in (16, 64):                                                # blocks of a square grid, in the curve's order
        bits = side.bit_length() - 1
        z = np.arange(side * side)
        cx = sum(((z >> (2 * i)) & 1) << i for i in range(bits))
        cy = sum(((z >> (2 * i + 1)) & 1) << i for i in range(bits))
        leaf = np.zeros((len(z), 1, 4))
        leaf[:, 0] = np.stack([np.full(len(z), 100), cx + .5, cy + .5, np.full(len(z), 100 / 6)], 1)
        levels = S._levels(leaf)
        assert levels[-1][0, 0, 0] == 100 * len(z)
        walks = [S._walk(np.array([cx[i], cx[i] + 1, cy[i], cy[i] + 1], float), levels, 0.02) for i in rng.integers(0, len(z), 30)]
        for far, near in walks:                                          # every point is met once
            assert far[..., 0].sum() + 100 * len(near) == 100 * len(z)
        met[side] = np.mean([len(n) for _, n in walks])
    assert met[64] < 2 * met[16] and met[64] < 64 * 64 / 20


def test_heaps_noise_nulls_and_single_points(spark):
    pts = [(i, 1.0, 1.0, 0) for i in range(200)] + [(200 + i, 5.0, 1.0 + i, 1) for i in range(10)] + [(300, 9.0, 9.0, 2)]
    extra = [(400, 2.0, 2.0, -1), (401, None, 1.0, 0), (402, float("nan"), 1.0, 1)]
    got = {r["record_id"]: r for r in S.silhouette_bounds(spark.createDataFrame(pts + extra, SCHEMA), 0.01, block_size=16).collect()}
    want = plain(pts)
    assert set(got) == set(want) and got[300]["s"] == 0
    assert all(abs(got[i]["s"] - want[i]) <= got[i]["bound"] + 1e-9 for i in want)


def test_empty_and_one_cluster(spark):
    assert S.silhouette_bounds(spark.createDataFrame([], SCHEMA)).count() == 0
    one = S.silhouette_bounds(spark.createDataFrame([(i, float(i), 0.0, 4) for i in range(30)], SCHEMA), block_size=8).collect()
    assert len(one) == 30 and {r["s"] for r in one} == {0.0} and {r["bound"] for r in one} == {0.0}


def test_mean_by_the_tree_is_near_the_exact_mean(spark):
    pts = spark.createDataFrame(blobs(600, 4), SCHEMA)
    exact = E.silhouette(pts)
    value, bound = E.silhouette_within(pts, 0.02)
    assert abs(value - exact) <= bound + 1e-9 and bound < 0.1
    assert abs(E.silhouette(pts, "euclidean_tree") - exact) <= 0.1
    assert E.silhouette_within(pts.withColumn("cluster", F.lit(1))) is None
