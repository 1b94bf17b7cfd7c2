"""The neighbour graph, its layout, and the choice between layouts."""
import math

import numpy as np
import pytest

from shoal.operators import layout as LY
from shoal.operators import neighbors as NB
from shoal.operators import reduce as RD


def groups(seed=1, many=8, each=30, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(many, dims)) * 2
    return np.concatenate([c + rng.normal(size=(each, dims)) * 0.5 for c in centres])


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(groups())], "record_id long, v array<double>")


@pytest.fixture(scope="module")
def near(spark, points):
    return NB.knn(points, 9, vector_col="v", metric="cosine", include_self=False).cache()


@pytest.fixture(scope="module")
def start(spark, points):
    from pyspark.ml.functions import array_to_vector
    return RD.pca2(points.select("record_id", array_to_vector("v").alias("features"))).checkpoint()


def test_scales_solve_their_equation():
    rng = np.random.default_rng(0)
    d = np.sort(rng.uniform(0.1, 2, (50, 14)), 1)
    rho, scale = LY.local_scales(d, 15)
    total = np.exp(-np.maximum(d - rho[:, None], 0) / scale[:, None]).sum(1)
    assert np.abs(total - math.log2(15)).max() < 1e-9 and (rho == d[:, 0]).all()
    same = np.full((3, 14), 0.5)                              # no scale reaches the sum: the least one stays
    assert np.allclose(LY.local_scales(same, 15)[1], LY.LEAST_SCALE * 14 * 0.5 / 15)
    few = np.array([[0.0, 0.0, np.inf], [np.inf, np.inf, np.inf]])
    assert np.isfinite(LY.local_scales(few, 4)[0]).all()


def test_graph_is_the_union_of_both_directions(near):
    rows = near.collect()
    of = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        of.setdefault(r["record_id"], []).append((r["neighbor_id"], r["dist"]))
    d = np.array([[x for _, x in of[i]] for i in sorted(of)])
    rho, scale = LY.local_scales(d, 10)
    w = {(i, j): math.exp(-max(x - rho[i], 0) / scale[i]) for i in of for j, x in of[i]}
    want = {}
    for i, j in w:
        p, q = w.get((i, j), 0), w.get((j, i), 0)
        want[min(i, j), max(i, j)] = p + q - p * q
    got = {(r["a"], r["b"]): r["w"] for r in LY.fuzzy_graph(near, 10).collect()}
    assert got == pytest.approx(want)


def test_curve_of_the_least_distance():
    a, b = LY.curve(0.1)
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.01


def test_layout_keeps_neighbours_better_than_pca(near, start):
    graph = LY.fuzzy_graph(near, 10).checkpoint()
    moved = LY.layout_epochs(graph, start)
    assert moved.count() == start.count()
    before, after = LY.preservation(near, start, 9), LY.preservation(near, moved, 9)
    assert after > before + 0.05 and after > 0.3
    blocks = LY.layout_epochs(graph, start, block_size=60)    # several blocks, positions exchanged between turns
    assert LY.preservation(near, blocks, 9) > before + 0.05


def test_layout_is_the_same_for_any_partitioning(spark, near, start):
    graph = LY.fuzzy_graph(near, 10).checkpoint()
    got = []
    for n in (1, 5):
        pts = LY.layout_epochs(graph.repartition(n), start.repartition(n), epochs=40, block_size=100)
        got.append({r["record_id"]: (r["x"], r["y"]) for r in pts.collect()})
    assert got[0] == got[1]


def test_points_without_edges_stay(spark, start):
    none = spark.createDataFrame([], "a long, b long, w double")
    assert LY.layout_epochs(none, start, epochs=5).count() == start.count()
    assert LY.layout_epochs(none, start.limit(0)).count() == 0


def test_layout_choice_and_fallback(spark, points):
    from pyspark.ml.functions import array_to_vector
    feats = points.select("record_id", array_to_vector("v").alias("features"))
    pts, used = RD.layout2(feats, method="neighbours", neighbours=10)
    assert used == "neighbours" and pts.count() == feats.count()
    assert RD.layout2(feats)[1] == "pca"
    assert RD.layout2(feats.where("record_id < 2"), method="neighbours")[1] == "pca"
    with pytest.raises(ValueError):
        RD.layout2(feats, method="other")
