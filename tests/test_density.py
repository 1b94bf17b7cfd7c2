"""M4c, M4d, M4, M5: the spanning tree, the condensed tree and the labels against their definitions."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.operators import cluster as C
from shoal.operators import density as D
from shoal.operators import spanning as S
from tests.density_reference import kruskal, labels_of


def frame(spark, pts):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "record_id long, x double, y double")


def blobs(seed, sizes=(60, 40, 25), spread=0.4, noise=20):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(n, 2)) * spread + rng.uniform(-6, 6, 2) for n in sizes]
    return np.concatenate([*parts, rng.uniform(-8, 8, (noise, 2))])


def nested(seed):
    """Two loose groups, each of tight ones: the best choice lies at different depths."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(30, 2)) * 0.05 + c for c in ((0, 0), (0.6, 0), (0, 0.6), (9, 9), (9.5, 9))]
    return np.concatenate([*parts, rng.normal(size=(70, 2)) * 0.8 + (-8, 5)])


def ties(seed):
    return np.round(np.random.default_rng(seed).normal(size=(170, 2)) * 2, 0)


CASES = {"blobs": blobs(1), "nested": nested(2), "uniform": np.random.default_rng(3).uniform(size=(180, 2)),
         "ties": np.round(blobs(4), 1), "copies": ties(5), "line": np.c_[np.arange(60.0) ** 1.5, np.zeros(60)]}


def pairs(df):
    return {(r["a"], r["b"]): r["w"] for r in df.collect()}


@pytest.mark.parametrize("name", ["uniform", "ties", "copies"])
def test_spanning_tree_over_blocks_is_kruskals(spark, name, monkeypatch):
    pts = CASES[name]
    df, want = frame(spark, pts), kruskal(pts, 3)
    assert pairs(S.spanning_tree(df, 3, block_size=24).edges()) == pytest.approx(want)
    if name == "ties":
        monkeypatch.setattr(S, "DRIVER_MERGES", 0)            # components merged by joins
        assert pairs(S.spanning_tree(df, 3, block_size=40).edges()) == pytest.approx(want)


@pytest.mark.parametrize("name", sorted(CASES))
def test_labels_are_those_of_the_definition(spark, name, monkeypatch):
    monkeypatch.setattr(D, "FAN", 2)                          # several levels of groups
    pts = CASES[name]
    df = frame(spark, pts)
    for least, samples, size in ((5, 3, 90), (8, 2, 2048))[:2 if name in ("nested", "copies") else 1]:
        tree = S.spanning_tree(df, samples, block_size=size)
        got = D.numbered(D.condensed_tree(tree, least)[1])
        assert [r["cluster"] for r in got.orderBy("record_id").collect()] == labels_of(pts, least, samples)


def test_condensed_tree_is_consistent(spark):
    df = frame(spark, CASES["nested"])
    clusters, points = D.condensed_tree(S.spanning_tree(df, 3, block_size=50), 5)
    rows = {r["cluster"]: r for r in clusters.collect()}
    roots = [r for r in rows.values() if r["parent"] is None]
    assert len(roots) == 1 and roots[0]["size"] == len(CASES["nested"]) and not roots[0]["taken"]
    for r in rows.values():
        above = r["parent"]
        assert above is None or rows[above]["size"] > r["size"]
        while r["taken"] and above:                           # no taken cluster lies below another
            assert not rows[above]["taken"]
            above = rows[above]["parent"]
    sizes = {r["cluster"]: r["count"] for r in points.groupBy("cluster").count().collect() if r["cluster"]}
    assert sizes == {c: r["size"] for c, r in rows.items() if r["taken"]}


def test_same_tree_however_the_points_lie(spark):
    df = frame(spark, CASES["ties"])
    one = D.condensed_tree(S.spanning_tree(df.coalesce(1), 3, block_size=2048), 5)
    many = D.condensed_tree(S.spanning_tree(df.repartition(5), 3, block_size=20), 5)
    assert sorted(map(tuple, one[0].collect()), key=str) == sorted(map(tuple, many[0].collect()), key=str)
    assert {tuple(r) for r in one[1].collect()} == {tuple(r) for r in many[1].collect()}


def test_a_heap_of_equal_points_is_one_cluster(spark):
    pts = np.concatenate([np.full((300, 2), 2.5), np.random.default_rng(1).uniform(-9, 9, (60, 2))])
    run = D.density(frame(spark, pts), block_size=40)
    labels = [r["cluster"] for r in run.assignments.orderBy("record_id").collect()]
    assert labels == labels_of(pts, 5, 3) and set(labels[:300]) == {0}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7])
def test_few_points(spark, n):
    pts = np.array([[0.0, 0], [0, 1], [0, 1.5], [9, 9], [9, 9.2], [9, 9.3], [4, 4]])[:n]
    run = D.density(frame(spark, pts))
    least = min(5, max(2, n // 5))
    assert [r["cluster"] for r in run.assignments.orderBy("record_id").collect()] == labels_of(pts, least, min(3, least))
    assert run.n_noise == sum(r["cluster"] < 0 for r in run.assignments.collect())


def test_noise_fallback_switches_to_kmeans(spark):
    grouped = C.cluster_points(frame(spark, blobs(1)), use_density=True, restarts=2)
    assert (grouped.method, grouped.method_effective) == ("hdbscan", "hdbscan") and grouped.n_clusters >= 3
    rng = np.random.default_rng(6)
    far = 20 * 1.3 ** np.arange(40)                           # each farther out than the last two are apart: they leave one by one
    sparse = np.concatenate([rng.normal(size=(12, 2)) * 0.01, rng.normal(size=(12, 2)) * 0.01 + 5, np.c_[far, -far]])
    assert sum(c < 0 for c in labels_of(sparse, 5, 3)) * 2 > len(sparse)
    run = C.cluster_points(frame(spark, sparse), use_density=True, k=4, restarts=2)
    assert (run.method, run.method_effective, run.n_clusters, run.n_noise) == ("hdbscan", "kmeans", 4, 0)
    assert run.assignments.where(F.col("cluster") < 0).count() == 0
