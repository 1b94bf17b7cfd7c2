"""Properties of the model operators (k-means, PCA, noise rule)."""
from pyspark.sql import functions as F

from shoal.operators import cluster as C
from shoal.operators import evaluate as E


def _blobs(spark):
    rows = []
    for b, (cx, cy) in enumerate([(0, 0), (10, 0), (0, 10)]):
        for i in range(20):
            rows.append((b * 100 + i, cx + (i % 5) * 0.1, cy + (i // 5) * 0.1))
    return spark.createDataFrame(rows, "record_id long, x double, y double")


def test_kmeans_recovers_blobs(spark):
    pts = _blobs(spark)
    run = C.kmeans(pts, k=3, restarts=3)
    lab = pts.join(run.assignments, "record_id").withColumn("blob", (F.col("record_id") / 100).cast("int"))
    pairs = lab.select("blob", "cluster").distinct().count()
    assert pairs == 3 and run.n_clusters == 3 and run.n_noise == 0
    assert E.silhouette(lab) > 0.9


def test_effective_k_and_noise_rule():
    assert C.effective_k(8, 3) == 2 and C.effective_k(8, 100) == 8 and C.effective_k(8, 5) == 4
    assert not C.too_much_noise(4, 8) and C.too_much_noise(5, 8)


def test_lloyd_step_does_not_increase_cost(spark):
    pts = _blobs(spark)
    start = [(0, 1.0, 1.0), (1, 9.0, 1.0), (2, 1.0, 9.0)]
    cost0 = C.assign_nearest(pts, start).agg(F.sum("d2")).first()[0]
    new = [(r["cluster"], r["cx"], r["cy"]) for r in C.lloyd_step(pts, start).collect()]
    cost1 = C.assign_nearest(pts, new).agg(F.sum("d2")).first()[0]
    assert cost1 <= cost0


def test_knn_across_blocks_matches_brute_force(spark):
    import numpy as np

    from shoal.operators import neighbors as NB
    rng = np.random.default_rng(7)
    pts = rng.integers(0, 40, size=(900, 2)).astype(float)  # many exact ties
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)],
                               "record_id long, x double, y double")
    got = {(r["record_id"], r["rank"]): (r["neighbor_id"], r["dist"])
           for r in NB.knn(df, 4, include_self=False, block_size=100).collect()}
    plane = {(r["record_id"], r["rank"]): (r["neighbor_id"], r["dist"])
             for r in NB.knn_plane(df, 4, include_self=False, block_size=100).collect()}
    assert plane == got
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(pts)):
        order = sorted(range(len(pts)), key=lambda j: (d[i, j], j))[:4]
        for rank, j in enumerate(order, 1):
            assert got[(i, rank)] == (j, d[i, j])


def test_spanning_forest_matches_kruskal(spark):
    import numpy as np

    from shoal.operators import neighbors as NB
    rng = np.random.default_rng(3)
    pts = np.round(rng.normal(size=(240, 2)) * 3, 1)  # rounding creates equal weights
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)],
                               "record_id long, x double, y double")
    got = {(r["a"], r["b"]): r["w"] for r in NB.spanning_forest(df, 3, block_size=64).collect()}
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 2]
    edges = sorted((max(core[i], core[j], d[i, j]), i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)))
    parent = list(range(len(pts)))

    def find(u):
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        return u
    want = {}
    for w, i, j in edges:
        ri, rj = find(i), find(j)
        if ri != rj:
            parent[ri] = rj
            want[(i, j)] = w
    assert len(got) == len(pts) - 1
    assert set(got) == set(want)
    assert all(abs(got[e] - want[e]) < 1e-12 for e in want)


def test_plane_search_visits_near_blocks_only(spark, monkeypatch):
    """Clusters, outliers and a mass of equal points: exact, and the visits grow with the points."""
    import numpy as np

    from shoal.operators import neighbors as NB
    monkeypatch.setattr(NB, "BOX_GROUP", 4)
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(size=(400, 2)), rng.normal(size=(300, 2)) * 0.01 + 50, np.full((60, 2), 7.5),
                          rng.uniform(-500, 500, (15, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "record_id long, x double, y double")
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2))
    got = {(r["record_id"], r["rank"]): (r["neighbor_id"], r["dist"]) for r in NB.knn_plane(df, 3, block_size=50).collect()}
    for i in range(len(pts)):
        order = sorted(range(len(pts)), key=lambda j: (d[i, j], j))[:3]
        assert [got[i, k][0] for k in (1, 2, 3)] == order
    assert NB.knn_plane(df.limit(0), 3).count() == 0
    assert NB.knn_plane(df.limit(2), 3).count() == 4
