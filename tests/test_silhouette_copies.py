"""Points of the silhouettes are copied few times, and leave few rows, however many blocks there are."""
import numpy as np

from shoal.operators import evaluate as E
from shoal.operators import silhouette_tree as S
from tests.test_silhouette_tree import SCHEMA, blobs, plain


def watch(module, monkeypatch):
    dealt = []
    real = module.by_block
    monkeypatch.setattr(module, "by_block", lambda rows, *a: dealt.append(rows) or real(rows, *a))
    return dealt


def test_exact_sums_copy_a_point_to_few_blocks(spark, monkeypatch):
    dealt, pts = watch(E, monkeypatch), blobs(700, 3)
    got = E.silhouette_samples(spark.createDataFrame(pts, SCHEMA), block_size=5).collect()       # 140 blocks of 5
    want = plain(pts)
    assert len(got) == 700 and all(abs(r["s"] - want[r["record_id"]]) < 1e-9 for r in got)
    assert [d.count() for d in dealt] == [700, 700 * E.SIDES]
    assert E._sides(600_000, 9, 2048) == (E.SIDES, 1) and E._sides(3_000_000, 9, 2048) == (E.SIDES, 3)
    assert E._sides(100, 9, 2048) == (1, 1) and E._sides(1_000_000, 1000, 2048) == (239, 1)


def test_exact_sums_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(E, "MOST_ASKED", 90)
    dealt, pts = watch(E, monkeypatch), blobs(400, 5)
    got = E.silhouette_samples(spark.createDataFrame(pts, SCHEMA), block_size=100).collect()
    want = plain(pts)
    assert len(got) == 400 and all(abs(r["s"] - want[r["record_id"]]) < 1e-9 for r in got)
    assert [d.count() for d in dealt] == [400 * 5, 400 * 5]


def test_distance_sums_of_runs(monkeypatch):
    monkeypatch.setattr(E, "COLUMNS", 7)
    monkeypatch.setattr(E, "ENTRIES", 20)
    x, y = np.random.default_rng(0).normal(size=(2, 11))
    rx, ry = np.random.default_rng(1).normal(size=(2, 40))
    starts = np.array([0, 1, 3, 7, 8, 25, 39])
    d = np.sqrt((x[:, None] - rx) ** 2 + (y[:, None] - ry) ** 2)
    want = np.stack([d[:, i:j].sum(1) for i, j in zip(starts, [*starts[1:], 40])], 1)
    assert np.allclose(E._distance_sums(x, y, rx, ry, starts), want, rtol=0, atol=1e-12)


def test_blocks_of_the_tree_ask_in_groups(spark, monkeypatch):
    dealt, pts = watch(S, monkeypatch), blobs(1000, 7)
    got = S.silhouette_bounds(spark.createDataFrame(pts, SCHEMA), 0.02, block_size=8).collect()  # 125 blocks, one group
    want = plain(pts)
    assert len(got) == 1000 and all(abs(r["s"] - want[r["record_id"]]) <= r["bound"] + 1e-9 for r in got)
    asking, met = dealt
    assert asking.count() == 1000 and met.count() <= 1000


def test_groups_and_parts_of_the_tree_meet_every_point(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 64)
    monkeypatch.setattr(S, "MOST_ASKED", 100)
    dealt, pts = watch(S, monkeypatch), blobs(600, 9)
    pts += [(1000 + i, 3.0, 4.0, 6) for i in range(150)]                  # a heap: its blocks meet each other as far nodes
    exact = S.silhouette_bounds(spark.createDataFrame(pts, SCHEMA), 0.0, block_size=8).collect()
    want = plain(pts)
    assert len(exact) == len(want) and all(abs(r["s"] - want[r["record_id"]]) < 1e-9 for r in exact)
    near = S.silhouette_bounds(spark.createDataFrame(pts, SCHEMA), 0.02, block_size=8).collect()
    assert len(near) == len(want) and all(abs(r["s"] - want[r["record_id"]]) <= r["bound"] + 1e-9 for r in near)
    assert dealt[0].count() > len(want) and dealt[0].select("qg").distinct().count() > 4
