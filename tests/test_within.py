"""Pairs within a radius by groups and blocks, against brute force."""

import numpy as np
import pytest

from tessera.operators import spatial, within


def cloud(spark, xyz, first=0):
    return spark.createDataFrame([(first + i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")


def brute(q, p, r):
    d2 = ((q[:, None] - p[None]) ** 2).sum(2)
    return d2, d2 < r * r


@pytest.mark.parametrize("scale", [(1, 1, 1), (40, 3, 0.1), (0, 0, 0), (1e9, 1, 1)])
def test_near_pairs(scale):
    rng = np.random.default_rng(3)
    q, p = rng.random((150, 3)) * scale, rng.random((170, 3)) * scale
    for r in (0.2, 1.0, 30.0):
        got = {(i, j): d for a, b, c in within.near_pairs(q, p, r) for i, j, d in zip(a.tolist(), b.tolist(), c.tolist())}
        d2, hit = brute(q, p, r)
        assert set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(hit))))
        assert all(abs(d2[k] - d) < 1e-9 for k, d in got.items())


@pytest.mark.parametrize("rows", [1_000_000, 16])
def test_joins_and_sums_in_blocks(spark, monkeypatch, rows):
    """A crowded place makes many blocks of queries and points; sums over blocks are those of one group."""
    for c in ("PART_ROWS", "QUERY_ROWS", "POINT_ROWS"):
        monkeypatch.setattr(within, c, rows)
    rng = np.random.default_rng(5)
    q, p = np.vstack([rng.random((60, 3)) * 4, np.ones((40, 3))]), np.vstack([rng.random((70, 3)) * 4, np.ones((50, 3)), [[90, 90, 90]]])
    a, b = cloud(spark, q), cloud(spark, p, 1000)
    d2, hit = brute(q, p, 1.0)
    got = [(r.qid, r.pid - 1000) for r in spatial.ball_join(a, b, 1.0).collect()]
    assert sorted(got) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(hit))))
    odd = spark.createDataFrame([(500, None, 1.0, 1.0), (501, float("nan"), 1.0, 1.0)], a.schema)
    kde = {r.id: r.kde for r in spatial.density(a.unionByName(odd), b.unionByName(odd), 0.4).collect()}
    w = np.where(d2 < 1.0, np.exp(-d2 / 0.32), 0)
    assert len(kde) == 102 and kde[500] == kde[501] == 0 and all(abs(kde[i] - v) < 1e-9 for i, v in enumerate(w.sum(1)))
    moved = {r.id: (r.x, r.y, r.z) for r in spatial.mean_shift_step(a, b, 0.4, 2.5).collect()}
    want = np.where(w.sum(1)[:, None] >= 1e-9, w @ p / np.maximum(w.sum(1)[:, None], 1e-300), q)
    assert all(np.allclose(moved[i], v) for i, v in enumerate(want))


def test_queries_are_not_repeated_for_cells(spark):
    """The join of 27 cells wrote each query 27 times."""
    a = cloud(spark, np.random.default_rng(1).random((50, 3)))
    plan = spatial.ball_join(a, a, 0.3)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_displacements_are_counted_where_points_meet(spark, monkeypatch):
    """No table of pairs is written: with a crowd it was a hundred times the points."""
    a = cloud(spark, np.random.default_rng(2).random((200, 3)) * 2)
    written = []
    keep = spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df: written.append(keep(df)) or written[-1])
    monkeypatch.setattr(within, "PART_ROWS", 64)
    got = spatial.displacement_search(a, a, 4.0, 0.2).first()
    assert abs(got.dx) < 1e-3 and got.kde >= 200
    assert max(t.count() for t in written) < 20_000  # of 40,000 pairs
    d = spatial.ball_join(a, a, 4.0).selectExpr("px - qx as x", "py - qy as y", "pz - qz as z")
    one, two = ({(r.i, r.j, r.k): r.kde for r in df.collect()} for df in (spatial.pair_density(a, a, 4.0, 0.2), spatial.displacement_density(d, 4.0, 0.2)))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 * two[k] for k in one)
