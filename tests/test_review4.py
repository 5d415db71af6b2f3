"""What the fourth review found: work that grew faster than it had to."""

import numpy as np
import pytest

from tessera.operators import spatial


def test_differences_wait_until_many_share_a_cell(monkeypatch):
    """every piece of pairs was sorted and spread by itself, a few differences a cell."""
    d = np.random.default_rng(3).uniform(-3, 3, (4000, 3))
    grid, calls, own = spatial._Spread(3.0, 0.4, 0.5), [], spatial._Spread._add
    monkeypatch.setattr(spatial._Spread, "_add", lambda self, p: calls.append(len(p)) or own(self, p))
    for at in range(0, 4000, 100):
        assert not list(grid.add(d[at : at + 100]))
    (rows,) = grid.rest()
    assert calls == [4000]
    at = np.stack([rows.column(c).to_numpy() for c in "ijk"], 1) * 0.5 - 3.0
    d2 = ((d - at[:, None]) ** 2).sum(2)
    assert np.allclose(rows.column("kde").to_numpy(), np.where(d2 < 1.0, np.exp(-d2 / 0.32), 0.0).sum(1), rtol=1e-12)


@pytest.mark.parametrize("size", [0.4, 0.05, 2e-4])
def test_refinement_of_many_differences_is_cheap(size):
    """F1: a difference that some offsets do not reach took 14 microseconds, three coordinates of 1,419 offsets as one array."""
    import tracemalloc

    p = np.random.default_rng(4).uniform(-1.8, 1.8, (5000, 3))
    (offsets,) = [o for o in spatial._refinements(size)[:1]]
    tracemalloc.start()
    got = spatial._densities(p, np.array([0.1, 0.0, -0.1]), offsets, 0.4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros(len(offsets))
    for k in range(0, len(p), 500):
        d2 = ((p[k : k + 500, None] - (np.array([0.1, 0.0, -0.1]) + offsets)) ** 2).sum(2)
        want += np.where(d2 < 1.0, np.exp(-d2 / 0.32), 0.0).sum(0)
    assert np.allclose(got, want, rtol=1e-11)
    assert most < 16_000_000  # 24 MB before for 512 differences and the offsets, more with their squares


@pytest.mark.parametrize("step", [0.5, 2.0])
def test_profiles_do_not_overflow(step):
    d = np.linspace(-1, 1, 50)
    assert np.allclose(spatial._profiles(d, step, 3, 0.05), np.exp(-((d + np.arange(3)[:, None] * step) ** 2) / 0.005), rtol=1e-9, atol=0)


def _noise(spark, n=8000):
    """Labels that features say little about: cuts are at the ends, so a large node stays large for many levels."""
    r = np.random.default_rng(8)
    rows = [(k, float(a), float(round(b, 2)), float(c), int(l)) for k, (a, b, c, l) in enumerate(zip(r.integers(0, 9, n), r.random(n) * 80, r.random(n), r.integers(0, 3, n)))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int").repartition(3)


@pytest.mark.parametrize("kind", ["gini", "entropy"])
def test_large_nodes_are_cut_without_writing_rows_again(spark, monkeypatch, kind):
    """every level wrote, dealt and sorted all rows of large nodes again."""
    from tessera.operators import forest

    df, written, own = _noise(spark), [], forest.stored
    options = {"trees": 3, "least": 5, "width": 2, "kind": kind, "depth": 12, "seed": 1}
    one = forest.fit(df, list("abc"), **options).collect()
    monkeypatch.setattr(forest, "stored", lambda df: written.append(1) or own(df))
    parts = forest.fit(df, list("abc"), task_rows=700, **options).collect()
    assert len(written) <= 6  # rows of each set of features, their lists, nodes and pieces; three tables a level before
    for tree in range(3):
        mine, other = (by_path([tuple(x)[1:] for x in got if x.tree == tree]) for got in (one, parts))
        assert len(mine) > 20 and mine.keys() == other.keys()
        for p in mine:
            assert mine[p][:3] == other[p][:3] and mine[p][3] == pytest.approx(other[p][3], abs=1e-6)


def by_path(nodes):
    at, out, work = {n[0]: n for n in nodes}, {}, [("", 0)]
    while work:
        path, k = work.pop()
        _, left, right, var, th, label, gain = at[k]
        out[path] = (var, th, label, gain)
        work += [(path + "l", left), (path + "r", right)] if left else []
    assert len(out) == len(nodes)
    return out


@pytest.mark.parametrize("kind", ["gini", "entropy"])
def test_no_cut_is_below_the_bound_of_its_block(kind):
    from tessera.operators import levels

    r = np.random.default_rng(2)
    for rows, block in ((30, 3), (900, 64), (5000, 300)):
        y = r.integers(0, 3, rows)
        run = np.cumsum(np.eye(3, dtype=np.int64)[y], axis=0)
        own = run[-1]
        total = levels.impurity(run, kind) + levels.impurity(own - run, kind)
        for s in range(0, rows, block):
            e = min(rows, s + block)
            start = run[s] - np.eye(3, dtype=np.int64)[y[s]]
            assert levels._least(start[None], run[e - 1][None], own, kind)[0] <= total[s:e].min() + 1e-6


@pytest.mark.parametrize("kind", ["gini", "entropy"])
def test_nodes_of_a_task_are_cut_by_bounds(monkeypatch, kind):
    """F2: a task went over every row of every feature once a level, 15 microseconds a row in all; the trees are the same, number by number."""
    from tessera.operators import forest, levels

    r = np.random.default_rng(7)
    x, y, w = np.stack([r.random(6000), r.integers(0, 9, 6000), np.round(r.random(6000), 2)], 1), r.integers(0, 3, 6000), r.integers(1, 300, 6000)
    want = forest.grow_tree(x, y, 3, np.arange(3), 40, kind, 30, w)
    monkeypatch.setattr(levels, "BOUNDED_ROWS", 300)
    rows = []
    grow = lambda x, *rest: rows.append(len(x)) or forest.grow_tree(x, *rest)
    assert levels.grow_bounded(grow, x, y, 3, 40, kind, 30, w) == want
    assert max(rows) <= 300
