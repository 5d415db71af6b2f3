"""Findings of the third review."""

import numpy as np

from tessera.model import Grid
from tessera.operators import fit, recon
from tessera.plans import restore


def test_register_far_above_zero(spark):
    """a mean a thousand times the deviation outweighed every lag but 0."""
    rng = np.random.default_rng(4)
    v = 1e4 + 10 * rng.standard_normal((24, 24))
    rows = lambda a: spark.createDataFrame([(x, y, 0, float(a[y, x])) for y in range(24) for x in range(24)], "x int, y int, z int, v double")
    assert restore.register(rows(np.roll(v, (-3, 5), (0, 1))), rows(v), Grid(24, 24)) == (5, -3)


def test_windows_are_not_broadcast(spark):
    """exploded windows were gathered in the driver."""
    small = spark.range(5).selectExpr("id", "id * 1.0 as x", "id * 1.0 as y", "0.0 as z")
    image = Grid(9, 9).frame(spark)
    plan = fit._windows(image, small, 2, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_tiles_denoised_together():
    """a tile took 60 rounds of array operations of its own."""
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.random((20, 3, 8, 8)) * 100, np.full((1, 3, 8, 8), 7.0), np.zeros((1, 3, 8, 8))])
    for periodic in (True, False):
        got, _ = recon.denoise_many(v, periodic=periodic, iterations=25)
        for a, b in zip(got, v):
            assert np.allclose(a, recon.denoise(b, periodic=periodic, iterations=25)[0], rtol=1e-9, atol=1e-9)


def test_a_long_table_is_read_in_parts(spark, tmp_path, monkeypatch):
    """F16: a two-dimensional array of any length was one batch of one task."""
    from tessera.sources import npy

    monkeypatch.setattr(npy, "PART", 600)
    monkeypatch.setattr(npy, "BATCH", 100)
    v = np.arange(2000.0).reshape(1000, 2)
    np.save(tmp_path / "t.npy", v)
    files = npy._Files({"path": str(tmp_path / "t.npy")})
    parts = files.parts([str(tmp_path / "t.npy")])
    batches = [b for p in parts for b in files.read(p)]
    assert len(parts) == 4 and max(b.num_rows for b in batches) == 100
    rows = [r for b in batches for r in b.to_pylist()]
    assert len(rows) == 2000 and all(v[r["y"], r["x"]] == r["v"] for r in rows)


def test_band_join_against_all_pairs(spark):
    """vectors of a band of dx met whatever their other components."""
    from tessera.operators import spatial

    rng = np.random.default_rng(8)
    va, vb = rng.normal(size=(60, 3)) * 2, rng.normal(size=(60, 3)) * 2
    vb[:20] = va[:20] + 0.1
    vb[20:30] = -va[20:30]
    va[25] = vb[25] = [0.1, 3.0, 1.0]
    vb[25] *= -1
    make = lambda v: spark.createDataFrame([(k, k + 100, *map(float, p)) for k, p in enumerate(v)], "i long, j long, dx double, dy double, dz double")
    want = set()
    for i, x in enumerate(va):
        for j, y in enumerate(vb):
            minus, plus, top = np.linalg.norm(x - y), np.linalg.norm(x + y), max(np.linalg.norm(x), np.linalg.norm(y))
            if abs(x[0] - y[0]) <= 2 * 2**0.5 * 0.4 and top > 1 and min(minus, plus) / top < 0.05 + 0.4 / top:
                want.add((i, j, bool(plus < minus)))
    df = spatial.band_join(make(va), make(vb), 0.4, 0.05)
    assert "SortMergeJoin" not in df._jdf.queryExecution().toString()
    assert {(r.ai, r.bi, r.swapped) for r in df.collect()} == want and any(s for *_, s in want)


def _repeated_rows(spark):
    r = np.random.default_rng(12)
    rows = [(k, float(a), float(b), float(c), int((a + b > 5) + (c > 3))) for k, (a, b, c) in enumerate(r.integers(0, 7, (900, 3)))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int").repartition(3)


def test_equal_rows_of_a_forest_are_counted(spark, monkeypatch):
    """equal rows were kept one by one, so a table with few unlike ones was cut by sums, and written whole once a level."""
    from tessera.operators import forest

    df = _repeated_rows(spark)
    options = {"trees": 3, "least": 30, "width": 2}
    whole = sorted(map(tuple, forest.fit(df, list("abc"), **options).collect()))
    assert len(whole) > 9
    levels = []
    cuts = forest.best_cuts
    monkeypatch.setattr(forest, "best_cuts", lambda *a: levels.append(1) or cuts(*a))
    monkeypatch.setattr(forest, "TREES_AT_ONCE", 2)
    assert sorted(map(tuple, forest.fit(df, list("abc"), task_rows=150, **options).collect())) == whole  # 569 rows a tree, at most 147 unlike ones
    assert not levels


def test_folds_are_grown_together(spark, monkeypatch):
    """each fold had passes over all rows of its own; the folds' forests are those that fit gives on the other folds."""
    from tessera.checkpoints import stored
    from tessera.operators import forest

    df, grown = _repeated_rows(spark), []
    own = forest._grown
    monkeypatch.setattr(forest, "_grown", lambda *a: grown.append(1) or own(*a))
    for task_rows in (10**6, 150):
        grown.clear()
        got = [tuple(r) for r in forest.cross_validate(df, list("abc"), 3, trees=4, least=9, task_rows=task_rows).orderBy("fold").collect()]
        assert len(grown) == 1
        for k in range(3):
            model = stored(forest.fit(df.where(f"id % 3 != {k}"), list("abc"), trees=4, least=9))
            assert got[k] == (k, *tuple(forest.accuracy(forest.predict(df.where(f"id % 3 = {k}"), model, list("abc"))).select("n", "accuracy").first()))


def test_ranges_do_not_grow_with_the_table(spark, monkeypatch):
    """as many ranges as shuffle partitions, whatever the rows, so a task's rows grew with the table."""
    from pyspark.sql import functions as F

    from tessera.operators import ordered

    made, own = [], ordered.stored
    monkeypatch.setattr(ordered, "stored", lambda df: made.append(own(df)) or made[-1])
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50, raising=False)
    df = spark.range(2000).select(F.pmod(F.col("id") * 997, F.lit(2000)).alias("v"), F.lit(1).alias("one"))
    rows = ordered.running(df, ["v"], ["one"], "v").orderBy("v").collect()
    assert [(r.v, r.run_one, r.all_one, r.after) for r in rows] == [(k, k + 1, 2000, k + 1 if k < 1999 else None) for k in range(2000)]
    assert max(r["count"] for r in made[0].groupBy("range").count().collect()) <= 200  # 500 with the session's four partitions
