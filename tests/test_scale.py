"""What keeps tasks bounded must not change results: ranges, blocks, tiles, kernels and models in parts against plain versions."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import checkpoints
from tessera.model import Grid, to_tiles
from tessera.operators import dense, forest, fourier, geometry, morph, ordered, recon, spatial, stencil, tree
from tessera.plans import halo, restore
from tessera import sources, streaming
from tessera.sources import convert, log, npy, strips, svg, tiff
from tests.test_kernels import frame, volume_of


def test_running_sums_over_ranges(spark):
    r = np.random.default_rng(1)
    rows = [(float(v), int(n)) for v, n in zip(r.permutation(500), r.integers(0, 9, 500))]
    got = {x.f: x for x in ordered.running(spark.createDataFrame(rows, "f double, n long").repartition(5), ["f"], ["n"], "f").collect()}
    total, seen = sum(n for _, n in rows), 0
    for k, (f, n) in enumerate(sorted(rows)):
        seen += n
        assert (got[f].run_n, got[f].all_n, got[f].after) == (seen, total, k + 1.0 if k < 499 else None)
    assert ordered.running(spark.createDataFrame([], "f double, n long"), ["f"], ["n"], "f").count() == 0


@pytest.mark.parametrize("side", [(7, 5, 2), (128, 128, 64)])
def test_blocks_equal_the_whole(spark, side, monkeypatch):
    """Filters over small blocks with halos, over one block and over whole arrays agree, at all borders."""
    v = np.random.default_rng(2).random((5, 23, 31))
    grid, df = Grid(31, 23, 5), frame(spark, v)
    monkeypatch.setattr(dense.over_blocks, "__defaults__", (side,))
    assert np.allclose(volume_of(stencil.laplacian_of_gaussian(df, grid, 0.8, 0.6), grid), stencil.log_of_gaussian(v, True, 0.8, 0.6))
    want = v
    for a, s in (("x", 0.7), ("y", 0.7), ("z", 0.5)):
        want = dense.correlate(want, a, stencil.gaussian(s), "normalized")
    assert np.allclose(volume_of(stencil.smooth(df, grid, 0.7, 0.5), grid), want)
    peaks = {(r.x, r.y, r.z) for r in stencil.log_maxima(df, grid, 0.8, 0.6).collect()}
    top = dense.maxima(stencil.log_of_gaussian(v, True, 0.8, 0.6), (0, 0, 0), grid)
    assert peaks == {(x, y, z) for z, y, x in zip(*top.nonzero())} and peaks


@pytest.mark.parametrize("mode", ["mirror", "zeros", "normalized"])
def test_dense_and_row_passes_agree(spark, mode):
    v = np.random.default_rng(3).random((1, 4, 9))
    taps = [0.1, 0.2, 0.4, 0.25, 0.05, 0.3, 0.7, 0.1, 0.2]
    for axis in "xy":
        assert np.allclose(volume_of(stencil.convolve(frame(spark, v), axis, taps, mode), Grid(9, 4)), dense.correlate(v, axis, taps, mode))


def test_tile_arithmetic_finds_all_tiles(spark):
    for n, most, overlap in ((32, 12, 3), (31, 7, 9), (10, 10, 4), (29, 3, 1)):
        got = geometry.split_tiles(Grid(n, 1).frame(spark), Grid(n, 1), most, overlap)
        want = {(k, x) for k, (a, b) in enumerate(geometry.divide(n, most)) for x in range(max(0, a - overlap), min(n, b + overlap + 1))}
        assert {(r.tile, r.x) for r in got.collect()} == want


def slow_labels(m):
    """Labels by flooding, in raster order of the first pixels."""
    out, n = np.zeros(m.shape, int), 0
    for y, x in zip(*np.nonzero(m)):
        if out[y, x]:
            continue
        n += 1
        work = [(y, x)]
        while work:
            i, j = work.pop()
            if 0 <= i < m.shape[0] and 0 <= j < m.shape[1] and m[i, j] and not out[i, j]:
                out[i, j] = n
                work += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    return out


@pytest.mark.parametrize("kind", ["random", "snake", "full", "rings", "none"])
def test_components_over_many_blocks(spark, monkeypatch, kind):
    """Blocks of 4 x 4 pixels: regions that wind through all of them, one that fills all, none."""
    monkeypatch.setattr(morph, "SIDE", 4)
    r = np.random.default_rng(2)
    h, w = 23, 37
    y, x = np.indices((h, w))
    m = {"random": r.random((h, w)) < 0.58, "snake": (y % 4 == 0) | ((y % 4 == 2) & False) | ((y % 8 < 4) & (x == w - 1)) | ((y % 8 >= 4) & (x == 0)), "full": x >= 0, "rings": np.maximum(abs(x - 18), abs(y - 11)) % 2 == 0, "none": x < 0}[kind]
    got = np.zeros((h, w), int)
    for p in morph.components(frame(spark, m[None].astype(float)), Grid(w, h)).collect():
        assert got[p.y, p.x] == 0
        got[p.y, p.x] = p.label
    assert np.array_equal(got, slow_labels(m))


def all_nearest(q, p, k):
    """{query: [(point, squared distance)]} by all distances; q and p: identifier to place."""
    out = {}
    for i, a in q.items():
        d = sorted((float(sum((u - v) ** 2 for u, v in zip(a, b))), j) for j, b in p.items())[:k]
        out[i] = [(j, x) for x, j in d]
    return out


@pytest.mark.parametrize("kind", ["even", "clumps", "line", "lattice", "apart"])
def test_nearest_over_many_partitions(spark, monkeypatch, kind):
    """Partitions of 20 points: neighbours beyond the own one, ties, clumps of equal places, queries far outside."""
    r = np.random.default_rng(len(kind))
    monkeypatch.setattr(tree, "LEAF_ROWS", 4)
    monkeypatch.setattr(tree, "QUERY_ROWS", 30)
    b = {"even": r.random((300, 3)), "clumps": np.repeat(r.random((9, 3)), 40, 0), "line": r.random((300, 1)) * [1, 0, 0], "lattice": r.integers(0, 4, (300, 3)).astype(float), "apart": np.vstack([r.random((299, 3)), [[1e6, 0, 0]]])}[kind]
    a = np.vstack([b[::5] + (0.01 if kind == "even" else 0), r.random((20, 3)) * 3 - 1, [[50.0, -9, 2]]])
    q, p = ({7 * i - 100: tuple(map(float, v)) for i, v in enumerate(x)} for x in (a, b))
    frame = lambda m: spark.createDataFrame([(i, *v) for i, v in m.items()], "id long, x double, y double, z double").repartition(3)
    for k in (1, 6, 70):
        got = {}
        for x in tree.nearest(frame(q), frame(p), k, part_rows=20).orderBy("qid", "rank").collect():
            got.setdefault(x.qid, []).append((x.pid, x.d2))
        want = all_nearest(q, p, k)
        assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
        assert all(np.allclose([d for _, d in got[i]], [d for _, d in want[i]]) for i in want)


def test_nearest_moves_only_what_is_near_a_border_again(spark, monkeypatch):
    """Of a long strip in partitions of 64, few points are in reach of queries from beyond; most queries are done in their own partition."""
    r = np.random.default_rng(8)
    b = r.random((4000, 3)) * [4000, 1, 1]
    frame = lambda v: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "id long, x double, y double, z double").repartition(3)
    within, moved = tree._within, []
    monkeypatch.setattr(tree, "_within", lambda *given: moved.append(within(*given)) or moved[-1])
    got = {(x.qid, x["rank"]): x.pid for x in tree.nearest(frame(b + 0.1), frame(b), 2, part_rows=64).collect()}
    d = (((b + 0.1)[:, None] - b[None]) ** 2).sum(2)
    want = np.argsort(d, 1, kind="stable")[:, :2]
    assert got == {(i, k + 1): int(j) for i, row in enumerate(want) for k, j in enumerate(row)}
    assert 0 < moved[0].count() < 1000


def test_nearest_without_and_with_shared_identifiers(spark):
    """Rows without a place are near nothing and hide nobody; rows of one identifier are one query, also over partitions."""
    frame = lambda v: spark.createDataFrame(v, "id long, x double, y double, z double").repartition(3)
    nan, p = float("nan"), [(i, float(i), 0.0, 0.0) for i in range(200)]
    q = [(1, 3.2, 0.0, 0.0), (1, 150.1, 0.0, 0.0), (2, 77.4, 0.0, 0.0), (3, nan, 0.0, 0.0), (4, None, 1.0, 1.0)]
    odd = [(1000 + i, nan if i % 2 else None, float(i), 0.0) for i in range(20)] + [(2000 + i, float(10 * i), nan, nan) for i in range(20)]
    got = [(x.qid, x["rank"], x.pid) for x in tree.nearest(frame(q), frame(p + odd), 2, part_rows=20).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, 150), (1, 2, 3), (2, 1, 77), (2, 2, 78)]


def test_search_keeps_few_points_of_a_crowded_place():
    """6,000 queries and points at one place: no 36 million pairs."""
    p = np.zeros((6000, 3))
    q, starts = p + 1.0, tree.blocks_of(p + 1.0)[1]
    tracemalloc.start()
    who, pid, d = tree.search(p, np.arange(6000)[::-1].copy(), q, starts, 3, np.full(6000, np.inf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(who, np.repeat(np.arange(6000), 3)) and np.array_equal(pid, np.tile(np.arange(3), 6000)) and (d == 3).all() and peak < 50e6


@pytest.mark.parametrize("name", ["closest_point", "nearest_neighbours"])
def test_points_are_grouped_once_for_both_sides(spark, monkeypatch, name):
    from tessera import queries, views

    points, calls = views.points, []
    monkeypatch.setattr(views, "points", lambda *given: calls.append(given) or points(*given))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1


@pytest.mark.parametrize("name", ["closest_point", "nearest_neighbours"])
def test_points_are_not_stored_again(spark, monkeypatch, name):
    """The grouped points are read where they lie: of the tables that the search stores only its results hold places, and identifiers are not looked up."""
    from tessera import queries

    stored, columns = tree.stored, []
    monkeypatch.setattr(tree, "stored", lambda df: columns.append(df.columns) or stored(df))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert all("pid" in c for c in columns if "x" in c) and ["qid"] not in columns


def test_order_lines_that_share_an_identifier(spark, tmp_path):
    """Line 8 of order 1 and line 0 of order 2 have one identifier: it is asked for once, from both places, also where there are partitions."""
    from tessera import queries, views

    lines = [(o, n, 1000.0 * (o % 7), 10.0 * n) for o in range(60) for n in (0, 3, 8)]
    for kind, own in (("shared", lines), ("apart", [x for x in lines if x[1] != 8]), ("missing", [*lines[:1], (1, None, 1.0, 1.0)])):
        spark.createDataFrame(own, "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/{kind}/lineitem.parquet")
    assert [views.points_distinct(spark, f"{tmp_path}/{k}") for k in ("shared", "apart", "missing")] == [False, True, False]
    rows = [(8 * o + n, np.array([o / 20, p / 1000, q / 10])) for o, n, p, q in lines]
    want = {}
    for i, v in rows:
        d, j = min((round(float(((v + [4, 2, -1] - w) ** 2).sum()), 9), j) for j, w in rows)
        want[i] = min(want.get(i, (np.inf, 0)), (d, j))
    got = queries.QUERIES["closest_point"](spark, f"{tmp_path}/shared").collect()
    assert len(got) == len(want) and all(x.d2 == pytest.approx(want[x.qid][0], abs=1e-6) for x in got)


def test_parts_are_those_of_the_tree(spark):
    """Worked out by Spark level by level as by numpy: splits across all axes, places on a split, without bounds, beyond all."""
    r = np.random.default_rng(4)
    p = r.integers(0, 40, (3000, 3)) / 7
    split = tree.Tree(p, 9)
    q = np.vstack([p, r.random((500, 3)) * 9 - 2, [[np.inf, -np.inf, 0], [-0.0, 0, 1e300]]])
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "id long, x double, y double, z double")
    got = tree._placed(rows, split).orderBy("id")
    assert not got.schema["part"].nullable and len(set(split.axis)) == 3
    assert [x.part for x in got.collect()] == split.locate(q).tolist()


@pytest.mark.parametrize("n", [1, 2, 5, 31, 32, 33, 1000])
def test_even_leaves(n):
    p = np.random.default_rng(n).integers(0, 9, (n, 3)).astype(float)
    for depth in range(int(np.log2(n)) + 1):
        at, _ = tree.even(p, depth)
        assert at.shape[0] == 1 << depth and sorted(at[at >= 0]) == list(range(n)) and np.ptp((at >= 0).sum(1)) <= 1


def test_rounding_without_decimals_is_rounding(spark):
    from pyspark.sql import functions as F

    from tessera.queries.volumes import rounded

    c = ["rand(1) * 10", "randn(2) / 1000", "randn(3) * 2e7", "(floor(rand(4) * 1e7) + 0.5) / 1e6", "-(floor(rand(5) * 1e4) + 0.5) / 1e6", "double('nan')", "double('inf')", "cast(null as double)", "-1e-9"]
    df = spark.range(20_000).selectExpr(f"explode(array({', '.join(c)})) as c").withColumn("was", F.round("c", 6) + 0.0).withColumn("was", F.col("was").cast("string"))
    assert rounded(df).select("c", "was").where("not (cast(c as string) <=> was)").count() == 0


def slow_tree(x, y, least, kind, depth):
    """{path: (var, th, label, gain)} by trying every cut of every feature in every node."""
    out = {}

    def weight(n):
        n = np.asarray(n, float)
        if kind == "gini":
            return n.sum() - (n**2).sum() / max(n.sum(), 1)
        ln = lambda k: np.log(float(np.prod(np.arange(1, k + 1)))) if k <= 8 else k * np.log(k) - k + 0.5 * np.log(2 * np.pi * k)
        return ln(n.sum()) - sum(ln(c) for c in n)

    def grow(path, rows):
        own = np.bincount(y[rows], minlength=3)
        best = (weight(own), None)
        if len(rows) > least and (own > 0).sum() > 1 and len(path) < depth:
            for f in range(x.shape[1]):
                v = np.unique(x[rows, f])
                for a, b in zip(v[:-1], v[1:]):
                    left = rows[x[rows, f] <= a]
                    l = np.bincount(y[left], minlength=3)
                    total = weight(l) + weight(own - l)
                    if total < best[0] - 1e-9:
                        best = (total, (f, (a + b) / 2, left))
        if best[1] is None:
            out[path] = (0, 0.0, int(own.argmax()), 0.0)
            return
        f, th, left = best[1]
        out[path] = (f, th, int(own.argmax()), weight(own) - best[0])
        grow(path + "l", left)
        grow(path + "r", np.setdiff1d(rows, left))

    grow("", np.arange(len(y)))
    return out


def by_path(nodes):
    """{path: (var, th, label, gain)} of node rows, which must be numbered from 0 without gaps."""
    at = {n[0]: n for n in nodes}
    assert sorted(at) == list(range(len(nodes)))
    out, work = {}, [("", 0)]
    while work:
        path, k = work.pop()
        _, left, right, var, th, label, gain = at[k]
        out[path] = (var, th, label, gain)
        work += [(path + "l", left), (path + "r", right)] if left else []
    assert len(out) == len(nodes)
    return out


def same_tree(a, b):
    assert a.keys() == b.keys()
    for p in a:
        assert a[p][0] == b[p][0] and a[p][2] == b[p][2] and a[p][1] == pytest.approx(b[p][1]) and a[p][3] == pytest.approx(b[p][3], abs=1e-6), p


def test_tree_grown_level_by_level_equals_trying_every_cut():
    kind = "gini"  # with entropies, which of equal cuts is the first hangs on their last digits
    r = np.random.default_rng(6)
    for n, values, least, depth in ((1, 3, 1, 60), (40, 4, 1, 60), (90, 1000, 3, 60), (120, 9, 1, 3), (60, 1, 1, 60), (150, 30, 20, 60)):
        x, y = r.integers(0, values, (n, 3)).astype(float), r.integers(0, 3, n)
        same_tree(by_path(forest.grow_tree(x, y, 3, np.arange(3), least, kind, depth)), slow_tree(x, y, least, kind, depth))


def test_tree_by_entropy_takes_the_best_cuts():
    r = np.random.default_rng(3)
    x, y = r.random((70, 2)), r.integers(0, 3, 70)
    got, want = (by_path(n) if isinstance(n, list) else n for n in (forest.grow_tree(x, y, 3, np.arange(2), 1, "entropy", 2), slow_tree(x, y, 1, "entropy", 2)))
    same_tree(got, want)


@pytest.mark.parametrize("kind, depth", [("gini", 60), ("entropy", 2), ("gini", 2)])
def test_forest_cut_by_sums_equals_trees_of_tasks(spark, kind, depth):
    """Nodes above 12 rows are cut by sums over ranges, those below by tasks; the trees are those that a task grows alone."""
    r = np.random.default_rng(9)
    rows = [(k, float(a), float(b), float(c), int((a + b > 9) + (c > 5))) for k, (a, b, c) in enumerate(r.integers(0, 11, (160, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label int").repartition(3)
    options = {"trees": 2, "share": 0.8, "least": 2, "kind": kind, "width": 2, "depth": depth}
    whole, parts = (forest.fit(df, list("abc"), task_rows=n, **options).collect() for n in (10**6, 12))
    for tree in (0, 1):
        one, other = ([tuple(x)[1:] for x in got if x.tree == tree] for got in (whole, parts))
        assert len(one) > 3
        same_tree(by_path(one), by_path(other))
    model = spark.createDataFrame(parts, forest.NODES)
    assert forest.predict(df, model, list("abc")).count() == 160


def test_forest_in_parts_equals_whole(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(k, float(a), float(b), int(a + b > 1)) for k, (a, b) in enumerate(r.random((200, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    model = checkpoints.stored(forest.fit(df, ["a", "b"], trees=7, least=5))
    whole = {x.id: x.prediction for x in forest.predict(df, model, ["a", "b"]).collect()}
    for most in (1, model.count() // 2):
        with monkeypatch.context() as m:
            m.setattr(forest, "NODES_AT_ONCE", most)
            assert {x.id: x.prediction for x in forest.predict(df, model, ["a", "b"]).collect()} == whole
    told = forest.cross_validate(df, ["a", "b"], 4, trees=9, least=2).collect()
    assert sum(x.n for x in told) == 200 and min(x.accuracy for x in told) > 0.55  # one feature a tree


def test_kernel_cuts_change_nothing(spark):
    """A kernel larger than twice the image gives the image the same values as its cut."""
    r = np.random.default_rng(5)
    k, v = r.random((5, 41, 31)), r.random((2, 9, 8)) * 50 + 1
    cut, grid = geometry.crop_by_image(frame(spark, k), Grid(31, 41, 5), Grid(8, 9, 2))
    small = volume_of(cut, grid)
    assert small.shape == (3, 17, 15)

    def blurred(kernel):
        c = [(n - 1) // 2 for n in kernel.shape]
        out = np.zeros_like(v)
        for z, y, x in np.ndindex(v.shape):
            for a, b, d in np.ndindex(v.shape):
                p = (z - a + c[0], y - b + c[1], x - d + c[2])
                if all(0 <= i < n for i, n in zip(p, kernel.shape)):
                    out[z, y, x] += v[a, b, d] * kernel[p]
        return out

    assert np.allclose(blurred(k), blurred(small))


def test_kernel_centre(spark):
    k = np.zeros((6, 3, 3))
    k[2] = 9
    got, grid = geometry.centre_z(frame(spark, k), Grid(3, 3, 6))
    assert grid.nz == 5 and volume_of(got, grid)[2].sum() == 81


def test_denoised_tiles_match_the_whole(spark):
    v = np.random.default_rng(6).poisson(20, (2, 24, 24)).astype(float)
    whole = recon.denoise(v, 0.1, 0.1, False, 4)[0]
    got = volume_of(restore.denoise_image(frame(spark, v), Grid(24, 24, 2), iterations=4, tile=12, overlap=9), Grid(24, 24, 2))
    assert np.abs(got - whole).mean() < 0.02 * whole.mean()


def test_iteration_metrics_fall(spark):
    v = np.random.default_rng(7).poisson(30, (1, 16, 16)).astype(float)
    k = np.outer([1, 2, 1], [1, 2, 1])[None] / 16
    rows = restore.iteration_metrics(to_tiles(frame(spark, v), Grid(16, 16), 16), k, recon.Options(iterations=6)).orderBy("iter").collect()
    assert [r.iter for r in rows] == list(range(6)) and rows[-1].error < rows[0].error and all(a.time <= b.time for a, b in zip(rows, rows[1:]))


def test_raw_slabs_logs_and_pictures(spark, tmp_path):
    v = np.random.default_rng(8).random((5, 4, 3)).astype("<f4").astype(float)
    convert.write_raw(frame(spark, v), str(tmp_path / "raw"), 3, 4, 2).collect()
    assert sorted(p.stat().st_size for p in (tmp_path / "raw").glob("*.raw")) == [48, 96, 96]
    assert (volume_of(convert.read_slabs(spark, str(tmp_path / "raw"), 3, 4), Grid(3, 4, 5)) == v).all()
    text = open(log.write_log(log.provenance(spark, "shift", by=2), str(tmp_path / "a.log.txt"))).read()
    assert "operation: shift" in text and "option.by: 2" in text
    dots = spark.createDataFrame([(1, 1.0, 2.0, 5.0, 1), (2, 2.0, 3.0, 9.0, 0)], "id long, x double, y double, value double, use int")
    for mode, ids in (("auto", [1]), ("threshold", [2]), ("first", [2])):
        assert [r.id for r in svg.selected(dots, mode, threshold=6.0, n=1).collect()] == ids
    picture = open(svg.write(frame(spark, v), dots, str(tmp_path / "p.svg"))).read()
    assert picture.count("<circle") == 2 and 'viewBox="0 0 3 4"' in picture


def test_stored_tables_are_released(spark):
    since = checkpoints.marks()
    df = checkpoints.stored(spark.range(5))
    assert df.count() == 5
    path = df.inputFiles()[0]
    checkpoints.release(since)
    import os

    assert not os.path.exists(path.replace("file://", "").replace("file:", ""))


def test_rates_with_a_watermark(spark, tmp_path):
    """A window is given out once the watermark has passed it; a row that comes later than that is left out."""
    from tessera import streaming

    batches = [[("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 3.0)], [("2024-01-01 05:00:00", 5.0)], [("2024-01-01 00:20:00", 100.0), ("2024-01-01 09:00:00", 7.0)]]
    (tmp_path / "in").mkdir()
    schema = "ts timestamp, event_type string, value double"
    stream = streaming.rates(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "t string, value double").select(F.to_timestamp("t").alias("ts"), F.lit("a").alias("event_type"), "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("hour(window.start) h", "n", "total").collect()
    assert sorted((r.h, r.n, r.total) for r in got) == [(0, 2, 4.0), (5, 1, 5.0)]


@pytest.mark.parametrize("method, border, start, stop", [("shb", 2, "flat", "fixed"), ("shb", 2, "smooth", "relative"), ("rl", 1, "identity", "fixed"), ("rl", 0, "flat", "absolute"), ("shb", 1, "flat", "absolute")])
def test_halo_exchange_equals_the_whole_array(spark, method, border, start, stop):
    """Tiles of 7 voxels and more: result, rounds and errors are those of one array."""
    r = np.random.default_rng(8)
    image = r.random((5, 23, 31)) * 50 + 1
    z, y, x = np.indices((3, 5, 3)) - np.array([1, 2, 1]).reshape(3, 1, 1, 1)
    kernel = np.exp(-(x * x + 0.4 * y * y + z * z) / 1.5) * (1 + 0.2 * x)
    tolerance = {"relative": 0.2, "absolute": 150.0}.get(stop, 0.0)
    o = recon.Options(method=method, iterations=6, border=border, start=start, stop=stop, tolerance=tolerance)
    want, made, errors = recon.deconvolve(image + o.offset, kernel, o)
    grid = Grid(31, 23, 5)
    got, told = halo.deconvolve(frame(spark, image), grid, kernel, o, side=7)
    assert np.allclose([x.error for x in told.orderBy("iter").collect()], errors, rtol=1e-9) and len(errors) == told.count()
    assert np.allclose(volume_of(got, grid), np.maximum(want - o.offset, 0), atol=1e-6)
    if stop != "fixed":
        assert 1 < len(errors) <= 6 and made == len(errors) - (len(errors) < 6 or made < 6)


def test_rounds_move_halos_only(spark):
    """The plan of a round has no exchange: tiles stay in their buckets."""
    rows = spark.range(40).selectExpr("cast(id % 8 as int) tile", "id")
    a, one = checkpoints.bucketed(rows, "tile", 4)
    b, two = checkpoints.bucketed(rows, "tile", 4)
    work = a.groupBy("tile").cogroup(b.groupBy("tile")).applyInArrow(lambda p, q: p.select(["tile", "id"]), "tile int, id long")
    assert work.count() == 40 and "Exchange" not in work._jdf.queryExecution().executedPlan().toString()
    for name in (one, two):
        checkpoints.drop_bucketed(spark, name)


def test_fourier_by_lines(spark, monkeypatch):
    """Transforms in parts of few lines equal those of the whole array."""
    monkeypatch.setattr(fourier, "LINES", 40)
    r = np.random.default_rng(12)
    v, k = r.random((3, 7, 10)), r.random((3, 3, 5))
    grid, size = Grid(10, 7, 3), Grid(5, 3, 3)
    want, got = np.fft.fftn(v), np.zeros(v.shape, complex)
    for p in fourier.transform(fourier.complex_rows(frame(spark, v)), grid).collect():
        got[p.z, p.y, p.x] = p.re + 1j * p.im
    assert np.allclose(got, want)
    padded = np.zeros((5, 9, 14))
    padded[1:4, 1:8, 2:12] = v
    slow = np.array([[[(padded[z : z + 3, y : y + 3, x : x + 5] * k[::-1, ::-1, ::-1]).sum() for x in range(10)] for y in range(7)] for z in range(3)])
    assert np.allclose(volume_of(fourier.convolve(frame(spark, v), grid, frame(spark, k), size), grid), slow)


def test_overlap_sums(spark):
    v = np.random.default_rng(13).random((6, 8))
    got = {(p.dx, p.dy): p.v for p in fourier.overlap_sums(frame(spark, v[None]), Grid(8, 6), ["v"]).collect()}
    assert len(got) == 15 * 11
    for (dx, dy), s in got.items():
        assert s == pytest.approx(v[max(0, dy) : 6 + min(0, dy), max(0, dx) : 8 + min(0, dx)].sum())


@pytest.mark.parametrize("kind", ["tif16", "tif32", "npy"])
def test_images_written_strip_by_strip(spark, monkeypatch, tmp_path, kind):
    """Strips of two or three rows: the files are those that one task would write of the whole image, strips and planes without voxels included."""
    monkeypatch.setattr(strips, "STRIP", 60)
    r = np.random.default_rng(14)
    one, two = r.random((3, 7, 9)) * 100, r.random((1, 4, 5)) * 7
    one[1], two[0, 2:] = 0, 0
    two[0, 3, 4] = 1
    rows = [(n, x, y, z, float(v[z, y, x])) for n, v in (("one", one), ("two", two)) for z, y, x in np.argwhere(v > 0).tolist()]
    df = spark.createDataFrame(rows, "image_id string, x int, y int, z int, v double").repartition(3)
    out = str(tmp_path)
    if kind == "npy":
        assert sorted(x.path for x in npy.write(df, out).collect()) == [f"{out}/one.npy", f"{out}/two.npy"]
        for n, v in (("one", one), ("two", two)):
            assert (tmp_path / f"{n}.npy").read_bytes() == npy.encode(v.astype("<f4"))
    else:
        bits = int(kind[3:])
        assert all(x.written for x in tiff.write(df, out, bits, description="some text", big=bits == 32).collect())
        for n, v in (("one", one), ("two", two)):
            scaled = np.clip(np.floor(v * (65535 / v.max()) + 0.5), 0, 65535) if bits == 16 else v
            assert (tmp_path / f"{n}.tif").read_bytes() == tiff.encode(scaled, bits, description="some text", big=bits == 32)
        (tmp_path / "two.tif").unlink()
        assert {x.path[-7:]: x.written for x in tiff.write(df, out, bits).collect()} == {"one.tif": False, "two.tif": True}
    assert not [f for f in tmp_path.iterdir() if f.is_dir()]


def test_table_rows_written_by_tasks(spark, tmp_path):
    df = spark.range(1000).selectExpr("id * 2.5 as a", "cast(1000 - id as double) as b").repartition(7).orderBy("b")
    path = npy.write_table(df, str(tmp_path / "t.npy"))
    a = np.load(path)
    assert a.shape == (1000, 2) and a[:, 1].tolist() == list(range(1, 1001)) and a[0, 0] == 2497.5


def test_mode_search_by_array_and_by_sums(spark, monkeypatch):
    r = np.random.default_rng(15)
    p = np.vstack([r.normal(0, 1, (150, 3)), r.normal(6, 0.7, (200, 3))])
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, x double, y double, z double")
    got = spatial.mode_search(df, 1.0)
    assert np.allclose(got, 6, atol=0.4)
    monkeypatch.setattr(spatial, "TOGETHER", 3)
    assert np.allclose(spatial.mode_search(df, 1.0), got, atol=1e-5)


def plain_search(d, capture, sigma):
    """The search with every density summed over all differences."""
    density = lambda at: sum(w for v in d if (r := ((v - at) ** 2).sum()) < (2.5 * sigma) ** 2 for w in [np.exp(-r / (2 * sigma * sigma))])
    n = int(np.ceil(4 * capture)) + 1
    grid = [np.array([x, y, z]) * 2 * capture / (n - 1) - capture for z in range(n) for y in range(n) for x in range(n)]
    grid = [(density(g), g) for g in grid if (g * g).sum() <= capture * capture]
    top, best = max(grid, key=lambda t: t[0])
    size = sigma
    while size > 1e-4:
        centre = best
        for x in range(-7, 8):
            for y in range(-7, 8):
                for z in range(-7, 8):
                    if x * x + y * y + z * z <= 49:
                        at = centre + np.array([x, y, z]) * size / 7
                        if (v := density(at)) > top * (1 + 1e-11):
                            top, best = v, at
        size /= 2
    return best, top, max((v for v, g in grid if ((g - best) ** 2).sum() >= (2 + sigma) ** 2), default=0.0)


@pytest.mark.parametrize("together, kept", [(1_000_000, 1 << 22), (3, 10)])
def test_displacement_search_against_plain_sums(spark, monkeypatch, together, kept):
    """In one task or where the differences lie, on a grid that a task holds or not: the same as plain sums."""
    monkeypatch.setattr(spatial, "TOGETHER", together)
    monkeypatch.setattr(spatial, "KEPT", kept)
    r = np.random.default_rng(5)
    a = r.random((14, 3)) * (9, 9, 3)
    b = np.vstack([a[:9] - (1.3, -0.7, 0.4) + r.normal(0, 0.2, (9, 3)), r.random((4, 3)) * 9])
    d = np.array([p - q for p in a for q in b if ((p - q) ** 2).sum() < 9])
    best, top, second = plain_search(d, 3.0, 0.5)
    make = lambda v: spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(v)], "id long, x double, y double, z double")
    got = spatial.displacement_search(make(a), make(b), 3.0, 0.5).first()
    assert (got.dx, got.dy, got.dz) == pytest.approx(tuple(best), abs=2e-4)
    assert (got.kde, got.second, got.goodness) == pytest.approx((top, second, (top - second) / (top + second)), rel=1e-6)


def test_displacement_search_of_nothing(spark):
    one = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert spatial.displacement_search(one, one.where("id > 0"), 3.0, 0.5).count() == 0
    assert spatial.displacement_search(one, one.selectExpr("id", "x + 50 as x", "y", "z"), 3.0, 0.5).count() == 0
    same = spatial.displacement_search(one, one, 3.0, 0.5).first()
    assert (same.dx, same.kde, same.second, same.goodness) == (0.0, 1.0, 0.0, 1.0)


class Counting:
    """A file that counts the bytes that are read."""

    def __init__(self, f, counts):
        self.f, self.counts = f, counts

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def seek(self, at):
        self.f.seek(at)

    def read(self, n=None):
        data = self.f.read(n)
        self.counts.append(len(data))
        return data


@pytest.mark.parametrize("module, source, data", [(tiff, tiff.TiffSource, lambda v: tiff.encode(v, 32)), (npy, npy.NpySource, lambda v: npy.encode(v.astype("<f4")))])
def test_bounds_decide_what_is_read(spark, tmp_path, monkeypatch, module, source, data):
    from tessera.sources.boxes import options_of

    v = np.arange(6 * 50 * 40, dtype=float).reshape(6, 50, 40)
    for name in "ab":
        (tmp_path / f"{name}.x").write_bytes(data(v + (name == "b")))
    counts, real = [], module.open_in
    head = 0 if module is tiff else 200
    with monkeypatch.context() as m:
        m.setattr(module, "open_in", lambda p: Counting(real(p), counts))

        def read(**bounds):
            reader = source({"path": str(tmp_path)} | options_of(**bounds)).reader(None)
            parts = reader.partitions()
            counts.clear()
            return [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()], sum(counts)

        one = [f"{tmp_path}/a.x"]
        rows, size = read(images=one, z=2)
        assert size <= 50 * 40 * 4 + head and [r["v"] for r in rows] == list(v[2].ravel())
        rows, size = read(images=one, z=2, y=(10, 11), x=(3, 9))
        assert size <= 2 * 40 * 4 + head and {(r["x"], r["y"]) for r in rows} == {(x, y) for x in range(3, 10) for y in (10, 11)}
        assert read(z=9) == ([], 0) and read(images=["none"]) == ([], 0) and read(images=[]) == ([], 0)
        assert read(y=(49, 3))[0] == [] and read(x=-1)[0] == [] and len(read()[0]) == 2 * v.size
    load = lambda **bounds: sources.read(spark, source.name(), str(tmp_path), **bounds)
    assert load(z=(4, 99)).count() == 2 * 2 * 50 * 40 and load(z=1).unionByName(load(z=3, x=(-3, 0))).count() == 2 * 50 * 41 and load().where("z = 1").union(load()).count() == 2 * 7 * 50 * 40


def test_images_arrive_once(spark, tmp_path):
    """Batches of one start; a batch that fails and is repeated, a restart, files that stay and files without a whole name."""
    folder, out, check = (str(tmp_path / k) for k in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    put = lambda name, n: (tmp_path / "in" / name).write_bytes(tiff.encode(np.full((1, 2, 2), n)))
    put("b.tif", 1), put("c.tif", 2), put("_d.tif", 50), put("notes.txt", 60)
    total = lambda b: b.groupBy("image_id").agg(F.sum("v").alias("v"))

    def fails(batch):
        raise ValueError("lost")

    with pytest.raises(Exception):
        streaming.watch_images(spark, folder, fails, out, check).awaitTermination(120)
    put("a.tif", 4)  # sorts before what has been seen
    for _ in range(3):
        streaming.watch_images(spark, folder, total, out, check).awaitTermination(120)
    put("e.tif", 8)
    streaming.watch_images(spark, folder, total, out, check).awaitTermination(120)
    got = spark.read.parquet(out)
    assert {r.image_id[-5:]: r.v for r in got.collect()} == {"a.tif": 16.0, "b.tif": 4.0, "c.tif": 8.0, "e.tif": 32.0} and got.count() == 4
    assert got.where("image_id like '%b.tif' or image_id like '%c.tif'").select("batch").distinct().count() == 1


def test_table_functions_of_images(spark, tmp_path):
    """SQL over blocks and over whole images equals the operators; halos wider than a block, missing columns, planes, more rows than a batch."""
    from tessera.functions import register

    register.register(spark)
    v, w = (np.random.default_rng(k).random((5, 60, 50)) * 100 for k in (1, 2))
    grid, one = Grid(50, 60, 5), frame(spark, v)
    one.withColumn("image_id", F.lit("a")).unionByName(frame(spark, w).withColumn("image_id", F.lit("b"))).withColumn("other", F.lit(3)).createOrReplaceTempView("voxels_two")
    one.createOrReplaceTempView("voxels_one")
    cut = "TABLE(SELECT * FROM tessera_blocks(TABLE(voxels_two), {}, {}, {}, {})) PARTITION BY (image_id, block)"
    want = {"a": volume_of(stencil.smooth(one, grid, 1.0, 0.6), grid), "b": volume_of(stencil.smooth(frame(spark, w), grid, 1.0, 0.6), grid)}
    for table in ("TABLE(voxels_two) PARTITION BY (image_id)", cut.format(20, 9, 8, 4), cut.format(3, 2, 8, 4)):
        got = spark.sql(f"SELECT * FROM tessera_smooth({table}, 1.0D, 0.6D)").cache()
        assert got.count() == 2 * v.size
        assert all(np.allclose(volume_of(got.where(F.col("image_id") == k), grid), want[k]) for k in want)
    assert np.allclose(volume_of(spark.sql("SELECT * FROM tessera_smooth(TABLE(voxels_one) WITH SINGLE PARTITION, 1.0D, 0.6D)"), grid), want["a"])
    dots = {(r.x, r.y, r.z) for r in spark.sql(f"SELECT * FROM tessera_maxima({cut.format(16, 4, 5, 5)}, 0.9D, 0.9D) WHERE image_id = 'a'").collect()}
    assert dots and dots == {(r.x, r.y, r.z) for r in stencil.log_maxima(one, grid, 0.9, 0.9).collect()}
    got = volume_of(spark.sql("SELECT * FROM tessera_deconvolve(TABLE(voxels_one) WITH SINGLE PARTITION, 0.8D, 0.5D, 3)"), grid)
    g, d = np.array(stencil.gaussian(0.8)), np.array(stencil.gaussian(0.5))
    assert np.allclose(got, np.maximum(recon.deconvolve(v + 5, d[:, None, None] * g[:, None] * g, recon.Options(iterations=3))[0] - 5, 0))
    spark.sql(f"SELECT * FROM tessera_write(TABLE(voxels_two) PARTITION BY (image_id), '{tmp_path}')").write.saveAsTable("tessera_written_files", mode="overwrite", path=str(tmp_path / "told"))
    back = spark.sql("SELECT * FROM tessera_read(TABLE(SELECT path FROM tessera_written_files WHERE path LIKE '%b.tif'))")
    assert np.allclose(volume_of(back, grid), w.astype("f4"))
    assert spark.sql("SELECT * FROM tessera_smooth(TABLE(SELECT * FROM voxels_one WHERE x < 0) WITH SINGLE PARTITION, 1D, 1D)").count() == 0
    assert spark.sql("SELECT * FROM tessera_grid(2, 3, 4)").distinct().count() == 24 and spark.sql("SELECT * FROM tessera_grid(2, 0, 4)").count() == 0
    spark.sql("DROP TABLE tessera_written_files")


def test_few_points_are_aligned_by_the_grid(spark):
    """Sets too small to vote by pairs."""
    from tessera.plans import align

    a = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 40.0, 30.0, 5.0)], "id long, x double, y double, z double")
    got = align.align(a, a.selectExpr("id", "x + 1.2 as x", "y - 2.3 as y", "z + 0.4 as z"))
    assert got.method == "grid" and (got.dx, got.dy, got.dz) == pytest.approx((1.2, -2.3, 0.4), abs=1e-3) and align.VOTERS == 250
