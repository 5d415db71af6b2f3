"""Dense kernels, generators, fits, files and streams: properties, planted truths and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import sources, streaming
from tessera.functions import gamma_from_fwhm, gauss, lorentz, register, sigma_from_fwhm
from tessera.model import Grid, to_tiles, to_voxels
from tessera.operators import agg, fit, forest, geometry, morph, psf, recon, spatial, stencil
from tessera.plans import align, dots, nuclei, restore
from tessera.sources import convert, npy, png, tables, tiff


def frame(spark, volume):
    z, y, x = np.indices(volume.shape)
    rows = [(int(a), int(b), int(c), float(v)) for a, b, c, v in zip(x.ravel(), y.ravel(), z.ravel(), volume.ravel())]
    return spark.createDataFrame(rows, "x int, y int, z int, v double")


def volume_of(df, grid):
    out = np.zeros((grid.nz, grid.ny, grid.nx))
    for r in df.collect():
        out[r.z, r.y, r.x] = r.v
    return out


def test_grid_fill_and_tiles(spark):
    grid = Grid(5, 4, 2)
    v = np.arange(40.0).reshape(2, 4, 5)
    df = frame(spark, v)
    assert volume_of(grid.fill(df.where("x <> 2")), grid)[:, :, 2].sum() == 0
    assert (volume_of(to_voxels(to_tiles(df, grid, 3)), grid) == v).all()


def test_fwhm_identities(spark):
    rows = spark.range(10, 101).select((F.col("id") / 10).alias("w"))
    g = rows.select((gauss(F.col("w") / 2, sigma_from_fwhm(F.col("w"))) / gauss(F.lit(0.0), sigma_from_fwhm(F.col("w")))).alias("r"), (lorentz(F.col("w") / 2, F.lit(0.0), gamma_from_fwhm(F.col("w"))) / lorentz(F.lit(0.0), F.lit(0.0), gamma_from_fwhm(F.col("w")))).alias("q"))
    for r in g.collect():
        assert r.r == pytest.approx(0.5, abs=1e-9) and r.q == pytest.approx(0.5, abs=1e-9)


def test_mirror_of_long_kernels(spark):
    v = np.arange(4.0).reshape(1, 1, 4)
    taps = [1.0] * 11
    got = volume_of(stencil.convolve(frame(spark, v), "x", taps, "mirror"), Grid(4, 1, 1)).ravel()
    padded = np.pad(v.ravel(), 5, mode="reflect")
    assert np.allclose(got, np.convolve(padded, taps, "valid"))


def test_local_maxima_of_an_impulse(spark):
    v = np.zeros((5, 9, 9))
    v[2, 4, 5] = 1
    got = morph.local_maxima(stencil.laplacian_of_gaussian(frame(spark, v), Grid(9, 9, 5), 1.0, 1.0), Grid(9, 9, 5)).orderBy(F.col("v").desc()).first()
    assert (got.x, got.y, got.z) == (5, 4, 2)


def test_components_match_flood_fill(spark):
    m = (np.random.default_rng(2).random((12, 15)) < 0.55).astype(float)
    label, want = 0, np.zeros(m.shape, int)
    for y in range(12):
        for x in range(15):
            if m[y, x] and not want[y, x]:
                label += 1
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < 12 and 0 <= b < 15 and m[a, b] and not want[a, b]:
                        want[a, b] = label
                        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    got = np.zeros(m.shape, int)
    for r in morph.components(frame(spark, m[None]), Grid(15, 12)).collect():
        got[r.y, r.x] = r.label
    assert (got == want).all()


def test_components_of_nothing(spark):
    assert morph.components(frame(spark, np.zeros((1, 3, 3))), Grid(3, 3)).count() == 0


def test_deconvolution_sharpens():
    rng = np.random.default_rng(0)
    truth = np.zeros((1, 40, 40))
    truth[0, rng.integers(5, 35, 6), rng.integers(5, 35, 6)] = 500
    k = np.exp(-0.5 * (np.arange(-4, 5)[:, None] ** 2 + np.arange(-4, 5)[None, :] ** 2) / 2.0)[None]
    k /= k.sum()
    wide = np.zeros(truth.shape)
    wide[:, :9, :9] = k
    blurred = np.fft.irfftn(np.fft.rfftn(truth) * np.fft.rfftn(np.roll(wide, (-4, -4), (1, 2))), truth.shape, axes=(0, 1, 2)) + 5
    for method in ("rl", "shb"):
        for border in (0, 1, 2):
            got, made, errors = recon.deconvolve(blurred, k, recon.Options(method, 60, border))
            assert made == 60 and errors[-1] < errors[0] / 10 and got.max() > 2 * blurred.max()
    assert recon.deconvolve(blurred, k, recon.Options("identity"))[1] == 0
    assert recon.deconvolve(blurred, k, recon.Options("shb", 200, 0, stop="relative"))[1] < 200


def test_dense_and_row_iterations_agree(spark):
    v = np.random.default_rng(1).integers(1, 50, (1, 1, 24)).astype(float)
    taps = [0.25, 0.5, 0.25]
    for method, rows in (("rl", recon.richardson_lucy_rows), ("shb", recon.heavy_ball_rows)):
        dense = recon.deconvolve(v, np.array(taps).reshape(1, 1, 3), recon.Options(method, 4, 0, floor=0.01))[0]
        assert np.allclose(volume_of(rows(frame(spark, v), {"x": taps}, 4), Grid(24, 1)), dense, atol=1e-9)


def test_smooth_sizes():
    assert [recon.next_smooth(n) for n in (1, 17, 97, 2048)] == [1, 18, 98, 2048]


def test_denoise_lowers_its_objective():
    rng = np.random.default_rng(3)
    v = np.full((1, 20, 20), 10.0) + rng.normal(0, 1, (1, 20, 20))
    got, values = recon.denoise(v, 0.3, 0.0, iterations=30)
    assert values == sorted(values, reverse=True) and got.std() < v.std()


def test_bessel():
    assert psf.j0(np.array([0.0, 2.404825557695773, 5.520078110286311, 250.0])) == pytest.approx([1, 0, 0, -0.0260], abs=2e-3)
    x = np.array([199.0, 201.0])
    t = (np.arange(4000) + 0.5) * math.pi / 4000
    assert psf.j0(x) == pytest.approx(np.cos(x[:, None] * np.sin(t)).mean(axis=1), abs=1e-6)


def test_psf_volumes(spark):
    for df in (psf.born_wolf(spark, nxy=11, nz=5), psf.angular_spectrum(spark, 500.0, nxy=15, nz=3), psf.angular_spectrum(spark, 500.0, 480.0, nxy=15, nz=3)):
        rows = df.collect()
        assert sum(r.v for r in rows) == pytest.approx(1)
        top = max(rows, key=lambda r: r.v)
        half = max(r.x for r in rows) // 2, max(r.z for r in rows) // 2
        assert abs(top.x - half[0]) <= 1 and abs(top.y - half[0]) <= 1 and top.z == half[1]
    r = np.linspace(0, 600, 25)
    a, b = psf.born_wolf_profile(r, 300.0, 461.0, 1.45, 1.512), psf.born_wolf_series(r, 300.0, 461.0, 1.45, 1.512)
    assert np.allclose(a, b, atol=2e-3 * a.max())


def test_planted_dot_is_fitted(spark):
    z, y, x = np.indices((11, 15, 15))
    g = np.exp(-0.5 * ((x - 7.3) ** 2 + (y - 6.8) ** 2) / 1.4**2 - 0.5 * ((z - 5.2) / 1.8) ** 2)
    v = 20 + 4000 * g / g.sum()
    got = fit.fit_dots(frame(spark, v), spark.createDataFrame([(3, 7.0, 7.0, 5.0)], "id long, x double, y double, z double"), Grid(15, 15, 11), 1.4, 1.8).first()
    assert (got.f_x, got.f_y, got.f_z) == pytest.approx((7.3, 6.8, 5.2), abs=0.05)
    assert got.f_sigma_lateral == pytest.approx(1.4, rel=0.1) and got.f_corr > 0.99


def test_dots_pipeline_finds_planted_dots(spark):
    rng = np.random.default_rng(4)
    v = np.full((7, 24, 24), 10.0) + rng.random((7, 24, 24))
    z, y, x = np.indices(v.shape)
    for a, b, c in ((5, 6, 3), (17, 8, 3), (11, 18, 2)):
        v += 300 * np.exp(-0.5 * ((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2))
    got = dots.detect(frame(spark, v), Grid(24, 24, 7), 1.0, 1.0, n=3).collect()
    assert {(r.x, r.y, r.z) for r in got} == {(5, 6, 3), (17, 8, 3), (11, 18, 2)} and got[0].use == 1
    assert [r.value for r in got] == sorted((r.value for r in got), reverse=True)


def points(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")


def test_nearest_of_identical_points(spark):
    p = points(spark, np.zeros((12, 3)))
    got = spatial.nearest(p, p, 3).orderBy("qid", "rank").collect()
    assert len(got) == 36 and all(r.d2 == 0 and r.pid == r["rank"] - 1 for r in got)


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((40, 3)) * 10, rng.random((90, 3)) ** 3 * 10
    got = {(r.qid, r["rank"]): r.pid for r in spatial.nearest(points(spark, a), points(spark, b), 4).collect()}
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    for q in range(40):
        assert [got[q, k] for k in (1, 2, 3, 4)] == np.argsort(d[q], kind="stable")[:4].tolist()
    assert spatial.nearest(points(spark, a), points(spark, b).where("false"), 2).count() == 0


def test_planted_shift_is_found(spark):
    rng = np.random.default_rng(6)
    a = rng.random((60, 3)) * (500, 500, 30)
    delta = np.array([4.21, 2.67, -1.001])
    b = np.vstack([a[:25] + delta, rng.random((20, 3)) * (500, 500, 30)])
    got = align.align(points(spark, a), points(spark, b), sigma=0.4)
    assert (got.dx, got.dy, got.dz) == pytest.approx(tuple(delta), abs=0.05)
    assert got.goodness > 0.9 and got.method == "pairs"


def test_grid_search_refines_the_shift(spark):
    rng = np.random.default_rng(11)
    a = rng.random((40, 3)) * (300, 300, 20)
    b = a + (3.3, -2.2, 0.7)
    got = spatial.displacement_search(points(spark, b), points(spark, a), 6.0, 0.4).first()
    assert (got.dx, got.dy, got.dz) == pytest.approx((3.3, -2.2, 0.7), abs=1e-3) and got.goodness > 0.8


def test_tiled_deconvolution_equals_whole(spark):
    rng = np.random.default_rng(12)
    v = rng.integers(1, 100, (1, 24, 24)).astype(float)
    k = np.outer([1, 2, 1], [1, 2, 1])[None] / 16
    o = recon.Options(iterations=4)
    whole = volume_of(restore.deconvolve_image(frame(spark, v), Grid(24, 24), k, o, tile=64), Grid(24, 24))
    tiled = volume_of(restore.deconvolve_image(frame(spark, v), Grid(24, 24), frame(spark, k), o, tile=12, overlap=9), Grid(24, 24))
    assert np.allclose(whole, np.maximum(recon.deconvolve(v + 5, k, o)[0] - 5, 0))
    assert np.abs(tiled - whole).mean() < 0.05 * whole.mean()
    with pytest.raises(ValueError):
        restore.deconvolve_image(frame(spark, v * 0), Grid(24, 24), k)


def test_registration(spark):
    v = np.zeros((1, 16, 16))
    v[0, 4:7, 5:9] = 9
    moved = np.roll(v, (3, -2), (1, 2))
    assert restore.register(frame(spark, moved), frame(spark, v), Grid(16, 16)) == (-2, 3)
    got = volume_of(restore.shift_image(frame(spark, moved), Grid(16, 16), reference=frame(spark, v)), Grid(16, 16))
    assert (got == v).all()


def test_conversions(tmp_path, spark):
    v = np.random.default_rng(2).random((3, 4, 5)).astype("<f4")
    (tmp_path / "a.raw").write_bytes(v.tobytes())
    convert.raw_to_tiff(spark, str(tmp_path / "a.raw"), str(tmp_path / "t"), 5, 4, 3, 32).collect()
    convert.tiff_to_npy(spark, str(tmp_path / "t"), str(tmp_path / "n")).collect()
    convert.npy_to_tiff(spark, str(tmp_path / "n"), str(tmp_path / "b")).collect()
    assert (np.load(tmp_path / "n" / "a.npy") == v).all()
    assert (tmp_path / "b" / "a.tif").exists()
    with pytest.raises(ValueError):
        convert.read_raw(spark, str(tmp_path / "a.raw"), 5, 4, 4)


def test_pixel_integrals_match_a_fine_grid():
    """Adaptive integrals of the model over pixels, against a grid of 60 x 60 Gauss-Legendre nodes in each."""
    nodes, w = np.polynomial.legendre.leggauss(60)
    for z, wavelength, na in ((0.0, 461.0, 1.45), (600.0, 520.0, 1.2)):
        x0, y0 = np.array([-65.0, 65.0, 325.0, 455.0]), np.array([-65.0, -65.0, 195.0, 455.0])
        got = psf.pixel_integrals(x0, y0, z, wavelength, na, 1.512, 130.0)
        lines = psf.line_integrals(x0, y0, z, wavelength, na, 1.512, 130.0)
        for k in range(4):
            x, y = x0[k] + 65 * (nodes + 1), y0[k] + 65 * (nodes + 1)
            v = psf.born_wolf_profile(np.sqrt(x[None, :] ** 2 + y[:, None] ** 2).ravel(), z, wavelength, na, 1.512).reshape(60, 60)
            assert got[k] == pytest.approx((v * w[None, :] * w[:, None]).sum() / 4, abs=1e-7)
            at = psf.born_wolf_profile(np.sqrt(x**2 + y0[k] ** 2), z, wavelength, na, 1.512)
            assert lines[k] == pytest.approx((at * w).sum() / 2, abs=1e-7)


def test_adaptive_halves_where_it_must():
    a, b = np.array([0.0, 0.0, -1.0, 2.0]), np.array([1.0, np.pi, 1.0, 2.0])
    seen = []

    def f(k, x):
        seen.append(len(x))
        return np.select([k == 0, k == 1, k == 2], [np.exp(x), np.sin(x), np.sqrt(np.abs(x))], 1.0)

    got = psf.adaptive(f, a, b, 1e-10)
    assert np.allclose(got, [np.e - 1, 2, 4 / 3, 0], atol=1e-8) and sum(seen) < 3000


def test_sql_functions(spark):
    register.register(spark)
    assert spark.sql("SELECT tessera_lateral_resolution(500D, 1.25D) AS a").first().a == 200
    assert spark.sql("SELECT tessera_j0(0D) AS a").first().a == pytest.approx(1)
    assert spark.sql("SELECT * FROM tessera_psf_profile(0D, 461D, 1.4D, 1.5D, 50D, 8)").count() == 8
    assert spark.sql("SELECT * FROM tessera_grid(2, 3, 4)").count() == 24


def test_forest_learns_and_predicts(spark):
    rng = np.random.default_rng(7)
    x = rng.random((300, 4))
    y = (x[:, 0] > 0.5).astype(int) + 2 * (x[:, 1] > 0.4)
    df = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, label int")
    for kind in ("gini", "entropy"):
        nodes = forest.fit(df, list("abcd"), trees=40, kind=kind)
        got = forest.predict(df, nodes, list("abcd"))
        assert forest.accuracy(got).first().accuracy > 0.9
        imp = {r.name: r.importance for r in forest.importance(nodes, list("abcd")).collect()}
        assert imp["a"] + imp["b"] > 0.6 and sum(imp.values()) == pytest.approx(1)


def test_tree_expression_equals_walk(spark):
    rng = np.random.default_rng(8)
    x = rng.random((80, 2))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0.6)).astype(int)
    nodes = forest.grow_tree(x, y, 2, np.array([0, 1]), 1, "gini")
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = df.select("id", forest.tree_expression([n[:6] for n in nodes], ["a", "b"]).alias("p")).orderBy("id").collect()
    assert [r.p for r in got] == y.tolist()


def test_pixel_classifier(spark):
    v = np.zeros((1, 16, 16))
    v[0, 4:12, 4:12] = 100
    plane = frame(spark, v + np.random.default_rng(9).random(v.shape))
    marks = spark.createDataFrame([(x, y, int(4 <= x < 12 and 4 <= y < 12)) for x in range(0, 16, 2) for y in range(0, 16, 2)], "x int, y int, label int")
    nodes, names = nuclei.train(plane, marks, [1.0], trees=15)
    got = nuclei.classify(plane, nodes, names, [1.0]).collect()
    assert np.mean([r.prediction == int(4 <= r.x < 12 and 4 <= r.y < 12) for r in got]) > 0.9


def test_kfold_and_subset(spark):
    df = spark.range(50).withColumnRenamed("id", "row")
    assert {r.fold: r["count"] for r in agg.kfold(df, "row", 5).groupBy("fold").count().collect()} == dict.fromkeys(range(5), 10)
    a, b = ({r.row for r in agg.random_subset(df, "row", 20, s).collect()} for s in (1, 1))
    assert a == b and len(a) == 20


def test_positional_concatenation_checks_length(spark):
    a = spark.createDataFrame([(0, 1.0)], "_row long, a double")
    with pytest.raises(ValueError):
        agg.concatenate_columns(a, a.limit(0).withColumnRenamed("a", "b"))


def test_tiling_division():
    for n, most in ((32, 12), (7, 7), (100, 33), (5, 2)):
        parts = geometry.divide(n, most)
        assert parts[0][0] == 0 and parts[-1][1] == n - 1 and all(b - a + 1 <= most for a, b in parts) and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))


def test_tiff_formats(tmp_path, spark):
    sources.register(spark)
    v = np.random.default_rng(0).integers(0, 60000, (3, 5, 4))
    for k, (bits, big) in enumerate(((16, False), (16, True), (32, False), (32, True))):
        (tmp_path / f"{k}.tif").write_bytes(tiff.encode(v, bits, "ImageJ=1\nimages=3", (2.0, 3.0), big=big))
    got = spark.read.format("tessera_tiff").options(path=str(tmp_path), planes=2).load()
    assert got.count() == 4 * v.size
    for r in got.collect():
        assert r.v == v[r.z, r.y, r.x]
    assert all(r.supported and (r.m, r.n, r.p) == (4, 5, 3) for r in tiff.info(spark, str(tmp_path)).collect())
    assert tiff.flat_description("ImageJ=1\nimages=3\nloop=1") == "ImageJ=1\nloop=1" and tiff.flat_description("images=3") == "images=3"
    with pytest.raises(ValueError):
        tiff.directories(__import__("io").BytesIO(b"nothing like it at all"))


def test_npy_types(tmp_path, spark):
    sources.register(spark)
    for kind in npy.TYPES:
        (tmp_path / f"{kind}.npy").write_bytes(npy.encode(np.arange(24).astype(kind).reshape(2, 3, 4)))
    (tmp_path / "order.npy").write_bytes(npy.encode(np.asfortranarray(np.arange(24.0).reshape(2, 3, 4))))
    got = spark.read.format("tessera_npy").option("path", str(tmp_path)).load().collect()
    assert len(got) == 24 * 11 and all(r.v == r.x + 4 * r.y + 12 * r.z for r in got)
    with pytest.raises(ValueError):
        npy.encode(np.zeros(3), "f4")


def test_png_filters(spark, tmp_path):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    assert (png.decode(png.encode(rgb)) == rgb).all()
    import struct
    import zlib

    lines, flat = b"", rgb.reshape(6, -1).astype(int)
    for y, kind in enumerate((0, 1, 2, 3, 4, 1)):
        above = flat[y - 1] if y else np.zeros(15, int)
        left = np.concatenate([[0, 0, 0], flat[y][:-3]])
        corner = np.concatenate([[0, 0, 0], above[:-3]])
        paeth = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, above, corner)]
        guess = (0 * left, left, above, (left + above) // 2, np.array(paeth))[kind]
        lines += bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines))
    assert (png.decode(data) == rgb).all()


def test_table_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"]).toDF("a", "b", "a")
    assert df.toDF("a__0", "b", "a").select("a").first()[0] == 3
    with pytest.raises(KeyError):
        tables.column(df, "q")


def test_stream_of_files(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0)], "g int, v double").repartition(3).write.parquet(src)
    q = streaming.watch_tables(spark, src, "g int, v double", lambda b: b.groupBy("g").agg(F.sum("v").alias("v")), str(tmp_path / "out"), str(tmp_path / "ck"), 1)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("g").agg(F.sum("v").alias("v")).collect()
    assert {r.g: r.v for r in got} == {1: 5.0, 2: 5.0}
