"""Whole pipelines, and operators that are met within them, as queries of their own."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera import sources, views
from tessera.functions import images
from tessera.model import AXES, Grid, to_tiles, to_voxels
from tessera.operators import agg, fit, forest, geometry, morph, psf, recon
from tessera.plans import dots, nuclei, restore
from tessera.queries import volumes
from tessera.queries.files import _folder
from tessera.queries.sql import Sql, r6
from tessera.queries.volumes import DOTS_SQL, G2, G3, rounded
from tessera.sources import convert, log, svg, tables, tiff

Q: dict = {}
S: dict[str, str] = {}


def add(name: str, run, sql: str | None = None) -> None:
    Q[name] = run
    if sql is not None:
        S[name] = sql


def g3(text: str) -> str:
    q = Sql()
    return q.out(text.format(g=q.cte(views.GRID3_SQL)))


def g2(text: str) -> str:
    q = Sql()
    return q.out(text.format(g=q.cte(views.GRID2_SQL)))


# ---------------------------------------------------------------- reconstruction
def _psf(spark):
    return psf.sted(spark, 2.5, 2.0, 7, 3)


add("deconvolve_image", lambda s, d: restore.deconvolve_image(views.grid3(s, d), G3, _psf(s), recon.Options(iterations=10), tile=16, overlap=6))
add("deconvolve_identity", lambda s, d: rounded(restore.deconvolve_image(views.grid3(s, d), G3, _psf(s), recon.Options(method="identity"), tile=16, overlap=6)), g3("SELECT x, y, z, " + r6("v") + " AS v FROM {g}"))
add("iteration_metrics", lambda s, d: restore.iteration_metrics(to_tiles(views.grid3(s, d), G3, 16), _psf(s), recon.Options(iterations=8)).drop("time"))
add("denoise_image", lambda s, d: restore.denoise_image(views.grid3(s, d), G3, iterations=5, tile=16, overlap=4))


def _cropped(s, d):
    """The volume as a kernel would be cut: weak margins, to its brightest plane, to what an image of 5 x 3 x 2 meets, to odd sizes."""
    kernel = geometry.trim_margin(views.grid3(s, d), "x", 0.98)
    kernel, grid = geometry.centre_z(kernel, Grid(kernel.agg(F.max("x")).first()[0] + 1, G3.ny, G3.nz))
    kernel, grid = geometry.crop_by_image(kernel, grid, Grid(5, 3, 2))
    odd, _ = geometry.make_odd(kernel.where("x < 4"), Grid(4, grid.ny, grid.nz))
    return odd


add(
    "kernel_crops",
    _cropped,
    """WITH g AS MATERIALIZED (SELECT * FROM ("""
    + views.GRID3_SQL
    + """) t), s AS (SELECT x, sum(v) AS s FROM g GROUP BY x), k AS (SELECT min(x) AS a, max(x) - min(x) + 1 AS w FROM s WHERE s >= 0.98 * (SELECT max(s) FROM s)),
t AS MATERIALIZED (SELECT x - a AS x, y, z, v, w FROM g, k WHERE x BETWEEN a AND a + w - 1),
h AS (SELECT z AS top, least(z, 3 - z) AS half FROM (SELECT z, max(v) AS m FROM t GROUP BY z) q ORDER BY m DESC, z LIMIT 1),
c AS (SELECT CASE WHEN w > 9 THEN x - ((w - 1) // 2 - 4) ELSE x END AS x, y - 13 AS y, z - (top - half) AS z, v FROM t, h WHERE z BETWEEN top - half AND top + half AND y BETWEEN 13 AND 17)
SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(d.i AS INT) AS z, coalesce(v, 0.0) AS v FROM range(5) a(i) CROSS JOIN range(5) b(i) CROSS JOIN range(4) d(i) JOIN h ON d.i <= 2 * half LEFT JOIN c ON c.x = a.i AND c.y = b.i AND c.z = d.i AND a.i < 4""",
)
# ---------------------------------------------------------------- registration
def _moved(s, d):
    plane = views.grid2(s, d)
    return geometry.circular_shift(plane, G2, (5, -3, 0)), plane


add("register_shift", lambda s, d: s.createDataFrame([restore.register(*_moved(s, d), G2)], "dx int, dy int"), "SELECT 5 AS dx, -3 AS dy FROM (SELECT count(*) FROM lineitem) t")
add("shift_onto_reference", lambda s, d: restore.shift_image(_moved(s, d)[0], G2, reference=_moved(s, d)[1]), g2("SELECT x, y, z, CASE WHEN x <= 26 AND y >= 3 THEN v ELSE 0.0 END AS v FROM {g}"))


# ---------------------------------------------------------------- conversions and files
def _raw_to_tiff(s, d):
    sources.register(s)
    raw, out = _folder(s, "raw"), _folder(s, "tiff")
    convert.write_raw(views.grid3(s, d), raw, 32, 32, 2).collect()
    slabs = convert.read_slabs(s, raw, 32, 32).withColumn("image_id", F.lit("grid"))
    tiff.write(slabs, out, bits=32).collect()
    return s.read.format("tessera_tiff").option("path", out).load().select(*AXES, "v")


def _there_and_back(s, d):
    first, second, third = (_folder(s, k) for k in ("tiff", "npy", "tiff"))
    tiff.write(views.grid3(s, d).withColumn("image_id", F.lit("grid")), first, bits=32).collect()
    convert.tiff_to_npy(s, first, second).collect()
    convert.npy_to_tiff(s, second, third).collect()
    return s.read.format("tessera_tiff").option("path", third).load().select(*AXES, "v")


def _log(s, d):
    """The log of a run over the whole volume; seconds and bytes differ from run to run and are left out here."""
    options = recon.Options(iterations=2)
    out, told = log.measured(s, "deconvolve", lambda: restore.deconvolve_image(views.grid3(s, d), G3, _psf(s), options, tile=16, overlap=6), iterations=options.iterations, method=options.method)
    path = _folder(s, "logs") + "/run.log.txt"
    log.write_log(told, path)
    return s.read.text(path).select(F.split_part("value", F.lit(": "), F.lit(1)).alias("key"), F.split_part("value", F.lit(": "), F.lit(2)).alias("value")).where("key like 'option%' or key in ('operation', 'rows')")


def _metrics_file(s, d):
    """A table of measures an hour, through the sink and back."""
    out = _folder(s, "metrics")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) - 473352
    tables.write(views.table(s, d, "events").groupBy(hour.cast("int").alias("iter")).agg(F.count(F.lit(1)).cast("double").alias("time"), F.avg("value").alias("error")), out)
    return tables.read(s, out).select(F.col("iter").cast("int").alias("iter"), F.col("time").cast("double").alias("time"), F.round(F.col("error").cast("double"), 2).alias("error"))


for _name, _f in (("raw_to_tiff", _raw_to_tiff), ("convert_there_and_back", _there_and_back)):
    add(_name, _f, g3("SELECT x, y, z, v FROM {g}"))
add("provenance_log", _log, g3("SELECT * FROM (VALUES ('operation', 'deconvolve'), ('option.iterations', '2'), ('option.method', 'shb')) t(key, value) UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM {g}"))
add("metrics_file", _metrics_file, "SELECT CAST(floor(epoch(ts) / 3600) - 473352 AS INT) AS iter, count(*)::DOUBLE AS time, round(avg(value)::FLOAT::DOUBLE, 2) AS error FROM events GROUP BY 1")


# ---------------------------------------------------------------- dots
_DOTS = "SELECT CAST(i AS BIGINT) AS id, CAST(2 + i * 7 % 28 AS DOUBLE) AS x, CAST(2 + i * 5 % 28 AS DOUBLE) AS y, CAST(i % 4 AS DOUBLE) AS z FROM range({n}) t(i)"


def _dots(s, n=60):
    return s.range(n).selectExpr("id", "cast(2 + id * 7 % 28 as double) x", "cast(2 + id * 5 % 28 as double) y", "cast(id % 4 as double) z")


_soft = "greatest(0.0, least(1.0, 1.75 * 1.5 + 0.5 - sqrt(dx * dx + dy * dy)))"
_circ = g3(f"""SELECT p.id, p.x, p.y, p.z, {r6("coalesce(CASE WHEN m + r > 0 THEN (m - r) / (m + r) END, -1.0)")} AS circularity FROM ({_DOTS.format(n=60)}) p LEFT JOIN (
SELECT id, (caa + cbb) / 2 AS m, sqrt(pow((caa - cbb) / 2, 2) + cab * cab) AS r FROM (
SELECT id, (sum(w * dx * w * dx) - sum(w * dx) * sum(w * dx) / 49) / 48 AS caa, (sum(w * dy * w * dy) - sum(w * dy) * sum(w * dy) / 49) / 48 AS cbb, (sum(w * dx * w * dy) - sum(w * dx) * sum(w * dy) / 49) / 48 AS cab FROM (
SELECT p.id, g.x - p.x AS dx, g.y - p.y AS dy, g.v * {_soft.replace("dx", "(g.x - p.x)").replace("dy", "(g.y - p.y)")} AS w FROM ({_DOTS.format(n=60)}) p JOIN {{g}} g ON abs(g.x - p.x) <= 3 AND abs(g.y - p.y) <= 3 AND g.z = p.z) s GROUP BY id) c) e USING (id)""")
add("lateral_circularity", lambda s, d: rounded(morph.lateral_circularity(views.grid3(s, d), _dots(s), G3, 1.5)), _circ)
_m = "(3.0 + 900.0 * exp(-0.5 * ((g.x - p.x) * (g.x - p.x) + (g.y - p.y) * (g.y - p.y)) / 2.25) / (2 * pi() * 2.25))"
add("log_likelihood", lambda s, d: fit.log_likelihood(views.grid3(s, d), _dots(s), 1.5, 3.0, 900.0).select("id", F.round("loss", 3).alias("loss")), g3(f"SELECT p.id, round(-sum(g.v * ln({_m}) - {_m}), 3) AS loss FROM ({_DOTS.format(n=60)}) p JOIN {{g}} g ON abs(g.x - p.x) <= 2 AND abs(g.y - p.y) <= 2 AND g.z = p.z GROUP BY p.id"))
add("positive_prefix", lambda s, d: agg.positive_prefix(views.points(s, d).select("id", F.col("x").alias("value")), "value"), f"SELECT id, x AS value FROM ({views.POINTS_SQL}) p WHERE x > 0")
# ---------------------------------------------------------------- reconstructions that have a closed form
_POINT = np.ones((1, 1, 1))
for _method in ("rl", "shb"):
    # Under a point as point-spread function an image is its own reconstruction, across tiles and their merge.
    add(f"deconvolve_point_{_method}", lambda s, d, m=_method: rounded(restore.deconvolve_image(views.grid3(s, d), G3, _POINT, recon.Options(method=m, iterations=3), tile=16, overlap=6)), g3("SELECT x, y, z, " + r6("v") + " AS v FROM {g}"))
_BOX = np.ones((3, 7, 7)) / 147
_padded = math.prod(recon.work_shape((4, 16, 16), _BOX.shape, recon.Options.border))
#: The first model of a flat start is flat, so its error and divergence are sums over the image.
add(
    "iteration_metrics_first",
    lambda s, d: restore.iteration_metrics(to_tiles(views.grid3(s, d), G3, 16), _BOX, recon.Options(iterations=2)).where("iter = 0").select("tile", F.round("error", 2).alias("error"), F.round("kl", 2).alias("kl")),
    g3(f"SELECT tile, round(avg((v - c) * (v - c)), 2) AS error, round(sum(v * ln(v / c)), 2) AS kl FROM (SELECT *, sum(v) OVER (PARTITION BY tile) / {_padded} AS c FROM (SELECT CAST(y // 16 * 2 + x // 16 AS INT) AS tile, v + 5.0 AS v FROM {{g}}) t) u GROUP BY tile"),
)


# ---------------------------------------------------------------- planted truth
_PLANTED = """SELECT s_suppkey AS id, s_suppkey % 8 * 16 + 8 + CAST(s_suppkey % 7 - 3 AS DOUBLE) / 10 AS cx, s_suppkey // 8 * 16 + 8 + CAST(s_nationkey % 5 - 2 AS DOUBLE) / 10 AS cy,
500 + abs(s_acctbal) AS n, CAST(2 + s_nationkey % 4 AS DOUBLE) AS bg, 1.2 + CAST(s_suppkey % 3 AS DOUBLE) / 10 AS sigma FROM supplier"""


def _planted_fit(s, d):
    """A Gaussian a supplier, in a square of its own of one large image, and what the fits say of them."""
    p = views._sql(s, d, _PLANTED.replace("//", "div"), "supplier")
    cells = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(15))))
    x, y = ((F.floor(F.col(c) / 16) * 16).cast("int") + F.col(k) for c, k in (("cx", "i"), ("cy", "j")))
    r2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    v = F.col("bg") + F.col("n") * F.exp(-0.5 * r2 / F.col("sigma") ** 2) / (2 * math.pi * F.col("sigma") ** 2)
    image = cells.withColumns({"x": x, "y": y}).select("x", "y", F.lit(0).alias("z"), v.alias("v"))
    dots_ = p.select("id", F.round("cx").alias("x"), F.round("cy").alias("y"), F.lit(0.0).alias("z"))
    top = p.agg(F.max("cy")).first()[0] or 0.0
    got = fit.fit_dots(image, dots_, Grid(128, int(top) + 17), 2.0)
    return got.select("id", *[(F.round(c, k) + 0.0).alias(a) for a, c, k in (("x", "f_x", 2), ("y", "f_y", 2), ("sigma", "f_sigma_lateral", 2), ("bg", "f_bg", 1))], F.col("f_signal_count").alias("n"), F.col("f_status").alias("status")).join(p.select("id", F.col("n").alias("truth")), "id").withColumn("near", F.abs(F.col("n") - F.col("truth")) < 0.001 * F.col("truth")).drop("n", "truth")


add("dots_fitted_planted", _planted_fit, f"SELECT id, round(cx, 2) AS x, round(cy, 2) AS y, round(sigma, 2) AS sigma, bg, CAST(0 AS INT) AS status, true AS near FROM ({_PLANTED}) p")


def _constants(s, d):
    """A tile of one value a supplier: what is left is the minimum of the fidelity and the sparsity."""
    cells = views.table(s, d, "supplier").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(2))))
    image = cells.select((F.col("s_suppkey") * 8 + F.col("i")).cast("int").alias("x"), "y", "z", (1 + F.abs("s_acctbal")).cast("double").alias("v"))
    grid = Grid((image.agg(F.max("x")).first()[0] or 0) + 1, 8, 3)
    return to_voxels(recon.denoise_tiles(to_tiles(image, grid, 8), periodic=False)).select("x", "y", "z", (F.round("v", 2) + 0.0).alias("v"))


add("denoise_constants", _constants, "SELECT CAST(s_suppkey * 8 + i.i AS INT) AS x, CAST(j.i AS INT) AS y, CAST(k.i AS INT) AS z, round(1 + abs(s_acctbal) - 0.05, 2) AS v FROM supplier, range(8) i(i), range(8) j(i), range(3) k(i)")


# ---------------------------------------------------------------- table functions in SQL
def _by_sql(text: str):
    def run(s, d):
        images.register(s)
        cut = "TABLE(SELECT * FROM tessera_blocks(TABLE(SELECT * FROM {t}), 16, 2, 7, 5)) PARTITION BY (block)"
        return rounded(s.sql(text.replace("CUT", cut), t=views.grid3(s, d)))

    return run


add("sql_smooth", _by_sql("SELECT x, y, z, v FROM tessera_smooth(CUT, 1.5D, 1.0D)"), volumes.S["gaussian_smooth"])
add("sql_maxima", _by_sql("SELECT x, y, z, v AS value FROM tessera_maxima(CUT, 1.0D, 1.0D) ORDER BY v DESC, z, y, x LIMIT 40"), f"SELECT x, y, z, value FROM ({DOTS_SQL}) d")


# ---------------------------------------------------------------- pixel classification
_scales = [1.0, 1.5]


def _classified(s, d):
    plane = nuclei.reduce_planes(views.grid3(s, d), G3, "mean")
    marked = plane.select("x", "y", F.when(F.col("v") > 400, 1).otherwise(0).alias("label"))
    nodes, names = nuclei.train(plane, marked, _scales, trees=15)
    return nuclei.classify(plane, nodes, names, _scales)


add("pixel_classification", _classified)
#: Three trees of one cut each, over Gaussian, Laplacian of Gaussian and the smaller eigenvalue of the Hessian.
_CUTS = [(0, 150.2512345, 1, 2), (1, 0.1234567, 0, 1), (6, -3.2112345, 2, 0)]
_RULES = [n for t, (var, th, low, high) in enumerate(_CUTS) for n in ((t, 0, 1, 2, var, th, 0, 1.0), (t, 1, 0, 0, 0, 0.0, low, 0.0), (t, 2, 0, 0, 0, 0.0, high, 0.0))]


def _by_rules(s, d):
    """A given forest over all pixels: features, votes and ties as in the whole pipeline."""
    plane = views.grid2(s, d)
    return nuclei.classify(plane, s.createDataFrame(_RULES, forest.NODES), nuclei.features(plane, [1.0])[1], [1.0])


_tree = [f"CASE WHEN s1_{f} < {th!r} THEN {low} ELSE {high} END AS {a}" for a, f, (_, th, low, high) in zip("abc", ("gauss", "log", "he2"), _CUTS)]
add("pixel_classification_rules", _by_rules, f"SELECT x, y, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE least(a, b, c) END AS prediction FROM (SELECT x, y, {', '.join(_tree)} FROM ({volumes.S['pixel_features']}) f) t")


# ---------------------------------------------------------------- pictures
def _overlay(mode):
    def run(s, d):
        """The circles of detected dots as the written picture has them."""
        volume = views.grid3(s, d)
        path = _folder(s, "svg") + "/picture.svg"
        found = dots.detect(volume, G3, 1.0, 1.0, n=40).withColumn("id", G3.raster())
        svg.write(volume, svg.selected(found, mode, threshold=100.0, n=3), path)
        lines = s.read.text(path).where("value like '<circle%'")
        return lines.select(*[F.regexp_extract("value", f'{c}="([0-9.]+)"', 1).cast("double").alias(c) for c in ("cx", "cy", "r")])

    return run


for _mode, _where in (("auto", "WHERE use = 1"), ("threshold", "WHERE value > 100"), ("first", "ORDER BY value DESC LIMIT 3")):
    add(f"svg_{_mode}", _overlay(_mode), f"SELECT x + 0.5::DOUBLE AS cx, y + 0.5::DOUBLE AS cy, 3.0::DOUBLE AS r FROM ({DOTS_SQL}) d {_where}")
