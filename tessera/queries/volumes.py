"""Queries over the volume, plane and signal views, each with DuckDB SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera import views
from tessera.checkpoints import stored
from tessera.functions import axial_resolution, gamma_from_fwhm, lateral_resolution, linear_grids, sigma_from_fwhm
from tessera.model import AXES, Grid
from tessera.operators import agg, fourier, geometry, maps, morph, psf, recon, stencil
from tessera.plans import dots, halo, nuclei
from tessera.queries.sql import Sql, r6
from tessera.sources.png import grey, label_colors

Q: dict = {}
S: dict[str, str] = {}
G3, G2 = views.GRID3, views.GRID2


def _round6(c: F.Column) -> F.Column:
    """round(c, 6) without decimals, which take a microsecond a value, where the sixth place is beyond doubt: the quotient of two integers is exact."""
    u = c * 1e6
    sure = (F.abs(c) < 1e6) & (F.abs(u - F.floor(u) - 0.5) > 1e-3)
    return F.when(sure, F.floor(u + 0.5) / 1e6).otherwise(F.round(c, 6))


def rounded(df):
    return df.select(*[(_round6(F.col(c)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def add(name: str, run, sql: str | None = None) -> None:
    Q[name] = run
    if sql is not None:
        S[name] = sql


def on3(work):
    return lambda spark, d: work(views.grid3(spark, d))


def on2(work):
    return lambda spark, d: work(views.grid2(spark, d))


def g3() -> tuple[Sql, str]:
    q = Sql()
    return q, q.cte(views.GRID3_SQL)


def g2() -> tuple[Sql, str]:
    q = Sql()
    return q, q.cte(views.GRID2_SQL)


def simple3(name, work, select):
    q, g = g3()
    add(name, on3(work), q.out(select.format(g=g)))


def simple2(name, work, select):
    q, g = g2()
    add(name, on2(work), q.out(select.format(g=g)))


# ---------------------------------------------------------------- element-wise
for _op, _sign in (("add", "+"), ("subtract", "-"), ("multiply", "*")):
    simple3(f"elementwise_{_op}", lambda v, op=_op: maps.binary(v, geometry.flip(v, G3), op), "SELECT a.x, a.y, a.z, a.v " + _sign + " b.v AS v FROM {g} a JOIN {g} b ON b.x = 31 - a.x AND b.y = 31 - a.y AND b.z = 3 - a.z")
simple3("elementwise_divide", lambda v: rounded(maps.binary(v, maps.scalar(v, "add", 1.0), "divide")), "SELECT x, y, z, " + r6("v / (v + 1)") + " AS v FROM {g}")
simple3("plane_multiply", lambda v: maps.binary_plane(v, geometry.plane(v, 0), "multiply", G3), "SELECT a.x, a.y, a.z, a.v * b.v AS v FROM {g} a JOIN {g} b ON a.x = b.x AND a.y = b.y AND b.z = 0")
simple3("flat_field", lambda v: rounded(maps.flat_field(v, maps.scalar(geometry.plane(v, 1), "add", 1.0), G3)), "SELECT a.x, a.y, a.z, " + r6("a.v / (b.v + 1)") + " AS v FROM {g} a JOIN {g} b ON a.x = b.x AND a.y = b.y AND b.z = 1")
simple3("scalar_affine", lambda v: maps.scalar(maps.scalar(v, "multiply", 0.5), "add", -3.0), "SELECT x, y, z, v * 0.5 - 3.0 AS v FROM {g}")
simple3("invert", maps.invert, "SELECT x, y, z, 1.0 - v AS v FROM {g}")
simple3("clamp_positive", lambda v: maps.positive(maps.scalar(v, "add", -400.0)), "SELECT x, y, z, greatest(v - 400.0, 0.0) AS v FROM {g}")
simple3("min_to_zero", maps.min_to_zero, "SELECT x, y, z, v - (SELECT min(v) FROM {g}) AS v FROM {g}")
simple3("unit_sum", lambda v: maps.unit_sum(v).withColumn("v", F.round("v", 9)), "SELECT x, y, z, round(v / (SELECT sum(v) FROM {g}), 9) AS v FROM {g}")
simple3("anscombe", lambda v: rounded(maps.anscombe(v)), "SELECT x, y, z, " + r6("2 * sqrt(v + 0.375)") + " AS v FROM {g}")
simple3("anscombe_round_trip", lambda v: rounded(maps.inverse_anscombe(maps.anscombe(v))), "SELECT x, y, z, " + r6("v") + " AS v FROM {g}")
simple3("saturation_counters", lambda v: maps.counters(v, 0.0), "SELECT count(*) FILTER (v = 0) AS n_background, count(*) FILTER (isnan(v) OR isinf(v)) AS n_not_finite FROM {g}")
simple3("u16_values", maps.to_u16, "SELECT x, y, z, CAST(least(65535.0, floor(v * (65535.0 / (SELECT max(v) FROM {g})) + 0.5)) AS INT) AS v FROM {g}")
simple3("threshold", lambda v: maps.threshold(v, 400.0), "SELECT x, y, z, CASE WHEN v > 400 THEN 1.0 ELSE 0.0 END AS v FROM {g}")
simple3("constant_volume", lambda v: maps.constant(v, 2.5), "SELECT x, y, z, CAST(2.5 AS DOUBLE) AS v FROM {g}")
add("linear_grid", lambda s, d: linear_grids(views.table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), -F.col("p_size"), F.col("p_retailprice") / 100, F.lit(2.5)).select("p_partkey", "i", F.round("value", 9).alias("value")), f"SELECT p_partkey, CAST(i AS INT) AS i, round(-p_size + i * (p_retailprice / 100 + p_size) / greatest(1, n - 1), 9) AS value FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, CAST(ceil((p_retailprice / 100 + p_size) / 2.5::DOUBLE) + 1 AS BIGINT) AS n FROM part) q) t")
add(
    "optics",
    lambda s, d: rounded(views.table(s, d, "part").select("p_partkey", lateral_resolution(F.col("p_retailprice"), F.lit(1.4)).alias("lateral"), axial_resolution(F.col("p_retailprice"), F.lit(1.4)).alias("axial"), sigma_from_fwhm(F.col("p_retailprice")).alias("sigma"), gamma_from_fwhm(F.col("p_retailprice")).alias("gamma"))),
    f"SELECT p_partkey, {r6('p_retailprice / 2.8')} AS lateral, {r6('2 * p_retailprice / (1.4 * 1.4)')} AS axial, {r6('p_retailprice / (2 * sqrt(2 * ln(2)))')} AS sigma, {r6('p_retailprice / (2 * sqrt(pow(2, 2.0 / 3.0) - 1))')} AS gamma FROM part",
)

# ---------------------------------------------------------------- geometry
simple3("crop", lambda v: geometry.crop(v, (3, 4, 1), (20, 9, 2)), "SELECT x - 3 AS x, y - 4 AS y, z - 1 AS z, v FROM {g} WHERE x BETWEEN 3 AND 20 AND y BETWEEN 4 AND 9 AND z BETWEEN 1 AND 2")
simple3("line", lambda v: geometry.line(v, "x", (2, 5, 1), 4), "SELECT CAST(i AS INT) AS i, coalesce(v, 0.0) AS v FROM range(-4, 5) r(i) LEFT JOIN {g} ON x = 2 + i AND y = 5 AND z = 1")
simple3("region_padded", lambda v: geometry.region(v, (-1, 30, 0), (1, 33, 1)).select(*AXES, F.isnan("v").alias("out"), F.when(F.isnan("v"), 0.0).otherwise(F.col("v")).alias("v")), "SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z, v IS NULL AS out, coalesce(v, 0.0) AS v FROM range(3) a(i) CROSS JOIN range(4) b(i) CROSS JOIN range(2) c(i) LEFT JOIN {g} ON x = a.i - 1 AND y = b.i + 30 AND z = c.i")
simple3("plane", lambda v: geometry.plane(v, 2), "SELECT x, y, 0 AS z, v FROM {g} WHERE z = 2")
simple3("insert", lambda v: geometry.insert(Grid(34, 35, 5), v, (1, 2, 0)), "SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z, coalesce(v, 0.0) AS v FROM range(34) a(i) CROSS JOIN range(35) b(i) CROSS JOIN range(5) c(i) LEFT JOIN {g} ON x = a.i - 1 AND y = b.i - 2 AND z = c.i")
simple3("flip", lambda v: geometry.flip(v, G3), "SELECT 31 - x AS x, 31 - y AS y, 3 - z AS z, v FROM {g}")
simple3("circular_shift", lambda v: geometry.circular_shift(v, G3, (3, -5, 1)), "SELECT (x + 3) % 32 AS x, (y + 27) % 32 AS y, (z + 1) % 4 AS z, v FROM {g}")
simple3("center_shift", lambda v: geometry.center_shift(v, G3), "SELECT (x + 16) % 32 AS x, (y + 16) % 32 AS y, (z + 2) % 4 AS z, v FROM {g}")
simple3("permute_axes", lambda v: geometry.permute(v, "yzx"), "SELECT y AS x, z AS y, x AS z, v FROM {g}")
simple3("downsample", lambda v: stencil.downsample(v, 4), "SELECT x // 4 AS x, y // 4 AS y, z, sum(v) AS v FROM {g} GROUP BY 1, 2, 3")
simple3("collage", lambda v: geometry.collage(v, G3), "SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, 0 AS z, coalesce(m.v, 0.0) AS v FROM range(36) a(i) CROSS JOIN range(36) b(i) LEFT JOIN (SELECT x, y, max(v) AS v FROM {g} GROUP BY 1, 2 UNION ALL SELECT x, z + 32, max(v) FROM {g} GROUP BY 1, 2 UNION ALL SELECT z + 32, y, max(v) FROM {g} GROUP BY 1, 2) m ON m.x = a.i AND m.y = b.i")
simple3("z_stack", lambda v: geometry.stack([(v, G3), (maps.invert(v), G3)]), "SELECT x, y, z, v FROM {g} UNION ALL SELECT x, y, z + 4, 1.0 - v FROM {g}")
simple3("trim_margin", lambda v: geometry.trim_margin(v, "x", 0.98), "SELECT x - a AS x, y, z, v FROM {g}, (SELECT min(x) AS a, max(x) AS b FROM (SELECT x, sum(v) AS s FROM {g} GROUP BY x) q WHERE s >= 0.98 * (SELECT max(s) FROM (SELECT sum(v) AS s FROM {g} GROUP BY x) p)) k WHERE x BETWEEN a AND b")
_q, _g = g3()
_m = _q.conv(_g, "x", [0.25, 0.75, 0.0], "zeros", 32)
add("subpixel_shift", on3(lambda v: geometry.shift(v, G3, (2.25, 0.0, 0.0))), _q.out(f"SELECT a.x, a.y, a.z, coalesce(b.v, 0.0) AS v FROM {_g} a LEFT JOIN {_m} b ON b.x = a.x - 2 AND b.y = a.y AND b.z = a.z"))
add(
    "trilinear",
    lambda s, d: rounded(geometry.trilinear(views.grid3(s, d), s.range(200).selectExpr("id", "(id % 37) * 0.83 as x", "(id % 23) * 1.41 as y", "(id % 7) * 0.47 as z"), G3)),
    (lambda q, g: q.out(f"""SELECT p.id, {r6('coalesce(sum(v * (1 - abs(g.x - px)) * (1 - abs(g.y - py)) * (1 - abs(g.z - pz))), 0.0)')} AS v
FROM (SELECT i AS id, (i % 37) * 0.83::DOUBLE AS px, (i % 23) * 1.41::DOUBLE AS py, (i % 7) * 0.47::DOUBLE AS pz FROM range(200) t(i)) p
LEFT JOIN {g} g ON abs(g.x - px) < 1 AND abs(g.y - py) < 1 AND abs(g.z - pz) < 1 AND px <= 31 AND py <= 31 AND pz <= 3 GROUP BY p.id"""))(*g3()),
)
_sinc = lambda e: f"CASE WHEN {e} = 0 THEN 1.0 ELSE sin(pi() * {e}) / (pi() * {e}) END"
for _a in (3, 5, 7):
    _w = f"({_sinc('(p - n)')}) * ({_sinc(f'((p - n) / {_a})')})"
    add(
        f"lanczos{_a}",
        lambda s, d, a=_a: rounded(geometry.lanczos(views.signal(s, d).select("x", "v"), s.range(300).selectExpr("id", "id * 1.37 as p").withColumn("p", F.col("p").cast("double")), a)),
        f"""SELECT id, {r6(f"coalesce(max(CASE WHEN abs(p - n) < {1e-8 if _a == 3 else 1e-9} THEN v END), greatest(sum(w * v){' / sum(w)' if _a == 3 else ''}, 0.0))")} AS v FROM (
SELECT id, p, n, v, CASE WHEN abs(p - n) < {_a} THEN {_w} ELSE 0.0 END AS w FROM (SELECT i AS id, i * 1.37::DOUBLE AS p, unnest(range(CAST(floor(i * 1.37::DOUBLE) AS BIGINT) - {_a - 1}, CAST(floor(i * 1.37::DOUBLE) AS BIGINT) + {_a + 1})) AS n FROM range(300) t(i)) q
JOIN ({views.SIGNAL_DUCK}) s ON s.x = abs(n)) z GROUP BY id""",
    )
_tiles = ", ".join(f"({k}, {x0}, {x1}, {y0}, {y1})" for k, (y0, y1, x0, x1) in enumerate((y0, y1, x0, x1) for y0, y1 in geometry.divide(32, 12) for x0, x1 in geometry.divide(32, 12)))
simple3("tiling_split", lambda v: geometry.split_tiles(v, G3, 12, 3).withColumn("w", F.round("w", 6)), "SELECT t.tile, x, y, z, v, round(1.0 - greatest(x0 - x, x - x1, y0 - y, y - y1, 0) / 4.0, 6) AS w FROM {g} JOIN (VALUES " + _tiles + ") t(tile, x0, x1, y0, y1) ON x BETWEEN x0 - 3 AND x1 + 3 AND y BETWEEN y0 - 3 AND y1 + 3")
simple3("tiling_merge", lambda v: rounded(geometry.merge_tiles(geometry.split_tiles(v, G3, 12, 3))), "SELECT x, y, z, " + r6("v") + " AS v FROM {g}")
simple3("tiles_round_trip", lambda v: __import__("tessera.model", fromlist=["x"]).to_voxels(__import__("tessera.model", fromlist=["x"]).to_tiles(v, G3, 16)), "SELECT x, y, z, v FROM {g}")

# ---------------------------------------------------------------- stencils
_taps = [0.125, 0.25, 0.25, 0.25, 0.125]
for _mode in stencil.MODES:
    _q, _g = g3()
    _c = _q.conv(_g, "y", _taps, _mode, 32)
    add(f"conv1_{_mode}", on3(lambda v, m=_mode: rounded(stencil.convolve(v, "y", _taps, m))), _q.out(f"SELECT x, y, z, {r6('v')} AS v FROM {_c}"))
_q, _g = g3()
_c = _q.conv(_q.conv(_q.conv(_g, "x", stencil.gaussian(1.5), "normalized", 32), "y", stencil.gaussian(1.5), "normalized", 32), "z", stencil.gaussian(1.0, 7), "normalized", 4)
add("gaussian_smooth", on3(lambda v: rounded(stencil.smooth(v, G3, 1.5, 1.0))), _q.out(f"SELECT x, y, z, {r6('v')} AS v FROM {_c}"))
_q, _g = g2()
_c = _q.conv(_q.conv(_g, "x", stencil.gaussian_d1(1.2), "zeros", 32), "y", stencil.gaussian(1.2), "zeros", 32)
add("gaussian_derivative", on2(lambda v: rounded(stencil.partial(v, "x", 1.2))), _q.out(f"SELECT x, y, z, {r6('v')} AS v FROM {_c}"))
_q, _g = g3()
add("laplacian_of_gaussian", on3(lambda v: rounded(stencil.laplacian_of_gaussian(v, G3, 1.2, 1.0))), _q.out(f"SELECT x, y, z, {r6('v')} AS v FROM {_q.log(_g, G3, 1.2, 1.0)}"))
_q, _g = g2()
_k, _d1, _d2 = stencil.gaussian(1.5), stencil.gaussian_d1(1.5), stencil.gaussian_d2(1.5)
_h = [_q.conv(_q.conv(_g, "x", a, "mirror", 32), "y", b, "mirror", 32) for a, b in ((_d2, _k), (_k, _d2), (_d1, _d1))]
add("determinant_of_hessian", on2(lambda v: rounded(stencil.determinant_of_hessian(v, 1.5))), _q.out(f"SELECT x, y, z, {r6('v')} AS v FROM {_q.join(_h, 'p0.v * p1.v - p2.v * p2.v')}"))


def _grad(q, g, s):
    k, d = stencil.gaussian(s), stencil.gaussian_d1(s)
    a = q.conv(q.conv(g, "x", d, "zeros", 32), "y", k, "zeros", 32)
    b = q.conv(q.conv(g, "y", d, "zeros", 32), "x", k, "zeros", 32)
    return q.join([a, b], "sqrt(p0.v * p0.v + p1.v * p1.v)")


_q, _g = g3()
add("focus_score", on3(lambda v: stencil.focus_score(v, 1.0).withColumn("score", F.round("score", 4))), _q.out(f"SELECT z, round(sum(v), 4) AS score FROM {_grad(_q, _g, 1.0)} GROUP BY z"))
_q, _g = g3()
_m = _grad(_q, _g, 1.0)
add("auto_z_crop", on3(lambda v: geometry.auto_z_crop(v, stencil.focus_score(v, 1.0), G3, 3)), _q.out(f"SELECT x, y, CAST(z - f AS INT) AS z, v FROM {_g}, (SELECT greatest(0, least(1, z - 1)) AS f FROM (SELECT z, sum(v) AS s FROM {_m} GROUP BY z) q ORDER BY s DESC, z LIMIT 1) b WHERE z BETWEEN f AND f + 2"))
simple3("cumulative_sum", lambda v: stencil.cumulative_sum(v, "x"), "SELECT x, y, z, sum(v) OVER (PARTITION BY y, z ORDER BY x) AS v FROM {g}")
simple3("box_sum", lambda v: stencil.box_sum(v, G3, 3, 2), "SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, g.z, sum(g.v) AS v FROM range(34) a(i) CROSS JOIN range(33) b(i) JOIN {g} g ON g.x BETWEEN a.i - 2 AND a.i AND g.y BETWEEN b.i - 1 AND b.i GROUP BY 1, 2, 3")
_q, _g = g2()
_a, _b = _q.cte(f"SELECT x, y, v FROM {_g} WHERE x < 12 AND y < 12"), _q.cte(f"SELECT x - 5 AS x, y - 3 AS y, v FROM {_g} WHERE x BETWEEN 5 AND 16 AND y BETWEEN 3 AND 14")
_l = _q.cte(f"SELECT a.x - b.x AS dx, a.y - b.y AS dy, sum(a.v) AS sa, sum(a.v * a.v) AS saa, sum(a.v * b.v) AS sab FROM {_a} a, {_b} b GROUP BY 1, 2")
_n = _q.cte(f"SELECT dx, dy, sab, sa, st, n, sqrt(greatest(saa - sa * sa / n, 0.0)) * sqrt(n - 1.0) * sd AS norm FROM {_l}, (SELECT count(*) AS n, sum(v) AS st, stddev_samp(v) AS sd FROM {_b}) t")
add("cross_correlation", on2(lambda v: rounded(stencil.cross_correlation(geometry.crop(v, (0, 0, 0), (11, 11, 0)), geometry.crop(v, (5, 3, 0), (16, 14, 0)), Grid(12, 12)))), _q.out(f"SELECT dx, dy, {r6('CASE WHEN norm > 1e-9 THEN (sab - sa * st / n) / norm ELSE sab END')} AS ncc FROM {_n}"))

_wide, _tall = [0.125, 0.25, 0.25, 0.25, 0.125], [0.25, 0.5, 0.25]


def _by_fourier(v):
    """The separable kernel as rows, through spectra."""
    kernel = Grid(5, 3).frame(v.sparkSession).withColumn("v", F.element_at(F.lit(_wide), F.col("x") + 1) * F.element_at(F.lit(_tall), F.col("y") + 1))
    return fourier.convolve(v, G3, kernel, Grid(5, 3))


_q, _g = g3()
_c = _q.conv(_q.conv(_g, "x", _wide, "zeros", 32), "y", _tall, "zeros", 32)
add("fourier_convolution", on3(lambda v: rounded(_by_fourier(v))), _q.out(f"SELECT x, y, z, {r6('v')} AS v FROM {_c}"))
simple3("fourier_round_trip", lambda v: rounded(fourier.transform(fourier.transform(fourier.complex_rows(v), G3), G3, True).select(*AXES, F.col("re").alias("v"), F.abs("im").alias("im"))), "SELECT x, y, z, " + r6("v") + " AS v, 0.0::DOUBLE AS im FROM {g}")
add("fourier_line", lambda s, d: rounded(fourier.along(fourier.complex_rows(views.signal(s, d)), Grid(views.HOURS, 1), "x").select("x", "re", "im")), f"SELECT CAST(k.i AS INT) AS x, {r6('sum(v * cos(2 * pi() * ((k.i * g.x) % 720) / 720))')} AS re, {r6('-sum(v * sin(2 * pi() * ((k.i * g.x) % 720) / 720))')} AS im FROM range(720) k(i), ({views.SIGNAL_DUCK}) g GROUP BY k.i")


def _features_sql(s: float) -> str:
    q, g = g2()
    k, d1, d2 = stencil.gaussian(s), stencil.gaussian_d1(s), stencil.gaussian_d2(s)
    one = lambda a, b: q.conv(q.conv(g, "x", a, "normalized" if a is k else "zeros", 32), "y", b, "normalized" if b is k else "zeros", 32)
    gg, dx, dy, xx, yy, xy = one(k, k), one(d1, k), one(k, d1), one(d2, k), one(k, d2), one(d1, d1)
    st = [q.conv(q.conv(q.join(p, "p0.v * p1.v"), "x", k, "normalized", 32), "y", k, "normalized", 32) for p in ([dx, dx], [dx, dy], [dy, dy])]
    eig = lambda a, b, c: (f"({a} + {c}) / 2 + sqrt(({a} - {c}) * ({a} - {c}) / 4 + {b} * {b})", f"({a} + {c}) / 2 - sqrt(({a} - {c}) * ({a} - {c}) / 4 + {b} * {b})")
    s1, s2 = eig("sa.v", "sb.v", "sc.v")
    h1, h2 = eig("xx.v", "xy.v", "yy.v")
    n = f"s{s:g}_"
    cols = {"gauss": "gg.v", "log": "-xx.v - yy.v", "gm": "sqrt(dx.v * dx.v + dy.v * dy.v)", "st1": s1, "st2": s2, "he1": h1, "he2": h2}
    named = ", ".join(f"{r6(e)} AS {n}{c}" for c, e in cols.items())
    joins = " ".join(f"JOIN {t} {a} USING (x, y, z)" for t, a in ((dx, "dx"), (dy, "dy"), (xx, "xx"), (yy, "yy"), (xy, "xy"), (st[0], "sa"), (st[1], "sb"), (st[2], "sc")))
    return q.out(f"SELECT x, y, z, {named} FROM {gg} gg {joins}")


add("pixel_features", on2(lambda v: rounded(stencil.pixel_features(v, [1.0]))), _features_sql(1.0))

# ---------------------------------------------------------------- maxima, components
_q, _g = g3()
add("local_maxima_3d", on3(lambda v: morph.local_maxima(v, G3)), _q.out(f"SELECT x, y, z, v FROM {_q.neighbours(_g, True)} WHERE v > greatest(m, 0) AND x BETWEEN 1 AND 30 AND y BETWEEN 1 AND 30 AND z BETWEEN 1 AND 2"))
_q, _g = g2()
add("local_maxima_2d", on2(lambda v: morph.local_maxima(v, G2)), _q.out(f"SELECT x, y, z, v FROM {_q.neighbours(_g, False)} WHERE v > m AND x BETWEEN 1 AND 30 AND y BETWEEN 1 AND 30"))
_scales = [1.0, 1.5, 2.25]
_q, _g = g2()
_levels = [_q.neighbours(_q.log(_g, G2, s, s), False) for s in _scales]
_u = _q.cte(" UNION ALL ".join(f"SELECT {k} AS k, CAST({s} AS DOUBLE) AS scale, x, y, z, v, m FROM {t}" for k, (s, t) in enumerate(zip(_scales, _levels))))
add(
    "scale_space_maxima",
    on2(lambda v: rounded(morph.scale_space_maxima({s: stencil.laplacian_of_gaussian(v, G2, s) for s in _scales}, G2)).drop("refined")),
    _q.out(f"SELECT a.x, a.y, a.z, {r6('a.v')} AS v, a.scale FROM {_u} a LEFT JOIN {_u} b ON (a.x, a.y, a.z) = (b.x, b.y, b.z) AND abs(a.k - b.k) = 1 WHERE a.v > greatest(a.m, 0) AND a.x BETWEEN 1 AND 30 AND a.y BETWEEN 1 AND 30 GROUP BY ALL HAVING coalesce(max(greatest(b.v, b.m)), -1e300) <= a.v"),
)


def mask2(spark, d):
    v = views.grid2(spark, d)
    cut = agg.exact_percentile(v, "v", 60).select(F.col("value").alias("cut"))
    return v.crossJoin(F.broadcast(cut)).select(*AXES, F.when(F.col("v") > F.col("cut"), 1.0).otherwise(0.0).alias("v"))


def _mask(q: Sql, g: str) -> str:
    return q.cte(f"SELECT x, y, z, CASE WHEN v > (SELECT v FROM {g} ORDER BY v LIMIT 1 OFFSET 614) THEN 1.0 ELSE 0.0 END AS v FROM {g}")


def _components(q: Sql, m: str, on: str) -> str:
    """(x, y, root): the first pixel in raster order that can be reached."""
    p = q.cte(f"SELECT x, y, x + 32 * y AS i FROM {m} WHERE {on}")
    e = q.cte(f"SELECT a.i AS a, b.i AS b FROM {p} a JOIN {p} b ON abs(a.x - b.x) + abs(a.y - b.y) = 1")
    name = f"r{len(q.parts)}"
    q.parts.append(f"{name}(i, reached) AS (SELECT i, i FROM {p} UNION SELECT {name}.i, e.b FROM {name} JOIN {e} e ON e.a = {name}.reached)")
    return q.cte(f"SELECT p.x, p.y, min(r.reached) AS root FROM {name} r JOIN {p} p ON p.i = r.i GROUP BY 1, 2")


_q, _g = g2()
_c = _components(_q, _mask(_q, _g), "v > 0")
add("components", lambda s, d: morph.components(mask2(s, d), G2), _q.out(f"SELECT x, y, dense_rank() OVER (ORDER BY root) AS label FROM {_c}", True))
_q, _g = g2()
_c = _components(_q, _mask(_q, _g), "v > 0")
add("component_areas", lambda s, d: morph.areas(morph.components(mask2(s, d), G2)), _q.out(f"SELECT dense_rank() OVER (ORDER BY root) AS label, count(*) AS area FROM {_c} GROUP BY root", True))
_q, _g = g2()
_m = _mask(_q, _g)
_c = _components(_q, _m, "v > 0")
add("remove_small", lambda s, d: morph.remove_small(mask2(s, d), G2, 5), _q.out(f"SELECT m.x, m.y, m.z, CASE WHEN c.n >= 5 THEN 1.0 ELSE 0.0 END AS v FROM {_m} m LEFT JOIN (SELECT x, y, count(*) OVER (PARTITION BY root) AS n FROM {_c}) c USING (x, y)", True))
_q, _g = g2()
_m = _mask(_q, _g)
_c = _components(_q, _m, "v = 0")
add("fill_holes", lambda s, d: morph.fill_holes(mask2(s, d), G2, 6), _q.out(f"SELECT m.x, m.y, m.z, CASE WHEN m.v > 0 OR (c.n < 6 AND NOT c.edge) THEN 1.0 ELSE 0.0 END AS v FROM {_m} m LEFT JOIN (SELECT x, y, count(*) OVER w AS n, bool_or(x IN (0, 31) OR y IN (0, 31)) OVER w AS edge FROM {_c} WINDOW w AS (PARTITION BY root)) c USING (x, y)", True))

# ---------------------------------------------------------------- aggregates
simple3("stats", lambda v: rounded(agg.stats(v)), f"SELECT {r6('sum(v)')} AS sum, {r6('avg(v)')} AS mean, min(v) AS min, max(v) AS max, count(*) AS n, {r6('stddev_samp(v)')} AS std FROM {{g}}")
add("covariance", lambda s, d: rounded(agg.covariance(views.table(s, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("cov", 2).alias("cov"), "corr")), f"SELECT round(covar_samp(l_quantity, l_extendedprice), 2) + 0.0 AS cov, {r6('corr(l_quantity, l_extendedprice)')} AS corr FROM lineitem")
simple3("argmax", lambda v: agg.argmax(v, G3), "SELECT x, y, z, v FROM {g} ORDER BY v DESC, x + 32 * (y + 32 * z) LIMIT 1")
for _how, _f in (("max", "max"), ("sum", "sum"), ("mean", "avg")):
    simple3(f"{_how}_projection", lambda v, h=_how: rounded(agg.projection(v, h)), "SELECT x, y, " + r6(f"{_f}(v)") + " AS v FROM {g} GROUP BY x, y")
simple3("mse", lambda v: rounded(agg.mean_squared_error(v, geometry.flip(v, G3))), "SELECT " + r6("avg((a.v - b.v) * (a.v - b.v))") + " AS mse FROM {g} a JOIN {g} b ON b.x = 31 - a.x AND b.y = 31 - a.y AND b.z = 3 - a.z")
simple3("i_divergence", lambda v: rounded(agg.i_divergence(v, geometry.flip(v, G3))), "SELECT " + r6("sum(CASE WHEN a.v > 0 AND b.v > 0 THEN b.v * ln(b.v / a.v) - (b.v - a.v) ELSE 0 END) / count(*)") + " AS idiv FROM {g} a JOIN {g} b ON b.x = 31 - a.x AND b.y = 31 - a.y AND b.z = 3 - a.z")
simple3("kl_divergence", lambda v: agg.kl_divergence(v, geometry.flip(v, G3)).select(F.round("kl", 4).alias("kl")), "SELECT round(sum(CASE WHEN a.v > 0 AND b.v > 0 THEN a.v * ln(a.v / b.v) ELSE 0 END), 4) AS kl FROM {g} a JOIN {g} b ON b.x = 31 - a.x AND b.y = 31 - a.y AND b.z = 3 - a.z")
simple3("background_sum", lambda v: agg.background([v, geometry.flip(v, G3)]), "SELECT x, y, 0 AS z, sum(v) AS v FROM (SELECT x, y, v FROM {g} UNION ALL SELECT 31 - x, 31 - y, v FROM {g}) q GROUP BY 1, 2")
_q, _g = g3()
_h = _q.histogram(_g)
add("histogram", on3(lambda v: agg.histogram(v).select("bin", "c")), _q.out(f"SELECT bin, c FROM {_h}"))
_q, _g = g3()
_h = _q.histogram(_g)
add("histogram_log", on3(lambda v: rounded(agg.log_counts(agg.histogram(v)).select("bin", "c"))), _q.out(f"SELECT bin, {r6('ln(1 + c)')} AS c FROM {_h}"))
_q, _g = g3()
_h = _q.histogram(_g)
add("histogram_percentile", on3(lambda v: rounded(agg.histogram_percentile(agg.histogram(v), 0.9))), _q.out(f"SELECT {r6('l + (min(bin) + 1) / 65537.0 * (r - l)')} AS value FROM (SELECT bin, l, r, sum(c) OVER (ORDER BY bin) AS run, sum(c) OVER () AS total FROM {_h}) q WHERE run >= 0.9 * total GROUP BY l, r"))
_q, _g = g3()
_o = _q.otsu(_q.histogram(_g))
add("otsu", on3(lambda v: rounded(agg.otsu(agg.histogram(v)))), _q.out(f"SELECT level, {r6('value')} AS value FROM {_o}"))
_q, _g = g3()
_o = _q.otsu(_q.histogram(_g))
add("otsu_mask", on3(lambda v: maps.threshold(v.crossJoin(F.broadcast(agg.otsu(agg.histogram(v)).select("value"))), F.col("value")).drop("value")), _q.out(f"SELECT x, y, z, CASE WHEN v > value THEN 1.0 ELSE 0.0 END AS v FROM {_g}, {_o}"))
simple3("exact_percentile", lambda v: agg.exact_percentile(v, "v", 37.5), "SELECT v AS value FROM {g} ORDER BY v LIMIT 1 OFFSET 1536")
add("majority_vote", lambda s, d: agg.majority(views.table(s, d, "lineitem"), ["l_suppkey"], "l_linenumber"), "SELECT l_suppkey, l_linenumber FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem GROUP BY 1, 2) q WHERE r = 1")
simple3("table_equality", lambda v: v.sparkSession.createDataFrame([(agg.same_table(v, geometry.flip(geometry.flip(v, G3), G3)), agg.same_table(v, maps.invert(v)))], "same boolean, other boolean"), "SELECT true AS same, false AS other")
add("sort_head", lambda s, d: agg.head(views.features(s, d), "f3", 25, "id").select("id", "f3"), f"SELECT id, f3 FROM ({views.FEATURES_SQL}) q ORDER BY f3 DESC, id LIMIT 25")
add("concatenate_rows", lambda s, d: agg.concatenate_rows(views.features(s, d).select("id", "f0"), views.features(s, d).select("id", "f3")), f"SELECT id, f0 FROM ({views.FEATURES_SQL}) a UNION ALL SELECT id, f3 FROM ({views.FEATURES_SQL}) b")
def _side_by_side(rows):
    return agg.concatenate_columns(rows.select("_row", "f0"), rows.select("_row", F.col("f3").alias("other")))


add("concatenate_columns", lambda s, d: _side_by_side(views.numbered(s, d)), f"SELECT _row, f0, f3 AS other FROM ({views.NUMBERED_SQL}) a")
add("row_selection", lambda s, d: views.features(s, d).where("f0 > 27.5").select("id", "f0"), f"SELECT id, f0 FROM ({views.FEATURES_SQL}) a WHERE f0 > 27.5")
add("random_subset", lambda s, d: agg.random_subset(views.features(s, d), "id", 100).select("id"), f"SELECT id FROM ({views.FEATURES_SQL}) a ORDER BY md5('0:' || id), id LIMIT 100")
add("kfold", lambda s, d: agg.kfold(views.features(s, d), "id", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n")), f"SELECT CAST(id % 5 AS INT) AS fold, count(*) AS n FROM ({views.FEATURES_SQL}) a GROUP BY 1")

# ---------------------------------------------------------------- reconstruction
_sig = [0.25, 0.5, 0.25]


def _recon_sql(kind: str, rounds: int) -> str:
    q = Sql()
    g = q.cte(views.SIGNAL_DUCK)
    x = last = q.cte(f"SELECT x, y, z, (SELECT avg(v) FROM {g}) AS v FROM {g}")
    for k in range(rounds):
        if kind == "rl":
            ratio = q.join([g, q.conv(x, "x", _sig, "periodic", 720)], "CASE WHEN p1.v > 0 THEN p0.v / p1.v ELSE 0.01 END")
            x = q.join([x, q.conv(ratio, "x", _sig, "periodic", 720)], "greatest(p0.v * p1.v, 0.01)")
        else:
            a = min(max((k - 1) / (k + 2), 0.0), 1.0)
            p = q.join([x, last], f"greatest(p0.v + {a!r} * (p0.v - p1.v), 0.01)")
            ratio = q.join([g, q.conv(p, "x", _sig, "periodic", 720)], "p0.v / p1.v")
            x, last = q.join([p, q.conv(ratio, "x", _sig, "periodic", 720)], "greatest(p0.v * p1.v, 0.0)"), x
    return q.out(f"SELECT x, y, z, {r6('v')} AS v FROM {x}")


def _rounds_sql(rounds: int, stop: str, tolerance: float) -> str:
    """(iter, error, kl) of the rounds of the heavy ball up to the one that stops it."""
    q = Sql()
    g = q.cte(views.SIGNAL_DUCK)
    x = last = q.cte(f"SELECT x, y, z, (SELECT avg(v) FROM {g}) AS v FROM {g}")
    told = []
    for k in range(rounds):
        a = min(max((k - 1) / (k + 2), 0.0), 1.0)
        p = q.join([x, last], f"greatest(p0.v + {a!r} * (p0.v - p1.v), 0.01)")
        model = q.conv(p, "x", _sig, "periodic", 720)
        told.append(f"SELECT {k} AS iter, avg((m.v - g.v) * (m.v - g.v)) AS error, sum(CASE WHEN g.v > 0 AND m.v > 0 THEN g.v * ln(g.v / m.v) ELSE 0.0 END) AS kl FROM {model} m JOIN {g} g USING (x, y, z)")
        x, last = q.join([p, q.conv(q.join([g, model], "p0.v / p1.v"), "x", _sig, "periodic", 720)], "greatest(p0.v * p1.v, 0.0)"), x
    every = q.cte(" UNION ALL ".join(told))
    ends = {"relative": f"abs(b.error - a.error) / b.error < {tolerance!r}", "absolute": f"b.error < {tolerance!r}"}[stop]
    return q.out(f"SELECT iter, {r6('error')} AS error, {r6('kl')} AS kl FROM {every} WHERE iter <= coalesce((SELECT min(b.iter) FROM {every} b JOIN {every} a ON a.iter = b.iter - 1 WHERE {ends}), {rounds})")


def _whole(s, d, side=64, **options):
    """The signal in tiles that exchange halos."""
    return halo.deconvolve(views.signal(s, d), Grid(views.HOURS, 1, 1), np.array(_sig).reshape(1, 1, 3), recon.Options(border=0, offset=0.0, **options), side)


add("halo_heavy_ball", lambda s, d: rounded(_whole(s, d, method="shb", iterations=4)[0]), _recon_sql("shb", 4))
add("halo_richardson_lucy", lambda s, d: rounded(_whole(s, d, method="rl", iterations=3)[0]), _recon_sql("rl", 3))
for _stop, _tolerance in (("relative", 0.1), ("absolute", 40.0)):
    add(f"halo_stop_{_stop}", lambda s, d, a=_stop, t=_tolerance: rounded(_whole(s, d, iterations=8, stop=a, tolerance=t)[1]), _rounds_sql(8, _stop, _tolerance))
add("richardson_lucy", lambda s, d: rounded(recon.richardson_lucy_rows(views.signal(s, d), {"x": _sig}, 3)), _recon_sql("rl", 3))
add("heavy_ball", lambda s, d: rounded(recon.heavy_ball_rows(views.signal(s, d), {"x": _sig}, 4)), _recon_sql("shb", 4))
_q, _g = g3()
_w = _q.conv(_q.cte(f"SELECT x, y, z, 1.0 AS v FROM {_g}"), "x", _sig, "zeros", 32)
add("boundary_weights", on3(lambda v: rounded(recon.boundary_weights(v, {"x": _sig}))), _q.out(f"SELECT x, y, z, {r6('1 / v')} AS v FROM {_w}"))
simple3("start_flat", lambda v: rounded(recon.start(v)), "SELECT x, y, z, " + r6("m") + " AS v FROM {g}, (SELECT avg(v) AS m FROM {g}) a")
simple3("start_identity", lambda v: recon.start(v, "identity"), "SELECT x, y, z, v FROM {g}")
_q, _g = g3()
_p = _q.cte(f"SELECT x, y, z, 2 * sqrt(v + 0.375) AS v FROM {_g}")
for _axis, _n in (("x", 32), ("y", 32)):
    _p = _q.conv(_p, _axis, stencil.gaussian(1.0), "normalized", _n)
_p = _q.conv(_p, "z", stencil.gaussian(1.0, 7), "normalized", 4)
add("prefilter", on3(lambda v: rounded(maps.inverse_anscombe(stencil.smooth(maps.anscombe(v), G3, 1.0)))), _q.out(f"SELECT x, y, z, {r6('v / 2 * v / 2 - 0.375')} AS v FROM {_p}"))


def _deconvolved(spark, d, work):
    from tessera.model import to_tiles, to_voxels

    return to_voxels(work(to_tiles(views.grid3(spark, d), G3, 32)))


add("deconvolve_tiles", lambda s, d: _deconvolved(s, d, lambda t: recon.deconvolve_tiles(t, __import__("numpy").ones((1, 3, 3)) / 9, recon.Options(iterations=5))))
add("denoise_tiles", lambda s, d: _deconvolved(s, d, lambda t: recon.denoise_tiles(t, iterations=5)))

# ---------------------------------------------------------------- generators
_gamma, _sigma = f"(s_nationkey / 10.0::DOUBLE + 3) / {2 * math.sqrt(2 ** (2 / 3) - 1)!r}", f"(4.0::DOUBLE + s_suppkey % 3) / {2 * math.sqrt(2 * math.log(2))!r}"


def _sted(s, d):
    widths = psf.sted_volumes(views.table(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_nationkey") / 10.0 + 3.0, F.col("s_suppkey") % 3 + F.lit(4.0), 11, 7)
    return widths.select("s_suppkey", *AXES, F.round("v", 9).alias("v"))


add(
    "psf_sted",
    _sted,
    f"SELECT s_suppkey, CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z, round(exp(-0.5 * (c.i - 3) * (c.i - 3) / (s * s)) / (s * sqrt(2 * pi())) * g / pow((a.i - 5) * (a.i - 5) + (b.i - 5) * (b.i - 5) + g * g, 1.5) / (2 * pi()), 9) AS v FROM (SELECT s_suppkey, {_gamma} AS g, {_sigma} AS s FROM supplier) p, range(11) a(i), range(11) b(i), range(7) c(i)",
)


def _shape(volumes):
    """What closed form says of a volume, whatever its parameters: number of voxels, sum, brightest voxel, likeness to its mirror images."""
    v = stored(volumes)
    mirror = v.select("key", F.col("y").alias("x"), F.col("x").alias("y"), "z", F.col("v").alias("w"))
    told = v.join(mirror, ["key", *AXES]).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max_by(F.struct(*AXES), "v").alias("top"), F.max(F.abs(F.col("v") - F.col("w"))).alias("skew"))
    return rounded(told.select("key", "n", "total", *[F.col(f"top.{a}").alias("top_" + a) for a in AXES], "skew"))


def _sizes(s, d, index, **columns):
    """Wavelengths and apertures that the parts' sizes stand for: one row a size. columns: the first wavelength of each."""
    sizes = views.table(s, d, "part").select(F.col("p_size").alias("key")).distinct()
    return sizes.select("key", *[(v + 6 * F.col("key")).alias(c) for c, v in columns.items()], (1.0 + F.col("key") / 125).alias("na"), F.lit(index).alias("index"))


_shape_sql = "SELECT DISTINCT CAST(p_size AS BIGINT) AS key, CAST({n} * {n} * {nz} AS BIGINT) AS n, 1.0::DOUBLE AS total, {h} AS top_x, {h} AS top_y, {hz} AS top_z, 0.0::DOUBLE AS skew FROM part"
add("psf_born_wolf", lambda s, d: _shape(psf.born_wolf_volumes(_sizes(s, d, 1.512, wavelength=400), nxy=9, nz=3)), _shape_sql.format(n=9, nz=3, h=4, hz=1))
add("psf_pixel_integrals", lambda s, d: _shape(psf.pixel_volumes(_sizes(s, d, 1.512, wavelength=400), nxy=7, nz=3)), _shape_sql.format(n=7, nz=3, h=3, hz=1))
add("psf_angular_spectrum", lambda s, d: _shape(psf.angular_spectrum_volumes(_sizes(s, d, 1.515, emission=420, excitation=400), nxy=31, nz=5)), _shape_sql.format(n=31, nz=5, h=15, hz=2))

# ---------------------------------------------------------------- pipelines
_q, _g = g3()
_l = _q.neighbours(_q.log(_g, G3, 1.0, 1.0), True)
_m = _q.cte(f"SELECT x, y, z, v AS value FROM {_l} WHERE v > greatest(m, 0) AND x BETWEEN 1 AND 30 AND y BETWEEN 1 AND 30 AND z BETWEEN 1 AND 2")
_h = _q.histogram(_m, "value")
_o = _q.otsu(_q.cte(f"SELECT bin, l, r, ln(1 + c) AS c FROM {_h}"))
DOTS_SQL = _q.out(f"SELECT x, y, z, {r6('m.value')} AS value, CASE WHEN m.value > o.value THEN 1 ELSE 0 END AS use FROM {_m} m, {_o} o ORDER BY m.value DESC LIMIT 40")
add("dots_pipeline", on3(lambda v: rounded(dots.detect(v, G3, 1.0, 1.0, n=40))), DOTS_SQL)
add("dots_fitted", on3(lambda v: dots.detect(v, G3, 1.0, 1.0, n=10, fitting=True, circularity=True)))
simple3("nuclei_reduce_mean", lambda v: rounded(nuclei.reduce_planes(v, G3, "mean")), "SELECT x, y, 0 AS z, " + r6("avg(v)") + " AS v FROM {g} GROUP BY x, y")
_q, _g = g3()
_hist = _q.histogram(_q.cte(f"SELECT x, y, max(v) AS v FROM {_g} GROUP BY x, y"))
_pr = _q.cte(f"SELECT min(CASE WHEN run >= 0.01 * total THEN bin END) AS a, min(CASE WHEN run >= 0.995 * total THEN bin END) AS b, min(l) AS l, min(r) AS r FROM (SELECT bin, l, r, sum(c) OVER (ORDER BY bin) AS run, sum(c) OVER () AS total FROM {_hist}) q")


def _render(v):
    top = agg.projection(v, "max")
    hist = agg.histogram(top)
    low, high = (agg.histogram_percentile(hist, p).first()["value"] for p in (0.01, 0.995))
    return grey(top, low, high).select("x", "y", F.col("r").alias("grey"))


add("render_projection", on3(_render), _q.out(f"SELECT x, y, CAST(least(255.0, greatest(0.0, floor((v - (l + (a + 1) / 65537.0 * (r - l))) / ((b - a) / 65537.0 * (r - l)) * 255 + 0.5))) AS INT) AS grey FROM (SELECT x, y, max(v) AS v FROM {_g} GROUP BY x, y) m, {_pr}"))
simple2("label_colors", lambda v: label_colors(v.select("x", "y", (F.col("x") % 4).alias("label"))), "SELECT x, y, x % 4 AS label, CASE WHEN x % 4 IN (0, 3) THEN 255 ELSE 0 END AS r, CASE WHEN x % 4 IN (1, 3) THEN 255 ELSE 0 END AS g, CASE WHEN x % 4 IN (2, 3) THEN 255 ELSE 0 END AS b FROM {g}")
