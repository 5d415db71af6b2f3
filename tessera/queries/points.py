"""Queries over points, vectors and feature tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera import views
from tessera.checkpoints import stored
from tessera.operators import agg, forest, geometry, spatial
from tessera.plans import align
from tessera.queries.sql import log_p, r6
from tessera.queries.volumes import rounded

Q: dict = {}
S: dict[str, str] = {}
P, H = f"({views.POINTS_SQL})", f"({views.SHIFTED_SQL})"
FT = f"({views.FEATURES_SQL})"


def add(name: str, run, sql: str | None = None) -> None:
    Q[name] = run
    if sql is not None:
        S[name] = sql


_d2 = "((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z))"


def near(q: str, p: str, reach: float) -> str:
    """CTEs q, p and n: all pairs (q.*, p.* as a struct, d2) closer than reach, by cells of that size."""
    cells = ", ".join(f"CAST(floor({a} / {reach!r}) AS BIGINT) AS c{a}" for a in "xyz")
    steps = ", ".join(f"({i}, {j}, {k})" for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))
    return f"""q AS MATERIALIZED (SELECT id, x, y, z, {cells} FROM {q} s), p AS MATERIALIZED (SELECT id, x, y, z, {cells} FROM {p} t),
n AS MATERIALIZED (SELECT q.id AS qid, p.id AS pid, q.x AS qx, q.y AS qy, q.z AS qz, p.x AS px, p.y AS py, p.z AS pz, {_d2} AS d2
  FROM q CROSS JOIN (VALUES {steps}) o(i, j, k) JOIN p ON p.cx = q.cx + o.i AND p.cy = q.cy + o.j AND p.cz = q.cz + o.k WHERE {_d2} < {reach * reach!r})"""


def nearest_sql(k: int) -> str:
    """From the pairs within 4; queries with fewer than k of them meet all points."""
    return f"""WITH {near(H, P, 4.0)},
few AS MATERIALIZED (SELECT q.* FROM q LEFT JOIN (SELECT qid, count(*) AS c FROM n GROUP BY qid) m ON m.qid = q.id WHERE coalesce(c, 0) < {k}),
every AS (SELECT qid, pid, d2 FROM n WHERE qid NOT IN (SELECT id FROM few) UNION ALL SELECT q.id, p.id, {_d2} FROM few q, p)
SELECT qid, CAST(r AS INT) AS rank, pid, {r6('d2')} AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, pid) AS r FROM every) z WHERE r <= {k}"""


add("ball_join", lambda s, d: rounded(spatial.ball_join(views.shifted(s, d), views.points(s, d), 2.5).select("qid", "pid", "d2")), f"WITH {near(H, P, 2.5)} SELECT qid, pid, {r6('d2')} AS d2 FROM n")


def _nearest(s, d, k: int):
    p = stored(views.points(s, d))  # grouped once for both sides
    return spatial.nearest(views.moved(p), p, k, kept=True, distinct=views.points_distinct(s, d))


add("nearest_neighbours", lambda s, d: rounded(_nearest(s, d, 5)), nearest_sql(5))
add("closest_point", lambda s, d: rounded(_nearest(s, d, 1).select("qid", "pid", "d2")), f"SELECT qid, pid, d2 FROM ({nearest_sql(1)}) c")


def _vectors(s, d):
    e = views.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return e.where("id % 50 = 0"), e


add(
    "nearest_vectors",
    lambda s, d: rounded(spatial.nearest_vectors(*_vectors(s, d), 10)).select("qid", "rank", "pid", "d2"),
    f"SELECT qid, rank, pid, {r6('d2')} AS d2 FROM (SELECT a.vec_id AS qid, b.vec_id AS pid, s AS d2, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY s, b.vec_id) AS INT) AS rank FROM embeddings a, embeddings b, LATERAL (SELECT sum((x - y) * (x - y)) AS s FROM (SELECT unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y) u) l WHERE a.vec_id % 50 = 0) z WHERE rank <= 10",
)
add("kernel_density", lambda s, d: rounded(spatial.density(views.shifted(s, d), views.points(s, d), 1.5)), f"WITH {near(H, P, 3.75)} SELECT q.id, {r6('coalesce(sum(exp(-d2 / 4.5)), 0.0)')} AS kde FROM q LEFT JOIN n ON n.qid = q.id GROUP BY q.id")
_w = "exp(-d2 / 2.0)"
_ms = ", ".join(r6(f"CASE WHEN sum({_w}) >= 1e-9 THEN sum({_w} * p{a}) / sum({_w}) ELSE q.{a} END") + f" AS {a}" for a in "xyz")
add("mean_shift_step", lambda s, d: rounded(spatial.mean_shift_step(views.shifted(s, d), views.points(s, d), 1.0)), f"WITH {near(H, P, 10.0)} SELECT q.id, {_ms} FROM q LEFT JOIN n ON n.qid = q.id GROUP BY q.id, q.x, q.y, q.z")
add("pair_differences", lambda s, d: rounded(spatial.pair_differences(views.points(s, d), 2.0)), f"WITH {near(P, P, 2.0)} SELECT qid AS i, pid AS j, {r6('px - qx')} AS dx, {r6('py - qy')} AS dy, {r6('pz - qz')} AS dz FROM n WHERE qid < pid")
SM = f"({views.SMALL_SQL})"
add("all_pair_differences", lambda s, d: rounded(spatial.pair_differences(views.small_points(s, d))), f"SELECT q.id AS i, p.id AS j, {r6('p.x - q.x')} AS dx, {r6('p.y - q.y')} AS dy, {r6('p.z - q.z')} AS dz FROM {SM} q JOIN {SM} p ON q.id < p.id")


def _pairs(s, d):
    a = views.small_points(s, d)
    return spatial.pair_differences(a), spatial.pair_differences(geometry.transform_points(a, move=(4.0, 2.0, -1.0)).select("id", "x", "y", "z"))


_pd = f"(SELECT q.id AS i, p.id AS j, p.x - q.x AS dx, p.y - q.y AS dy, p.z - q.z AS dz FROM {SM} q JOIN {SM} p ON q.id < p.id)"
_minus = "sqrt((a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy) + (a.dz - b.dz) * (a.dz - b.dz))"
_plus = _minus.replace(" - b.", " + b.")
_top = "greatest(sqrt(a.dx * a.dx + a.dy * a.dy + a.dz * a.dz), sqrt(b.dx * b.dx + b.dy * b.dy + b.dz * b.dz))"
add("band_join", lambda s, d: rounded(spatial.band_join(*_pairs(s, d), 0.4, 0.01)), f"SELECT a.i AS ai, a.j AS aj, b.i AS bi, b.j AS bj, {r6(f'least({_minus}, {_plus})')} AS diff, {_plus} < {_minus} AS swapped FROM {_pd} a JOIN {_pd} b ON abs(a.dx - b.dx) <= {2 * math.sqrt(2) * 0.4!r} WHERE {_top} > 1 AND least({_minus}, {_plus}) / {_top} < 0.01 + 0.4 / {_top}")
add("transform_points", lambda s, d: rounded(geometry.transform_points(views.points(s, d), 1.1, 0.5, 0.3, (1.0, 2.0, 3.0))), f"SELECT id, {r6(f'x * 1.1 * {math.cos(0.3)!r} - y * 1.1 * {math.sin(0.3)!r} + 1')} AS x, {r6(f'x * 1.1 * {math.sin(0.3)!r} + y * 1.1 * {math.cos(0.3)!r} + 2')} AS y, {r6('z * 0.5 + 3')} AS z FROM {P} p")
add("bounding_box", lambda s, d: agg.bounding_box(views.points(s, d)), f"SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS volume FROM {P} p")
_kde = f"(WITH {near(f'(SELECT id, x - 4.0 AS x, y - 2.0 AS y, z + 1.0 AS z FROM {H} h)', P, 1.0)} SELECT q.id, coalesce(sum(exp(-d2 / 0.32)), 0.0) AS k FROM q LEFT JOIN n ON n.qid = q.id GROUP BY q.id)"
_size = "(max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) / 0.064"
_c = "greatest(a.c, b.c)"
_e = f"({_c} * (1 - exp(-a.n / {_c})) * (1 - exp(-b.n / {_c})))"
add(
    "alignment_significance",
    lambda s, d: spatial.alignment_significance(views.points(s, d), views.shifted(s, d), (4.0, 2.0, -1.0), 0.4).select("n_aligned", F.round("kde", 4).alias("kde"), F.round("expected", 4).alias("expected"), (F.round("goodness", 6) + 0.0).alias("goodness")),
    f"SELECT m.n AS n_aligned, round(m.k, 4) AS kde, round({_e}, 4) AS expected, {r6(f'CASE WHEN m.n - 1 < 1 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - {_e} / (m.n - 1))) END')} AS goodness FROM (SELECT count(*) FILTER (k > 0.7) AS n, sum(k) AS k FROM {_kde} t) m, (SELECT count(*) AS n, {_size} AS c FROM {P} p) a, (SELECT count(*) AS n, {_size} AS c FROM {H} h) b",
)


def _align(s, d):
    a = views.small_points(s, d)
    got = align.align(a, geometry.transform_points(a, move=(4.0, 2.0, -1.0)).select("id", "x", "y", "z"))
    return s.createDataFrame([(round(got.dx, 3) + 0.0, round(got.dy, 3) + 0.0, round(got.dz, 3) + 0.0, got.method)], "dx double, dy double, dz double, method string")


#: The planted shift is what the pairs of the two sets must vote for.
add("align_points", _align, "SELECT 4.0::DOUBLE AS dx, 2.0::DOUBLE AS dy, -1.0::DOUBLE AS dz, 'pairs' AS method")
_cell = ", ".join(f"CAST(floor((p{a} - q{a}) / 0.5 + 0.5) AS INT) AS {a}" for a in "xyz")
_peak = f"""WITH {near(P, H, 6.0)}, d AS MATERIALIZED (SELECT x, y, z, count(*) AS n FROM (SELECT {_cell} FROM n) c GROUP BY 1, 2, 3),
k AS (SELECT p.x, p.y, p.z, sum(q.n * exp(-{_d2} * 0.25 / {2 * 0.4 * 0.4!r})) AS kde FROM d p JOIN d q ON q.x BETWEEN p.x - 1 AND p.x + 1 AND {_d2} < 4.0 GROUP BY 1, 2, 3)
SELECT x * 0.5::DOUBLE AS dx, y * 0.5::DOUBLE AS dy, z * 0.5::DOUBLE AS dz, {r6("kde")} AS kde FROM k ORDER BY k.kde DESC, x, y, z LIMIT 1"""
add("displacement_peak", lambda s, d: rounded(spatial.displacement_peak(views.shifted(s, d), views.points(s, d), 6.0, 0.4)), _peak)
# ---------------------------------------------------------------- grid search with refinements and a second peak
_gd = "((i * 0.5 - 6.0 - x) * (i * 0.5 - 6.0 - x) + (j * 0.5 - 6.0 - y) * (j * 0.5 - 6.0 - y) + (k * 0.5 - 6.0 - z) * (k * 0.5 - 6.0 - z))"
_gk = ", ".join(f"CAST(floor(({a} + 6.0) / 0.5) AS INT) + {o}.s AS {c}" for a, o, c in (("x", "a", "i"), ("y", "b", "j"), ("z", "c", "k")))
_steps = "(SELECT CAST(t - 3 AS INT) AS s FROM range(7) r(t))"
_grid = f"""{near(P, H, 6.0)}, d AS MATERIALIZED (SELECT px - qx AS x, py - qy AS y, pz - qz AS z FROM n),
g AS MATERIALIZED (SELECT i, j, k, sum(exp(-{_gd} / {2 * 0.4 * 0.4!r})) AS kde FROM (SELECT x, y, z, {_gk} FROM d, {_steps} a, {_steps} b, {_steps} c) e
  WHERE {_gd} < 1.0 AND i BETWEEN 0 AND 24 AND j BETWEEN 0 AND 24 AND k BETWEEN 0 AND 24 AND (i * 0.5 - 6.0) * (i * 0.5 - 6.0) + (j * 0.5 - 6.0) * (j * 0.5 - 6.0) + (k * 0.5 - 6.0) * (k * 0.5 - 6.0) <= 36.0 GROUP BY i, j, k)"""
_rd = "((d.x - x0) * (d.x - x0) + (d.y - y0) * (d.y - y0) + (d.z - z0) * (d.z - z0))"

def _refined_sql(level: int) -> str:
    """CTE r of the next level: the best of the offsets around r of this one, if it is better."""
    size = 0.4 / 2**level / 7
    return f"""r{level + 1} AS MATERIALIZED (SELECT CASE WHEN better THEN x0 ELSE x END AS x, CASE WHEN better THEN y0 ELSE y END AS y, CASE WHEN better THEN z0 ELSE z END AS z, CASE WHEN better THEN s ELSE kde END AS kde
  FROM (SELECT *, s > (SELECT kde FROM r{level}) * (1 + 1e-11) AS better FROM (SELECT i, j, k, x0, y0, z0, sum(exp(-{_rd} / {2 * 0.4 * 0.4!r})) AS s
    FROM (SELECT i, j, k, x + i * {size!r} AS x0, y + j * {size!r} AS y0, z + k * {size!r} AS z0 FROM r{level}, o) e, w d WHERE {_rd} < 1.0 GROUP BY ALL) u QUALIFY s >= max(s) OVER () * (1 - 1e-11) ORDER BY i, j, k LIMIT 1) t, r{level})"""


_search = f"""WITH {_grid},
r0 AS MATERIALIZED (SELECT i * 0.5::DOUBLE - 6.0 AS x, j * 0.5::DOUBLE - 6.0 AS y, k * 0.5::DOUBLE - 6.0 AS z, kde FROM g ORDER BY round(kde, 9) DESC, k, j, i LIMIT 1),
w AS MATERIALIZED (SELECT d.* FROM d, r0 f WHERE (d.x - f.x) * (d.x - f.x) + (d.y - f.y) * (d.y - f.y) + (d.z - f.z) * (d.z - f.z) < 3.3),
o AS MATERIALIZED (SELECT a.t - 7 AS i, b.t - 7 AS j, c.t - 7 AS k FROM range(15) a(t), range(15) b(t), range(15) c(t) WHERE pow(a.t - 7, 2) + pow(b.t - 7, 2) + pow(c.t - 7, 2) <= 49),
{", ".join(_refined_sql(level) for level in range(12))}
SELECT round(x, 3) + 0.0 AS dx, round(y, 3) + 0.0 AS dy, round(z, 3) + 0.0 AS dz, round(kde, 4) AS kde, round(second, 4) AS second, round((kde - second) / (kde + second), 6) + 0.0 AS goodness
FROM r12, (SELECT coalesce(max(g.kde), 0.0) AS second FROM g, r12 WHERE pow(i * 0.5 - 6.0 - x, 2) + pow(j * 0.5 - 6.0 - y, 2) + pow(k * 0.5 - 6.0 - z, 2) >= 5.76) t"""


def _searched(s, d):
    found = spatial.displacement_search(views.shifted(s, d), views.points(s, d), 6.0, 0.4)
    return found.select(*[(F.round("d" + c, 3) + 0.0).alias("d" + c) for c in "xyz"], F.round("kde", 4).alias("kde"), F.round("second", 4).alias("second"), (F.round("goodness", 6) + 0.0).alias("goodness"))


#: Sums of ten thousands of terms: three decimals do not depend on their order.
add("displacement_grid", lambda s, d: spatial.pair_density(views.shifted(s, d), views.points(s, d), 6.0, 0.4).withColumn("kde", F.round("kde", 3)), f"WITH {_grid} SELECT i, j, k, round(kde, 3) AS kde FROM g")
add("displacement_search", _searched, _search)
_far = "((p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y) + (p.z - m.z) * (p.z - m.z))"
_near = "sum(exp(-{d} / 8.0) * p.{a}) FILTER ({d} < 400.0) / sum(exp(-{d} / 8.0)) FILTER ({d} < 400.0) AS {a}"
_modes = f"""WITH RECURSIVE {near(P, P, 5.0)},
b AS (SELECT qx AS x, qy AS y, qz AS z FROM n GROUP BY qid, qx, qy, qz ORDER BY sum(exp(-d2 / 8.0)) DESC, qid LIMIT 1),
m(k, x, y, z) AS (SELECT 0, x, y, z FROM b UNION ALL SELECT m.k + 1, {", ".join(_near.format(d=_far, a=a) for a in "xyz")} FROM m, p WHERE m.k < 100 GROUP BY m.k)
SELECT round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z FROM m WHERE k = 100"""
add("mode_search", lambda s, d: s.createDataFrame([tuple(round(v, 3) + 0.0 for v in spatial.mode_search(views.points(s, d), 2.0))], "x double, y double, z double"), _modes)

# ---------------------------------------------------------------- forest
_labels = [0, 1, 2]
_cuts = f"""WITH f AS MATERIALIZED (SELECT {{c}} AS f, label FROM {FT} t),
n AS (SELECT f, count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 2) AS n2 FROM f GROUP BY f),
k AS (SELECT f, lead(f) OVER (ORDER BY f) AS nx, sum(n) OVER w AS k, sum(n0) OVER w AS l0, sum(n1) OVER w AS l1, sum(n2) OVER w AS l2, sum(n) OVER () AS t, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1, sum(n2) OVER () AS t2 FROM n WINDOW w AS (ORDER BY f)),
c AS (SELECT k::DOUBLE AS k, (t - k)::DOUBLE AS r, t::DOUBLE AS t, l0::DOUBLE AS l0, l1::DOUBLE AS l1, l2::DOUBLE AS l2, (t0 - l0)::DOUBLE AS r0, (t1 - l1)::DOUBLE AS r1, (t2 - l2)::DOUBLE AS r2, (f + nx) / 2 AS th FROM k WHERE nx IS NOT NULL)
"""
_gini = "(k * (1 - pow(l0 / k, 2) - pow(l1 / k, 2) - pow(l2 / k, 2)) + r * (1 - pow(r0 / r, 2) - pow(r1 / r, 2) - pow(r2 / r, 2))) / t"
_entropy = f"{log_p('k')} - {log_p('l0')} - {log_p('l1')} - {log_p('l2')} + {log_p('r')} - {log_p('r0')} - {log_p('r1')} - {log_p('r2')}"
add("gini_split", lambda s, d: rounded(forest.gini_split(views.features(s, d), "f0", _labels)), _cuts.format(c="f0") + f"SELECT k::BIGINT AS n_left, r::BIGINT AS n_right, {r6(_gini)} AS gini, {r6('th')} AS threshold FROM c ORDER BY {_gini}, k LIMIT 1")
add("entropy_split", lambda s, d: forest.entropy_split(views.features(s, d), "f0", _labels).select("n_left", "n_right", F.round("entropy", 3).alias("entropy"), F.round("threshold", 6).alias("threshold")), _cuts.format(c="f0") + f"SELECT k::BIGINT AS n_left, r::BIGINT AS n_right, round({_entropy}, 3) AS entropy, round(th, 6) AS threshold FROM c ORDER BY {_entropy}, k LIMIT 1")
#: Three small fixed trees: tree, node, left, right, var, th, label, gain.
_NODES = [(0, 0, 1, 2, 3, 50000.5, 0, 12.0), (0, 1, 0, 0, 0, 0.0, 1, 0.0), (0, 2, 3, 4, 0, 25.5, 1, 4.0), (0, 3, 0, 0, 0, 0.0, 2, 0.0), (0, 4, 0, 0, 0, 0.0, 0, 0.0), (1, 0, 1, 2, 1, 0.055, 0, 6.0), (1, 1, 0, 0, 0, 0.0, 0, 0.0), (1, 2, 0, 0, 0, 0.0, 1, 0.0), (2, 0, 1, 2, 2, 0.035, 0, 2.0), (2, 1, 0, 0, 0, 0.0, 1, 0.0), (2, 2, 0, 0, 0, 0.0, 2, 0.0)]
_names = ["f0", "f1", "f2", "f3"]
_t0 = "CASE WHEN f3 < 50000.5 THEN 1 WHEN f0 < 25.5 THEN 2 ELSE 0 END"
_votes = f"SELECT id, label, {_t0} AS a, CASE WHEN f1 < 0.055 THEN 0 ELSE 1 END AS b, CASE WHEN f2 < 0.035 THEN 1 ELSE 2 END AS c FROM {FT} t"
_pred = f"SELECT id, label, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE least(a, b, c) END AS prediction FROM ({_votes}) v"


def _predicted(s, d):
    return forest.predict(views.features(s, d), s.createDataFrame(_NODES, forest.NODES), _names)


add("forest_predict", lambda s, d: _predicted(s, d).select("id", "prediction"), f"SELECT id, prediction FROM ({_pred}) y")
add("forest_case_when", lambda s, d: views.features(s, d).select("id", forest.tree_expression([n[1:7] for n in _NODES if n[0] == 0], _names).alias("prediction")), f"SELECT id, {_t0} AS prediction FROM {FT} a")
add("forest_accuracy", lambda s, d: rounded(forest.accuracy(_predicted(s, d))), f"SELECT {r6('count(*) FILTER (prediction = label) / count(*)')} AS accuracy, count(*) AS n FROM ({_pred}) y")
add("forest_confusion", lambda s, d: forest.confusion(_predicted(s, d)), f"SELECT label, prediction, count(*) AS n FROM ({_pred}) y GROUP BY 1, 2")
add("feature_ranks", lambda s, d: forest.feature_ranks(views.features(s, d), ["f0", "f3"]), " UNION ALL ".join(f"SELECT id, '{f}' AS feature, CAST(row_number() OVER (ORDER BY {f}, id) - 1 AS INT) AS rank FROM {FT} a" for f in ("f0", "f3")))


# ---------------------------------------------------------------- the first levels of an exact tree over all rows
def grown(s, d, task_rows: int = 500):
    """Two levels of cuts, all of them found by sums over ranges."""
    return forest.fit(views.features(s, d), _names, trees=1, share=1.0, width=4, depth=2, task_rows=task_rows)


def levels_sql(out: str) -> str:
    """CTE nodes (node, left, right, var, th, label, gain) of the same tree."""
    side = lambda p: f"({p} - ({p}0 * {p}0 + {p}1 * {p}1 + {p}2 * {p}2) / {p})"
    ctes, rows = [], f"SELECT 0 AS node, * EXCLUDE (id) FROM {FT} t"
    for level in range(2):
        ctes.append(f"""w{level} AS MATERIALIZED ({rows}),
n{level} AS (SELECT node, f, v, count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 2) AS n2
  FROM ({" UNION ALL ".join(f"SELECT node, {k} AS f, f{k} AS v, label FROM w{level}" for k in range(4))}) u GROUP BY node, f, v),
k{level} AS (SELECT node, f, v, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS nx, {", ".join(f"CAST(sum(n{c}) OVER w AS DOUBLE) AS l{c}, CAST(sum(n{c}) OVER (PARTITION BY node, f) AS DOUBLE) AS t{c}" for c in ("", 0, 1, 2))} FROM n{level} WINDOW w AS (PARTITION BY node, f ORDER BY v)),
s{level} AS (SELECT *, t - l AS r, t0 - l0 AS r0, t1 - l1 AS r1, t2 - l2 AS r2 FROM k{level} WHERE nx IS NOT NULL),
b{level} AS MATERIALIZED (SELECT node, f, (v + nx) / 2 AS th, {side("t")} - ({side("l")} + {side("r")}) AS gain FROM s{level} QUALIFY row_number() OVER (PARTITION BY node ORDER BY {side("l")} + {side("r")}, f, l) = 1)""")
        value = "CASE f " + " ".join(f"WHEN {k} THEN f{k}" for k in range(4)) + " END"
        rows = f"SELECT 2 * w{level}.node + CASE WHEN {value} < th THEN 1 ELSE 2 END AS node, w{level}.* EXCLUDE (node) FROM w{level} JOIN b{level} ON b{level}.node = w{level}.node"
    ctes.append(f"""w2 AS MATERIALIZED ({rows}),
m AS (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, label) AS r FROM (SELECT node, label FROM w0 UNION ALL SELECT node, label FROM w1 UNION ALL SELECT node, label FROM w2) u GROUP BY node, label),
nodes AS (SELECT CAST(m.node AS INT) AS node, CASE WHEN b.node IS NULL THEN 0 ELSE CAST(2 * m.node + 1 AS INT) END AS "left", CASE WHEN b.node IS NULL THEN 0 ELSE CAST(2 * m.node + 2 AS INT) END AS "right", coalesce(f, 0) AS var, round(coalesce(th, 0.0), 6) + 0.0 AS th, label, {r6("coalesce(gain, 0.0)")} AS gain
  FROM m LEFT JOIN (SELECT * FROM b0 UNION ALL SELECT * FROM b1) b USING (node) WHERE r = 1)""")
    return "WITH " + ",\n".join(ctes) + "\n" + out


add("forest_levels", lambda s, d: rounded(grown(s, d)).drop("tree"), levels_sql("SELECT * FROM nodes"))
add("forest_importance", lambda s, d: rounded(forest.importance(grown(s, d), _names)), levels_sql(f"SELECT CAST(k AS INT) AS var, 'f' || k AS name, {r6('coalesce((SELECT sum(gain) FROM nodes WHERE var = k AND \"left\" > 0), 0.0) / (SELECT sum(gain) FROM nodes)')} AS importance FROM range(4) t(k)"))
add("forest_fit", lambda s, d: forest.fit(views.features(s, d), _names, trees=6, least=40, kind="entropy"))
add("forest_cross_validation", lambda s, d: forest.cross_validate(views.features(s, d), _names, trees=5, least=200))
add("forest_fold_accuracy", lambda s, d: rounded(agg.kfold(_predicted(s, d), "id", 5).groupBy("fold").agg((F.count_if(F.col("prediction") == F.col("label")) / F.count(F.lit(1))).alias("accuracy"))), f"SELECT CAST(id % 5 AS INT) AS fold, {r6('count(*) FILTER (prediction = label) / count(*)')} AS accuracy FROM ({_pred}) y GROUP BY 1")
