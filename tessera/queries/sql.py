"""DuckDB SQL of the oracles, composed of common table expressions."""

from __future__ import annotations

import math

from tessera.model import others
from tessera.operators import stencil


class Sql:
    """Collects CTEs; each method adds one and returns its name."""

    def __init__(self):
        self.parts: list[str] = []

    def cte(self, text: str) -> str:
        name = f"c{len(self.parts)}"
        self.parts.append(f"{name} AS MATERIALIZED (\n{text}\n)")
        return name

    def out(self, text: str, recursive: bool = False) -> str:
        return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(self.parts) + "\n" + text

    def conv(self, src: str, axis: str, taps: list[float], mode: str, n: int) -> str:
        """Correlation along an axis by a join of each voxel with its taps."""
        r, period = len(taps) // 2, max(1, 2 * (n - 1))
        values = ", ".join(f"({k - r}, CAST({t!r} AS DOUBLE))" for k, t in enumerate(taps))
        at = f"(o.{axis} + t.o)"
        j = {"mirror": f"CASE WHEN (({at} % {period}) + {period}) % {period} >= {n} THEN {period} - (({at} % {period}) + {period}) % {period} ELSE (({at} % {period}) + {period}) % {period} END", "periodic": f"(({at} % {n}) + {n}) % {n}"}.get(mode, at)
        v = {"weighted": f"sum(t.k * g.v) * {sum(taps)!r} / sum(t.k)", "normalized": "sum(t.k * g.v) / sum(t.k)", "valid": f"CASE WHEN o.{axis} >= {r} AND o.{axis} < {n - r} THEN sum(t.k * g.v) ELSE 0 END"}.get(mode, "sum(t.k * g.v)")
        a, b = others(axis)
        return self.cte(f"SELECT o.x, o.y, o.z, {v} AS v FROM {src} o CROSS JOIN (VALUES {values}) t(o, k) JOIN {src} g ON g.{axis} = {j} AND g.{a} = o.{a} AND g.{b} = o.{b} GROUP BY o.x, o.y, o.z")

    def join(self, parts: list[str], value: str) -> str:
        """Tables over the same voxels as p0, p1, ... and an expression of their p0.v, p1.v."""
        text = f"SELECT p0.x, p0.y, p0.z, {value} AS v FROM {parts[0]} p0"
        for k, p in enumerate(parts[1:], 1):
            text += f" JOIN {p} p{k} USING (x, y, z)"
        return self.cte(text)

    def log(self, src: str, grid, lateral: float, axial: float) -> str:
        g, d = stencil.gaussian(lateral), [-t for t in stencil.gaussian_d2(lateral)]
        gx = self.conv(src, "x", g, "mirror", grid.nx)
        dx = self.conv(src, "x", d, "mirror", grid.nx)
        xy, yx = self.conv(dx, "y", g, "mirror", grid.ny), self.conv(gx, "y", d, "mirror", grid.ny)
        flat = self.join([xy, yx], "p0.v + p1.v")
        if grid.nz == 1:
            return flat
        gz, dz = stencil.gaussian(axial), [-t for t in stencil.gaussian_d2(axial)]
        deep = self.conv(self.conv(gx, "y", g, "mirror", grid.ny), "z", dz, "mirror", grid.nz)
        return self.join([self.conv(flat, "z", gz, "mirror", grid.nz), deep], "p0.v + p1.v")

    def neighbours(self, src: str, deep: bool) -> str:
        """(x, y, z, v, m): the largest of the neighbours."""
        z = "n.z BETWEEN o.z - 1 AND o.z + 1" if deep else "n.z = o.z"
        return self.cte(f"SELECT o.x, o.y, o.z, o.v, max(n.v) AS m FROM {src} o JOIN {src} n ON n.x BETWEEN o.x - 1 AND o.x + 1 AND n.y BETWEEN o.y - 1 AND o.y + 1 AND {z} AND (n.x, n.y, n.z) <> (o.x, o.y, o.z) GROUP BY o.x, o.y, o.z, o.v")

    def histogram(self, src: str, value: str = "v", bins: int = 65537) -> str:
        ends = self.cte(f"SELECT min({value}) - ((max({value}) - min({value})) / {bins} * 0.5 + 1e-6) AS l, max({value}) + ((max({value}) - min({value})) / {bins} * 0.5 + 1e-6) AS r FROM {src}")
        return self.cte(f"SELECT CAST(least(floor(({value} - l) / (r - l) * {bins} + 0.5), {bins - 1}) AS INT) AS bin, l, r, CAST(count(*) AS DOUBLE) AS c FROM {src}, {ends} GROUP BY 1, 2, 3")

    def otsu(self, hist: str, bins: int = 65537) -> str:
        """(level, value)."""
        run = self.cte(f"SELECT bin, l, r, sum(c) OVER w AS wb, sum(CAST(bin AS DOUBLE) * c) OVER w AS sb, sum(c) OVER () AS total, sum(CAST(bin AS DOUBLE) * c) OVER () AS everything FROM {hist} WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
        rank = self.cte(f"SELECT bin, l, r, wb * (total - wb) * (sb / wb - (everything - sb) / (total - wb)) * (sb / wb - (everything - sb) / (total - wb)) AS b FROM {run} WHERE wb > 0 AND total - wb > 0")
        return self.cte(f"SELECT bin AS level, l + bin / {float(bins - 2)!r} * (r - l) AS value FROM {rank} ORDER BY b DESC, bin DESC LIMIT 1")


def r6(e: str) -> str:
    return f"round({e}, 6) + 0.0"


def log_p(n: str) -> str:
    exact = " ".join(f"WHEN {k} THEN {math.log(math.factorial(k))!r}" for k in range(9))
    return f"(CASE {n} {exact} ELSE {n} * ln({n}) - {n} + 0.5 * ln({2 * math.pi!r} * {n}) END)"
