"""Stencils: separable convolution with boundary modes and the filters that are built of it.

A pass along an axis gathers each line once (one shuffle; a line is as long as the axis), computes all its values by array
functions and deals them out again. Lines must be dense: see Grid.fill. Filters of several passes work on dense blocks with halos instead
(tessera.operators.dense): one shuffle for all passes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import AXES, Grid, others
from tessera.operators import dense, fourier

MODES = ("valid", "mirror", "periodic", "weighted", "zeros", "normalized")


def _index(i: Column, n: Column, mode: str) -> Column:
    """Where a tap at i reads."""
    if mode == "mirror":  # reflect about the end samples, as often as it takes
        period = F.greatest(2 * (n - 1), F.lit(1))
        j = F.pmod(i, period)
        return F.when(j >= n, period - j).otherwise(j)
    return F.pmod(i, n) if mode == "periodic" else i


def convolve(df: DataFrame, axis: str, taps: list[float], mode: str = "mirror", stride: int = 1) -> DataFrame:
    """Correlation of every line along axis with an odd number of taps. At the borders:

    valid: 0; mirror: reflected without repeating the end; periodic: wrapped; zeros: 0 outside; weighted: taps inside, times the
    sum of all over the sum of those used; normalized: over the sum of those used."""
    if len(taps) % 2 == 0 or mode not in MODES:
        raise ValueError("an odd number of taps and a known mode are needed")
    r, whole = len(taps) // 2, float(sum(taps))
    line = df.groupBy(*others(axis)).agg(F.array_sort(F.collect_list(F.struct(axis, "v"))).alias("l")).withColumn("l", F.transform("l", lambda s: s["v"]))
    v, n = F.col("l"), F.size("l")

    def at(i: Column) -> Column:
        terms, used = [], []
        for k, t in enumerate(taps):
            if t == 0.0 and mode not in ("weighted", "normalized"):
                continue
            j = _index(i + (k - r), n, mode)
            inside = (j >= 0) & (j < n)
            terms.append(F.when(inside, F.lit(float(t)) * F.get(v, j)).otherwise(0.0))
            used.append(F.when(inside, F.lit(float(t))).otherwise(0.0))
        total = reduce(lambda a, b: a + b, terms, F.lit(0.0))
        if mode == "valid":
            return F.when((i >= r) & (i < n - r), total).otherwise(0.0)
        if mode == "weighted":
            return total * whole / reduce(lambda a, b: a + b, used)
        if mode == "normalized":
            return total / reduce(lambda a, b: a + b, used)
        return total

    lines = line.select(*others(axis), F.transform(F.sequence(F.lit(0), n - 1), at).alias("l"))
    out = lines.select(*others(axis), F.posexplode("l").alias(axis, "v"))
    out = out.where(F.col(axis) % stride == 0).withColumn(axis, F.floor(F.col(axis) / stride).cast("int")) if stride > 1 else out
    return out.select(*AXES, "v")


def separable(df: DataFrame, taps: dict[str, list[float]], mode: str = "mirror") -> DataFrame:
    """One pass for each axis that has taps."""
    for axis, own in taps.items():
        df = convolve(df, axis, own, mode)
    return df


# ---------------------------------------------------------------- kernels


def gaussian(sigma: float, longest: int | None = None) -> list[float]:
    """Half width ceil(3 sigma), at least 1; unit sum; cut to an odd length of at most longest."""
    r = max(1, math.ceil(3 * sigma))
    while longest is not None and 2 * r + 1 > longest and r > 0:
        r -= 1
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(k) for x in k]


def gaussian_d1(sigma: float) -> list[float]:
    """First derivative: taps times -x / sigma^2."""
    k = gaussian(sigma)
    r = len(k) // 2
    return [-(i - r) / sigma**2 * t for i, t in enumerate(k)]


def gaussian_d2(sigma: float) -> list[float]:
    """Second derivative: (x^2 - sigma^2) / sigma^4 times a unit Gaussian of half width ceil(4 sigma)."""
    r = math.ceil(4 * sigma)
    g = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [(i * i - sigma**2) / sigma**4 * t / sum(g) for i, t in zip(range(-r, r + 1), g)]


def _reach(**taps: list[float]) -> tuple[int, int, int]:
    return tuple(len(taps[a]) // 2 if a in taps else 0 for a in AXES)


def smooth(df: DataFrame, grid: Grid, lateral: float, axial: float | None = None) -> DataFrame:
    """Gaussian smoothing, weights at borders normalised; sigma of 0 or less skips an axis, z only with more than one plane."""
    axial = lateral if axial is None else axial
    taps = {a: gaussian(lateral) for a in "xy" if lateral > 0}
    if axial > 0 and grid.nz > 1:
        taps["z"] = gaussian(axial, 2 * grid.nz - 1)

    def work(v, first):
        for a, t in taps.items():
            v = dense.correlate(v, a, t, "normalized")
        return {"v": v}

    return dense.over_blocks(df, grid, work, _reach(**taps), "v double")


def log_of_gaussian(v: np.ndarray, deep: bool, lateral: float, axial: float) -> np.ndarray:
    """Of a block: the sum over the axes of minus the second derivative along one and the Gaussian along the others, mirrored borders."""
    g, d2 = gaussian(lateral), [-t for t in gaussian_d2(lateral)]
    gx, dx = dense.correlate(v, "x", g), dense.correlate(v, "x", d2)
    flat = dense.correlate(dx, "y", g) + dense.correlate(gx, "y", d2)
    if not deep:
        return flat
    gz, dz = gaussian(axial), [-t for t in gaussian_d2(axial)]
    return dense.correlate(flat, "z", gz) + dense.correlate(dense.correlate(gx, "y", g), "z", dz)


def _log_reach(grid: Grid, lateral: float, axial: float) -> tuple[int, int, int]:
    return math.ceil(4 * lateral), math.ceil(4 * lateral), math.ceil(4 * axial) if grid.nz > 1 else 0


def laplacian_of_gaussian(df: DataFrame, grid: Grid, lateral: float, axial: float | None = None) -> DataFrame:
    """See log_of_gaussian; one shuffle, to blocks."""
    axial = lateral if axial is None else axial
    return dense.over_blocks(df, grid, lambda v, first: {"v": log_of_gaussian(v, grid.nz > 1, lateral, axial)}, _log_reach(grid, lateral, axial), "v double")


def log_maxima(df: DataFrame, grid: Grid, lateral: float, axial: float) -> DataFrame:
    """(x, y, z, v): the strict local maxima of the Laplacian of Gaussian; only they leave their blocks."""

    def work(v, first):
        out = log_of_gaussian(v, grid.nz > 1, lateral, axial)
        return {"v": out, None: dense.maxima(out, first, grid)}

    return dense.over_blocks(df, grid, work, tuple(r + 1 for r in _log_reach(grid, lateral, axial)), "v double")


def partial(df: DataFrame, axis: str, sigma: float, order: int = 1, grid: Grid | None = None) -> DataFrame:
    """Gaussian derivative along axis, Gaussian along the other lateral axis; borders are not normalised."""
    r = math.ceil(4 * sigma)
    return dense.over_blocks(df, dense.extent(df, grid), lambda v, first: {"v": _partial(v, axis, sigma, order)}, (r, r, 0), "v double")


def _partial(v: np.ndarray, axis: str, sigma: float, order: int = 1) -> np.ndarray:
    own = gaussian_d1(sigma) if order == 1 else gaussian_d2(sigma)
    return dense.correlate(dense.correlate(v, axis, own, "zeros"), "y" if axis == "x" else "x", gaussian(sigma), "zeros")


def determinant_of_hessian(df: DataFrame, sigma: float, grid: Grid | None = None) -> DataFrame:
    """Ixx Iyy - Ixy^2 of planes."""
    g, d1, d2, r = gaussian(sigma), gaussian_d1(sigma), gaussian_d2(sigma), math.ceil(4 * sigma)

    def work(v, first):
        xx, yy, xy = (dense.correlate(dense.correlate(v, "x", a), "y", b) for a, b in ((d2, g), (g, d2), (d1, d1)))
        return {"v": xx * yy - xy * xy}

    return dense.over_blocks(df, dense.extent(df, grid), work, (r, r, 0), "v double")


def gradient_magnitude(df: DataFrame, sigma: float, grid: Grid | None = None) -> DataFrame:
    r = math.ceil(4 * sigma)
    return dense.over_blocks(df, dense.extent(df, grid), lambda v, first: {"v": np.hypot(_partial(v, "x", sigma), _partial(v, "y", sigma))}, (r, r, 0), "v double")


def focus_score(df: DataFrame, sigma: float = 3.0, grid: Grid | None = None) -> DataFrame:
    """(z, score): each plane's summed gradient magnitude."""
    return gradient_magnitude(df, sigma, grid).groupBy("z").agg(F.sum("v").alias("score"))


def eigenvalues(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of [[a, b], [b, c]], the larger first."""
    mean, root = (a + c) / 2, np.sqrt((a - c) * (a - c) / 4 + b * b)
    return mean + root, mean - root


def pixel_features(df: DataFrame, sigmas: list[float], grid: Grid | None = None) -> DataFrame:
    """Seven features of each pixel and sigma: Gaussian, LoG, gradient magnitude, two eigenvalues of the structure tensor and of the Hessian.

    Columns s<sigma>_<feature>. All scales are computed in one pass over blocks."""
    names = [f"s{s:g}_".replace(".", "_") + f for s in sigmas for f in ("gauss", "log", "gm", "st1", "st2", "he1", "he2")]
    r = math.ceil(4 * max(sigmas)) + math.ceil(3 * max(sigmas)) + 1

    def work(v, first):
        out = []
        for s in sigmas:
            g, d1, d2 = gaussian(s), gaussian_d1(s), gaussian_d2(s)
            both = lambda u, a, b, g=g: dense.correlate(dense.correlate(u, "x", a, "normalized" if a is g else "zeros"), "y", b, "normalized" if b is g else "zeros")
            dx, dy, dxx, dyy, dxy = (both(v, a, b) for a, b in ((d1, g), (g, d1), (d2, g), (g, d2), (d1, d1)))
            tensor = eigenvalues(*(both(u, g, g) for u in (dx * dx, dx * dy, dy * dy)))
            out += [both(v, g, g), -dxx - dyy, np.sqrt(dx * dx + dy * dy), *tensor, *eigenvalues(dxx, dxy, dyy)]
        return dict(zip(names, out))

    return dense.over_blocks(df, dense.extent(df, grid), work, (r, r, 0), ", ".join(f"{n} double" for n in names))


def cumulative_sum(df: DataFrame, axis: str) -> DataFrame:
    w = Window.partitionBy(*others(axis)).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("v", F.sum("v").over(w))


def box_sum(df: DataFrame, grid: Grid, px: int, py: int) -> DataFrame:
    """Full-size box sums: an output of (nx + px - 1) by (ny + py - 1), each the sum of the px by py box that ends there."""
    wide = Grid(grid.nx + px - 1, grid.ny + py - 1, grid.nz).fill(df)
    for axis, p in (("x", px), ("y", py)):
        w = Window.partitionBy(*others(axis)).orderBy(axis).rowsBetween(-(p - 1), 0)
        wide = wide.withColumn("v", F.sum("v").over(w))
    return wide


def downsample(df: DataFrame, factor: int) -> DataFrame:
    """Sums of aligned factor by factor boxes."""
    return df.groupBy(F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y"), "z").agg(F.sum("v").alias("v"))


def cross_correlation(image: DataFrame, template: DataFrame, grid: Grid) -> DataFrame:
    """Normalised cross-correlation surface of two planes of one shape: (dx, dy, ncc), dx and dy the lag of the image over the template.

    Sums by lag over the overlap, normalised by the whole number of pixels and the template's deviation; where that norm is at most
    1e-9 the plain sum of products stays. Products come from Fourier transforms along the lines, the image's own sums from running sums."""
    own = grid.fill(image).select("x", "y", F.col("v").alias("sa"), (F.col("v") * F.col("v")).alias("saa"))
    sums = fourier.overlap_sums(own, grid, ["sa", "saa"]).join(fourier.lagged_products(image, template, grid), ["dx", "dy"])
    whole = template.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("st"), F.stddev_samp("v").alias("sd"))  # one row
    sums = sums.crossJoin(F.broadcast(whole))
    spread = F.greatest(F.col("saa") - F.col("sa") * F.col("sa") / F.col("n"), F.lit(0.0))
    norm = F.sqrt(spread) * F.sqrt(F.col("n") - 1.0) * F.col("sd")
    return sums.select("dx", "dy", F.when(norm > 1e-9, (F.col("sab") - F.col("sa") * F.col("st") / F.col("n")) / norm).otherwise(F.col("sab")).alias("ncc"))
