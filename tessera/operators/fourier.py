"""Fourier transforms of volumes as voxel rows (x, y, z, re, im): along one axis after the other, lines dealt to tasks, a shuffle between the axes.

No task holds more than LINES voxels or one line, whatever the volume's size. Products with a transfer function are joins of spectra."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoints import stored
from tessera.model import AXES, Grid, others

#: Voxels of the lines that one task transforms at once.
LINES = 1_000_000
SPECTRUM = "x int, y int, z int, re double, im double"


def complex_rows(df: DataFrame) -> DataFrame:
    """Voxel rows with an imaginary part of 0."""
    return df.select(*AXES, F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))


def along(df: DataFrame, grid: Grid, axis: str, inverse: bool = False) -> DataFrame:
    """The discrete transform of every line along axis; missing voxels count as 0, lines without voxels stay away."""
    n, (a, b) = grid.size(axis), others(axis)
    most, width = max(1, LINES // n), grid.size(a)
    line = F.col(a).cast("long") + width * F.col(b).cast("long")

    def run(table: pa.Table) -> pa.Table:
        at, pos = table.column("line").to_numpy(), table.column(axis).to_numpy()
        lines, row = np.unique(at, return_inverse=True)
        v = np.zeros((len(lines), n), complex)
        v[row, pos] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        v = np.fft.ifft(v, axis=1) if inverse else np.fft.fft(v, axis=1)
        whole = np.repeat(lines, n)
        columns = {axis: np.tile(np.arange(n), len(lines)), a: whole % width, b: whole // width}
        return pa.table({**{c: pa.array(columns[c].astype(np.int32)) for c in AXES}, "re": pa.array(v.real.ravel()), "im": pa.array(v.imag.ravel())})

    return df.select(F.floor(line / most).alias("part"), line.alias("line"), axis, "re", "im").groupBy("part").applyInArrow(run, SPECTRUM)


def transform(df: DataFrame, grid: Grid, inverse: bool = False) -> DataFrame:
    """The transform along all axes; an inverse one is divided by the number of voxels."""
    for axis in AXES:
        if grid.size(axis) > 1:
            df = along(df, grid, axis, inverse)
    return df


def product(a: DataFrame, b: DataFrame, conjugate: bool = False) -> DataFrame:
    """a times b, or times b's conjugate, voxel by voxel."""
    sign = -1.0 if conjugate else 1.0
    other = b.select(*AXES, F.col("re").alias("c"), (sign * F.col("im")).alias("d"))
    return a.join(other, list(AXES)).select(*AXES, (F.col("re") * F.col("c") - F.col("im") * F.col("d")).alias("re"), (F.col("re") * F.col("d") + F.col("im") * F.col("c")).alias("im"))


def _sum_sizes(a: Grid, b: Grid) -> Grid:
    return Grid(*(a.size(c) + b.size(c) - 1 for c in AXES))


def convolve(df: DataFrame, grid: Grid, kernel: DataFrame, size: Grid) -> DataFrame:
    """df (x, y, z, v) convolved with kernel rows of odd sizes, zeros outside, of the size of df."""
    wide = _sum_sizes(grid, size)
    got = transform(product(stored(transform(complex_rows(df), wide)), transform(complex_rows(kernel), wide)), wide, True)
    shifted = [(F.col(c) - size.size(c) // 2).cast("int").alias(c) for c in AXES]
    inside = [(F.col(c) >= 0) & (F.col(c) < grid.size(c)) for c in AXES]
    return got.select(*shifted, F.col("re").alias("v")).where(inside[0] & inside[1] & inside[2])


def lagged_products(image: DataFrame, template: DataFrame, grid: Grid) -> DataFrame:
    """(dx, dy, sab): sums of image(p + d) template(p) over all lags d of two planes of one shape."""
    wide = Grid(2 * grid.nx - 1, 2 * grid.ny - 1)
    got = transform(product(stored(transform(complex_rows(image), wide)), transform(complex_rows(template), wide), True), wide, True)
    lag = lambda c, n, m: F.when(F.col(c) < n, F.col(c)).otherwise(F.col(c) - m).cast("int")
    return got.select(lag("x", grid.nx, wide.nx).alias("dx"), lag("y", grid.ny, wide.ny).alias("dy"), F.col("re").alias("sab"))


def overlap_sums(df: DataFrame, grid: Grid, sums: list[str]) -> DataFrame:
    """(dx, dy, sums): of each column the sum over the part of the plane that lies over itself moved by (-dx, -dy): running sums from either
    end of an axis, one axis after the other."""
    for axis, n, lag, key in (("x", grid.nx, "dx", "y"), ("y", grid.ny, "dy", "dx")):
        ahead = Window.partitionBy(key).orderBy(axis)
        upto, on = ahead.rowsBetween(Window.unboundedPreceding, 0), ahead.rowsBetween(0, Window.unboundedFollowing)
        sides = [(F.col(axis), on, F.lit(True)), (F.col(axis) - (n - 1), upto, F.col(axis) < n - 1)]
        one, two = (df.where(use).select(key, at.cast("int").alias(lag), *sums) for df, at, use in ((df.withColumns({c: F.sum(c).over(w) for c in sums}), at, use) for at, w, use in sides))
        df = one.unionByName(two)
    return df.select("dx", "dy", *sums)
