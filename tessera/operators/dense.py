"""Work on dense blocks with halos: voxels are dealt to blocks once, arrays are computed there, and each block gives back its own core."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import AXES, Grid

#: Core of a block along x, y and z: what a task holds is bounded by it and the halo, whatever the image's size.
SIDE = (128, 128, 64)


def extent(df: DataFrame, grid: Grid | None = None) -> Grid:
    """The given grid, or the one that the voxels span."""
    if grid is not None:
        return grid
    top = df.agg(*[F.coalesce(F.max(a) + 1, F.lit(0)).alias(a) for a in AXES]).first()
    return Grid(*(top[a] for a in AXES))


def correlate(v: np.ndarray, axis: str, taps: list[float], mode: str = "mirror") -> np.ndarray:
    """Correlation of an array (z, y, x) along an axis with an odd number of taps; borders: mirror (reflected without repeating the end), zeros, or
    normalized (over the sum of the taps inside)."""
    k, r = 2 - AXES.index(axis), len(taps) // 2
    n = v.shape[k]

    def over(a: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for i, t in enumerate(taps):
            if t:
                cut = [slice(None)] * 3
                cut[k] = slice(i, i + n)
                out += t * a[tuple(cut)]
        return out

    pad = [(0, 0)] * 3
    pad[k] = (r, r)
    if mode == "mirror":
        return over(np.pad(v, pad, mode="reflect") if n > 1 else np.repeat(v, 2 * r + 1, axis=k))
    total = over(np.pad(v, pad))
    if mode == "zeros":
        return total
    used = np.convolve(np.ones(n), taps[::-1], "full")[r : r + n]
    shape = [1, 1, 1]
    shape[k] = n
    return total / used.reshape(shape)


def over_blocks(df: DataFrame, grid: Grid, work, reach: tuple[int, int, int], schema: str, side: tuple[int, int, int] = SIDE) -> DataFrame:
    """(x, y, z and schema) of work on blocks of voxel rows, missing voxels being 0.

    work: array (z, y, x) of a block with reach more voxels on each side, where the image has them, and the place of its first voxel (z, y, x) to a
    dictionary of arrays of that shape by column; an array of booleans under the key None tells which voxels are given back."""
    sizes = [grid.size(a) for a in AXES]
    count = [-(-n // s) for n, s in zip(sizes, side)]
    columns = [c.split()[0] for c in schema.split(", ")]
    d = df.select(*AXES, F.col("v").cast("double").alias("v"))
    for a, s, r, n in zip(AXES, side, reach, count):
        low, high = F.greatest(F.lit(0), F.floor((F.col(a) - r) / s).cast("int")), F.least(F.lit(n - 1), F.floor((F.col(a) + r) / s).cast("int"))
        d = d.withColumn("b" + a, F.explode(F.sequence(low, high)) if n > 1 else F.lit(0))
    block = ((F.col("bz") * count[1] + F.col("by")) * count[0] + F.col("bx")).cast("int")

    def run(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        at = (number % count[0], number // count[0] % count[1], number // count[0] // count[1])
        first = [max(0, i * s - r) for i, s, r in zip(at, side, reach)]
        last = [min(n, (i + 1) * s + r) for i, s, r, n in zip(at, side, reach, sizes)]
        v = np.zeros([b - a for a, b in zip(first, last)][::-1])
        x, y, z = (table.column(a).to_numpy() - f for a, f in zip(AXES, first))
        v[z, y, x] = table.column("v").to_numpy()
        got = work(v, tuple(first[::-1]))
        core = tuple(slice(i * s - f, min((i + 1) * s, n) - f) for i, s, f, n in list(zip(at, side, first, sizes))[::-1])
        keep = got[None][core].nonzero() if None in got else tuple(a.ravel() for a in np.indices(v[core].shape))
        places = [(k + c.start + f).astype(np.int32) for k, c, f in zip(keep, core, first[::-1])][::-1]
        return pa.table({**dict(zip(AXES, places)), **{c: got[c][core][keep].astype(np.float64) for c in columns}})

    return d.select(block.alias("block"), *AXES, "v").groupBy("block").applyInArrow(run, "x int, y int, z int, " + schema)


def neighbour_max(v: np.ndarray, deep: bool) -> np.ndarray:
    """The largest of the 26 (deep) or 8 neighbours that exist."""
    p = np.pad(v, [(1, 1)] * 3, constant_values=-np.inf)
    nz, ny, nx = v.shape
    out = np.full(v.shape, -np.inf)
    for dz in (0, 1, 2) if deep else (1,):
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dz, dy, dx) != (1, 1, 1):
                    np.maximum(out, p[dz : dz + nz, dy : dy + ny, dx : dx + nx], out=out)
    return out


def maxima(v: np.ndarray, first: tuple[int, int, int], grid: Grid) -> np.ndarray:
    """Which voxels of a block are interior to the image and strictly above all 26 neighbours and 0, or in a plane above their 8 neighbours."""
    deep = grid.nz > 1
    m = neighbour_max(v, deep)
    top = v > (np.maximum(m, 0) if deep else m)
    for k, a in enumerate("zyx"):
        if a != "z" or deep:
            at = np.arange(v.shape[k]) + first[k]
            shape = [1, 1, 1]
            shape[k] = -1
            top = top & ((at >= 1) & (at <= grid.size(a) - 2)).reshape(shape)
    return top
