"""Whole-image pipelines: tiled deconvolution, registration by cross-correlation, denoising."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import AXES, VOXELS, Grid
from tessera.operators import agg, geometry, maps, recon, stencil

def kernel_of(psf: DataFrame, share: float = 0.001, image: Grid | None = None) -> np.ndarray:
    """A point-spread function (voxel rows) as an array for tasks: weak margins cut, what an image of the given size (a tile with its halo)
    cannot meet cut, even sizes made odd, unit sum. So it is at most eight times what a task holds of an image."""
    for axis in "xy":
        psf = geometry.trim_margin(psf, axis, share)
    top = psf.agg(*[(F.max(a) + 1).alias(a) for a in AXES]).first()
    whole = Grid(*(top[a] for a in AXES))
    psf, grid = geometry.crop_by_image(psf, whole, image or whole)
    rows = psf.toPandas()
    k = np.zeros([n + 1 - n % 2 for n in (grid.nz, grid.ny, grid.nx)])
    k[rows["z"], rows["y"], rows["x"]] = rows["v"]
    return k / k.sum()


def tiled(df: DataFrame, grid: Grid, work, tile: int, overlap: int) -> DataFrame:
    """work (array z, y, x to array of its shape) on tiles with halos, merged by weights that fall through the halos.

    A tile with its halo is what one task holds; tiles differ in nothing but place, so no task grows with the image."""

    def run(table: pa.Table) -> pa.Table:
        x, y, z = (table.column(a).to_numpy() for a in AXES)
        x0, y0 = x.min(), y.min()
        shape = (z.max() + 1, y.max() - y0 + 1, x.max() - x0 + 1)
        data, w = np.zeros(shape), np.zeros(shape)
        data[z, y - y0, x - x0] = table.column("v").to_numpy()
        w[z, y - y0, x - x0] = table.column("w").to_numpy()
        got = work(data)
        zz, yy, xx = (a.ravel().astype(np.int32) for a in np.indices(shape))
        return pa.table({"tile": pa.array(np.full(got.size, table.column("tile")[0].as_py(), np.int32)), "x": xx + np.int32(x0), "y": yy + np.int32(y0), "z": zz, "v": got.ravel(), "w": w.ravel()})

    tiles = geometry.split_tiles(df, grid, tile, overlap)
    return geometry.merge_tiles(tiles.groupBy("tile").applyInArrow(run, "tile int, " + VOXELS + ", w double"))


def deconvolve_image(df: DataFrame, grid: Grid, psf: DataFrame | np.ndarray, options: recon.Options = recon.Options(), tile: int = 512, overlap: int = 20, background: DataFrame | None = None) -> DataFrame:
    """Checks (finite, not negative, some signal), flat field, tiles with halos, deconvolution of each, weighted merge."""
    told = df.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.isnan("v")).alias("nan")).first()
    if told["low"] is None or told["low"] < 0 or told["high"] < 1 or told["nan"]:
        raise ValueError("an image needs finite values of at least 0, and some of 1 or more")
    df = maps.flat_field(df, background, grid) if background is not None else df
    shipped = df.sparkSession.sparkContext.broadcast(psf if isinstance(psf, np.ndarray) else kernel_of(psf, image=Grid(min(grid.nx, tile + 2 * overlap), min(grid.ny, tile + 2 * overlap), grid.nz)))
    return tiled(df, grid, lambda v: np.maximum(recon.deconvolve(v + options.offset, shipped.value, options)[0] - options.offset, 0), tile, overlap)


def denoise_image(df: DataFrame, grid: Grid, smooth: float = 0.1, sparse: float = 0.1, iterations: int = 60, tile: int = 512, overlap: int = 20) -> DataFrame:
    """Sparse second-order denoising of tiles with halos, weighted merge."""
    return tiled(df, grid, lambda v: recon.denoise(v, smooth, sparse, False, iterations)[0], tile, overlap)


def register(image: DataFrame, reference: DataFrame, grid: Grid) -> tuple[int, int]:
    """Lag (dx, dy) of the image over the reference where their maximum projections correlate best.

    Both are taken less their means: the correlation is normalised by the whole plane, so a mean far above the deviation would weigh against every
    lag but 0, where planes overlap in part."""
    plane = Grid(grid.nx, grid.ny)

    def flat(v: DataFrame) -> DataFrame:
        top = plane.fill(agg.projection(v, "max").select("x", "y", F.lit(0).alias("z"), "v"))
        return top.crossJoin(F.broadcast(top.agg(F.avg("v").alias("mean")))).select(*AXES, (F.col("v") - F.col("mean")).alias("v"))

    best = stencil.cross_correlation(flat(image), flat(reference), plane).orderBy(F.col("ncc").desc(), "dx", "dy").first()
    return best["dx"], best["dy"]


def shift_image(image: DataFrame, grid: Grid, by: tuple[float, float, float] | None = None, reference: DataFrame | None = None) -> DataFrame:
    """Move an image by an amount, or onto a reference."""
    if by is None:
        dx, dy = register(image, reference, grid)
        by = (-float(dx), -float(dy), 0.0)
    return geometry.shift(image, grid, by)


def iteration_metrics(tiles: DataFrame, psf: DataFrame | np.ndarray, options: recon.Options = recon.Options()) -> DataFrame:
    """(tile, iter, time, error, kl): one row an iteration of each dense tile, with the seconds since its start, for the metrics sink."""
    shipped = tiles.sparkSession.sparkContext.broadcast(psf if isinstance(psf, np.ndarray) else kernel_of(psf))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["data"], "<f4").reshape(r["nz"], r["ny"], r["nx"])
                begin, seconds, kl = time.monotonic(), [], []

                def each(model, image, begin=begin, seconds=seconds, kl=kl):
                    kl.append(recon.kl_divergence(image, model))
                    seconds.append(time.monotonic() - begin)

                errors = recon.deconvolve(data + options.offset, shipped.value, options, each)[2]
                n = len(errors)
                yield pa.RecordBatch.from_arrays([pa.array([r["tile"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(seconds, pa.float64()), pa.array(errors, pa.float64()), pa.array(kl, pa.float64())], ["tile", "iter", "time", "error", "kl"])

    return tiles.mapInArrow(run, "tile int, iter int, time double, error double, kl double")
