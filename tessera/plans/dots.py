"""Dot detection: Laplacian of Gaussian, strict local maxima, sort, automatic threshold, top n, optional fit and circularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checkpoints import stored
from tessera.model import AXES, Grid
from tessera.operators import agg, fit, maps, morph, stencil


def detect(df: DataFrame, grid: Grid, sigma: float = 1.0, sigma_z: float = 1.0, n: int | None = None, scaling: float = 1.0, background: DataFrame | None = None, scales: list[float] | None = None, fitting: bool = False, circularity: bool = False) -> DataFrame:
    """(x, y, z, value, use [, fit columns, circularity]), largest value first. n: how many dots at most, 0.005 nx ny unless given.

    use: value above the Otsu threshold of the histogram of all maxima with logarithmic counts."""
    df = maps.scalar(df, "multiply", scaling) if scaling != 1.0 else df
    df = maps.flat_field(df, background, grid) if background is not None else df
    if scales:
        dots = morph.scale_space_maxima({s: stencil.laplacian_of_gaussian(df, grid, s * sigma, s * sigma_z) for s in scales}, grid)
    else:
        dots = stencil.log_maxima(df, grid, sigma, sigma_z)
    dots = stored(dots.withColumnRenamed("v", "value"))  # few rows, read for the histogram and for the result
    cut = agg.otsu(agg.log_counts(agg.histogram(dots, "value"))).select(F.col("value").alias("cut"))
    told = dots.join(F.broadcast(cut), how="left").withColumn("use", F.coalesce((F.col("value") > F.col("cut")).cast("int"), F.lit(1))).drop("cut")
    n = int(0.005 * grid.nx * grid.ny) if n is None else n
    top = told.orderBy(F.col("value").desc(), grid.raster())
    top = top if n < 0 else top.limit(n)
    if fitting or circularity:
        top = own = stored(top.withColumn("id", grid.raster()))
        if fitting:
            top = top.join(fit.fit_dots(df, own.select("id", *AXES), grid, sigma, sigma_z), "id", "left")
        if circularity:
            top = top.join(morph.lateral_circularity(df, own.select("id", *AXES), grid, sigma).select("id", F.col("circularity").alias("lat_circularity")), "id", "left")
        top = top.drop("id").orderBy(F.col("value").desc(), grid.raster())
    return top
