"""Scalar column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lateral_resolution(wavelength: Column, na: Column) -> Column:
    """Abbe limit across the axis."""
    return wavelength / (2 * na)


def axial_resolution(wavelength: Column, na: Column) -> Column:
    """Abbe limit along the axis."""
    return 2 * wavelength / (na * na)


def sigma_from_fwhm(fwhm: Column) -> Column:
    return fwhm / (2 * math.sqrt(2 * math.log(2)))


def gamma_from_fwhm(fwhm: Column) -> Column:
    """Scale of the two-dimensional Lorentzian whose full width at half maximum is fwhm."""
    return fwhm / (2 * math.sqrt(2 ** (2 / 3) - 1))


def gauss(x: Column, sigma: Column) -> Column:
    """Normal density."""
    return F.exp(-0.5 * x * x / (sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))


def lorentz(x: Column, y: Column, gamma: Column) -> Column:
    """Two-dimensional Lorentzian density around 0."""
    return gamma / F.pow(x * x + y * y + gamma * gamma, F.lit(1.5)) / (2 * math.pi)


def distance_squared(a: str, b: str) -> Column:
    """Between points whose columns are prefixed."""
    return sum(((F.col(a + c) - F.col(b + c)) * (F.col(a + c) - F.col(b + c)) for c in "xyz"), F.lit(0.0))


def linear_grids(df: DataFrame, a: Column, b: Column, delta: Column) -> DataFrame:
    """df with (i, value): for each row ceil((b - a) / delta) + 1 equally spaced values from a to b. Rows whose b is below a have none."""
    wide = df.withColumns({"_a": a.cast("double"), "_b": b.cast("double"), "_n": (F.ceil((b - a) / delta) + 1).cast("int")}).where("_n > 0")
    rows = wide.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("value", F.col("_a") + F.col("i") * (F.col("_b") - F.col("_a")) / F.greatest(F.lit(1), F.col("_n") - 1)).drop("_a", "_b", "_n")


def linear_grid(spark: SparkSession, a: float, b: float, delta: float) -> DataFrame:
    """(i, value) of one grid."""
    return linear_grids(spark.range(1), F.lit(float(a)), F.lit(float(b)), F.lit(float(delta))).select("i", "value")


def log_factorial_ratio(n: Column) -> Column:
    """ln(n!): exact to 8, Stirling's formula above."""
    exact = F.element_at(F.array(*[F.lit(math.log(math.factorial(k))) for k in range(9)]), (F.least(n, F.lit(8)) + 1).cast("int"))
    x = n.cast("double")
    return F.when(n <= 8, exact).otherwise(x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x))
