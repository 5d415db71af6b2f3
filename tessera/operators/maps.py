"""Element-wise operators: column expressions on voxel rows, one scan and no shuffle unless another image is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import AXES, Grid

_OPS = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: a / b}
#: A plane of at most this many voxels is broadcast to a volume.
PLANE = 4_000_000


def binary(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Voxel by voxel a op b; both have the same shape."""
    other = b.select(*AXES, F.col("v").alias("w"))
    return a.join(other, list(AXES)).select(*AXES, _OPS[op](F.col("v"), F.col("w")).alias("v"))


def binary_plane(a: DataFrame, plane: DataFrame, op: str, grid: Grid) -> DataFrame:
    """A volume with a plane (z = 0) applied to each z. The plane is broadcast while it has at most PLANE voxels."""
    other = plane.where("z = 0").select("x", "y", F.col("v").alias("w"))
    other = F.broadcast(other) if grid.nx * grid.ny <= PLANE else other
    return a.join(other, ["x", "y"]).select(*AXES, _OPS[op](F.col("v"), F.col("w")).alias("v"))


def flat_field(a: DataFrame, plane: DataFrame, grid: Grid) -> DataFrame:
    """Division by a background plane whose smallest value must be above zero."""
    least = plane.agg(F.min("v")).first()[0]
    if least is None or least <= 0:
        raise ValueError("a flat field must be positive")
    return binary_plane(a, plane, "divide", grid)


def scalar(a: DataFrame, op: str, value: float) -> DataFrame:
    return a.withColumn("v", _OPS[op](F.col("v"), F.lit(value)))


def invert(a: DataFrame) -> DataFrame:
    """1 - v."""
    return a.withColumn("v", 1.0 - F.col("v"))


def positive(a: DataFrame) -> DataFrame:
    return a.withColumn("v", F.greatest("v", F.lit(0.0)))


def _with_total(a: DataFrame, **aggregates: Column) -> DataFrame:
    """a with aggregates of the whole as columns: one row, so it is broadcast."""
    return a.crossJoin(F.broadcast(a.agg(*[c.alias(k) for k, c in aggregates.items()])))


def min_to_zero(a: DataFrame) -> DataFrame:
    return _with_total(a, low=F.min("v")).withColumn("v", F.col("v") - F.col("low")).drop("low")


def unit_sum(a: DataFrame) -> DataFrame:
    return _with_total(a, total=F.sum("v")).withColumn("v", F.col("v") / F.col("total")).drop("total")


def anscombe(a: DataFrame) -> DataFrame:
    return a.withColumn("v", 2 * F.sqrt(F.col("v") + 0.375))


def inverse_anscombe(a: DataFrame) -> DataFrame:
    return a.withColumn("v", F.pow(F.col("v") / 2, 2) - 0.375)


def threshold(a: DataFrame, at) -> DataFrame:
    """1 where v is strictly above, else 0."""
    return a.withColumn("v", F.when(F.col("v") > at, 1.0).otherwise(0.0))


def counters(a: DataFrame, background: float) -> DataFrame:
    """How many voxels equal the background, and how many are not finite."""
    return a.agg(F.count_if(F.col("v") == background).alias("n_background"), F.count_if(F.isnan("v") | (F.abs("v") == float("inf"))).alias("n_not_finite"))


def to_u16(a: DataFrame, scaling: float = 0.0) -> DataFrame:
    """Values as a 16-bit sink writes them: scaled (by 65535 / max unless scaling is positive), clamped, rounded half away from zero; not finite: 0."""
    if scaling > 0:
        scaled = a.withColumn("s", F.lit(float(scaling)))
    else:
        scaled = _with_total(a, top=F.max("v")).withColumn("s", F.when(F.col("top") > 0, 65535.0 / F.col("top")).otherwise(1.0)).drop("top")
    finite = ~(F.isnan("v") | (F.abs("v") == float("inf")))
    value = F.greatest(F.lit(0.0), F.least(F.lit(65535.0), F.floor(F.col("v") * F.col("s") + 0.5).cast("double")))
    return scaled.select(*AXES, F.when(finite, value).otherwise(0.0).cast("int").alias("v"))


def constant(df: DataFrame, value: float) -> DataFrame:
    """A volume of the shape of df that holds one value."""
    return df.select(*AXES, F.lit(float(value)).alias("v"))
