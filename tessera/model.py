"""Schemas and the two physical forms of a volume: long voxel rows and dense tiles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
VOXELS = "x int, y int, z int, v double"
TILES = "tile int, x0 int, y0 int, z0 int, nx int, ny int, nz int, data binary"


def others(axis: str) -> list[str]:
    return [a for a in AXES if a != axis]


@dataclass(frozen=True)
class Grid:
    """Dimensions of a dense volume, known to the planner."""

    nx: int
    ny: int
    nz: int = 1

    def size(self, axis: str) -> int:
        return {"x": self.nx, "y": self.ny, "z": self.nz}[axis]

    @property
    def count(self) -> int:
        return self.nx * self.ny * self.nz

    def frame(self, spark: SparkSession, value: float = 0.0) -> DataFrame:
        """A constant volume, generated in parallel from one range of raster numbers."""
        n = F.col("id")
        return spark.range(self.count).select(
            (n % self.nx).cast("int").alias("x"), (F.floor(n / self.nx) % self.ny).cast("int").alias("y"), F.floor(n / (self.nx * self.ny)).cast("int").alias("z"), F.lit(float(value)).alias("v")
        )

    def fill(self, voxels: DataFrame, value: float = 0.0) -> DataFrame:
        """voxels with the missing ones set to value. One union and one aggregation, no join."""
        both = voxels.select(*AXES, F.col("v").cast("double").alias("v"), F.lit(1).alias("own")).unionByName(self.frame(voxels.sparkSession, value).withColumn("own", F.lit(0)))
        return both.groupBy(*AXES).agg(F.max_by("v", "own").alias("v"))

    def raster(self) -> Column:
        """Raster number of a voxel, x fastest: the order that breaks ties."""
        return F.col("x").cast("long") + self.nx * (F.col("y").cast("long") + self.ny * F.col("z").cast("long"))


def voxels(df: DataFrame, **columns) -> DataFrame:
    """df as voxel rows; columns names the source of x, y, z or v where it differs."""
    pick = lambda c, kind: F.expr(str(columns.get(c, c))).cast(kind).alias(c)
    return df.select(pick("x", "int"), pick("y", "int"), pick("z", "int"), pick("v", "double"))


def to_tiles(df: DataFrame, grid: Grid, size: int = 256) -> DataFrame:
    """Dense tiles of at most size voxels along x and y, all of z: float32 little-endian, x fastest. A tile is one row of bounded size."""
    tiles_x = -(-grid.nx // size)
    tile = (F.floor(F.col("y") / size) * tiles_x + F.floor(F.col("x") / size)).cast("int")

    def build(table: pa.Table) -> pa.Table:
        number = table.column("tile")[0].as_py()
        x0, y0 = number % tiles_x * size, number // tiles_x * size
        nx, ny = min(size, grid.nx - x0), min(size, grid.ny - y0)
        data = np.zeros((grid.nz, ny, nx), np.float32)
        data[table.column("z").to_numpy(), table.column("y").to_numpy() - y0, table.column("x").to_numpy() - x0] = table.column("v").to_numpy()
        row = {"tile": number, "x0": x0, "y0": y0, "z0": 0, "nx": nx, "ny": ny, "nz": grid.nz, "data": data.tobytes()}
        kinds = [(k, pa.binary() if k == "data" else pa.int32()) for k in row]
        return pa.Table.from_pylist([row], schema=pa.schema(kinds))

    return df.select(tile.alias("tile"), *AXES, "v").groupBy("tile").applyInArrow(build, TILES)


def to_voxels(tiles: DataFrame) -> DataFrame:
    """Voxel rows of dense tiles."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["data"], "<f4").reshape(row["nz"], row["ny"], row["nx"])
                z, y, x = (a.ravel().astype(np.int32) for a in np.indices(data.shape))
                yield pa.RecordBatch.from_arrays([pa.array(x + np.int32(row["x0"])), pa.array(y + np.int32(row["y0"])), pa.array(z + np.int32(row["z0"])), pa.array(data.ravel().astype(np.float64))], ["x", "y", "z", "v"])

    return tiles.mapInArrow(run, VOXELS)
