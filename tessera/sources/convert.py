"""Conversions between file formats, each a scan and a sink."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sources
from tessera.sources import npy, tiff
from tessera.sources.files import open_in, resolve, write_bytes
from tessera.sources.tiff import SCHEMA


def _named(df: DataFrame) -> DataFrame:
    """image_id without folder and ending."""
    return df.withColumn("image_id", F.regexp_extract("image_id", r"([^/]+?)(\.[A-Za-z]+)?$", 1))


def tiff_to_npy(spark: SparkSession, path: str, out: str) -> DataFrame:
    sources.register(spark)
    return npy.write(_named(spark.read.format("tessera_tiff").option("path", path).load()), out)


def npy_to_tiff(spark: SparkSession, path: str, out: str, bits: int = 32) -> DataFrame:
    sources.register(spark)
    return tiff.write(_named(spark.read.format("tessera_npy").option("path", path).load()), out, bits)


def read_raw(spark: SparkSession, path: str, nx: int, ny: int, nz: int, planes: int = 8) -> DataFrame:
    """A headerless float32 volume, x fastest; its size must be that of the shape. Slabs of planes are read in parallel."""
    fs, p = resolve(path)
    if fs.get_file_info(p).size != nx * ny * nz * 4:
        raise ValueError("the file does not have the size of the volume")

    def run(batches):
        for batch in batches:
            for z in batch.column("id").to_pylist():
                with open_in(path) as f:
                    f.seek(z * nx * ny * 4)
                    data = np.frombuffer(f.read(min(planes, nz - z) * nx * ny * 4), "<f4").reshape(-1, ny, nx)
                zz, yy, xx = (a.ravel().astype(np.int32) for a in np.indices(data.shape))
                yield pa.RecordBatch.from_arrays([pa.array([path] * data.size), pa.array(xx), pa.array(yy), pa.array(zz + np.int32(z)), pa.array(data.ravel().astype(np.float64))], ["image_id", "x", "y", "z", "v"])

    return spark.range(0, nz, planes, max(1, -(-nz // planes))).mapInArrow(run, SCHEMA)


def raw_to_tiff(spark: SparkSession, path: str, out: str, nx: int, ny: int, nz: int, bits: int = 16) -> DataFrame:
    return tiff.write(_named(read_raw(spark, path, nx, ny, nz)), out, bits)


def write_raw(df: DataFrame, path: str, nx: int, ny: int, planes: int = 8) -> DataFrame:
    """A volume (x, y, z, v) as headerless float32 slabs path/<first plane>.raw, x fastest, each of so many planes by one task: (path)."""

    def run(table: pa.Table) -> pa.Table:
        z = table.column("z").to_numpy()
        first = int(z.min()) // planes * planes
        data = np.zeros((int(z.max()) - first + 1, ny, nx), "<f4")
        data[z - first, table.column("y").to_numpy(), table.column("x").to_numpy()] = table.column("v").to_numpy()
        name = f"{path}/{first:08d}.raw"
        write_bytes(name, data.tobytes())
        return pa.table({"path": [name]})

    slab = F.floor(F.col("z") / planes).cast("int").alias("slab")
    return df.select("x", "y", "z", "v", slab).groupBy("slab").applyInArrow(run, "path string")


def read_slabs(spark: SparkSession, path: str, nx: int, ny: int) -> DataFrame:
    """The slabs that write_raw has written, as one volume (x, y, z, v); slabs are read in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.raw").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = np.frombuffer(content.as_py(), "<f4").reshape(-1, ny, nx)
                zz, yy, xx = (a.ravel().astype(np.int32) for a in np.indices(data.shape))
                yield pa.RecordBatch.from_arrays([pa.array(xx), pa.array(yy), pa.array(zz + np.int32(int(name.rsplit("/", 1)[1][:-4]))), pa.array(data.ravel().astype(np.float64))], ["x", "y", "z", "v"])

    return files.mapInArrow(run, "x int, y int, z int, v double")
