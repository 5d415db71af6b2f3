"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(spark: SparkSession) -> None:
    """Make tessera_tiff and tessera_npy known to spark.read.format and spark.readStream.format."""
    from tessera.sources.npy import NpySource
    from tessera.sources.tiff import TiffSource

    spark.dataSource.register(TiffSource)
    spark.dataSource.register(NpySource)


def read(spark: SparkSession, kind: str, path: str, images: list[str] | None = None, x: int | tuple[int, int] | None = None, y: int | tuple[int, int] | None = None, z: int | tuple[int, int] | None = None) -> DataFrame:
    """Voxels (image_id, x, y, z, v) of the files of a folder, or of some of them, within bounds: one place of an axis or (first, last).

    Bounds are options of the reader and not filters that Spark hands to it: in Spark 4.1 a table of a Python source that is read twice, once with
    filters, keeps those of the last scan for all, which loses rows."""
    from tessera.sources.boxes import options_of

    register(spark)
    return spark.read.format(kind).options(path=path, **options_of(images, x=x, y=y, z=z)).load()
