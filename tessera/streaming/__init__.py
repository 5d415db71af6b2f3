"""Batch operators over files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sources


def _append(source: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start a query that writes work of each micro-batch to a folder of its own, which a batch that is repeated after a failure replaces."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_tables(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 16):
    """Apply a batch operator to each micro-batch of new Parquet files and append its rows to out. Each file counts once."""
    return _append(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder), work, out, checkpoint)


def watch_images(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, kind: str = "tessera_tiff"):
    """The same for image files that arrive: work takes voxels (image_id, x, y, z, v) of whole images. The log of arrivals lies with the checkpoint."""
    sources.register(spark)
    return _append(spark.readStream.format(kind).options(path=folder, log=checkpoint + "/arrivals").load(), work, out, checkpoint)


def rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type of a stream of (ts, event_type, value), late rows accepted up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
