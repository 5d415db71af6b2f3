"""Tables that end a lineage, in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a single machine, an error on a cluster, whose machines could not share one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        there = "file://" + folder
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write once, read back: what iterative operators do between rounds. The table stays until release(), since results read it lazily."""
    path = f"{shared_dir(df.sparkSession)}/tessera-round-{uuid.uuid4().hex}"
    _tables.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, str]:
    """df written in buckets of key, read back, and the table's name: grouping or joining it by key moves nothing. Rows of a task that belong to other
    buckets go to files of those, so the next reader of a bucket finds them there."""
    spark = df.sparkSession
    name = f"tessera_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _tables.append((spark, path))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name), name


def drop_bucketed(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    for k in reversed(range(len(_tables))):
        if _tables[k][1].endswith(name):
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables[k][1])
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
            del _tables[k]


def marks() -> int:
    """How many tables there are; release(since) deletes those made later."""
    return len(_tables)


def release(since: int = 0) -> None:
    """Delete stored tables, once what was derived from them has been written."""
    for spark, path in _tables[since:]:
        try:
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
        except Exception:  # the session has ended
            pass
    del _tables[since:]


atexit.register(release)
