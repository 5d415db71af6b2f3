"""Provenance: what was run, with which options, when and where, as rows and as a log beside the outputs."""

from __future__ import annotations

import datetime
import getpass
import platform
import time

from pyspark.sql import DataFrame, SparkSession

from tessera.checkpoints import stored
from tessera.sources.files import size_of, write_bytes


def provenance(spark: SparkSession, name: str, **options) -> DataFrame:
    """(key, value): the operation, its options, and the versions and place of the run."""
    about = {"operation": name, "time": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "user": getpass.getuser(), "host": platform.node(), "python": platform.python_version(), "spark": spark.version, "application": spark.sparkContext.applicationId}
    rows = [*about.items(), *((f"option.{k}", str(v)) for k, v in sorted(options.items()))]
    return spark.createDataFrame([(k, v) for k, v in rows], "key string, value string")


def measured(spark: SparkSession, name: str, work, **options) -> tuple[DataFrame, DataFrame]:
    """(result of work(), written once; its provenance with rows, bytes and seconds)."""
    begin = time.monotonic()
    out = stored(work())
    files = out.inputFiles()
    size = sum(size_of(f) for f in files)
    told = {"rows": out.count(), "files": len(files), "bytes": size, "seconds": round(time.monotonic() - begin, 3)}
    extra = spark.createDataFrame([(k, str(v)) for k, v in told.items()], "key string, value string")
    return out, provenance(spark, name, **options).unionByName(extra)


def write_log(log: DataFrame, path: str) -> str:
    """A log of key: value lines (tens of them) as one text file."""
    write_bytes(path, "".join(f"{r['key']}: {r['value']}\n" for r in log.collect()).encode())
    return path
