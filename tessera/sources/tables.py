"""Float tables as delimited text, and look-ups in log files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.files import write_bytes


def read(spark: SparkSession, path: str, separator: str = "\t", first_line: str | None = None) -> DataFrame:
    """The first line (given, or else the file's) names the columns; every cell is a number, cells that are not become 0, and lines with fewer cells than names go.

    _row keeps the order of lines within files."""
    head = spark.read.text(path).limit(1).first() if first_line is None else (first_line,)
    if head is None:
        raise ValueError("an empty file")
    names = [n.strip(" \r\n") for n in head[0].split(separator)]
    lines = spark.read.schema(T.StructType([T.StructField("value", T.StringType())])).option("header", False).text(path)
    told = lines.select("value", F.monotonically_increasing_id().alias("_row")).withColumn("c", F.split("value", F.lit("\\Q" + separator + "\\E"), -1))
    own = told.where((F.col("value") != head[0]) & (F.size("c") >= len(names)))
    cell = lambda i: F.coalesce(F.expr(f"try_cast(trim(c[{i}]) as float)"), F.lit(0.0).cast("float"))
    return own.select("_row", *[cell(i).alias(n) for i, n in enumerate(names)])


def write(df: DataFrame, path: str, separator: str = "\t", decimals: int | None = None) -> None:
    """With a header; decimals None writes numbers in full, 6 as fixed-point text."""
    shown = [c for c in df.columns if c != "_row"]
    text = [F.format_string(f"%.{decimals}f", F.col(c).cast("double")).alias(c) if decimals is not None else F.col(c) for c in shown]
    df.select(*text).write.mode("overwrite").option("sep", separator).option("header", True).csv(path)


def column(df: DataFrame, name: str):
    """By name; of several the last."""
    at = [i for i, c in enumerate(df.columns) if c == name]
    if not at:
        raise KeyError(name)
    return df.toDF(*[c if i == at[-1] or c != name else f"{c}__{i}" for i, c in enumerate(df.columns)])[name]


def write_logs(lines: DataFrame, folder: str) -> DataFrame:
    """lines (image, at, line) as one <image>.log.txt each in the folder, written by the tasks: (image, lines). A log is tens of lines."""

    def put(t: pa.Table) -> pa.Table:
        rows = t.sort_by("at")
        write_bytes(f"{folder}/{rows.column('image')[0].as_py()}.log.txt", "".join(f"{x}\n" for x in rows.column("line").to_pylist()).encode())
        return pa.table({"image": rows.column("image")[:1], "lines": pa.array([rows.num_rows], pa.int32())})

    return lines.select(F.col("image").cast("string").alias("image"), "at", "line").groupBy("image").applyInArrow(put, "image string, lines int")


def scaling(spark: SparkSession, images: DataFrame, logs: str) -> DataFrame:
    """images (image) with the last "scaling:" of <image>.log.txt in the folder logs, 1 where there is none."""
    lines = spark.read.text(f"{logs}/*.log.txt").select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    found = lines.where(F.col("value").startswith("scaling:")).groupBy(F.expr("substring(file, 1, length(file) - 8)").alias("image"))
    value = found.agg(F.max_by(F.expr("try_cast(trim(substring(value, 9)) as double)"), "at").alias("scaling"))
    return images.join(value, "image", "left").select("image", F.coalesce("scaling", F.lit(1.0)).alias("scaling"))
