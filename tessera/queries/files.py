"""Queries that go through files: written into the shared folder, read back."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sources, views
from tessera.checkpoints import shared_dir
from tessera.plans import dots
from tessera.queries.points import levels_sql
from tessera.queries.volumes import DOTS_SQL, rounded
from tessera.sources import npy, png, tables, tiff
from tessera.streaming import watch_images

Q: dict = {}
S: dict[str, str] = {}


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/tessera-{kind}-{uuid.uuid4().hex}"


def _image(spark, d) -> DataFrame:
    return views.grid3(spark, d).withColumn("image_id", F.lit("grid"))


def tiff_round_trip(spark, d) -> DataFrame:
    """Float planes out and in."""
    sources.register(spark)
    out = _folder(spark, "tiff")
    tiff.write(_image(spark, d), out, bits=32).collect()
    return spark.read.format("tessera_tiff").option("path", out).load().select("x", "y", "z", "v")


def tiff_box(spark, d) -> DataFrame:
    """Only a box of the file is read."""
    sources.register(spark)
    out = _folder(spark, "tiff")
    tiff.write(_image(spark, d), out, bits=32).collect()
    return spark.read.format("tessera_tiff").options(path=out, x0=4, nx=10, y0=8, ny=5, z0=1, nz=2).load().select("x", "y", "z", "v")


def tiff_u16(spark, d) -> DataFrame:
    sources.register(spark)
    out = _folder(spark, "tiff")
    tiff.write(_image(spark, d), out, bits=16).collect()
    return spark.read.format("tessera_tiff").option("path", out).load().select("x", "y", "z", F.col("v").cast("int").alias("v"))


def tiff_info(spark, d) -> DataFrame:
    out = _folder(spark, "tiff")
    tiff.write(_image(spark, d), out, bits=16, description="ImageJ=1\nimages=4\nslices=4\nspacing=0.3", resolution=(7.5, 7.5)).collect()
    return tiff.info(spark, out).select("m", "n", "p", "bits", F.round("x_resolution", 3).alias("x_resolution"), "z_spacing", "supported", F.array_join(F.filter(F.split("description", "\n"), lambda s: ~(s.startswith("images=") | s.startswith("slices="))), ";").alias("flat_description"))


def tiff_skip_existing(spark, d) -> DataFrame:
    out = _folder(spark, "tiff")
    first = tiff.write(_image(spark, d), out).select("written").collect()
    again = tiff.write(_image(spark, d), out).select("written").collect()
    return spark.createDataFrame([(first[0][0], again[0][0])], "first boolean, again boolean")


def npy_round_trip(spark, d) -> DataFrame:
    sources.register(spark)
    out = _folder(spark, "npy")
    npy.write(_image(spark, d), out).collect()
    return spark.read.format("tessera_npy").option("path", out).load().select("x", "y", "z", "v")


def npy_table(spark, d) -> DataFrame:
    sources.register(spark)
    out = _folder(spark, "npy")
    from tessera.sources.files import write_bytes

    write_bytes(out + "/.keep", b"")
    npy.write_table(views.table(spark, d, "orders").orderBy("o_orderkey").select("o_totalprice", F.col("o_custkey").cast("double")), out + "/table.npy")
    return spark.read.format("tessera_npy").option("path", out + "/table.npy").load().select(F.col("y").alias("row"), F.col("x").alias("column"), F.round("v", 2).alias("v"))


def tsv_round_trip(spark, d) -> DataFrame:
    out = _folder(spark, "tsv")
    tables.write(views.features(spark, d).select("f0", "f1", "f3"), out)
    return tables.read(spark, out).groupBy("f0").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("f1").cast("double")), 3).alias("f1"))


def csv_fixed(spark, d) -> DataFrame:
    """Garbage and missing cells become 0, short lines go."""
    out = _folder(spark, "csv")
    price = F.when(F.col("p_size") % 5 == 0, "x").when(F.col("p_size") % 5 == 1, "").otherwise(F.col("p_retailprice").cast("string"))
    line = F.when(F.col("p_partkey") % 7 == 0, F.concat_ws(",", "p_partkey", price)).otherwise(F.concat_ws(",", "p_partkey", price, F.concat(F.lit(" "), "p_size", F.lit(" "))))
    views.table(spark, d, "part").select(line.alias("value")).write.text(out)
    return tables.read(spark, out, ",", "a, b ,c").select(F.col("a").cast("long").alias("a"), F.round(F.col("b").cast("double"), 2).alias("b"), F.col("c").cast("int").alias("c"))


def csv_six_decimals(spark, d) -> DataFrame:
    return views.features(spark, d).select("id", F.format_string("%.6f", F.col("f3").cast("double")).alias("text"))


def log_scaling(spark, d) -> DataFrame:
    """A log for each supplier: the last scaling counts, a third says none."""
    out = _folder(spark, "logs")
    own = views.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("image"), "s_suppkey", "s_acctbal")
    said = F.when(F.col("s_suppkey") % 3 != 0, F.array(F.lit("start"), F.lit("scaling: 7"), F.concat(F.lit("scaling: "), F.round("s_acctbal", 2).cast("string")))).otherwise(F.array(F.lit("start")))
    tables.write_logs(own.select("image", F.posexplode(said).alias("at", "line")), out).write.format("noop").mode("overwrite").save()
    return tables.scaling(spark, own.select("image"), out)


def png_labels(spark, d) -> DataFrame:
    out = _folder(spark, "png")
    pixels = png.label_colors(views.grid2(spark, d).select(F.lit("p").alias("image_id"), "x", "y", ((F.col("x") + F.col("y")) % 4).alias("label")))
    png.write(pixels, out).collect()
    return png.read_labels(spark, out).select("x", "y", "label")


def model_round_trip(spark, d) -> DataFrame:
    """A fitted model, written and read."""
    from tessera.queries.points import grown

    out = _folder(spark, "model")
    grown(spark, d).write.parquet(out)
    return rounded(spark.read.parquet(out)).drop("tree")


def tiff_planes_stacked(spark, d) -> DataFrame:
    """A big-file stack through the encoder: order lines counted by 24 places."""
    from tessera.sources.files import write_bytes

    sources.register(spark)
    out = _folder(spark, "tiff")
    n = {r["i"]: r["count"] for r in views.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 24).alias("i")).count().collect()}
    volume = np.array([n.get(i, 0) for i in range(24)]).reshape(2, 3, 4)
    write_bytes(out + "/b.tif", tiff.encode(volume, 16 if volume.max() < 65536 else 32, big=True))
    return spark.read.format("tessera_tiff").option("path", out).load().select("x", "y", "z", "v")


def tiff_where(spark, d) -> DataFrame:
    """Bounds that reach the reader: one plane, some of its lines, one of two images."""
    out = _folder(spark, "tiff")
    both = _image(spark, d)
    tiff.write(both.unionByName(both.select(F.lit("other").alias("image_id"), "x", "y", "z", (F.col("v") + 1).alias("v"))), out, bits=32).collect()
    return sources.read(spark, "tessera_tiff", out, [out + "/grid.tif"], x=(3, 8), y=(7, 19), z=2).where("v > 100").select("x", "y", "z", "v")


def npy_where(spark, d) -> DataFrame:
    out = _folder(spark, "npy")
    npy.write(_image(spark, d), out).collect()
    return sources.read(spark, "tessera_npy", out, x=(21, 99), y=(-5, 4), z=(2, 3)).select("x", "y", "z", "v")


def images_as_stream(spark, d) -> DataFrame:
    """Dots of images as they arrive: one image, then, after a restart, its mirror image."""
    folder, out, checkpoint = (_folder(spark, k) for k in ("arriving", "dots", "checkpoint"))

    def work(batch: DataFrame) -> DataFrame:
        name = batch.agg(F.regexp_extract(F.min("image_id"), "([a-z]+)[.]tif$", 1).alias("image")).first()["image"]
        return dots.detect(batch.select("x", "y", "z", "v"), views.GRID3, 1.0, 1.0, n=40).withColumn("image", F.lit(name))

    image = _image(spark, d)
    for arrived in (image, image.select(F.lit("mirror").alias("image_id"), (31 - F.col("x")).alias("x"), "y", "z", "v")):
        tiff.write(arrived, folder, bits=32).collect()
        watch_images(spark, folder, work, out, checkpoint).awaitTermination()
    return rounded(spark.read.parquet(out).drop("batch"))


for _f in (tiff_round_trip, tiff_box, tiff_u16, tiff_info, tiff_skip_existing, npy_round_trip, npy_table, tsv_round_trip, csv_fixed, csv_six_decimals, log_scaling, png_labels, model_round_trip, tiff_planes_stacked, tiff_where, npy_where, images_as_stream):
    Q[_f.__name__] = _f

_G = f"({views.GRID3_SQL})"
_FT = f"({views.FEATURES_SQL})"
S |= {
    "tiff_round_trip": f"SELECT x, y, z, v FROM {_G} g",
    "tiff_box": f"SELECT x, y, z, v FROM {_G} g WHERE x BETWEEN 4 AND 13 AND y BETWEEN 8 AND 12 AND z BETWEEN 1 AND 2",
    "tiff_u16": f"SELECT x, y, z, CAST(least(65535.0, floor(v * (65535.0 / (SELECT max(v) FROM {_G} m)) + 0.5)) AS INT) AS v FROM {_G} g",
    "tiff_info": "SELECT 32 AS m, 32 AS n, 4 AS p, 16 AS bits, 7.5::DOUBLE AS x_resolution, 0.3::DOUBLE AS z_spacing, true AS supported, 'ImageJ=1;spacing=0.3' AS flat_description",
    "tiff_skip_existing": "SELECT true AS first, false AS again",
    "npy_round_trip": f"SELECT x, y, z, v FROM {_G} g",
    "npy_table": "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INT) AS row, 0 AS \"column\", round(o_totalprice::FLOAT::DOUBLE, 2) AS v FROM orders UNION ALL SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INT), 1, o_custkey::DOUBLE FROM orders",
    "tsv_round_trip": f"SELECT f0::FLOAT AS f0, count(*) AS n, round(sum(f1::FLOAT::DOUBLE), 3) AS f1 FROM {_FT} a GROUP BY 1",
    "csv_fixed": "SELECT p_partkey AS a, CASE WHEN p_size % 5 IN (0, 1) THEN 0.0 ELSE round(p_retailprice::FLOAT::DOUBLE, 2) END AS b, p_size AS c FROM part WHERE p_partkey % 7 <> 0",
    "csv_six_decimals": f"SELECT id, printf('%.6f', f3::DOUBLE) AS text FROM {_FT} a",
    "log_scaling": "SELECT CAST(s_suppkey AS VARCHAR) AS image, CASE WHEN s_suppkey % 3 <> 0 THEN round(s_acctbal, 2) ELSE 1.0 END AS scaling FROM supplier",
    "png_labels": f"SELECT x, y, CASE WHEN (x + y) % 4 = 3 THEN -1 ELSE (x + y) % 4 END AS label FROM ({views.GRID2_SQL}) g",
    "model_round_trip": levels_sql("SELECT * FROM nodes"),
    "tiff_planes_stacked": "SELECT CAST(i % 4 AS INT) AS x, CAST(i // 4 % 3 AS INT) AS y, CAST(i // 12 AS INT) AS z, CAST(count(l_partkey) AS DOUBLE) AS v FROM range(24) t(i) LEFT JOIN lineitem ON l_partkey % 24 = i GROUP BY i",
    "tiff_where": f"SELECT x, y, z, v FROM {_G} g WHERE z = 2 AND y BETWEEN 7 AND 19 AND x BETWEEN 3 AND 8 AND v > 100",
    "npy_where": f"SELECT x, y, z, v FROM {_G} g WHERE z > 1 AND y <= 4 AND x > 20",
    "images_as_stream": f"WITH d AS MATERIALIZED ({DOTS_SQL}) SELECT 'grid' AS image, * FROM d UNION ALL SELECT 'mirror', 31 - x, y, z, value, use FROM d",
}
