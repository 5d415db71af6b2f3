"""Views that give the driver's tables the shape of volumes, points, signals and features. The same text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import Grid
from tessera.operators.ordered import running

GRID3, GRID2, HOURS = Grid(32, 32, 4), Grid(32, 32, 1), 720

_AXES = """(SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z FROM
  (SELECT DISTINCT l_partkey % 32 AS i FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_orderkey % 32 AS i FROM lineitem) b CROSS JOIN (SELECT DISTINCT l_suppkey % 4 AS i FROM lineitem) c)"""
SUMS3 = "SELECT CAST(l_partkey % 32 AS INT) AS x, CAST(l_orderkey % 32 AS INT) AS y, CAST(l_suppkey % 4 AS INT) AS z, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3"
#: For DuckDB, with missing voxels filled.
GRID3_SQL = f"SELECT g.x, g.y, g.z, coalesce(s.v, 0.0) AS v FROM {_AXES} g LEFT JOIN ({SUMS3}) s ON s.x = g.x AND s.y = g.y AND s.z = g.z"
GRID2_SQL = f"SELECT x, y, CAST(0 AS INT) AS z, sum(v) AS v FROM ({GRID3_SQL}) q GROUP BY x, y"
#: All order lines as points; they thin out nowhere as the table grows, since x does. Suppliers where all pairs of a small set are asked for.
POINTS_SQL = "SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_orderkey AS DOUBLE) / 20 AS x, max(l_extendedprice) / 1000 AS y, CAST(max(l_quantity) AS DOUBLE) / 10 AS z FROM lineitem GROUP BY l_orderkey, l_linenumber"
SMALL_SQL = "SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y, CAST(s_suppkey % 101 AS DOUBLE) / 10 AS z FROM supplier"
SHIFTED_SQL = f"SELECT id, x + 4.0 AS x, y + 2.0 AS y, z - 1.0 AS z FROM ({POINTS_SQL}) p"
SIGNAL_SQL = "SELECT CAST(h AS INT) AS x, CAST(0 AS INT) AS y, CAST(0 AS INT) AS z, CAST(count(*) AS DOUBLE) AS v FROM (SELECT CAST(floor(unix_seconds / 3600) AS BIGINT) - 473352 AS h FROM {seconds}) q GROUP BY 1"
#: All order lines. Lines of one order may share a number, so id does not tell all rows apart; _row of NUMBERED_SQL does.
FEATURES_SQL = "SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS f0, l_discount AS f1, l_tax AS f2, l_extendedprice AS f3, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem"
FEATURE_ORDER = ["id", "f3", "f0", "f1", "f2", "label"]
NUMBERED_SQL = f"SELECT *, row_number() OVER (ORDER BY {', '.join(FEATURE_ORDER)}) AS _row FROM ({FEATURES_SQL}) f"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, name: str = "lineitem") -> DataFrame:
    return spark.sql(text.replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf_dir, name))


def grid3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRID3.fill(_sql(spark, sf_dir, SUMS3))


def grid2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRID2.fill(_sql(spark, sf_dir, SUMS3.replace("l_suppkey % 4", "0").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, POINTS_SQL)


def points_distinct(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the identifiers of points are surely distinct: all line numbers are from 0 to 7, none is missing, and none overflows."""
    said = "min(l_linenumber) >= 0 and max(l_linenumber) < 8 and count(l_linenumber) = count(*) and min(l_orderkey) > -(1L << 59) and max(l_orderkey) < 1L << 59"
    return bool(table(spark, sf_dir, "lineitem").agg(F.expr(said)).first()[0])


def small_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SMALL_SQL, "supplier")


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(points(spark, sf_dir))


def moved(points: DataFrame) -> DataFrame:
    return points.selectExpr("id", "x + 4.0 as x", "y + 2.0 as y", "z - 1.0 as z")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour, 720 hours from 2024-01-01."""
    e = table(spark, sf_dir, "events").selectExpr("cast(floor(unix_seconds(cast(ts as timestamp)) / 3600) as bigint) - 473352 as h").groupBy("h").count()
    return Grid(HOURS, 1, 1).fill(e.selectExpr("cast(h as int) as x", "0 as y", "0 as z", "cast(count as double) as v").where(f"x >= 0 and x < {HOURS}"))


SIGNAL_DUCK = "SELECT CAST(i AS INT) AS x, CAST(0 AS INT) AS y, CAST(0 AS INT) AS z, CAST(count(h) AS DOUBLE) AS v FROM range(720) r(i) LEFT JOIN (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352 AS h FROM events) e ON e.h = r.i GROUP BY i"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, f0 .. f3, label) of all order lines."""
    return _sql(spark, sf_dir, FEATURES_SQL)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features with _row, from 1 in FEATURE_ORDER, range by range."""
    rows = running(features(spark, sf_dir).withColumn("one", F.lit(1).cast("long")), FEATURE_ORDER, ["one"])
    return rows.withColumnRenamed("run_one", "_row").drop("one", "all_one")
