"""Aggregates of voxels and tables. All combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import AXES, Grid
from tessera.operators.ordered import running

#: Fixed value: results depend on it.
BINS = 65537


def stats(df: DataFrame) -> DataFrame:
    return df.agg(F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"), F.stddev_samp("v").alias("std"))


def covariance(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.covar_samp(a, b).alias("cov"), F.corr(a, b).alias("corr"))


def argmax(df: DataFrame, grid: Grid) -> DataFrame:
    """The voxel of the largest value, the first in raster order among equals."""
    return df.agg(F.max_by(F.struct(*AXES), F.struct(F.col("v"), -grid.raster())).alias("p"), F.max("v").alias("v")).select("p.x", "p.y", "p.z", "v")


def projection(df: DataFrame, how: str = "max", axis: str = "z") -> DataFrame:
    """max, sum or mean along an axis."""
    rest = [a for a in AXES if a != axis]
    return df.groupBy(*rest).agg({"max": F.max, "sum": F.sum, "mean": F.avg}[how]("v").alias("v"))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*AXES, F.col("v").alias("w")), list(AXES))


def mean_squared_error(a: DataFrame, b: DataFrame) -> DataFrame:
    return _pairs(a, b).agg(F.avg((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))).alias("mse"))


def i_divergence(estimate: DataFrame, image: DataFrame) -> DataFrame:
    """Mean of g ln(g / y) - (g - y) over voxels where both are positive, divided by all voxels."""
    g, y = F.col("w"), F.col("v")
    return _pairs(estimate, image).agg((F.sum(F.when((y > 0) & (g > 0), g * F.log(g / y) - (g - y)).otherwise(0.0)) / F.count(F.lit(1))).alias("idiv"))


def kl_divergence(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Sum of x ln(x / ref) where both are positive."""
    x, r = F.col("v"), F.col("w")
    return _pairs(df, reference).agg(F.sum(F.when((x > 0) & (r > 0), x * F.log(x / r)).otherwise(0.0)).alias("kl"))


def background(images: list[DataFrame]) -> DataFrame:
    """Sum over images of their sum projections."""
    out = images[0]
    for i in images[1:]:
        out = out.unionByName(i)
    return out.groupBy("x", "y").agg(F.sum("v").alias("v")).select("x", "y", F.lit(0).alias("z"), "v")


def histogram(df: DataFrame, value: str = "v", bins: int = BINS) -> DataFrame:
    """(bin, c, left, right): the range widened by half a bin and 1e-6, values rounded to bins, the last one included. Null for under two values."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).where("n >= 2")
    half = (F.col("hi") - F.col("lo")) / bins * 0.5 + 1e-6
    ends = ends.select((F.col("lo") - half).alias("left"), (F.col("hi") + half).alias("right"))
    place = F.floor((F.col(value) - F.col("left")) / (F.col("right") - F.col("left")) * bins + 0.5)
    told = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    return told.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"), "left", "right").agg(F.count(F.lit(1)).cast("double").alias("c"))


def log_counts(hist: DataFrame) -> DataFrame:
    return hist.withColumn("c", F.log1p("c"))


def histogram_percentile(hist: DataFrame, p: float, bins: int = BINS) -> DataFrame:
    """The edge after the first bin at which the counts reach share p. At most bins rows are in the window."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumns({"run": F.sum("c").over(w), "total": F.sum("c").over(Window.partitionBy())})
    at = F.min(F.when(F.col("run") >= p * F.col("total"), F.col("bin")))
    left, right = F.first("left"), F.first("right")
    if p <= 0 or p >= 1:
        return hist.agg((left if p <= 0 else right).alias("value"))
    return run.agg((left + (at + 1) / F.lit(float(bins)) * (right - left)).alias("value"))


def otsu(hist: DataFrame, bins: int = BINS) -> DataFrame:
    """(level, value): the level that maximises the variance between classes, the last among equals.

    Bins without counts repeat the statistic of the next occupied one, so only occupied bins are ranked and an equal run ends there. At
    most bins rows are in the window."""
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    h = hist.withColumn("b", F.col("bin").cast("double")).withColumns(
        {"wb": F.sum("c").over(before), "sb": F.sum(F.col("b") * F.col("c")).over(before), "total": F.sum("c").over(every), "all": F.sum(F.col("b") * F.col("c")).over(every)}
    )
    wf = F.col("total") - F.col("wb")
    mf, mb = (F.col("all") - F.col("sb")) / wf, F.col("sb") / F.col("wb")
    ranked = h.withColumn("between", F.when((F.col("wb") > 0) & (wf > 0), F.col("wb") * wf * (mb - mf) * (mb - mf))).where("between is not null")
    best = ranked.agg(F.max_by("bin", F.struct("between", "bin")).alias("level"), F.first("left").alias("left"), F.first("right").alias("right"))
    return best.select("level", (F.col("left") + F.col("level") / F.lit(float(bins - 2)) * (F.col("right") - F.col("left"))).alias("value"))


def exact_percentile(df: DataFrame, value: str, percent: float) -> DataFrame:
    """The floor(percent / 100 * n)-th smallest value, from 0, without interpolation. Counts by value are summed range by range."""
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    k = F.least(F.floor(F.lit(percent / 100.0) * F.col("all_n")), F.col("all_n") - 1)
    return running(counts, ["value"], ["n"]).where(F.col("run_n") > k).agg(F.min("value").alias("value"))


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label of each group, the smallest among equals."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias(label))


def bounding_box(points: DataFrame) -> DataFrame:
    out = points.agg(*[f(a).alias(f"{a}{k}") for a in AXES for f, k in ((F.min, 0), (F.max, 1))])
    volume: Column = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0"))
    return out.withColumn("volume", volume)


def same_table(a: DataFrame, b: DataFrame) -> bool:
    """Equal names, types and rows with their multiplicities. Unlike rows are looked for until one is found."""
    if a.dtypes != b.dtypes:
        return False
    n = F.count(F.lit(1)).alias("_n")
    left, right = a.groupBy(*a.columns).agg(n), b.groupBy(*b.columns).agg(n)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def head(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    """The n rows with the largest values: a top-k, not a sort. A negative n keeps all."""
    ordered = df.orderBy(F.col(column).desc(), tie)
    return ordered if n < 0 else ordered.limit(n)


def positive_prefix(df: DataFrame, column: str) -> DataFrame:
    """The rows before the first value that is not positive, values falling: all positive ones, so no sort is needed to tell them."""
    return df.where(F.col(column) > 0)


def concatenate_columns(a: DataFrame, b: DataFrame, row: str = "_row") -> DataFrame:
    """Rows side by side by row number; both must have as many."""
    if a.count() != b.count():
        raise ValueError("tables of different length")
    return a.join(b, row)


def concatenate_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """By position; names are the first's."""
    if len(a.columns) != len(b.columns):
        raise ValueError("tables of different width")
    return a.union(b)


def random_subset(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows, those whose seeded hash of key comes first."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def kfold(df: DataFrame, row: str, k: int) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.col(row), F.lit(k)).cast("int"))
