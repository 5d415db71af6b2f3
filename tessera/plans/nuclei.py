"""Pixel classification: reduce a volume to a plane, compute features, fit a forest on annotated pixels, predict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import AXES, Grid
from tessera.operators import agg, forest, stencil


def reduce_planes(df: DataFrame, grid: Grid, how: str = "max") -> DataFrame:
    """max, sum, mean over z, or the sharpest plane (focus)."""
    if how == "focus":
        best = stencil.focus_score(df, 1.0, grid).agg(F.max_by("z", F.struct("score", -F.col("z"))).alias("best"))
        return df.crossJoin(F.broadcast(best)).where(F.col("z") == F.col("best")).select("x", "y", F.lit(0).alias("z"), "v")
    return agg.projection(df, how).select("x", "y", F.lit(0).alias("z"), "v")


#: Smallest scale, number of scales, number of trees.
FIRST_SCALE, SCALES, TREES = 3.5, 3, 201


def sigmas(first: float = FIRST_SCALE, n: int = SCALES) -> list[float]:
    return [first * 2 ** (k / 2) for k in range(n)]


def features(plane: DataFrame, scales: list[float]) -> tuple[DataFrame, list[str]]:
    got = stencil.pixel_features(plane, scales)
    return got, [c for c in got.columns if c not in AXES]


def train(plane: DataFrame, annotated: DataFrame, scales: list[float], trees: int = TREES, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """annotated (x, y, label), labels below 0 are not annotated. Leaves of cbrt(n) pixels."""
    table, names = features(plane, scales)
    rows = table.join(annotated.where("label >= 0").select("x", "y", "label"), ["x", "y"]).withColumn("id", F.col("y").cast("long") * 1_000_000 + F.col("x"))
    least = max(1, round(rows.count() ** (1 / 3)))
    return forest.fit(rows, names, trees, least=least, kind="entropy", seed=seed), names


def classify(plane: DataFrame, nodes: DataFrame, names: list[str], scales: list[float]) -> DataFrame:
    table, _ = features(plane, scales)
    rows = table.withColumn("id", F.col("y").cast("long") * 1_000_000 + F.col("x"))
    return forest.predict(rows, nodes, names).select("x", "y", "prediction")
