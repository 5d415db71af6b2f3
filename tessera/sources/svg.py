"""Pictures of a volume with its dots: the maximum projection in grey, circles around selected dots, as SVG."""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import agg
from tessera.sources import png
from tessera.sources.files import write_bytes

#: Shares of the histogram that become black and white.
BLACK, WHITE = 0.01, 0.995


def selected(dots: DataFrame, mode: str = "auto", threshold: float = 0.0, n: int = 100) -> DataFrame:
    """auto: dots in use; threshold: of a larger value; first: the n largest values."""
    if mode == "auto":
        return dots.where("use = 1")
    if mode == "threshold":
        return dots.where(F.col("value") > threshold)
    if mode == "first":
        return agg.head(dots, "value", n, "id")
    raise ValueError(f"unknown mode: {mode}")


def circles(dots: DataFrame, radius: float = 3.0) -> DataFrame:
    """(id, cx, cy, r) in the picture's units, pixel centres at halves."""
    return dots.select("id", (F.col("x") + 0.5).alias("cx"), (F.col("y") + 0.5).alias("cy"), F.lit(radius).alias("r"))


def stretched(df: DataFrame) -> DataFrame:
    """The maximum projection as (x, y, r, g, b) with the histogram's shares stretched to 0 .. 255."""
    top = agg.projection(df, "max")
    hist = agg.histogram(top)
    low, high = (agg.histogram_percentile(hist, p).first()["value"] for p in (BLACK, WHITE))
    return png.grey(top, low, high)


def write(df: DataFrame, dots: DataFrame, path: str) -> str:
    """One picture of path: the projection as an embedded PNG and the dots' circles. A projection and its selected dots fit a screen, so one
    task may hold them."""
    pixels, marks = stretched(df).toPandas(), circles(dots).orderBy("id").toPandas()
    rgb = np.zeros((int(pixels.y.max()) + 1, int(pixels.x.max()) + 1, 3), np.uint8)
    rgb[pixels.y, pixels.x] = pixels[["r", "g", "b"]].to_numpy(np.uint8)
    h, w = rgb.shape[:2]
    image = base64.b64encode(png.encode(rgb)).decode()
    rings = "".join(f'<circle cx="{c.cx:g}" cy="{c.cy:g}" r="{c.r:g}" fill="none" stroke="lime" stroke-width="0.5"/>\n' for c in marks.itertuples())
    write_bytes(path, f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w} {h}">\n<image width="{w}" height="{h}" href="data:image/png;base64,{image}"/>\n{rings}</svg>\n'.encode())
    return path
