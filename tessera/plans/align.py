"""Alignment of two point sets by their difference vectors, with a grid search to fall back on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checkpoints import stored
from tessera.operators import agg, spatial


@dataclass(frozen=True)
class Alignment:
    dx: float
    dy: float
    dz: float
    kde: float
    goodness: float
    method: str


#: Fixed value: points of each set that vote.
VOTERS = 250


def align(a: DataFrame, b: DataFrame, sigma: float = 0.4, relative: float = 0.01, capture: float = 10.0, limit: int = VOTERS) -> Alignment:
    """The displacement b - a. The strongest limit points (by value where there is one) of each set vote by pairs; a weak vote (density under 2 at
    its mode) is replaced by the grid search within the capture radius."""

    def strongest(p: DataFrame) -> DataFrame:
        p = agg.positive_prefix(p, "value") if "value" in p.columns else p
        order = [F.col("value").desc(), "id"] if "value" in p.columns else ["id"]
        return stored(p.orderBy(*order).limit(limit))

    sa, sb = strongest(a), strongest(b)
    delta, kde, method = (0.0, 0.0, 0.0), 0.0, "none"
    if sa.count() >= 3 and sb.count() >= 3:
        pairs = spatial.band_join(spatial.pair_differences(sa), spatial.pair_differences(sb), sigma, relative)
        h = stored(spatial.hypotheses(sa, sb, pairs))
        if not h.isEmpty():
            mode = spatial.mode_search(h, sigma)
            one = h.sparkSession.createDataFrame([(0, *mode)], "id long, x double, y double, z double")
            kde, delta, method = spatial.density(one, h, sigma).first()["kde"], tuple(-m for m in mode), "pairs"
    if kde < 2:
        best = spatial.displacement_search(sb, sa, capture, sigma).first()
        if best is not None:
            delta, kde, method = (best["dx"], best["dy"], best["dz"]), best["kde"], "grid"
    told = spatial.alignment_significance(a, b, delta, sigma).first()
    return Alignment(*delta, told["kde"] or 0.0, told["goodness"], method)
