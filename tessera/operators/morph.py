"""Local maxima, components and what is built of them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoints import stored
from tessera.model import AXES, Grid, others
from tessera.operators import dense
from tessera.operators.ordered import running


def neighbour_max(df: DataFrame, deep: bool) -> DataFrame:
    """(x, y, z, v, m): m the largest of the 26 (deep) or 8 neighbours that exist.

    Separable: running maxima of three along x, then y, then z leave the centre out at the last step, so rows are never multiplied."""

    def near(axis: str, c: Column, own: bool) -> Column:
        w = Window.partitionBy(*others(axis)).orderBy(axis)
        three = [F.lag(c).over(w), F.lead(c).over(w)] + ([c] if own else [])
        return F.greatest(*three)

    d = df.withColumns({"x3": near("x", F.col("v"), True), "x2": near("x", F.col("v"), False)})
    # y: maxima of whole rows above and below; own row without the centre
    d = d.withColumns({"xy9": near("y", F.col("x3"), True), "y8": F.greatest(near("y", F.col("x3"), False), F.col("x2"))})
    m = F.greatest(near("z", F.col("xy9"), False), F.col("y8")) if deep else F.col("y8")
    return d.withColumn("m", m).select(*AXES, "v", "m")


def local_maxima(df: DataFrame, grid: Grid) -> DataFrame:
    """Interior voxels strictly above all 26 neighbours and 0; in planes strictly above their 8 neighbours."""
    reach = (1, 1, 1 if grid.nz > 1 else 0)
    return dense.over_blocks(df, grid, lambda v, first: {"v": v, None: dense.maxima(v, first, grid)}, reach, "v double")


def _vertex(a: Column, b: Column, c: Column, ya: Column, yb: Column, yc: Column) -> Column:
    """Where the parabola through three points peaks."""
    num = (b - a) * (b - a) * (yb - yc) - (b - c) * (b - c) * (yb - ya)
    den = (b - a) * (yb - yc) - (b - c) * (yb - ya)
    return b - num / den / 2


def scale_space_maxima(responses: dict[float, DataFrame], grid: Grid) -> DataFrame:
    """Maxima within their scale that no voxel around them exceeds at the next smaller or larger scale: (x, y, z, v, scale, refined).

    refined: the peak of a parabola through all-scale responses at the voxel in logarithmic scale; an end scale stays."""
    scales = sorted(responses)
    tagged = reduce(DataFrame.unionByName, [neighbour_max(responses[s], grid.nz > 1).withColumn("k", F.lit(i)) for i, s in enumerate(scales)])
    w = Window.partitionBy(*AXES).orderBy("k")
    around = F.greatest("v", "m")
    values = F.collect_list("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = tagged.withColumns({"below": F.lag(around).over(w), "above": F.lead(around).over(w), "all": values})
    inner = reduce(lambda a, b: a & b, [F.col(a).between(1, grid.size(a) - 2) for a in ("xyz" if grid.nz > 1 else "xy")])
    top = (F.col("v") > F.greatest("m", F.lit(0.0))) & (F.col("below").isNull() | (F.col("v") >= F.col("below"))) & (F.col("above").isNull() | (F.col("v") >= F.col("above")))
    at = F.array_position("all", F.array_max("all")).cast("int")
    logs = F.array(*[F.log(F.lit(float(s))) for s in scales])
    get = lambda arr, i: F.element_at(arr, F.greatest(F.lit(1), F.least(F.lit(len(scales)), i)))
    peak = F.exp(_vertex(get(logs, at - 1), get(logs, at), get(logs, at + 1), get(F.col("all"), at - 1), get(F.col("all"), at), get(F.col("all"), at + 1)))
    end = (at == 1) | (at == len(scales))
    listed = F.array(*[F.lit(float(s)) for s in scales])
    return d.where(inner & top).select(*AXES, "v", F.element_at(listed, F.col("k") + 1).alias("scale"), F.when(end, F.element_at(listed, at)).otherwise(peak).alias("refined"))


#: Pixels along the side of a block that one task labels; equivalences that are broadcast.
SIDE, FEW = 512, 500_000


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0 .. n - 1 that each can reach over the links (a, b)."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if np.array_equal(la, lb):
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(label, up := label[label]):
            label = up


def _within_blocks(on: DataFrame, grid: Grid, side: int) -> DataFrame:
    """(x, y, root): root is the first pixel, in raster order, of the part of a region that lies in the pixel's block."""

    def label(table: pa.Table) -> pa.Table:
        key = np.sort(table.column("x").to_numpy().astype(np.int64) + grid.nx * table.column("y").to_numpy().astype(np.int64))
        run = np.cumsum(np.r_[True, (key[1:] != key[:-1] + 1) | (key[1:] % grid.nx == 0)]) - 1
        at = np.searchsorted(key, key + grid.nx)
        there = at < len(key)
        there[there] = key[at[there]] == key[there] + grid.nx
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        root = key[first][linked(len(first), run[there], run[at[there]])][run]
        return pa.table({"x": pa.array((key % grid.nx).astype(np.int32)), "y": pa.array((key // grid.nx).astype(np.int32)), "root": pa.array(root)})

    block = lambda a: F.floor(F.col(a) / side).alias("b" + a)
    return on.select("x", "y", block("x"), block("y")).groupBy("bx", "by").applyInArrow(label, "x int, y int, root long")


def _seams(pixels: DataFrame, side: int) -> DataFrame:
    """(level, sx, sy, a, b): roots that touch across a border of blocks, and the level and place of the smallest square of 2^level by 2^level blocks
    that holds both."""
    out = None
    for axis, other in (("x", "y"), ("y", "x")):
        ends = pixels.where(F.col(axis) % side == side - 1).select((F.col(axis) + 1).alias(axis), other, F.col("root").alias("a"))
        met = ends.join(pixels.where(F.col(axis) % side == 0).select("x", "y", F.col("root").alias("b")), ["x", "y"])
        block, behind = F.floor(F.col(axis) / side), F.floor(F.col(axis) / side) - 1
        level = F.length(F.conv(block.bitwiseXOR(behind).cast("string"), 10, 2))
        at = lambda a: F.expr(f"shiftright(cast(floor({a} / {side}) as bigint), level)")
        own = met.withColumn("level", level.cast("int")).select("level", at("x").alias("sx"), at("y").alias("sy"), "a", "b")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def _merged(rows: DataFrame) -> DataFrame:
    """(was, now) for the roots of each square that change when its seams (sx, sy, a, b) are closed. A square has at most as many as its two middle lines."""

    def close(table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy() for c in "ab")
        roots = np.unique(np.r_[a, b])
        now = roots[linked(len(roots), np.searchsorted(roots, a), np.searchsorted(roots, b))]
        return pa.table({"was": pa.array(roots[now != roots]), "now": pa.array(now[now != roots])})

    return rows.groupBy("sx", "sy").applyInArrow(close, "was long, now long")


def components(mask: DataFrame, grid: Grid, side: int | None = None) -> DataFrame:
    """(x, y, label) of the 4-connected regions where v > 0 in a plane; labels 1, 2, ... in raster order of each region's first pixel.

    Blocks are labelled by one task each. Then only pairs of roots along the borders of blocks move: the seams within each square of 2 x 2 blocks are
    closed, then those within 4 x 4, and so on, each square by one task that holds its two middle lines. The equivalences of all levels make
    one table (was, now), by which the pixels' roots are replaced once; a root has no more pixels than a block, so no key is hot."""
    side = side or SIDE
    on = mask.where((F.col("v") > 0) & (F.col("z") == 0)).select("x", "y")
    pixels = stored(_within_blocks(on, grid, side))
    named = pixels
    if max(grid.nx, grid.ny) > side:
        seams, told = stored(_seams(pixels, side)), None
        for level in range(1, (max(grid.nx - 1, grid.ny - 1) // side).bit_length() + 1):
            own = seams.where(F.col("level") == level)
            if told is not None:
                for c in "ab":
                    own = own.join(told.select(F.col("was").alias(c), "now"), c, "left").withColumn(c, F.coalesce("now", c)).drop("now")
            new = stored(_merged(own))
            if told is not None:  # what had become a root that now changes goes on to the new one
                later = new.select(F.col("was").alias("now"), F.col("now").alias("then"))
                moved = told.join(F.broadcast(later) if new.count() <= FEW else later, "now", "left").select("was", F.coalesce("then", "now").alias("now"))
                new = stored(moved.unionByName(new))
            told = new
        named = pixels.join(told.withColumnRenamed("was", "root"), "root", "left").select("x", "y", F.coalesce("now", "root").alias("root"))
        named = stored(named)
    roots = named.where(F.col("root") == F.col("x") + grid.nx * F.col("y").cast("long")).select("root")
    ranks = running(roots.withColumn("one", F.lit(1)), ["root"], ["one"]).select("root", F.col("run_one").cast("int").alias("label"))
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(ranks, "root")
    total, large = grid.nx * grid.ny, F.col("n") > max(1, grid.nx * grid.ny // 1000)  # fewer than a thousand regions are large
    if total <= SIDE * SIDE:
        return named.join(ranks, "root").select("x", "y", "label")
    sizes = stored(sizes)
    rest = named.join(F.broadcast(sizes.where(large).select("root", F.col("label").alias("of_large"))), "root", "left")
    known = rest.where("of_large is not null").select("x", "y", F.col("of_large").alias("label"))
    return known.unionByName(rest.where("of_large is null").join(sizes.where(~large), "root").select("x", "y", "label"))


def areas(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("area"))


def remove_small(mask: DataFrame, grid: Grid, least: float) -> DataFrame:
    """mask (0 / 1) without regions of fewer than least pixels."""
    own = components(mask, grid)
    keep = own.join(areas(own).where(F.col("area") >= least), "label").select("x", "y", F.lit(1.0).alias("own"))
    return mask.join(keep, ["x", "y"], "left").select(*AXES, F.coalesce("own", F.lit(0.0)).alias("v"))


def fill_holes(mask: DataFrame, grid: Grid, most: float) -> DataFrame:
    """mask with background regions filled that do not touch the border and have fewer than most pixels."""
    ground = components(mask.withColumn("v", F.when(F.col("v") > 0, 0.0).otherwise(1.0)), grid)
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == grid.nx - 1) | (F.col("y") == grid.ny - 1)
    holes = ground.groupBy("label").agg(F.count(F.lit(1)).alias("area"), F.bool_or(edge).alias("edge")).where(~F.col("edge") & (F.col("area") < most))
    fill = ground.join(holes, "label").select("x", "y", F.lit(1.0).alias("own"))
    return mask.join(fill, ["x", "y"], "left").select(*AXES, F.when(F.col("own").isNotNull() | (F.col("v") > 0), 1.0).otherwise(0.0).alias("v"))


def lateral_circularity(df: DataFrame, dots: DataFrame, grid: Grid, sigma: float) -> DataFrame:
    """dots (id, x, y, z) with the ratio of the smaller to the larger eigenvalue of the intensity-weighted offsets' covariance in a soft disc
    of radius 1.75 max(sigma, 1). The buffer's empty cells count as zeros; -1 when outside or flat."""
    radius = 1.75 * max(sigma, 1.0)  # a fixed value
    r = int(radius) + 1
    n = float((2 * r + 1) ** 2)
    p = dots.select("id", *[F.floor(F.col(a) + 0.5).cast("int").alias("c" + a) for a in AXES])
    asked = p.withColumn("dx", F.explode(F.sequence(F.lit(-r), F.lit(r)))).withColumn("dy", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    asked = asked.select("id", "dx", "dy", (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y"), F.col("cz").alias("z"))
    soft = F.greatest(F.lit(0.0), F.least(F.lit(1.0), radius + 0.5 - F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))))
    got = asked.join(df, list(AXES)).withColumn("w", soft * F.col("v"))
    a, b = F.col("w") * F.col("dx"), F.col("w") * F.col("dy")
    s = got.groupBy("id").agg(F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"))
    cov = lambda xy, x, y: (F.col(xy) - F.col(x) * F.col(y) / n) / (n - 1)
    mean, root = (cov("aa", "a", "a") + cov("bb", "b", "b")) / 2, F.sqrt(F.pow((cov("aa", "a", "a") - cov("bb", "b", "b")) / 2, 2) + F.pow(cov("ab", "a", "b"), 2))
    ratio = s.select("id", F.when(mean + root > 0, (mean - root) / (mean + root)).alias("circularity"))
    return dots.join(ratio, "id", "left").withColumn("circularity", F.coalesce("circularity", F.lit(-1.0)))
