"""Geometry and layout: coordinate arithmetic, interpolation, tiling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import AXES, Grid
from tessera.operators.stencil import convolve


def crop(df: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], rebase: bool = True) -> DataFrame:
    """The box low to high, both included; its corner becomes the origin."""
    for a, lo, hi in zip(AXES, low, high):
        df = df.where(F.col(a).between(lo, hi))
    return df.select(*[(F.col(a) - (lo if rebase else 0)).cast("int").alias(a) for a, lo in zip(AXES, low)], "v")


def line(df: DataFrame, axis: str, center: tuple[int, int, int], half: int) -> DataFrame:
    """(i, v), i from -half to half: the line along axis through center; 0 outside the image. The line is bounded by 2 half + 1 rows."""
    at = dict(zip(AXES, center))
    own = df
    for a in AXES:
        own = own.where(F.col(a) == at[a]) if a != axis else own.where(F.col(a).between(at[a] - half, at[a] + half))
    frame = df.sparkSession.range(-half, half + 1).select(F.col("id").cast("int").alias("i"))
    return frame.join(own.select((F.col(axis) - at[axis]).alias("i"), "v"), "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))


def region(df: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """The box with NaN where it leaves the image."""
    size = [h - lo + 1 for lo, h in zip(low, high)]
    frame = Grid(*size).frame(df.sparkSession).select(*AXES)
    return frame.join(crop(df, low, high), list(AXES), "left").select(*AXES, F.coalesce("v", F.lit(float("nan"))).alias("v"))


def plane(df: DataFrame, z: int) -> DataFrame:
    return df.where(F.col("z") == z).select("x", "y", F.lit(0).alias("z"), "v")


def insert(target: Grid, df: DataFrame, at: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """df in a larger volume of zeros, its corner at a voxel."""
    moved = df.select(*[(F.col(a) + k).cast("int").alias(a) for a, k in zip(AXES, at)], "v")
    return target.fill(moved.where((F.col("x") < target.nx) & (F.col("y") < target.ny) & (F.col("z") < target.nz)))


def flip(df: DataFrame, grid: Grid) -> DataFrame:
    return df.select(*[(grid.size(a) - 1 - F.col(a)).cast("int").alias(a) for a in AXES], "v")


def circular_shift(df: DataFrame, grid: Grid, by: tuple[int, int, int]) -> DataFrame:
    return df.select(*[F.pmod(F.col(a) + k, F.lit(grid.size(a))).cast("int").alias(a) for a, k in zip(AXES, by)], "v")


def center_shift(df: DataFrame, grid: Grid) -> DataFrame:
    """Half-size circular shift, as before or after a Fourier transform."""
    return circular_shift(df, grid, tuple(grid.size(a) // 2 for a in AXES))


def shift(df: DataFrame, grid: Grid, by: tuple[float, float, float]) -> DataFrame:
    """Sub-pixel shift with linear interpolation, zeros outside: the image moves by the given amount."""
    for axis, d in zip(AXES, by):
        whole = math.floor(d + 0.5) if d >= 0 else -math.floor(-d + 0.5)
        rest = d - whole
        if rest:
            taps = [max(rest, 0.0), 1 - abs(rest), max(-rest, 0.0)]
            df = convolve(df, axis, taps, "zeros")
        if whole:
            df = df.withColumn(axis, (F.col(axis) + whole).cast("int")).where(F.col(axis).between(0, grid.size(axis) - 1))
            df = grid.fill(df)
    return df


def permute(df: DataFrame, order: str) -> DataFrame:
    """New axes x, y, z from the old ones in order, such as "yzx": names only, no cost."""
    return df.select(*[F.col(o).alias(a) for a, o in zip(AXES, order)], "v")


def transform_points(points: DataFrame, magnify: float = 1.0, weight_z: float = 1.0, rotate: float = 0.0, move: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Lateral magnification, z weight, rotation about z, translation, in this order."""
    x, y, z = F.col("x") * magnify, F.col("y") * magnify, F.col("z") * weight_z
    c, s = math.cos(rotate), math.sin(rotate)
    return points.withColumns({"x": x * c - y * s + move[0], "y": x * s + y * c + move[1], "z": z + move[2]})


def trilinear(df: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """points (id, x, y, z double) with the interpolated value v; 0 outside the volume. Each point asks for its eight corners."""
    inside = None
    for a in AXES:
        ok = (F.col("p" + a) >= 0) & (F.col("p" + a) <= grid.size(a) - 1)
        inside = ok if inside is None else inside & ok
    p = points.select("id", *[F.col(a).alias("p" + a) for a in AXES])
    corners = p.where(inside)
    for a in AXES:
        low = F.floor("p" + a).cast("int")
        part = F.col("p" + a) - low
        corners = corners.withColumn("c", F.explode(F.array(F.struct(low.alias("i"), (1 - part).alias("w")), F.struct((low + 1).alias("i"), part.alias("w"))))).withColumns({a: F.col("c.i"), "w" + a: F.col("c.w")}).drop("c")
    corners = corners.withColumn("w", F.col("wx") * F.col("wy") * F.col("wz")).where("w > 0")
    got = corners.join(df, list(AXES)).groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return p.join(got, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))


def _sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi))


def lanczos(signal: DataFrame, points: DataFrame, a: int = 5) -> DataFrame:
    """points (id, p) interpolated from signal (x, v), x from 0, mirrored at 0; 2 a taps. Close to a sample its value is taken; weights
    are re-normalised for a = 3 only; results are not negative."""
    near = 1e-8 if a == 3 else 1e-9
    base = F.floor("p").cast("int")
    taps = points.withColumn("n", F.explode(F.sequence(base - (a - 1), base + a))).withColumn("d", F.col("p") - F.col("n"))
    weight = F.when(F.abs("d") < a, _sinc(F.col("d")) * _sinc(F.col("d") / a)).otherwise(0.0)
    got = taps.withColumns({"w": weight, "k": F.abs("n")}).join(signal.select(F.col("x").alias("k"), "v"), "k")
    total = F.sum(F.col("w") * F.col("v"))
    value = F.greatest(total / F.sum("w") if a == 3 else total, F.lit(0.0))
    exact = F.max(F.when(F.abs("d") < near, F.col("v")))
    return got.groupBy("id").agg(F.coalesce(exact, value).alias("v"))


# ---------------------------------------------------------------- tiles


def divide(n: int, most: int) -> list[tuple[int, int]]:
    """ceil(n / most) parts of nearly equal size, as (first, last)."""
    k = -(-n // most)
    edges = [round(i * n / k) for i in range(k + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def split_tiles(df: DataFrame, grid: Grid, most: int, overlap: int) -> DataFrame:
    """Voxels with each tile whose halo holds them and their merge weight there: 1 in the core, falling linearly through the halo.

    Tiles of an axis begin at k * n / count, rounded as divide() does, so a voxel finds the few whose halo may hold it by arithmetic."""
    nx, ny = len(divide(grid.nx, most)), len(divide(grid.ny, most))

    def candidates(a: str, n: int, count: int) -> Column:
        at = lambda c: F.floor((c * count + count - 1) / n)
        low, high = at(F.greatest(F.lit(0), F.col(a) - overlap)) - 1, at(F.least(F.lit(n - 1), F.col(a) + overlap)) + 1
        return F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), low), F.least(F.lit(count - 1).cast("long"), high)))

    hit = df.withColumn("kx", candidates("x", grid.nx, nx)).withColumn("ky", candidates("y", grid.ny, ny))
    edge = lambda k, n, count: F.bround(k * n / count).cast("int")
    cores = {"cx0": edge(F.col("kx"), grid.nx, nx), "cx1": edge(F.col("kx") + 1, grid.nx, nx) - 1, "cy0": edge(F.col("ky"), grid.ny, ny), "cy1": edge(F.col("ky") + 1, grid.ny, ny) - 1}
    out = lambda a: F.greatest(F.col(f"c{a}0") - F.col(a), F.col(a) - F.col(f"c{a}1"), F.lit(0))
    hit = hit.withColumns(cores).withColumns({"ox": out("x"), "oy": out("y")}).where((F.col("ox") <= overlap) & (F.col("oy") <= overlap))
    return hit.select((F.col("ky") * nx + F.col("kx")).cast("int").alias("tile"), *AXES, "v", (1.0 - F.greatest("ox", "oy") / F.lit(float(overlap + 1))).alias("w"))


def merge_tiles(tiles: DataFrame) -> DataFrame:
    """Weighted mean over the tiles that hold a voxel."""
    return tiles.groupBy(*AXES).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def collage(df: DataFrame, grid: Grid) -> DataFrame:
    """The three maximum projections in one plane of (nx + nz) by (ny + nz)."""
    m = F.max("v").alias("v")
    xy = df.groupBy("x", "y").agg(m)
    xz = df.groupBy("x", "z").agg(m).select("x", (F.col("z") + grid.ny).alias("y"), "v")
    zy = df.groupBy("z", "y").agg(m).select((F.col("z") + grid.nx).alias("x"), "y", "v")
    return Grid(grid.nx + grid.nz, grid.ny + grid.nz).fill(xy.unionByName(xz).unionByName(zy).withColumn("z", F.lit(0)))


def auto_z_crop(df: DataFrame, scores: DataFrame, grid: Grid, planes: int) -> DataFrame:
    """The planes around the one with the highest focus score (z, score), clamped to the volume."""
    best = scores.orderBy(F.col("score").desc(), "z").limit(1).select(F.greatest(F.lit(0), F.least(F.lit(grid.nz - planes), F.col("z") - planes // 2)).alias("first"))
    return df.crossJoin(F.broadcast(best)).where(F.col("z").between(F.col("first"), F.col("first") + planes - 1)).select("x", "y", (F.col("z") - F.col("first")).cast("int").alias("z"), "v")


def trim_margin(df: DataFrame, axis: str, share: float = 0.001) -> DataFrame:
    """Without the outer planes along axis whose sum is below share of the largest plane's; the rest re-based."""
    sums = df.groupBy(axis).agg(F.sum("v").alias("s"))
    top = sums.agg(F.max("s").alias("m"))
    keep = sums.crossJoin(F.broadcast(top)).where(F.col("s") >= share * F.col("m")).agg(F.min(axis).alias("a"), F.max(axis).alias("b"))
    return df.crossJoin(F.broadcast(keep)).where(F.col(axis).between(F.col("a"), F.col("b"))).withColumn(axis, (F.col(axis) - F.col("a")).cast("int")).select(*AXES, "v")


def centre_z(df: DataFrame, grid: Grid) -> tuple[DataFrame, Grid]:
    """A kernel cut along z so that its brightest plane is the middle one; planes that have no partner on the other side go."""
    top = df.groupBy("z").agg(F.max("v").alias("m")).agg(F.max_by("z", F.struct("m", -F.col("z"))).alias("z")).first()["z"]
    half = min(top, grid.nz - 1 - top)
    return df.where(F.col("z").between(top - half, top + half)).withColumn("z", (F.col("z") - (top - half)).cast("int")), Grid(grid.nx, grid.ny, 2 * half + 1)


def crop_by_image(df: DataFrame, grid: Grid, image: Grid) -> tuple[DataFrame, Grid]:
    """A kernel cut to 2 n - 1 planes of each axis around its middle, n the image's size: what lies farther out reaches no pair of the image's
    voxels, so nothing is lost."""
    sizes = []
    for a in AXES:
        n, most = grid.size(a), 2 * image.size(a) - 1
        if n > most:
            first = (n - 1) // 2 - (most - 1) // 2
            df = df.where(F.col(a).between(first, first + most - 1)).withColumn(a, (F.col(a) - first).cast("int"))
        sizes.append(min(n, most))
    return df, Grid(*sizes)


def make_odd(df: DataFrame, grid: Grid) -> tuple[DataFrame, Grid]:
    """Even dimensions grow by one plane of zeros."""
    wide = Grid(*[n + 1 - n % 2 for n in (grid.nx, grid.ny, grid.nz)])
    return (df, grid) if wide == grid else (wide.fill(df), wide)


def stack(volumes: list[tuple[DataFrame, Grid]]) -> DataFrame:
    """Volumes of one lateral shape, one above the other."""
    out, z = None, 0
    for df, grid in volumes:
        own = df.select("x", "y", (F.col("z") + z).cast("int").alias("z"), "v")
        out, z = own if out is None else out.unionByName(own), z + grid.nz
    return out
