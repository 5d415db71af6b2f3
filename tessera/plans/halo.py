"""Reconstruction of a whole image in tiles that exchange halos every round, with one stopping rule for all of it.

The work domain, the image and the margin that its border option adds, is cut to tiles along x and y. A tile keeps its part of the estimate from
round to round, in a bucket of its own; what moves is only the strips of two kernel radii that its neighbours need. A round is one pass over the
tiles: forward model, error, ratio, correction. The error over the whole image decides when to stop, so the result does not depend on
the tiling: it is what one array of the whole image would give."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import checkpoints
from tessera.model import AXES, VOXELS, Grid
from tessera.operators import dense, recon

#: Side of a tile's core, at least (and more than two kernel radii); buckets at most.
SIDE, BUCKETS = 256, 4096


class Line:
    """One axis of the periodic work domain: n voxels of the image, size in all, tiles of at least side and of more than 2 r voxels."""

    def __init__(self, n: int, kernel: int, border: int, side: int | None):
        self.n, self.r = n, (kernel - 1) // 2
        self.size = recon.work_shape((n,), (kernel,), border)[0]
        self.tiles = 1 if side is None else max(1, self.size // max(side, 2 * self.r + 1))
        self.edges = [t * self.size // self.tiles for t in range(self.tiles + 1)]

    def core(self, t: int) -> np.ndarray:
        return np.arange(self.edges[t], self.edges[t + 1])

    def around(self, t: int, reach: int) -> np.ndarray:
        """Coordinates of the core and reach more on either side, around the end of the domain where need be."""
        return np.arange(self.edges[t] - reach, self.edges[t + 1] + reach) % self.size

    def near(self, t: int) -> list[int]:
        return sorted({(t + k) % self.tiles for k in (-1, 0, 1)})

    def tile(self, c):
        """Column of the tile that holds coordinate c."""
        return F.floor(((F.pmod(c, F.lit(self.size)) + 1) * self.tiles - 1) / self.size).cast("int")


def _at(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Where the elements of want stand in have, which is sorted; -1 for those that do not."""
    k = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return np.where(have[k] == want, k, -1)


def _shared(core: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return core[np.isin(core, wanted)]


class Tiling:
    """Everything a task must know of the domain: the lines, the kernel and the options."""

    def __init__(self, grid: Grid, kernel: np.ndarray, o: recon.Options, side: int):
        self.z, self.y, self.x = (Line(n, k, o.border, s) for n, k, s in zip((grid.nz, grid.ny, grid.nx), kernel.shape, (None, side, side)))
        self.kernel, self.o = kernel / kernel.sum(), o
        self.count = self.x.tiles * self.y.tiles

    def place(self, tile: int) -> tuple[int, int]:
        return tile % self.x.tiles, tile // self.x.tiles

    def shape(self, tile: int) -> tuple[int, int, int]:
        tx, ty = self.place(tile)
        return self.z.size, len(self.y.core(ty)), len(self.x.core(tx))

    def _spectrum(self, shape: tuple) -> np.ndarray:
        """Of the kernel around the origin of an array of this shape; along z, where the domain is whole, it may wrap."""
        padded = np.zeros(shape)
        for index, v in np.ndenumerate(self.kernel):
            at = tuple((i - (k - 1) // 2) % n for i, k, n in zip(index, self.kernel.shape, shape))
            padded[at] += v
        return np.fft.rfftn(padded)

    def _filtered(self, v: np.ndarray, back: bool) -> np.ndarray:
        """v through the kernel (back: through its mirror image), without a radius on either side along x and y."""
        k = self._spectrum(v.shape)
        got = np.fft.irfftn(np.fft.rfftn(v) * (np.conj(k) if back else k), v.shape, axes=(0, 1, 2))
        cut = lambda line: slice(line.r, -line.r or None)
        return got[:, cut(self.y), cut(self.x)]

    def inside(self, tile: int, reach: bool) -> np.ndarray:
        """Which voxels of the core, or of the core and a radius around it, are the image's."""
        tx, ty = self.place(tile)
        x, y = (line.around(t, line.r if reach else 0) < line.n for line, t in ((self.x, tx), (self.y, ty)))
        return (np.arange(self.z.size) < self.z.n)[:, None, None] & y[None, :, None] & x[None, None, :]

    def weight(self, tile: int) -> np.ndarray:
        if not self.o.border:
            return np.ones(self.shape(tile))
        w = self._filtered(self.inside(tile, True).astype(float), True)
        return np.where(w > 0.01, 1 / np.where(w > 0.01, w, 1), 0.0)

    def guess(self, x: np.ndarray, last: np.ndarray, made: int) -> np.ndarray:
        """What the forward model is applied to."""
        if self.o.method == "rl":
            return x
        return np.maximum(x + min(max((made - 1) / (made + 2), 0.0), self.o.alpha_max) * (x - last), self.o.floor)

    def strips(self, tile: int, p: np.ndarray):
        """(neighbour, part of p that lies within two radii of it) for each neighbour, itself included where the domain wraps onto it."""
        tx, ty = self.place(tile)
        for uy in self.y.near(ty):
            for ux in self.x.near(tx):
                to = uy * self.x.tiles + ux
                if to != tile:
                    cy, cx = (np.isin(line.core(t), line.around(u, 2 * line.r)) for line, t, u in ((self.y, ty, uy), (self.x, tx, ux)))
                    if cy.any() and cx.any():
                        yield to, p[:, cy][:, :, cx]

    def gathered(self, tile: int, parts: dict[int, np.ndarray]) -> np.ndarray:
        """p over the core and two radii around it, from the strips of the neighbours and its own core."""
        tx, ty = self.place(tile)
        wide = [line.around(t, 2 * line.r) for line, t in ((self.y, ty), (self.x, tx))]
        out = np.zeros((self.z.size, len(wide[0]), len(wide[1])))
        for other, p in parts.items():
            ux, uy = self.place(other)
            cores = [line.core(u) if other == tile else _shared(line.core(u), w) for line, u, w in zip((self.y, self.x), (uy, ux), wide)]
            (iy, ix) = (_at(c, w) for c, w in zip(cores, wide))
            p = p.reshape(self.z.size, len(cores[0]), len(cores[1]))
            out[np.ix_(np.arange(self.z.size), np.flatnonzero(iy >= 0), np.flatnonzero(ix >= 0))] = p[:, iy[iy >= 0]][:, :, ix[ix >= 0]]
        return out

    def step(self, tile: int, x: np.ndarray, last: np.ndarray, p_wide: np.ndarray, image: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float, float]:
        """(next x, squared error, Kullback-Leibler divergence) of this tile's part of the image. image: over the core and a radius around it."""
        o, inside = self.o, self.inside(tile, True)
        y = self._filtered(p_wide, False)
        core = (slice(None), slice(self.y.r, -self.y.r or None), slice(self.x.r, -self.x.r or None))
        own = inside[core]
        a, b = image[core][own], y[core][own]
        if o.method == "rl":
            ratio = np.where(inside, np.where(y > 0, image / np.where(y > 0, y, 1), o.floor), 1e-6)
        else:
            safe = np.where(np.abs(y) < 1e-6, np.copysign(1e-6, y), y)
            ratio = np.where(inside, image / safe, 0.0)
        new = np.maximum(p_wide[:, 2 * self.y.r : p_wide.shape[1] - 2 * self.y.r, 2 * self.x.r : p_wide.shape[2] - 2 * self.x.r] * weight * self._filtered(ratio, True), o.floor if o.method == "rl" else 0.0)
        return new, float(((b - a) ** 2).sum()), recon.kl_divergence(a, b)


_STATE = "tile int, kind int, source int, data binary, last binary, error double, kl double"
_CORE, _STRIP = 0, 1


def _rows(found: list[tuple]) -> pa.Table:
    kinds = (("tile", pa.int32()), ("kind", pa.int32()), ("source", pa.int32()), ("data", pa.binary()), ("last", pa.binary()), ("error", pa.float64()), ("kl", pa.float64()))
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, zip(*found))})


def _emit(t: Tiling, tile: int, x: np.ndarray, last: np.ndarray, made: int, error: float | None, kl: float | None) -> pa.Table:
    out = [(tile, _CORE, tile, x.tobytes(), last.tobytes(), error, kl)]
    return _rows(out + [(to, _STRIP, tile, np.ascontiguousarray(p).tobytes(), None, None, None) for to, p in t.strips(tile, t.guess(x, last, made))])


def smoothed(df: DataFrame, grid: Grid, sigma: float) -> DataFrame:
    """Separable Gaussian over three sigmas, its weights normalised at the borders."""
    r = max(1, int(np.ceil(3 * sigma)))
    taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2).tolist()

    def work(v: np.ndarray, first: tuple) -> dict:
        return {"v": reduce(lambda a, axis: dense.correlate(a, axis, taps, "normalized") if a.shape[2 - AXES.index(axis)] > 1 else a, "zyx", v)}

    return dense.over_blocks(df, grid, work, (r, r, r), "v double")


def deconvolve(df: DataFrame, grid: Grid, kernel: np.ndarray, options: recon.Options = recon.Options(), side: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(voxels, rounds): the image reconstructed as a whole, and (iter, error, kl) of every round, error the mean square over the image.

    Voxels that are missing count as 0. options as for one array: method, start, border, stopping by a number of rounds, by the relative change of the
    error or by the error itself. kernel: odd sizes along all axes."""
    spark, side = df.sparkSession, side or SIDE
    if any(n % 2 == 0 for n in kernel.shape):
        raise ValueError("a kernel needs odd sizes")
    image = df.select(*AXES, (F.col("v").cast("double") + options.offset).alias("v"))
    if options.offset:
        image = grid.fill(image, options.offset)
    if options.method == "identity":
        return grid.fill(df), spark.createDataFrame([], "iter int, error double, kl double")
    if options.prefilter > 0:
        flat = smoothed(image.withColumn("v", 2 * F.sqrt(F.greatest("v", F.lit(0.0)) + 0.375)), grid, options.prefilter)
        image = flat.select(*AXES, F.greatest(F.col("v") * F.col("v") / 4 - 0.375, F.lit(0.0)).alias("v"))
    image = checkpoints.stored(image)
    t = Tiling(grid, kernel, replace(options, prefilter=0.0), side)
    shipped = spark.sparkContext.broadcast(t)  # the kernel and a few numbers
    mean = (image.agg(F.sum("v")).first()[0] or 0.0) / (t.x.size * t.y.size * t.z.size)
    first = smoothed(image, grid, 8.0) if options.start == "smooth" else image
    both = image.withColumn("of", F.lit(0)).unionByName(first.select(*AXES, "v").withColumn("of", F.lit(1))) if options.start != "flat" else image.withColumn("of", F.lit(0))
    for a, line in (("x", t.x), ("y", t.y)):
        near = F.array_distinct(F.array(*[line.tile(F.col(a) + k) for k in (-line.r, 0, line.r)]))
        both = both.withColumn("t" + a, F.explode(near))
    dealt = both.select((F.col("ty") * t.x.tiles + F.col("tx")).alias("tile"), "of", *AXES, "v")
    # Tiles of the margin alone get no voxels of the image, but must be there.
    dealt = dealt.unionByName(spark.range(t.count).select(F.col("id").cast("int").alias("tile"), F.lit(-1).alias("of"), *[F.lit(0).alias(a) for a in AXES], F.lit(0.0).alias("v")))

    def begin(table: pa.Table) -> pa.Table:
        t = shipped.value
        tile, of = table.column("tile")[0].as_py(), table.column("of").to_numpy()
        tx, ty = t.place(tile)
        z, y, x, v = (table.column(c).to_numpy() for c in ("z", "y", "x", "v"))

        def dense_of(kind: int, reach: bool) -> np.ndarray:
            wide = [line.around(k, line.r if reach else 0) for line, k in ((t.y, ty), (t.x, tx))]
            uniq = [np.unique(w) for w in wide]
            a = np.zeros((t.z.size, len(uniq[0]), len(uniq[1])))
            iy, ix = _at(uniq[0], y), _at(uniq[1], x)
            own = (of == kind) & (iy >= 0) & (ix >= 0)
            a[z[own], iy[own], ix[own]] = v[own]
            return a[:, _at(uniq[0], wide[0])][:, :, _at(uniq[1], wide[1])]

        start = dense_of(1, False) if t.o.start != "flat" else np.full(t.shape(tile), mean)
        return pa.table({"tile": pa.array([tile], pa.int32()), "image": pa.array([dense_of(0, True).tobytes()], pa.binary()), "weight": pa.array([t.weight(tile).tobytes()], pa.binary()), "start": pa.array([start.tobytes()], pa.binary())})

    buckets = min(t.count, BUCKETS)
    static, static_name = checkpoints.bucketed(dealt.groupBy("tile").applyInArrow(begin, "tile int, image binary, weight binary, start binary"), "tile", buckets)

    def opened(table: pa.Table) -> pa.Table:
        t, tile = shipped.value, table.column("tile")[0].as_py()
        x = np.frombuffer(table.column("start")[0].as_py()).reshape(t.shape(tile))
        return _emit(t, tile, x, x, 0, None, None)

    def round_of(made: int):
        def work(state: pa.Table, own: pa.Table) -> pa.Table:
            t, tile = shipped.value, own.column("tile")[0].as_py()
            shape, parts = t.shape(tile), {}
            for row in state.to_pylist():
                if row["kind"] == _CORE:
                    x, last = (np.frombuffer(row[c]).reshape(shape) for c in ("data", "last"))
                else:
                    parts[row["source"]] = np.frombuffer(row["data"])
            parts[tile] = t.guess(x, last, made)
            image = np.frombuffer(own.column("image")[0].as_py()).reshape(shape[0], shape[1] + 2 * t.y.r, shape[2] + 2 * t.x.r)
            weight = np.frombuffer(own.column("weight")[0].as_py()).reshape(shape)
            new, error, kl = t.step(tile, x, last, t.gathered(tile, parts), image, weight)
            return _emit(t, tile, new, x, made + 1, error, kl)

        return work

    state, name = checkpoints.bucketed(static.select("tile", "start").groupBy("tile").applyInArrow(opened, _STATE), "tile", buckets)
    told, n = [], grid.nx * grid.ny * grid.nz
    for made in range(options.iterations):
        step = state.groupBy("tile").cogroup(static.select("tile", "image", "weight").groupBy("tile")).applyInArrow(round_of(made), _STATE)
        new, new_name = checkpoints.bucketed(step, "tile", buckets)
        error, kl = new.where(F.col("kind") == _CORE).agg(F.sum("error"), F.sum("kl")).first()
        told.append((made, error / n, kl))
        stop = made and (options.stop == "relative" and abs(told[-1][1] - told[-2][1]) / told[-1][1] < options.tolerance or options.stop == "absolute" and told[-1][1] < options.tolerance)
        if stop:
            checkpoints.drop_bucketed(spark, new_name)
            break
        checkpoints.drop_bucketed(spark, name)
        state, name = new, new_name

    def ended(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t, tile = shipped.value, row["tile"]
                v, inside = np.frombuffer(row["data"]).reshape(t.shape(tile)), t.inside(tile, False)
                z, y, x = np.nonzero(inside)
                tx, ty = t.place(tile)
                yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in (t.x.core(tx)[x], t.y.core(ty)[y], z)), pa.array(v[inside])], ["x", "y", "z", "v"])

    out = checkpoints.stored(state.where(F.col("kind") == _CORE).select("tile", "data").mapInArrow(ended, VOXELS).select(*AXES, F.greatest(F.col("v") - options.offset, F.lit(0.0)).alias("v")))
    for old in (name, static_name):
        checkpoints.drop_bucketed(spark, old)
    return out, spark.createDataFrame(told, "iter int, error double, kl double")
