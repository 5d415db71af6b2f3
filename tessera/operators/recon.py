"""Iterative image reconstruction: dense kernels for tiles, and the same iterations as stencils on voxel rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checkpoints import stored
from tessera.model import AXES, TILES
from tessera.operators.stencil import convolve


@dataclass(frozen=True)
class Options:
    """method: rl, shb or identity; border: 2 pads by the whole kernel, 1 by half, 0 is periodic; stop: fixed, relative or absolute."""

    method: str = "shb"
    iterations: int = 50
    border: int = 2
    floor: float = 1e-2
    alpha_max: float = 1.0
    start: str = "flat"
    stop: str = "fixed"
    tolerance: float = 0.02
    offset: float = 5.0
    prefilter: float = 0.0


def kl_divergence(image: np.ndarray, model: np.ndarray) -> float:
    """Sum of image ln(image / model) where both are above 0."""
    both = (image > 0) & (model > 0)
    return float((image[both] * np.log(image[both] / model[both])).sum())


def work_shape(image: tuple, kernel: tuple, border: int) -> tuple:
    grow = {2: lambda m, p: m + p - 1, 1: lambda m, p: m + (p + 1) // 2, 0: max}[border]
    return tuple(grow(m, p) for m, p in zip(image, kernel))


def next_smooth(n: int) -> int:
    """The next size that has no prime factor above 13."""
    while True:
        m = n
        for p in (2, 3, 5, 7, 11, 13):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def _gauss3(v: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian with weights normalised at borders."""
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    for axis in range(v.ndim):
        if v.shape[axis] > 1:
            line = lambda a: np.convolve(a, k, "full")[r : r + len(a)] / np.convolve(np.ones_like(a), k, "full")[r : r + len(a)]
            v = np.apply_along_axis(line, axis, v)
    return v


def deconvolve(image: np.ndarray, kernel: np.ndarray, o: Options = Options(), each=lambda model, image: None) -> tuple[np.ndarray, int, list[float]]:
    """(result, iterations made, mean squared forward error before each). each is called with the modelled and the real image when an error has been computed."""
    if o.method == "identity":
        return image.astype(float), 0, []
    image = image.astype(float)
    if o.prefilter > 0:
        image = np.maximum((_gauss3(2 * np.sqrt(np.maximum(image, 0) + 0.375), o.prefilter) / 2) ** 2 - 0.375, 0)
    shape = work_shape(image.shape, kernel.shape, o.border)
    own = tuple(slice(0, n) for n in image.shape)
    padded = np.zeros(shape)
    cut = tuple(slice(0, min(a, b)) for a, b in zip(kernel.shape, shape))
    padded[cut] = kernel[cut]
    padded = np.roll(padded, [-((n - 1) // 2) for n in kernel.shape], axis=tuple(range(padded.ndim))) / kernel.sum()
    k = np.fft.rfftn(padded)
    forward = lambda v: np.fft.irfftn(np.fft.rfftn(v) * k, shape, axes=range(v.ndim))
    back = lambda v: np.fft.irfftn(np.fft.rfftn(v) * np.conj(k), shape, axes=range(v.ndim))
    # Fixed values here and below, which results depend on: weights of 0.01 or less count as none; ratios keep 1e-6 from 0.
    weight = np.ones(shape)
    if o.border:
        ones = np.zeros(shape)
        ones[own] = 1
        w = back(ones)
        weight = np.where(w > 0.01, 1 / np.where(w > 0.01, w, 1), 0.0)
    if o.start == "identity":
        x = np.zeros(shape)
        x[own] = image
    elif o.start == "smooth":
        x = np.zeros(shape)
        x[own] = _gauss3(image, 8.0)
    else:
        x = np.full(shape, image.sum() / np.prod(shape))
    last, errors = x, []
    made = 0
    while made < o.iterations:
        if o.method == "rl":
            p = x
        else:
            alpha = min(max((made - 1) / (made + 2), 0.0), o.alpha_max)
            p = np.maximum(x + alpha * (x - last), o.floor)
        y = forward(p)
        errors.append(float(((y[own] - image) ** 2).mean()))
        each(y[own], image)
        if len(errors) > 1 and (o.stop == "relative" and abs(errors[-1] - errors[-2]) / errors[-1] < o.tolerance or o.stop == "absolute" and errors[-1] < o.tolerance):
            break
        ratio = np.full(shape, 1e-6 if o.method == "rl" else 0.0)
        if o.method == "rl":
            ratio[own] = np.where(y[own] > 0, image / np.where(y[own] > 0, y[own], 1), o.floor)
        else:
            safe = np.where(np.abs(y[own]) < 1e-6, np.copysign(1e-6, y[own]), y[own])
            ratio[own] = image / safe
        new = p * weight * back(ratio)
        last, x = x, np.maximum(new, o.floor if o.method == "rl" else 0.0)
        made += 1
    return x[own], made, errors


def deconvolve_tiles(tiles: DataFrame, kernel: np.ndarray, o: Options = Options()) -> DataFrame:
    """Each dense tile on its own, with the offset added before and taken off after: TILES and (iterations, error). Tiles are of bounded size, so a
    task's memory does not follow the image; halos are the caller's (split_tiles)."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                data = np.frombuffer(r["data"], "<f4").reshape(r["nz"], r["ny"], r["nx"])
                got, made, errors = deconvolve(data + o.offset, kernel, o)
                r |= {"data": np.maximum(got - o.offset, 0).astype("<f4").tobytes(), "iterations": made, "error": errors[-1] if errors else None}
            names = [c.split()[0] for c in TILES.split(", ")]
            kinds = [(n, pa.binary() if n == "data" else pa.int32()) for n in names] + [("iterations", pa.int32()), ("error", pa.float64())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return tiles.mapInArrow(run, TILES + ", iterations int, error double")


def start(df: DataFrame, how: str = "flat") -> DataFrame:
    """flat: the mean everywhere; identity: the image."""
    if how == "identity":
        return df
    return df.crossJoin(F.broadcast(df.agg(F.avg("v").alias("m")))).select(*AXES, F.col("m").alias("v"))


def _blur(df: DataFrame, taps: dict[str, list[float]]) -> DataFrame:
    for axis, t in taps.items():
        df = convolve(df, axis, t, "periodic")
    return df


def _with(a: DataFrame, b: DataFrame, value) -> DataFrame:
    return a.join(b.select(*AXES, F.col("v").alias("w")), list(AXES)).select(*AXES, value.alias("v"))


def richardson_lucy_rows(df: DataFrame, taps: dict[str, list[float]], iterations: int, floor: float = 1e-2) -> DataFrame:
    """The same iteration on voxel rows with a separable periodic kernel: x <- x K'(image / Kx). Lineage ends every fourth round."""
    mirrored = {a: t[::-1] for a, t in taps.items()}
    x = start(df)
    for k in range(iterations):
        ratio = _with(df, _blur(x, taps), F.when(F.col("w") > 0, F.col("v") / F.col("w")).otherwise(floor))
        x = _with(x, _blur(ratio, mirrored), F.greatest(F.col("v") * F.col("w"), F.lit(floor)))
        x = stored(x) if k % 4 == 3 else x
    return x


def heavy_ball_rows(df: DataFrame, taps: dict[str, list[float]], iterations: int, floor: float = 1e-2, alpha_max: float = 1.0) -> DataFrame:
    """Scaled heavy ball on voxel rows: p = max(x + a (x - x_last), floor), x <- max(p K'(image / Kp), 0)."""
    mirrored = {a: t[::-1] for a, t in taps.items()}
    x = last = start(df)
    for k in range(iterations):
        alpha = min(max((k - 1) / (k + 2), 0.0), alpha_max)
        p = _with(x, last, F.greatest(F.col("v") + alpha * (F.col("v") - F.col("w")), F.lit(floor)))
        safe = F.when(F.abs("w") < 1e-6, F.when(F.col("w") < 0, -1e-6).otherwise(1e-6)).otherwise(F.col("w"))
        ratio = _with(df, _blur(p, taps), F.col("v") / safe)
        new = _with(p, _blur(ratio, mirrored), F.greatest(F.col("v") * F.col("w"), F.lit(0.0)))
        x, last = (stored(new) if k % 2 == 1 else new), x
    return x


def boundary_weights(df: DataFrame, taps: dict[str, list[float]]) -> DataFrame:
    """1 / K'1 where that is above 0.01, else 0, over the image's own voxels."""
    ones = df.withColumn("v", F.lit(1.0))
    for axis, t in taps.items():
        ones = convolve(ones, axis, t[::-1], "zeros")
    return ones.withColumn("v", F.when(F.col("v") > 0.01, 1 / F.col("v")).otherwise(0.0))


# ---------------------------------------------------------------- denoising

_DIRECTIONS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1)]


#: Axes of an image, behind one that numbers images.
_XYZ = (-3, -2, -1)


def _second(v: np.ndarray, d: tuple, periodic: bool) -> np.ndarray:
    """v(p + d) - 2 v(p) + v(p - d); 0 where a neighbour is missing."""
    out = np.roll(v, [-s for s in d], _XYZ) - 2 * v + np.roll(v, d, _XYZ)
    if not periodic:
        for axis, s in enumerate(d):
            if s:
                edge = [Ellipsis, *[slice(None)] * 3]
                for i in (0, -1):
                    edge[axis + 1] = i
                    out[tuple(edge)] = 0
    return out


def denoise(image: np.ndarray, smooth: float = 0.1, sparse: float = 0.1, periodic: bool = True, iterations: int = 60) -> tuple[np.ndarray, list[float]]:
    """Minimise |x - image|^2 + smooth * sum over nine directions of |second difference| + sparse * |x|, x >= 0, by projected
    gradient steps that shrink by 0.8 until they help. Returns the image and the objective after each step."""
    x, values = denoise_many(image[None], smooth, sparse, periodic, iterations)
    return x[0], [float(v[0]) for v in values]


def denoise_many(images: np.ndarray, smooth: float = 0.1, sparse: float = 0.1, periodic: bool = True, iterations: int = 60) -> tuple[np.ndarray, list[np.ndarray]]:
    """denoise of each of several images of one shape, with steps of their own; the objectives of those that a round has improved."""
    images = images.astype(float)
    use = [d for d in _DIRECTIONS if all(images.shape[1 + a] > 2 or not s for a, s in enumerate(d))]
    total = lambda v: v.sum(_XYZ)

    def objective(x, image):
        return total((x - image) ** 2) + smooth * sum((total(np.abs(_second(x, d, periodic))) for d in use), np.zeros(len(x))) + sparse * total(np.abs(x))

    out, own, step = images.copy(), np.arange(len(images)), np.full(len(images), 0.25)
    last = objective(images, images)
    values = [last.copy()]
    for _ in range(iterations):
        x, image = out[own], images[own]
        g = 2 * (x - image) + sparse * np.sign(x)
        for d in use:
            s = np.sign(_second(x, d, periodic))
            g += smooth * (np.roll(s, d, _XYZ) - 2 * s + np.roll(s, [-k for k in d], _XYZ))
        todo, better = np.arange(len(own)), np.zeros(len(own), bool)
        while len(todo):
            todo = todo[step[own[todo]] >= 1e-6]
            new = np.maximum(x[todo] - step[own[todo], None, None, None] * g[todo], 0)
            value = objective(new, image[todo])
            helps = value < last[own[todo]]
            out[own[todo[helps]]], last[own[todo[helps]]], better[todo[helps]] = new[helps], value[helps], True
            todo = todo[~helps]
            step[own[todo]] *= 0.8
        own = own[better]
        if not len(own):
            break
        values.append(last[own])
    return out, values


#: Bytes of voxels of tiles that are denoised together.
TOGETHER = 1 << 20


def denoise_tiles(tiles: DataFrame, smooth: float = 0.1, sparse: float = 0.1, periodic: bool = True, iterations: int = 60) -> DataFrame:
    """Each dense tile on its own; small ones of a shape share their array operations."""

    def run(batches):
        for batch in batches:
            rows, shapes = batch.to_pylist(), {}
            for r in rows:
                shapes.setdefault((r["nz"], r["ny"], r["nx"]), []).append(r)
            for shape, own in shapes.items():
                most = max(1, TOGETHER // max(1, 8 * int(np.prod(shape))))
                for at in range(0, len(own), most):
                    some = own[at : at + most]
                    got, _ = denoise_many(np.stack([np.frombuffer(r["data"], "<f4").reshape(shape) for r in some]), smooth, sparse, periodic, iterations)
                    for r, v in zip(some, got):
                        r["data"] = v.astype("<f4").tobytes()
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return tiles.mapInArrow(run, TILES)
