"""Generators of point-spread functions: volumes from rows of parameters, made plane by plane."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoints import stored
from tessera.functions import gamma_from_fwhm, gauss, lorentz, sigma_from_fwhm
from tessera.model import AXES, VOXELS


def j0(x: np.ndarray) -> np.ndarray:
    """Bessel function of order 0: the midpoint rule on its integral form, exact to rounding while x is well below the number of nodes, beyond
    200 the leading asymptotic terms."""
    x = np.abs(np.asarray(x, float))
    out = np.zeros_like(x)
    near = x < 200
    top = float(x[near].max(initial=0))
    n = 64 if top < 40 else 128 if top < 100 else 256
    t = (np.arange(n) + 0.5) * math.pi / n
    for k in range(0, n, 16):  # blocks bound the temporary
        out[near] += np.cos(x[near][:, None] * np.sin(t[k : k + 16])).sum(axis=1)
    out[near] /= n
    far = x[~near]
    z = 1 / (8 * far)
    out[~near] = np.sqrt(2 / (math.pi * far)) * ((1 - 4.5 * z**2) * np.cos(far - math.pi / 4) + z * np.sin(far - math.pi / 4))
    return out


def born_wolf_profile(r: np.ndarray, z: float, wavelength: float, na: float, index: float) -> np.ndarray:
    """|int_0^1 J0(k NA r rho) exp(-i k NA^2 rho^2 z / (2 n)) rho drho|^2 by Gauss-Legendre quadrature, with two nodes a radian of the phase and 64 at least."""
    k = 2 * math.pi / wavelength
    turns = k * na * float(np.max(r, initial=0)) + k * na * na * abs(z) / (2 * index)
    rho, w = np.polynomial.legendre.leggauss(64 * max(1, math.ceil(turns / 32)))
    rho, w = (rho + 1) / 2, w / 2
    phase = np.exp(-1j * k * na * na * rho * rho * z / (2 * index))
    value = (j0(k * na * r[:, None] * rho[None, :]) * (phase * rho * w)[None, :]).sum(axis=1)
    return np.abs(value) ** 2


def born_wolf_series(r: np.ndarray, z: float, wavelength: float, na: float, index: float) -> np.ndarray:
    """The same with the pupil's phase expanded in Bessel functions by least squares, each of which integrates in closed form."""
    k = 2 * math.pi / wavelength
    beta = k * na * na * z / (2 * index)
    n = 6 + math.ceil(abs(beta))
    scale = (3 * np.arange(1, n + 1) - 2) * 1.0
    rho = np.linspace(0, 1, 10 * n)
    coefficients = np.linalg.lstsq(j0(scale[None, :] * rho[:, None]).astype(complex), np.exp(-1j * beta * rho * rho), rcond=None)[0]
    a = k * na * np.asarray(r, float)[:, None]
    nodes, w = np.polynomial.legendre.leggauss(200)
    nodes, w = (nodes + 1) / 2, w / 2
    basis = np.stack([(j0(a * nodes) * (j0(s * nodes) * nodes * w)).sum(axis=1) for s in scale], axis=1)
    return np.abs(basis @ coefficients) ** 2


def _lanczos5(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    base = np.floor(x).astype(int)
    out = np.zeros(len(x))
    for k in range(-4, 6):
        d = x - (base + k)
        w = np.where(np.abs(d) < 5, np.sinc(d) * np.sinc(d / 5), 0.0)
        out += w * v[np.minimum(np.abs(base + k), len(v) - 1)]
    return np.maximum(out, 0)


def _volumes(params: DataFrame, nz: int, plane) -> DataFrame:
    """For each row of params (key and numbers) a volume (key, x, y, z, v) of unit sum, its planes plane(row, z), z from -nz // 2, made by different tasks."""
    names = [c for c in params.columns if c != "key"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                got = plane(row, row["z"] - nz // 2)
                y, x = (a.ravel().astype(np.int32) for a in np.indices(got.shape))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(got.size, row["key"], np.int64)), pa.array(x), pa.array(y), pa.array(np.full(got.size, row["z"], np.int32)), pa.array(got.ravel())], ["key", *AXES, "v"])

    each = params.select(F.col("key").cast("long").alias("key"), *[F.col(c).cast("double").alias(c) for c in names], F.explode(F.sequence(F.lit(0), F.lit(nz - 1))).alias("z"))
    planes = stored(each.repartition("key", "z").mapInArrow(run, "key long, " + VOXELS))
    total = planes.groupBy("key").agg(F.sum("v").alias("t"))
    return planes.join(total, "key").select("key", *AXES, (F.col("v") / F.col("t")).alias("v"))


def born_wolf_volumes(params: DataFrame, dxy: float = 130.0, dz: float = 300.0, nxy: int = 31, nz: int = 21, samples: int = 17, series: bool = False) -> DataFrame:
    """Born-Wolf volumes (key, x, y, z, v) of unit sum, one for each row (key, wavelength, na, index): a radial profile with samples points a
    pixel, interpolated and integrated over pixels. Sizes are made odd."""
    nxy, nz = nxy + 1 - nxy % 2, nz + 1 - nz % 2
    half = nxy // 2

    def plane(p: dict, z: int) -> np.ndarray:
        top = int(math.ceil((half + 1) * math.sqrt(2))) * samples
        r = np.arange(top + samples) * dxy / samples
        profile = (born_wolf_series if series else born_wolf_profile)(r, abs(z) * dz, p["wavelength"], p["na"], p["index"])
        sub = (np.arange(5) - 2) / 5
        x = (np.arange(-half, half + 1)[:, None] + sub[None, :]).reshape(-1)
        d = np.sqrt(x[:, None] ** 2 + x[None, :] ** 2) * samples
        fine = _lanczos5(profile, d.ravel()).reshape(d.shape)
        return fine.reshape(nxy, 5, nxy, 5).mean(axis=(1, 3))

    return _volumes(params, nz, plane)


def born_wolf(spark: SparkSession, wavelength: float = 461.0, na: float = 1.45, index: float = 1.512, **options) -> DataFrame:
    """One volume (x, y, z, v)."""
    return born_wolf_volumes(spark.createDataFrame([(0, float(wavelength), float(na), float(index))], "key long, wavelength double, na double, index double"), **options).drop("key")


def _simpson(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fm: np.ndarray, fb: np.ndarray) -> np.ndarray:
    return (b - a) / 6 * (fa + 4 * fm + fb)


def adaptive(f, a: np.ndarray, b: np.ndarray, tolerance: float, least: int = 3, most: int = 30) -> np.ndarray:
    """Integrals of f over many intervals at once, each halved until its own error estimate is small enough.

    f(which, x) gives values for the interval numbers which. Each round halves all open pieces of all intervals together: the difference of
    a piece's Simpson sum to that of its halves, divided by 15, is its error, which must be below tolerance times its share of the interval."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    out, who, whole = np.zeros(len(a)), np.arange(len(a)), b - a
    m = (a + b) / 2
    left, right, fa, fm, fb = a, b, f(who, a), f(who, m), f(who, b)
    for level in range(most):
        m = (left + right) / 2
        one = _simpson(left, right, fa, fm, fb)
        m1, m2 = (left + m) / 2, (m + right) / 2
        f1, f2 = f(who, m1), f(who, m2)
        halves = _simpson(left, m, fa, f1, fm) + _simpson(m, right, fm, f2, fb)
        error = np.abs(halves - one) / 15
        done = (error <= tolerance * np.where(whole[who] > 0, (right - left) / np.where(whole[who] > 0, whole[who], 1), 1)) & (level >= least) | (level == most - 1)
        np.add.at(out, who[done], (halves + (halves - one) / 15)[done])
        go = ~done
        if not go.any():
            break
        who = np.concatenate([who[go], who[go]])
        left, right = np.concatenate([left[go], m[go]]), np.concatenate([m[go], right[go]])
        fa, fm, fb = np.concatenate([fa[go], fm[go]]), np.concatenate([f1[go], f2[go]]), np.concatenate([fm[go], fb[go]])
    return out


def line_integrals(x0: np.ndarray, y: np.ndarray, z: float, wavelength: float, na: float, index: float, width: float, tolerance: float = 1e-9) -> np.ndarray:
    """Mean intensity of the Born-Wolf model along the line from x0 to x0 + width at height y, for many lines at once."""
    return adaptive(lambda k, x: born_wolf_profile(np.sqrt(x * x + y[k] * y[k]), z, wavelength, na, index), x0, x0 + width, tolerance * width) / width


def pixel_integrals(x0: np.ndarray, y0: np.ndarray, z: float, wavelength: float, na: float, index: float, width: float, tolerance: float = 1e-8) -> np.ndarray:
    """Mean intensity over the squares of the given width at (x0, y0): adaptive halving along y, of line integrals along x.

    The intensity is looked up in a cubic spline of its radial profile, which is finer than the tolerance asks for."""
    far = float(np.sqrt(np.max((np.abs(x0) + width) ** 2 + (np.abs(y0) + width) ** 2)))
    step = wavelength / na / 256
    r = np.arange(-2, int(far / step) + 4) * step
    table = born_wolf_profile(np.abs(r), z, wavelength, na, index)

    def intensity(x: np.ndarray) -> np.ndarray:
        at = x / step + 2
        k = np.clip(np.floor(at).astype(int), 1, len(table) - 3)
        t = at - k
        p, q, u, v = table[k - 1], table[k], table[k + 1], table[k + 2]
        return -t * (t - 1) * (t - 2) / 6 * p + (t + 1) * (t - 1) * (t - 2) / 2 * q - (t + 1) * t * (t - 2) / 2 * u + (t + 1) * t * (t - 1) / 6 * v

    def rows(which: np.ndarray, y: np.ndarray) -> np.ndarray:
        return adaptive(lambda k, x: intensity(np.sqrt(x * x + y[k] * y[k])), x0[which], x0[which] + width, tolerance * width) / width

    return adaptive(rows, y0, y0 + width, tolerance * width) / width


def pixel_volumes(params: DataFrame, dxy: float = 130.0, dz: float = 300.0, nxy: int = 15, nz: int = 5, tolerance: float = 1e-8) -> DataFrame:
    """Born-Wolf volumes (key, x, y, z, v) of unit sum, one for each row (key, wavelength, na, index), whose voxels are integrals over their pixels."""
    nxy, nz = nxy + 1 - nxy % 2, nz + 1 - nz % 2
    half = nxy // 2

    def plane(p: dict, z: int) -> np.ndarray:
        # An eighth of the plane is enough: it is alike in x and y and in their signs.
        v = {(a, b): 0.0 for a in range(half + 1) for b in range(a + 1)}
        x0, y0 = (np.array([(k[c] - 0.5) * dxy for k in v]) for c in (0, 1))
        v = dict(zip(v, pixel_integrals(x0, y0, abs(z) * dz, p["wavelength"], p["na"], p["index"], dxy, tolerance)))
        at = np.abs(np.arange(nxy) - half)
        return np.array([[v[max(i, j), min(i, j)] for i in at] for j in at])

    return _volumes(params, nz, plane)


def angular_spectrum_planes(wavelength: float, na: float, index: float, dxy: float, n: int, zs: list[float]) -> np.ndarray:
    """|inverse transform of pupil times propagator|^2 for each z."""
    f = np.fft.fftfreq(n, dxy)
    f2 = f[:, None] ** 2 + f[None, :] ** 2
    pupil = f2 <= (na / wavelength) ** 2
    kz = np.sqrt(np.maximum((index / wavelength) ** 2 - f2, 0))
    return np.stack([np.abs(np.fft.fftshift(np.fft.ifft2(pupil * np.exp(2j * math.pi * kz * z)))) ** 2 for z in zs])


def pinhole(radius: float) -> np.ndarray:
    """Share of each pixel that a disc of radius pixels covers, unit sum."""
    h = max(1, math.ceil(radius + 0.5))
    fine = (np.arange((2 * h + 1) * 16) + 0.5) / 16 - h - 0.5
    inside = (fine[:, None] ** 2 + fine[None, :] ** 2 <= radius**2).astype(float)
    k = inside.reshape(2 * h + 1, 16, 2 * h + 1, 16).mean(axis=(1, 3))
    return k / k.sum()


def angular_spectrum_volumes(params: DataFrame, dxy: float = 60.0, dz: float = 150.0, nxy: int = 63, nz: int = 21, pinhole_radius: float = 1.0) -> DataFrame:
    """Wide-field volumes (key, x, y, z, v) of unit sum, one for each row (key, emission, excitation, na, index); with an excitation wavelength
    above 0 the confocal one: (emission blurred by the pinhole) times excitation."""

    def plane(p: dict, z: int) -> np.ndarray:
        got = angular_spectrum_planes(p["emission"], p["na"], p["index"], dxy, nxy, [z * dz])[0]
        if p["excitation"]:
            k = pinhole(pinhole_radius)
            wide = np.zeros_like(got)
            wide[: k.shape[0], : k.shape[1]] = k
            wide = np.roll(wide, (-(k.shape[0] // 2), -(k.shape[1] // 2)), (0, 1))
            got = np.maximum(np.fft.ifft2(np.fft.fft2(got) * np.fft.fft2(wide)).real, 0) * angular_spectrum_planes(p["excitation"], p["na"], p["index"], dxy, nxy, [z * dz])[0]
        return got

    return _volumes(params, nz, plane)


def angular_spectrum(spark: SparkSession, emission: float, excitation: float | None = None, na: float = 1.4, index: float = 1.515, **options) -> DataFrame:
    """One volume (x, y, z, v)."""
    return angular_spectrum_volumes(spark.createDataFrame([(0, float(emission), float(excitation or 0), float(na), float(index))], "key long, emission double, excitation double, na double, index double"), **options).drop("key")


def sted_volumes(params: DataFrame, lateral: Column, axial: Column, n: int, nz: int) -> DataFrame:
    """params with (x, y, z, v), one volume a row: a Gaussian along z times a two-dimensional Lorentzian; columns only."""
    gamma, sigma = gamma_from_fwhm(lateral), sigma_from_fwhm(axial)
    at = lambda a, m: F.col(a) - float((m - 1) // 2)
    rows = params.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n * n * nz - 1))))
    rows = rows.withColumns({"x": F.col("_i") % n, "y": F.floor(F.col("_i") / n).cast("int") % n, "z": F.floor(F.col("_i") / (n * n)).cast("int")})
    return rows.withColumn("v", gauss(at("z", nz), sigma) * lorentz(at("x", n), at("y", n), gamma)).drop("_i")


def sted(spark: SparkSession, fwhm_lateral: float, fwhm_axial: float, n: int, nz: int) -> DataFrame:
    """One volume (x, y, z, v)."""
    return sted_volumes(spark.range(1), F.lit(float(fwhm_lateral)), F.lit(float(fwhm_axial)), n, nz).select(*AXES, "v")
