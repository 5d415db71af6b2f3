"""Sub-pixel maximum-likelihood fits of a Gaussian to dots."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import AXES, Grid

FIT = "id long, f_bg double, f_signal_count double, f_peak_signal double, f_x double, f_y double, f_z double, f_sigma_lateral double, f_sigma_axial double, f_status int, f_error double, f_corr double"


def roi_half(sigma: float) -> int:
    """Half of a region of ceil(4 sigma) made odd and at least 5."""
    n = max(5, math.ceil(4 * sigma))
    return (n + 1 - n % 2) // 2


def model(p: np.ndarray, at: np.ndarray, deep: bool) -> np.ndarray:
    """Background plus count times a normalised Gaussian. p: bg, n, x, y, sigma [, z, sigma z]."""
    s = p[4]
    g = np.exp(-0.5 * ((at[:, 0] - p[2]) ** 2 + (at[:, 1] - p[3]) ** 2) / s**2) / (2 * math.pi * s**2)
    if deep:
        g = g * np.exp(-0.5 * ((at[:, 2] - p[5]) / p[6]) ** 2) / (math.sqrt(2 * math.pi) * p[6])
    return p[0] + p[1] * g


def loss(p: np.ndarray, at: np.ndarray, v: np.ndarray, deep: bool) -> float:
    """-sum(I ln M - M); parameters that must not be negative make it huge."""
    if min(p[0], p[1]) < 0 or p[4] <= 0 or deep and p[6] <= 0:
        return 1e99
    m = np.maximum(model(p, at, deep), 1e-12)
    return -float((v * np.log(m) - m).sum())


def minimize(f, x: np.ndarray, rounds: int = 200, tolerance: float = 1e-5) -> tuple[np.ndarray, float, int]:
    """BFGS with central differences and a backtracking line search."""
    n, h = len(x), np.eye(len(x))
    scale = np.maximum(np.abs(x), 1.0)

    def grad(y):
        out = np.zeros(n)
        for i in range(n):
            e = np.zeros(n)
            e[i] = 1e-5 * scale[i]
            out[i] = (f(y + e) - f(y - e)) / (2 * e[i])
        return np.clip(np.nan_to_num(out), -1e12, 1e12)

    value, g = f(x), grad(x)
    h = np.diag(scale**2 / max(1.0, np.abs(g * scale).max()))
    for k in range(rounds):
        d = -h @ g
        if g @ d >= 0:
            h = np.diag(scale**2 / max(1.0, np.abs(g * scale).max()))
            d = -h @ g
        t = 1.0
        while t > 1e-10 and f(x + t * d) > value + 1e-4 * t * (g @ d):
            t /= 2
        if t <= 1e-10:
            return x, value, k
        new = x + t * d
        gn = grad(new)
        s, y = new - x, gn - g
        if abs(value - f(new)) < tolerance * 1e-4 * max(1.0, abs(value)) and np.abs(gn * scale).max() < tolerance * max(1.0, abs(value)):
            return new, f(new), k
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            a = np.eye(n) - r * np.outer(s, y)
            h = a @ h @ a.T + r * np.outer(s, s)
        x, value, g = new, f(new), gn
    return x, value, rounds


def _windows(df: DataFrame, dots: DataFrame, half: int, half_z: int) -> DataFrame:
    """(id, cx, cy, cz, x, y, z, v): the voxels around each dot. A dot asks for its bounded window by an equi-join, of sorted sides: the planner knows
    neither side's rows after an explode and would take either for small enough to be gathered in the driver and broadcast."""
    p = dots.select("id", *[F.floor(F.col(a) + 0.5).cast("int").alias("c" + a) for a in AXES])
    for a, h in zip(AXES, (half, half, half_z)):
        p = p.withColumn(a, F.explode(F.sequence(F.col("c" + a) - h, F.col("c" + a) + h)))
    return p.hint("merge").join(df, list(AXES))


def fit_dots(df: DataFrame, dots: DataFrame, grid: Grid, sigma: float = 1.0, sigma_z: float = 2.0) -> DataFrame:
    """dots (id, x, y, z) fitted in their windows: FIT columns, positions absolute. Status 0: converged. A window is bounded, so is a group."""
    deep = grid.nz > 1
    half, half_z = roi_half(sigma), roi_half(sigma_z) if deep else 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "y", "x"])
        c = pdf[["cx", "cy", "cz"]].iloc[0].to_numpy(float)
        at, v = pdf[["x", "y", "z"]].to_numpy(float) - c, pdf["v"].to_numpy(float)
        low = float(v.min())
        begin = [max(low, 1e-3), max(float((v - low).sum()), 1e-3), 0.0, 0.0, sigma] + ([0.0, sigma_z] if deep else [])
        p, value, rounds = minimize(lambda q: loss(q, at, v, deep), np.array(begin))
        m = model(p, at, deep)
        corr = float(np.corrcoef(m, v)[0, 1]) if v.std() > 0 and m.std() > 0 else 0.0
        peak = float(model(np.array(p), np.array([[p[2], p[3], p[5] if deep else 0.0]]), deep)[0])
        row = (int(pdf["id"].iloc[0]), p[0], p[1], peak, c[0] + p[2], c[1] + p[3], c[2] + (p[5] if deep else 0.0), p[4], p[6] if deep else 0.0, 0 if rounds < 200 else 1, value, corr)
        return pd.DataFrame([row], columns=[x.split()[0] for x in FIT.split(", ")])

    return _windows(df, dots, half, half_z).groupBy("id").applyInPandas(run, FIT)


def log_likelihood(df: DataFrame, dots: DataFrame, sigma: float, bg: float, count: float, half: int = 2) -> DataFrame:
    """(id, loss) of the planar model at fixed parameters, as columns."""
    w = _windows(df, dots, half, 0)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    m: Column = F.lit(bg) + count * F.exp(-0.5 * (dx * dx + dy * dy) / sigma**2) / (2 * math.pi * sigma**2)
    return w.groupBy("id").agg((-F.sum(F.col("v") * F.log(m) - m)).alias("loss"))
