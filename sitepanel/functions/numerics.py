"""Small matrix and tail-probability helpers for model-sized (p by p) inputs."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

ALIAS_TOLERANCE = 1e-10


@dataclass
class Swept:
    """Least squares from a cross-product matrix of (predictors, responses)."""

    kept: list[int]
    beta: np.ndarray  # predictors x responses, NaN where aliased
    inverse: np.ndarray  # predictors x predictors, NaN where aliased
    rss: np.ndarray  # responses x responses
    drop: np.ndarray  # predictors x responses, sequential sums of squares
    log_det: float


def sweep(gram: np.ndarray, predictors: int) -> Swept:
    """Sweep the first ``predictors`` rows in order, skipping linearly dependent ones."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    a = gram / np.outer(scale, scale)
    kept, log_det = [], 0.0
    m = gram.shape[0]
    drop = np.full((predictors, m - predictors), np.nan)
    for j in range(predictors):
        pivot = a[j, j]
        if pivot <= ALIAS_TOLERANCE:
            continue
        kept.append(j)
        log_det += math.log(pivot) + 2 * math.log(scale[j])
        row = a[j].copy()
        drop[j] = (row[predictors:] * scale[predictors:]) ** 2 / pivot
        a = a - np.outer(row, row) / pivot
        a[j, :] = a[:, j] = row / pivot
        a[j, j] = -1.0 / pivot
    beta = np.full((predictors, m - predictors), np.nan)
    inverse = np.full((predictors, predictors), np.nan)
    beta[kept] = a[kept, predictors:] * scale[predictors:] / scale[kept][:, None]
    inverse[np.ix_(kept, kept)] = -a[np.ix_(kept, kept)] / np.outer(scale[kept], scale[kept])
    tail = scale[predictors:]
    rss = a[predictors:, predictors:] * np.outer(tail, tail)
    return Swept(kept, beta, inverse, rss, drop, log_det)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float | None:
    if df <= 0 or not math.isfinite(t):
        return None
    return float(incomplete_beta(df / 2, 0.5, df / (df + t * t)))


def f_upper(f: float, df1: float, df2: float) -> float | None:
    if df1 <= 0 or df2 <= 0 or not math.isfinite(f):
        return None
    return float(incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)))


def pretty_breaks(low: float, high: float, cells: int) -> list[float]:
    """About ``cells`` equal intervals on round numbers that cover low to high."""
    if high <= low:
        high = low + max(abs(low), 1.0) * 1e-7
    raw = (high - low) / cells
    base = 10.0 ** math.floor(math.log10(raw))
    # Bias towards wider steps, and towards five times a power of ten.
    bias, bias5 = 1.5, 2.75
    unit = base
    for factor, weight in ((2, bias), (5, bias5), (10, bias)):
        if factor * base - raw < weight * (raw - unit):
            unit = factor * base
        else:
            break
    first = math.floor(low / unit + 1e-7)
    last = math.ceil(high / unit - 1e-7)
    return [k * unit for k in range(first, last + 1)]


def falling_roots(
    slope: Callable[[np.ndarray, np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, rounds: int = 80
) -> np.ndarray:
    """Where each of many functions falls through zero between its ``low`` and ``high``, all in one go (Illinois steps).

    ``slope(which, at)`` gives the values of the functions ``which`` at ``at``;
    a function that doesn't fall in its interval gives NaN.
    """
    low, high = low.astype(float).copy(), high.astype(float).copy()
    every = np.arange(len(low))
    up, down = slope(every, low), slope(every, high)
    falls = (up > 0) & (down <= 0)
    live = np.flatnonzero(falls)
    side = np.zeros(len(low))
    for turn in range(rounds):
        live = live[high[live] - low[live] > 1e-14 * high[live]]
        if not len(live):
            break
        x, y, f, g = low[live], high[live], up[live], down[live]
        point = y - g * (y - x) / (g - f) if turn % 4 < 3 else np.where(x > 0, np.sqrt(x * y), y / 2)
        point = np.clip(point, x + 1e-15 * y, y - 1e-15 * y)
        value = slope(live, point)
        above = value > 0
        low[live], up[live] = np.where(above, point, x), np.where(above, value, f)
        high[live], down[live] = np.where(above, y, point), np.where(above, g, value)
        # an end that stays twice counts half
        down[live] = np.where(above & (side[live] == 1), down[live] / 2, down[live])
        up[live] = np.where(~above & (side[live] == -1), up[live] / 2, up[live])
        side[live] = np.where(above, 1, -1)
    return np.where(falls, 0.5 * (low + high), np.nan)
