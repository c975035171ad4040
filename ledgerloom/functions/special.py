"""Special functions on numpy arrays, used inside grouped functions and pandas UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

FAMILIES = ("gamma", "weibull", "lognormal")


def _erf(x: np.ndarray) -> np.ndarray:
    return np.array([math.erf(v) for v in np.ravel(x)]).reshape(np.shape(x))


def norm_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + _erf(np.asarray(x, float) / math.sqrt(2.0)))


def digamma(x: float) -> float:
    out = 0.0
    while x < 10.0:
        out -= 1.0 / x
        x += 1.0
    i = 1.0 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10.0:
        out += 1.0 / (x * x)
        x += 1.0
    i = 1.0 / (x * x)
    return out + 1.0 / x + 0.5 * i + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def gamma_p(a: float, x: np.ndarray) -> np.ndarray:
    """Regularized lower incomplete gamma: series below a + 1, continued fraction above."""
    x = np.maximum(np.asarray(x, float), 0.0)
    out = np.zeros_like(x)
    lg = math.lgamma(a)
    low = (x > 0) & (x < a + 1.0)
    if low.any():
        xs = x[low]
        term = np.full_like(xs, 1.0 / a)
        total = term.copy()
        for n in range(1, 2000):
            term = term * xs / (a + n)
            total += term
            if np.all(term <= total * 1e-16):
                break
        out[low] = total * np.exp(-xs + a * np.log(xs) - lg)
    high = x >= a + 1.0
    if high.any():
        xs = x[high]
        b = xs + 1.0 - a
        c = np.full_like(xs, 1e300)
        d = 1.0 / b
        h = d.copy()
        for n in range(1, 2000):
            an = -n * (n - a)
            b = b + 2.0
            d = 1.0 / (an * d + b)
            c = b + an / c
            step = c * d
            h = h * step
            if np.all(np.abs(step - 1.0) < 1e-15):
                break
        out[high] = 1.0 - np.exp(-xs + a * np.log(xs) - lg) * h
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta by continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(0, 500):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + num / (c if abs(c) > 1e-300 else 1e-300)
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def t_two_sided_p(t: float, dof: float) -> float:
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def kolmogorov_p(d: float, n: float) -> float:
    """Asymptotic Kolmogorov tail with the usual small-sample correction."""
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2.0 * sum((-1) ** (j - 1) * math.exp(-2.0 * j * j * x * x) for j in range(1, 101))))


def fit(family: str, x: np.ndarray, k: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood (shape, scale) with location zero from values ``x`` of multiplicity ``k``."""
    n = k.sum()
    lx = np.log(x)
    ml = float((k * lx).sum() / n)
    if family == "lognormal":
        return math.sqrt(max(float((k * (lx - ml) ** 2).sum() / n), 1e-12)), math.exp(ml)
    mean_x = float((k * x).sum() / n)
    if family == "gamma":
        s = max(math.log(mean_x) - ml, 1e-9)
        a = (3.0 - s + math.sqrt((s - 3.0) ** 2 + 24.0 * s)) / (12.0 * s)
        for _ in range(50):
            step = (math.log(a) - digamma(a) - s) / (1.0 / a - trigamma(a))
            new = a - step
            a = new if new > 0 else a / 2.0
            if abs(step) < 1e-12 * a:
                break
        return a, mean_x / a
    sd = math.sqrt(max(float((k * (lx - ml) ** 2).sum() / n), 1e-12))
    c = 1.2825 / sd
    top = lx.max()
    for _ in range(100):
        w = k * np.exp(c * (lx - top))
        sw, swl = w.sum(), (w * lx).sum()
        swll = (w * lx * lx).sum()
        f = swl / sw - 1.0 / c - ml
        df = swll / sw - (swl / sw) ** 2 + 1.0 / (c * c)
        new = c - f / df
        new = new if new > 0 else c / 2.0
        done = abs(new - c) < 1e-12 * c
        c = new
        if done:
            break
    w = k * np.exp(c * (lx - top))
    return c, math.exp(top + math.log(w.sum() / n) / c)


def logpdf(family: str, x: np.ndarray, shape: float, scale: float) -> np.ndarray:
    if family == "gamma":
        return (shape - 1) * np.log(x) - x / scale - math.lgamma(shape) - shape * math.log(scale)
    if family == "weibull":
        z = x / scale
        return math.log(shape / scale) + (shape - 1) * np.log(z) - z**shape
    z = (np.log(x) - math.log(scale)) / shape
    return -np.log(x * shape) - 0.5 * math.log(2 * math.pi) - 0.5 * z * z


def cdf(family: str, x: np.ndarray, shape: float, scale: float) -> np.ndarray:
    if family == "gamma":
        return gamma_p(shape, x / scale)
    if family == "weibull":
        return 1.0 - np.exp(-((x / scale) ** shape))
    return norm_cdf((np.log(x) - math.log(scale)) / shape)


def mean(family: str, shape: float, scale: float) -> float:
    if family == "gamma":
        return shape * scale
    if family == "weibull":
        return scale * math.gamma(1.0 + 1.0 / shape)
    return scale * math.exp(0.5 * shape * shape)


_NORMAL = NormalDist()


def norm_ppf(u: np.ndarray) -> np.ndarray:
    return np.array([_NORMAL.inv_cdf(v) for v in np.ravel(u)]).reshape(np.shape(u))


def ppf(family: str, u: np.ndarray, shape: float, scale: float) -> np.ndarray:
    """Quantiles: closed form for Weibull and lognormal, guarded Newton for gamma."""
    if family == "weibull":
        return scale * (-np.log1p(-u)) ** (1.0 / shape)
    z = norm_ppf(u)
    if family == "lognormal":
        return scale * np.exp(shape * z)
    start = shape * np.maximum(1.0 - 1.0 / (9.0 * shape) + z / (3.0 * math.sqrt(shape)), 1e-3) ** 3
    lo, hi = np.zeros_like(start), np.full_like(start, np.inf)
    x = start
    for _ in range(30):
        f = gamma_p(shape, x) - u
        lo = np.where(f < 0, x, lo)
        hi = np.where(f >= 0, x, hi)
        pdf = np.exp((shape - 1) * np.log(x) - x - math.lgamma(shape))
        step = np.where(pdf > 0, f / np.maximum(pdf, 1e-300), 0.0)
        new = x - step
        outside = (new <= lo) | (new >= hi)
        fallback = np.where(np.isinf(hi), 2.0 * x, 0.5 * (lo + hi))
        new = np.where(outside, fallback, new)
        if np.all(np.abs(new - x) <= 1e-12 * x):
            x = new
            break
        x = new
    return x * scale


def _log_norm_cdf(x: np.ndarray) -> np.ndarray:
    """log of the normal CDF, by its asymptotic tail far to the left."""
    far = x < -30.0
    safe = np.where(far, 0.0, x)
    tail = np.where(far, x, -30.0)
    return np.where(far, -0.5 * tail * tail - np.log(-tail) - 0.5 * math.log(2 * math.pi), np.log(np.maximum(norm_cdf(safe), 1e-300)))


def first_passage_probability(opening: np.ndarray, mu: np.ndarray, sigma: np.ndarray, horizon: float) -> np.ndarray:
    """P(a daily random walk reaches zero within the horizon).

    Closed form for Brownian motion with the barrier moved by 0.5826 sigma, which
    corrects for looking once a day.
    """
    x = opening + 0.5826 * sigma
    s = sigma * math.sqrt(horizon)
    direct = norm_cdf((-x - mu * horizon) / s)
    mirrored = np.exp(np.minimum(0.0, -2.0 * mu * x / sigma**2 + _log_norm_cdf((-x + mu * horizon) / s)))
    return np.where(opening <= 0, 1.0, np.clip(direct + mirrored, 0.0, 1.0))


def first_passage_udf(horizon: float):
    @F.pandas_udf(DoubleType())
    def probability(opening: pd.Series, mu: pd.Series, sigma: pd.Series) -> pd.Series:
        return pd.Series(first_passage_probability(opening.to_numpy(float), mu.to_numpy(float), sigma.to_numpy(float), horizon))

    return probability


# Each call makes its own UDF: a module-level one holds a JVM object after its first use and stops the
# module from being pickled for the fitting functions.
def normal_cdf(x):
    @F.pandas_udf(DoubleType())
    def cdf(x: pd.Series) -> pd.Series:
        return pd.Series(norm_cdf(x.to_numpy(float)))

    return cdf(x)


def welch_p_value(t, dof):
    @F.pandas_udf(DoubleType())
    def p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided_p(a, b) if np.isfinite(a) and np.isfinite(b) else None for a, b in zip(t, dof)])

    return p_value(t, dof)
