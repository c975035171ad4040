"""Fitted forecasters, one series (and fold) per group: damped Holt-Winters and seasonal AR.

A group is one business's daily history, bounded by the calendar; thousands of series and
folds are fitted in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEASON = 7


def _hw_run(y: np.ndarray, a: float, b: float, g: float, phi: float):
    m = SEASON
    level, trend = y[:m].mean(), (y[m:2 * m].mean() - y[:m].mean()) / m
    season = list(y[:m] - level)
    err = np.empty(len(y))
    for t in range(len(y)):
        s = season[t % m]
        fit = level + phi * trend + s
        e = y[t] - fit
        err[t] = e
        new = level + phi * trend + a * e
        trend = phi * trend + a * b * e
        level = new
        season[t % m] = s + g * (1 - a) * e
    return err, level, trend, season


def holt_winters(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Additive damped trend, additive weekly season; coarse grid, then coordinate search."""
    sse = lambda p: float((_hw_run(y, *p)[0][SEASON:] ** 2).sum())
    best = min(((a, b, g, 0.95) for a in (0.05, 0.2, 0.5) for b in (0.01, 0.1) for g in (0.05, 0.2)), key=sse)
    low, high = (0.001, 0.0001, 0.0001, 0.8), (0.999, 0.999, 0.999, 0.995)
    now, step = sse(best), 0.5
    for _ in range(4):
        for i in range(4):
            for f in (1 - step, 1 + step):
                v = min(max(best[i] * f, low[i]), high[i])
                trial = (*best[:i], v, *best[i + 1:])
                s = sse(trial)
                if s < now:
                    best, now = trial, s
        step /= 2
    err, level, trend, season = _hw_run(y, *best)
    h = np.arange(1, horizon + 1)
    damp = np.cumsum(best[3] ** h)
    point = level + damp * trend + np.array([season[(len(y) + k - 1) % SEASON] for k in h])
    return point, np.std(err, ddof=1) * np.sqrt(h)


def seasonal_ar(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Least squares on lags 1, 7, 8 and a constant; scale from the psi weights of the recursion."""
    lags = (1, 7, 8)
    n0 = max(lags)
    x = np.column_stack([np.ones(len(y) - n0), *[y[n0 - k:len(y) - k] for k in lags]])
    t = y[n0:]
    coef = np.linalg.lstsq(x, t, rcond=None)[0]
    s = np.std(t - x @ coef, ddof=len(coef))
    path, psi = list(y), [1.0]
    for h in range(1, horizon + 1):
        path.append(coef[0] + sum(c * path[-k] for c, k in zip(coef[1:], lags)))
        if h < horizon:
            psi.append(sum(c * psi[h - k] for c, k in zip(coef[1:], lags) if h - k >= 0))
    return np.array(path[-horizon:]), s * np.sqrt(np.cumsum(np.square(psi)))


def seasonal_naive(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.arange(1, horizon + 1)
    s = np.std(y[SEASON:] - y[:-SEASON], ddof=1)
    return y[-SEASON:][(h - 1) % SEASON], s * np.sqrt(h / SEASON)


Forecaster = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]
# name -> (forecaster, keeps its own scale)
FORECASTERS: Mapping[str, tuple[Forecaster, bool]] = {
    "seasonal_naive": (seasonal_naive, False), "holt_winters": (holt_winters, False), "seasonal_ar": (seasonal_ar, True),
}


#: Fewest days that a forecaster is fitted on.
LEAST_DAYS = 4 * SEASON


def _fitted(y: np.ndarray, horizon: int, model: str) -> tuple[np.ndarray, np.ndarray, str | None]:
    """(point, scale, why there is none) of one model on one series."""
    if len(y) < LEAST_DAYS:
        return np.empty(0), np.empty(0), f"{len(y)} days; need >= {LEAST_DAYS}"
    try:
        point, scale = FORECASTERS[model][0](y, horizon)
    except (ValueError, np.linalg.LinAlgError) as e:
        return np.empty(0), np.empty(0), f"fit failed: {e}"
    if not (np.isfinite(point).all() and np.isfinite(scale).all()):
        return np.empty(0), np.empty(0), "fit failed: values are not finite"
    return point, scale, None


def routed_forecast(history: DataFrame, routes: DataFrame, value: str, horizon: int) -> DataFrame:
    """(business_id, model, h, point, scale, reason): each series forecast by the model that ``routes`` names for it.

    A series that the model cannot fit is one row with the reason and no h.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = pdf["model"].iloc[0]
        point, scale, reason = _fitted(pdf.sort_values("date")[value].to_numpy(float), horizon, model)
        n = len(point)
        h = pd.array(np.arange(1, n + 1) if n else [None], dtype="Int64")
        return pd.DataFrame({"business_id": pdf["business_id"].iloc[0], "model": model, "h": h, "point": point if n else [np.nan], "scale": scale if n else [np.nan], "reason": reason})

    rows = history.select("business_id", "date", value).join(routes.select("business_id", "model"), "business_id")
    out = rows.groupBy("business_id", "model").applyInPandas(run, "business_id long, model string, h long, point double, scale double, reason string")
    return out.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("point", "scale")})


def forecast(history: DataFrame, value: str, horizon: int, model: str) -> DataFrame:
    """(business, h, point, scale, model) of one model fitted on whole histories; series it cannot fit have no row here."""
    routes = history.select("business_id").distinct().withColumn("model", F.lit(model))
    return routed_forecast(history, routes, value, horizon).filter("reason is null").select("business_id", "h", "point", "scale", "model")


def fold_outcomes(history: DataFrame, folds: DataFrame, value: str, horizon: int, model: str) -> DataFrame:
    """Held-out residuals of a fitted model, every (series, fold) its own group; a fold that fails is one row with the reason."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        cut, end = int(pdf["train_end"].iloc[0]), int(pdf["test_end"].iloc[0])
        y = pdf[value].to_numpy(float)
        point, scale, reason = _fitted(y[:cut], end - cut, model)
        one = {"business_id": pdf["business_id"].iloc[0], "fold": pdf["fold"].iloc[0], "reason": reason}
        if reason:
            return pd.DataFrame([one | {"h": 0, "actual": np.nan, "predicted": np.nan, "residual": np.nan, "scale": np.nan}])
        actual = y[cut:end]
        return pd.DataFrame(one | {"h": np.arange(1, end - cut + 1), "actual": actual, "predicted": point, "residual": actual - point, "scale": scale})

    grid = folds.join(history.select("business_id", "date", value), "business_id")
    schema = "business_id long, fold long, h long, actual double, predicted double, residual double, scale double, reason string"
    return grid.groupBy("business_id", "fold").applyInPandas(run, schema).withColumn("model", F.lit(model))


def fold_residuals(history: DataFrame, folds: DataFrame, value: str, horizon: int, model: str) -> DataFrame:
    """The held-out residuals alone."""
    return fold_outcomes(history, folds, value, horizon, model).filter("reason is null").drop("reason")
