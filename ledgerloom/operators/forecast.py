"""Many-series cash-flow forecasting: seasonal naive, walk-forward scoring, conformal intervals.

A series is one business's daily ledger, so every per-series window or group is
bounded by the calendar, not by the number of transactions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import amount, units

SEASON = 7
# Standard normal quantile at 97.5 %: two-sided 95 % intervals.
Z_95 = 1.959963984540054


def last_season(history: DataFrame, value: str) -> DataFrame:
    """Last seven values per series, oldest first, and the lag-7 scale."""
    w = Window.partitionBy("business_id").orderBy("date")
    diffs = history.withColumn("_diff", F.col(value) - F.lag(value, SEASON).over(w))
    latest = F.row_number().over(Window.partitionBy("business_id").orderBy(F.col("date").desc()))
    tagged = diffs.withColumn("_back", latest)
    recent = F.collect_list(F.when(F.col("_back") <= SEASON, F.struct("date", F.col(value).alias("v"))))
    return tagged.groupBy("business_id").agg(
        F.max("date").alias("as_of"),
        F.transform(F.array_sort(recent), lambda s: s["v"]).alias("last_cycle"),
        F.stddev_samp("_diff").alias("scale"),
    )


def seasonal_naive(history: DataFrame, value: str, horizon: int, z: float = Z_95) -> DataFrame:
    """Repeat the last week; half-width z * s * sqrt(h / 7)."""
    h = F.col("h")
    half = z * F.col("scale") * F.sqrt(h / F.lit(float(SEASON)))
    point = F.element_at("last_cycle", ((h - 1) % SEASON + 1).cast("int"))
    return (
        last_season(history, value)
        .withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(
            "business_id",
            "as_of",
            h.cast("long").alias("h"),
            F.date_add("as_of", F.col("h").cast("int")).alias("target_date"),
            point.alias("point"),
            (point - half).alias("lower"),
            (point + half).alias("upper"),
        )
    )


def days_to_zero(path: DataFrame, opening: DataFrame, horizon: int) -> DataFrame:
    """First forecast day on which the balance is at or below zero; NULL if never."""
    upto = Window.partitionBy("business_id").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    walked = path.filter(F.col("h") <= horizon).join(opening, "business_id")
    balance = F.col("opening_balance") + F.sum("point").over(upto)
    return (
        walked.withColumn("balance", balance)
        .groupBy("business_id")
        .agg(
            F.max("opening_balance").alias("opening_balance"),
            F.min(F.when(F.col("balance") <= 0, F.col("h"))).alias("days_to_zero"),
            F.min("balance").alias("lowest_balance"),
        )
    )


def fold_plan(history: DataFrame, horizon: int, n_folds: int, min_train: int | None = None) -> DataFrame:
    """Walk-forward folds anchored at the end of each series; too short -> no rows."""
    need = F.greatest(F.floor(F.col("n") / 2), F.lit(4 * SEASON)) if min_train is None else F.lit(min_train)
    sized = history.groupBy("business_id").agg(F.count(F.lit(1)).alias("n")).withColumn("min_train", need)
    usable = F.col("n") - F.col("min_train")
    k = F.greatest(F.lit(1), F.least(F.lit(n_folds), F.floor(usable / horizon)))
    return (
        sized.filter(usable >= horizon)
        .withColumn("n_folds", k.cast("long"))
        .withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_folds") - 1)))
        .withColumn("test_end", F.col("n") - (F.col("n_folds") - 1 - F.col("fold")) * horizon)
        .withColumn("train_end", F.col("test_end") - horizon)
        .filter(F.col("train_end") >= F.col("min_train"))
        .select("business_id", "fold", "train_end", "test_end")
    )


def too_short(history: DataFrame, horizon: int) -> DataFrame:
    """Series refused by the walk-forward split, with the reason."""
    sized = history.groupBy("business_id").agg(F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.floor(F.col("n") / 2), F.lit(4 * SEASON)) + horizon
    return sized.filter(F.col("n") < need).select(
        "business_id",
        F.concat(F.lit("series too short: need > "), need.cast("string"), F.lit(" points, got "), F.col("n").cast("string")).alias("reject_reason"),
    )


def asof_folds(decisions: DataFrame, horizon: int, n_folds: int) -> DataFrame:
    """The walk-forward folds of every decision date, from how many history rows it has (history_rows is the last one's number)."""
    sized = decisions.select("business_id", "as_of", (F.col("history_rows") + 1).alias("n")).withColumn("min_train", F.greatest(F.floor(F.col("n") / 2), F.lit(4 * SEASON)))
    usable = F.col("n") - F.col("min_train")
    k = F.greatest(F.lit(1), F.least(F.lit(n_folds), F.floor(usable / horizon))).cast("long")
    folds = sized.filter(usable >= horizon).withColumn("k", k).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    end = F.col("n") - (F.col("k") - 1 - F.col("fold")) * horizon
    return folds.select("business_id", "as_of", "fold", (end - horizon).alias("train_end"), end.alias("test_end"), "min_train").filter("train_end >= min_train").drop("min_train")


def naive_residuals(history: DataFrame, folds: DataFrame, value: str, horizon: int, keys: Sequence[str] = ("business_id",)) -> DataFrame:
    """Held-out residual and scale of the seasonal naive model per (series, fold, h).

    ``keys`` may hold as_of, when the folds are those of many decision dates of one history.
    The training scale is a running lag-7 standard deviation, so all folds share one
    pass; the fold's forecast is a lookup 7 * ceil(h / 7) rows back.
    """
    w = Window.partitionBy("business_id").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        history.withColumn("idx", F.row_number().over(w).cast("long") - 1)
        .withColumn("_diff", F.col(value) - F.lag(value, SEASON).over(w))
        .withColumn("s", F.stddev_samp("_diff").over(upto))
        .select("business_id", "idx", "date", F.col(value).alias("v"), "s")
    )
    cells = folds.withColumn("h", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))
    target = cells.withColumn("idx", F.col("train_end") + F.col("h") - 1)
    actual = target.join(rows.select("business_id", "idx", F.col("v").alias("actual"), "date"), ["business_id", "idx"])
    source_idx = F.col("train_end") - SEASON + (F.col("h") - 1) % SEASON
    guess = rows.select("business_id", F.col("idx").alias("src"), F.col("v").alias("predicted"))
    scale = rows.select("business_id", (F.col("idx") + 1).alias("train_end"), "s")
    return (
        actual.withColumn("src", source_idx)
        .join(guess, ["business_id", "src"])
        .join(scale, ["business_id", "train_end"])
        .select(
            *keys,
            F.lit("seasonal_naive").alias("model"),
            "fold",
            "h",
            "date",
            "actual",
            "predicted",
            (F.col("actual") - F.col("predicted")).alias("residual"),
            (F.col("s") * F.sqrt(F.col("h") / F.lit(float(SEASON)))).alias("scale"),
        )
    )


def rmse(actual: Column | str, predicted: Column | str) -> Column:
    a, p = (F.col(x) if isinstance(x, str) else x for x in (actual, predicted))
    return F.sqrt(F.avg(F.pow(a - p, F.lit(2.0))))


def mape(actual: Column | str, predicted: Column | str, eps: float = 1e-8) -> Column:
    a, p = (F.col(x) if isinstance(x, str) else x for x in (actual, predicted))
    return F.avg(F.abs((a - p) / F.greatest(F.abs(a), F.lit(eps)))) * 100.0


def fold_scores(residuals: DataFrame) -> DataFrame:
    """RMSE and MAPE of every fold, then their means; every fold is kept."""
    per_fold = residuals.groupBy("business_id", "model", "fold").agg(
        rmse("actual", "predicted").alias("rmse"), mape("actual", "predicted").alias("mape")
    )
    return per_fold


def model_scores(per_fold: DataFrame) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("fold", "rmse"))), lambda s: s["rmse"])
    return per_fold.groupBy("business_id", "model").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("rmse").alias("mean_rmse"),
        F.avg("mape").alias("mean_mape"),
        listed.alias("fold_rmses"),
    )


def select_model(scores: DataFrame, models: list[str]) -> DataFrame:
    """Lowest mean RMSE wins; a model that could not be fitted stays with infinite scores."""
    spark = scores.sparkSession
    wanted = spark.createDataFrame([(m, i) for i, m in enumerate(models)], "model string, model_no long")
    grid = scores.select("business_id").distinct().crossJoin(F.broadcast(wanted))
    inf = F.lit(float("inf"))
    ranked = grid.join(scores, ["business_id", "model"], "left").select(
        "business_id",
        "model",
        "model_no",
        F.coalesce("n_folds", F.lit(0)).alias("n_folds"),
        F.coalesce("mean_rmse", inf).alias("mean_rmse"),
        F.coalesce("mean_mape", inf).alias("mean_mape"),
    )
    w = Window.partitionBy("business_id").orderBy("mean_rmse", "model_no")
    return ranked.withColumn("place", F.row_number().over(w).cast("long")).withColumn(
        "selected", (F.col("place") == 1) & (F.col("mean_rmse") < inf)
    )


SERIES = ("business_id", "model")


def scale_profile(residuals: DataFrame, floor: float = 1e-9, keys: Sequence[str] = SERIES) -> DataFrame:
    """a * h^gamma through the RMS residual per horizon; gamma clipped to [0, 1], a kept."""
    per_h = residuals.groupBy(*keys, "h").agg(
        F.greatest(F.sqrt(F.avg(F.pow("residual", F.lit(2.0)))), F.lit(floor)).alias("rms")
    )
    x, y = F.log(F.col("h").cast("double")), F.log("rms")
    fitted = per_h.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_h"),
        F.avg("rms").alias("flat"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("icpt"),
    )
    short = F.col("n_h") < 3
    return fitted.select(
        *keys,
        "n_h",
        F.when(short, F.col("flat")).otherwise(F.exp("icpt")).alias("a"),
        F.when(short, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("slope")))).alias("gamma"),
    )


def conformal_multiplier(scored: DataFrame, confidence: float = 0.95, keys: Sequence[str] = SERIES) -> DataFrame:
    """Split-conformal multiplier from (residual, scale) rows pooled per series and model.

    Scores per series number folds * horizon, a design constant, so the rank window is small.
    """
    ok = F.col("residual").isNotNull() & ~F.isnan("residual") & (F.col("scale") > 0) & (F.abs("residual") < float("inf"))
    scores = scored.filter(ok).withColumn("score", F.abs("residual") / F.col("scale"))
    w = Window.partitionBy(*keys).orderBy("score")
    ranked = scores.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    rank = F.ceil((F.col("_n") + 1) * F.lit(confidence))
    hit = F.least(rank, F.col("_n")) == F.col("_r")
    found = ranked.filter(hit).select(
        *keys,
        F.col("score").alias("q_hat"),
        F.col("_n").alias("n_scores"),
        rank.alias("rank"),
        (rank <= F.col("_n")).alias("achieved"),
    )
    every = scored.select(*keys).distinct().join(found, list(keys), "left")
    return every.select(
        *keys,
        F.coalesce("q_hat", F.lit(1.0)).alias("q_hat"),
        F.coalesce("n_scores", F.lit(0)).alias("n_scores"),
        F.coalesce("rank", F.lit(0)).alias("rank"),
        F.coalesce("achieved", F.lit(False)).alias("achieved"),
        F.when(F.coalesce("achieved", F.lit(False)), F.col("q_hat") / Z_95).otherwise(1.0).alias("scale_ratio"),
    )


def profile_scored(residuals: DataFrame, profile: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Residuals with the fitted power-law scale in place of the model's own."""
    return residuals.drop("scale").join(profile, list(keys)).withColumn(
        "scale", F.col("a") * F.pow(F.col("h").cast("double"), F.col("gamma"))
    )


def conformal_interval(point: Column, scale: Column, q_hat: Column) -> tuple[Column, Column]:
    return point - q_hat * scale, point + q_hat * scale


def conformal_forecast(path: DataFrame, profile: DataFrame, multiplier: DataFrame) -> DataFrame:
    """point +- q_hat * a * h^gamma for models without a scale of their own."""
    joined = path.join(profile.select("business_id", "a", "gamma"), "business_id").join(
        multiplier.select("business_id", "q_hat"), "business_id"
    )
    scale = F.col("a") * F.pow(F.col("h").cast("double"), F.col("gamma"))
    lower, upper = conformal_interval(F.col("point"), scale, F.col("q_hat"))
    return joined.select("business_id", "h", "target_date", "point", lower.alias("lower"), upper.alias("upper"))


def sigma_from_interval(lower: Column, upper: Column, z: float = Z_95) -> Column:
    return F.abs(upper - lower) / (2.0 * z)


BANDS = ((1, 7), (8, 14), (15, 30), (31, 45), (46, 60), (61, 75), (76, 90))


def interval_coverage(forecasts: DataFrame, actuals: DataFrame, nominal: float = 0.95) -> DataFrame:
    """Coverage and mean width, pooled and per horizon band; targets without an actual are skipped.

    ``forecasts`` needs business_id, target_date, h, lower, upper; ``actuals`` business_id, date, actual.
    """
    cells = forecasts.join(
        actuals.withColumnRenamed("date", "target_date"), ["business_id", "target_date"]
    )
    band = F.coalesce(*[F.when(F.col("h").between(a, b), F.lit(f"{a:02d}-{b:02d}")) for a, b in BANDS])
    inside = (F.col("actual") >= F.col("lower")) & (F.col("actual") <= F.col("upper"))
    agg = (
        cells.withColumn("band", band)
        .rollup("band")
        .agg(
            F.grouping("band").alias("_all"),
            F.count(F.lit(1)).alias("n"),
            F.avg(inside.cast("double")).alias("coverage"),
            F.avg(F.col("upper") - F.col("lower")).alias("mean_width"),
        )
        .filter((F.col("_all") == 1) | F.col("band").isNotNull())
        .withColumn("band", F.when(F.col("_all") == 1, F.lit("pooled")).otherwise(F.col("band")))
    )
    gap = F.col("coverage") - nominal
    verdict = (
        F.when(F.abs(gap) <= 0.05, "well calibrated").when(gap < 0, "overconfident").otherwise("underconfident")
    )
    return agg.drop("_all").withColumn("verdict", verdict)


def decompose(history: DataFrame, value: str) -> DataFrame:
    """Centred 7-day moving average, phase means, remainder; edges use what is there."""
    near = Window.partitionBy("business_id").orderBy("date").rowsBetween(-3, 3)
    phase = F.pmod(F.datediff("date", F.lit("1970-01-01").cast("date")), F.lit(SEASON))
    base = (
        history.withColumn("phase", phase.cast("long"))
        .withColumn("trend", amount(F.sum(units(value)).over(near)) / F.count(F.lit(1)).over(near))
        .withColumn("detrended", F.col(value) - F.col("trend"))
    )
    per_phase = Window.partitionBy("business_id", "phase")
    per_series = Window.partitionBy("business_id")
    centred = base.withColumn("phase_mean", F.avg("detrended").over(per_phase)).withColumn(
        "seasonal", F.col("phase_mean") - F.avg("detrended").over(per_series)
    )
    return centred.select(
        "business_id", "date", F.col(value).alias("value"), "trend", "seasonal",
        (F.col(value) - F.col("trend") - F.col("seasonal")).alias("residual"),
    )


def variance_shares(parts: DataFrame) -> DataFrame:
    """Shares of component variance (they sum to one) and the seasonality verdict."""
    v = parts.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.var_pop("seasonal").alias("vs"), F.var_pop("trend").alias("vt"), F.var_pop("residual").alias("vr"),
    ).filter(F.col("n") >= 2 * SEASON)
    total = F.col("vs") + F.col("vt") + F.col("vr")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(0.0)
    s = share("vs")
    verdict = F.when(s > 0.30, "strongly seasonal").when(s > 0.10, "moderately seasonal").otherwise("weakly seasonal")
    return v.select(
        "business_id", s.alias("seasonal_share"), share("vt").alias("trend_share"),
        share("vr").alias("residual_share"), verdict.alias("verdict"),
    )


def compare_periods(rows: DataFrame, keys: list[str], value: str, is_post: Column) -> DataFrame:
    """Welch comparison of two periods: means, t, degrees of freedom, Cohen's d.

    The p-value is added by ``welch_p_value`` because it needs the incomplete beta function.
    """
    pre, post = F.when(~is_post, F.col(value)), F.when(is_post, F.col(value))
    m = rows.groupBy(*keys).agg(
        F.count(pre).alias("n_pre"), F.count(post).alias("n_post"),
        F.avg(pre).alias("pre_mean"), F.avg(post).alias("post_mean"),
        F.var_samp(pre).alias("va"), F.var_samp(post).alias("vb"),
    )
    sa, sb = F.col("va") / F.col("n_pre"), F.col("vb") / F.col("n_post")
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2.0)
    diff = F.col("post_mean") - F.col("pre_mean")
    return m.select(
        *keys, "n_pre", "n_post", "pre_mean", "post_mean", diff.alias("difference"),
        ((F.col("pre_mean") - F.col("post_mean")) / F.sqrt(sa + sb)).alias("t_statistic"),
        (F.pow(sa + sb, F.lit(2.0)) / (sa * sa / (F.col("n_pre") - 1) + sb * sb / (F.col("n_post") - 1))).alias("dof"),
        F.when(pooled > 0, diff / pooled).otherwise(0.0).alias("cohens_d"),
    )
