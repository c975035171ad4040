"""Select a model for each series, forecast with it, and give it its own interval; failures are rows.

Every candidate is scored on the same walk-forward folds.  A candidate that fails on a fold keeps an
infinite score and its reason.  The champion table routes each series to one model, the residuals of
that model alone calibrate its interval, and a series without a champion is one row with the reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import forecast, forecast_models
from ledgerloom.session import cut_lineage

NAIVE = "seasonal_naive"


def candidate_outcomes(history: DataFrame, folds: DataFrame, value: str, horizon: int, models: Sequence[str]) -> DataFrame:
    """Held-out residuals of every model, and a row with a reason for each fold that failed."""
    out = None
    for model in models:
        if model == NAIVE:
            part = forecast.naive_residuals(history, folds, value, horizon).drop("date").withColumn("reason", F.lit(None).cast("string"))
        else:
            part = forecast_models.fold_outcomes(history, folds, value, horizon, model)
        out = part if out is None else out.unionByName(part)
    return out


def champions(history: DataFrame, outcomes: DataFrame, folds: DataFrame, horizon: int, models: Sequence[str]) -> DataFrame:
    """(business_id, model, mean_rmse, n_folds, place, reason) of every candidate of every series; place 1 with no reason is the champion.

    A series too short for a fold has its candidates with that reason; a failed fold makes a score infinite.
    """
    spark = history.sparkSession
    scored = outcomes.filter("reason is null").groupBy("business_id", "model", "fold").agg(forecast.rmse("actual", "predicted").alias("rmse"))
    scores = scored.groupBy("business_id", "model").agg(F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("n_folds"))
    failed = outcomes.filter("reason is not null").groupBy("business_id", "model").agg(F.min("reason").alias("failed"), F.count(F.lit(1)).alias("n_failed"))
    wanted = spark.createDataFrame([(m, i) for i, m in enumerate(models)], "model string, model_no long")
    grid = history.select("business_id").distinct().crossJoin(F.broadcast(wanted))
    refused = forecast.too_short(history, horizon).withColumnRenamed("reject_reason", "refused")
    rows = grid.join(scores, ["business_id", "model"], "left").join(failed, ["business_id", "model"], "left").join(refused, "business_id", "left")
    reason = F.coalesce("refused", "failed", F.when(F.col("rmse").isNull(), F.lit("no fold was scored")))
    rows = rows.withColumn("reason", reason).withColumn("mean_rmse", F.when(reason.isNull(), F.col("rmse")).otherwise(float("inf")))
    place = F.row_number().over(Window.partitionBy("business_id").orderBy("mean_rmse", "model_no"))
    return rows.select("business_id", "model", "mean_rmse", F.coalesce("n_folds", F.lit(0)).alias("n_folds"), place.cast("long").alias("place"), "reason")


def champion_forecast(
    history: DataFrame, value: str, horizon: int, cv_horizon: int, n_folds: int, models: Sequence[str] = tuple(forecast_models.FORECASTERS), confidence: float = 0.95
) -> DataFrame:
    """One table for every series: business_id, model, mean_rmse, h, target_date, point, lower, upper, or a reason.

    Models with a scale of their own keep its shape; the others get a power of the horizon fitted on their residuals.
    """
    keys = list(forecast.SERIES)
    history = cut_lineage(history.select("business_id", "date", value))
    folds = cut_lineage(forecast.fold_plan(history, cv_horizon, n_folds))
    outcomes = cut_lineage(candidate_outcomes(history, folds, value, cv_horizon, models))
    table = cut_lineage(champions(history, outcomes, folds, cv_horizon, models))
    best = table.filter("place = 1")
    chosen = best.filter("reason is null").select("business_id", "model", "mean_rmse")
    residuals = outcomes.filter("reason is null").join(chosen.select(*keys), keys, "left_semi")
    profile = cut_lineage(forecast.scale_profile(residuals))
    own = [m for m in models if m != NAIVE and forecast_models.FORECASTERS[m][1]]
    scaled = residuals.join(profile, keys).withColumn("scale", F.when(F.col("model").isin(*own) if own else F.lit(False), F.col("scale")).otherwise(F.col("a") * F.pow(F.col("h").cast("double"), F.col("gamma"))))
    q = forecast.conformal_multiplier(scaled, confidence).select(*keys, "q_hat")
    naive = forecast.seasonal_naive(history.join(chosen.filter(F.col("model") == NAIVE), "business_id", "left_semi"), value, horizon)
    paths = naive.select("business_id", F.lit(NAIVE).alias("model"), "h", "point", F.lit(None).cast("double").alias("scale"), F.lit(None).cast("string").alias("reason"))
    if any(m != NAIVE for m in models):
        paths = paths.unionByName(forecast_models.routed_forecast(history, chosen.filter(F.col("model") != NAIVE), value, horizon))
    last = history.groupBy("business_id").agg(F.max("date").alias("last_day"))
    joined = paths.join(chosen, keys).join(profile.select(*keys, "a", "gamma"), keys).join(q, keys).join(last, "business_id")
    scale = F.when(F.col("model").isin(*own) if own else F.lit(False), F.col("scale")).otherwise(F.col("a") * F.pow(F.col("h").cast("double"), F.col("gamma")))
    lower, upper = forecast.conformal_interval(F.col("point"), scale, F.col("q_hat"))
    found = joined.select("business_id", "model", "mean_rmse", "h", F.date_add("last_day", F.col("h").cast("int")).alias("target_date"), "point", lower.alias("lower"), upper.alias("upper"), "reason")
    # No candidate could be scored: the reasons of all of them, each once.
    why = table.join(best.filter("reason is not null").select("business_id"), "business_id", "left_semi").groupBy("business_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    return found.unionByName(why.select("business_id", none("model", "string"), none("mean_rmse", "double"), none("h", "long"), none("target_date", "date"), none("point", "double"), none("lower", "double"), none("upper", "double"), "reason"))
