"""Fitted models and streaming replays."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import credit, credit_models, forecast, forecast_models
from ledgerloom.plans.base_sql import cte, twin
from ledgerloom.plans.credit_queries import features
from ledgerloom.plans.forecast_queries import CV_HORIZON, N_FOLDS, VALUE
from ledgerloom.plans.registry import query, shown
from ledgerloom.plans.views import history_table
from ledgerloom.session import cut_lineage, ensure_checkpoint_dir
from ledgerloom.streaming import jobs

ROUNDS = 200


def split(spark, sf):
    s = cut_lineage(credit_models.stratified_split(features(spark, sf)))
    return s.filter("is_train"), s.filter("NOT is_train")


@query("logistic_scores")
def logistic_scores(spark, sf):
    train, test = split(spark, sf)
    scaler, model = credit_models.fit_logistic(train)
    return shown(credit_models.score_logistic(test, scaler, model).select("business_id", "counterparty_id", "invoice_id", "label", "score"))


@query("logistic_attribution")
def logistic_attribution(spark, sf):
    train, test = split(spark, sf)
    scaler, model = credit_models.fit_logistic(train)
    rows = credit.linear_attribution(credit_models.score_logistic(test, scaler, model), scaler, credit_models.wald_intervals(train, scaler, model))
    return rows.select("invoice_id", credit.rationale(F.col("score"), "contributions").alias("rationale"))


@query("boosted_trees")
def boosted_trees(spark, sf):
    train, test = split(spark, sf)
    return shown(credit_models.score_boosted(test, credit_models.fit_boosted(train, rounds=ROUNDS)).select("invoice_id", "label", "score"))


@query("occlusion_attribution")
def occlusion_attribution(spark, sf):
    train, test = split(spark, sf)
    model = credit_models.fit_boosted(train, rounds=ROUNDS)
    means = {f: m for f, (m, _) in credit_models.standard_scaler(train).items()}
    return shown(credit_models.occlusion(test, model, means))


@query("model_comparison")
def model_comparison(spark, sf):
    train, test = split(spark, sf)
    scaler, model = credit_models.fit_logistic(train)
    named = lambda d, n: d.select(F.lit(n).alias("model"), "score", "label")
    scores = (
        named(credit.rule_score(test), "rules").unionByName(named(credit_models.score_logistic(test, scaler, model), "logistic"))
        .unionByName(named(credit_models.score_boosted(test, credit_models.fit_boosted(train, rounds=ROUNDS)), "boosted"))
    )
    return shown(credit.lift_over_baseline(credit.roc_auc(cut_lineage(scores), ["model"]), "rules"))


@query("holt_winters_forecast")
def holt_winters_forecast(spark, sf):
    return shown(forecast_models.forecast(cut_lineage(history_table(spark, sf)), VALUE, 90, "holt_winters"))


@query("seasonal_ar_forecast")
def seasonal_ar_forecast(spark, sf):
    return shown(forecast_models.forecast(cut_lineage(history_table(spark, sf)), VALUE, 90, "seasonal_ar"))


@query("model_selection")
def model_selection(spark, sf):
    """Walk-forward scores of the three forecasters and the winner per business."""
    hist = cut_lineage(history_table(spark, sf))
    folds = cut_lineage(forecast.fold_plan(hist, CV_HORIZON, N_FOLDS))
    parts = [forecast_models.fold_residuals(hist, folds, VALUE, CV_HORIZON, m) for m in forecast_models.FORECASTERS]
    resid = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return shown(forecast.select_model(cut_lineage(forecast.model_scores(forecast.fold_scores(resid))), list(forecast_models.FORECASTERS)))


def folder(spark):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


CENTS = "CAST(round(value * 100) AS BIGINT)"


@query("stream_deduplicated_ledger", "SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events")
def stream_deduplicated_ledger(spark, sf):
    """Two overlapping pulls of the same events are posted once."""
    pull = lambda: jobs.event_stream(spark, sf).select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return jobs.run_to_table(jobs.deduplicated(pull().unionByName(pull()), ["event_id"], "ts"), folder(spark)).drop("ts")


@query("stream_daily_totals", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def stream_daily_totals(spark, sf):
    e = jobs.event_stream(spark, sf).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return shown(jobs.run_to_keyed_table(jobs.daily_totals(e, "ts", ["user_id"], "c"), folder(spark), ["day", "user_id"]))


cte("call_seq", "SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events")
_IN_WINDOW = "list_filter(c.times, lambda x: x > s.ts - INTERVAL 7 DAY)"
cte(
    "call_walk",
    f"""SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BOOLEAN AS accepted, []::TIMESTAMP[] AS times FROM call_seq
UNION ALL SELECT c.user_id, s.k, s.event_id, len({_IN_WINDOW}) < 20, CASE WHEN len({_IN_WINDOW}) < 20 THEN list_append({_IN_WINDOW}, s.ts) ELSE {_IN_WINDOW} END
FROM call_walk c JOIN call_seq s ON s.user_id = c.user_id AND s.k = c.k + 1""",
    "call_seq",
)


@query("stream_call_budget", twin("SELECT user_id, event_id, accepted, CAST(len(times) AS BIGINT) AS used FROM call_walk WHERE k > 0", "call_walk"))
def stream_call_budget(spark, sf):
    return jobs.run_to_table(jobs.call_budget(jobs.event_stream(spark, sf), "user_id", "ts", 20, 7), folder(spark))
