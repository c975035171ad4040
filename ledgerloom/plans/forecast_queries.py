"""Forecasts, walk-forward scores, conformal intervals, seasonality."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerloom.functions import special
from ledgerloom.operators import champion, forecast
from ledgerloom.plans.base_sql import AS_OF, CTES, HORIZON, cte, twin
from ledgerloom.plans.registry import query, shown
from ledgerloom.session import cut_lineage
from ledgerloom.plans.views import history_table, ledger_table, naive_path

CV_HORIZON = 14
N_FOLDS = 5
VALUE = "net_ex_receipts"

cte("numbered", "SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY date) - 1 AS idx FROM hist", "hist")
cte(
    "folds",
    f"""
SELECT business_id, fold, n - (k - 1 - fold) * {CV_HORIZON} - {CV_HORIZON} AS train_end FROM (
  SELECT business_id, n, mt, k, unnest(generate_series(0, k - 1)) AS fold FROM (
    SELECT business_id, n, mt, greatest(1, least({N_FOLDS}, (n - mt) // {CV_HORIZON})) AS k FROM (
      SELECT business_id, count(*) AS n, greatest(count(*) // 2, 28) AS mt FROM hist GROUP BY 1) WHERE n - mt >= {CV_HORIZON}))
WHERE n - (k - 1 - fold) * {CV_HORIZON} - {CV_HORIZON} >= mt
""",
    "hist",
)
cte(
    "fold_scale",
    """
SELECT f.business_id, f.fold, stddev_samp(a.y - b.y) AS s
FROM folds f JOIN numbered a ON a.business_id = f.business_id AND a.idx < f.train_end
JOIN numbered b ON b.business_id = a.business_id AND b.idx = a.idx - 7 GROUP BY 1, 2
""",
    "folds",
    "numbered",
)
cte(
    "resid",
    f"""
SELECT f.business_id, f.fold, g.h, a.date, a.y AS actual, p.y AS predicted, a.y - p.y AS residual, s.s * sqrt(g.h / 7.0::DOUBLE) AS scale
FROM folds f CROSS JOIN (SELECT unnest(generate_series(1, {CV_HORIZON})) AS h) g
JOIN numbered a ON a.business_id = f.business_id AND a.idx = f.train_end + g.h - 1
JOIN numbered p ON p.business_id = f.business_id AND p.idx = f.train_end - 7 + (g.h - 1) % 7
JOIN fold_scale s ON s.business_id = f.business_id AND s.fold = f.fold
""",
    "folds",
    "fold_scale",
)
cte(
    "profile",
    """
SELECT business_id, count(*) AS n_h, exp(regr_intercept(ln(rms), ln(h))) AS a, greatest(0.0, least(1.0, regr_slope(ln(rms), ln(h)))) AS gamma
FROM (SELECT business_id, h, greatest(sqrt(avg(residual * residual)), 1e-9) AS rms FROM resid GROUP BY 1, 2) GROUP BY 1
""",
    "resid",
)
cte(
    "scores",
    """SELECT r.business_id, abs(residual) / (p.a * pow(r.h, p.gamma)) AS score FROM resid r JOIN profile p ON p.business_id = r.business_id""",
    "resid",
    "profile",
)
cte(
    "qhat",
    """
SELECT business_id, n AS n_scores, rank, rank <= n AS achieved, list_extract(sc, least(rank, n)) AS q_hat,
  CASE WHEN rank <= n THEN list_extract(sc, least(rank, n)) / 1.959963984540054 ELSE 1.0 END AS scale_ratio
FROM (SELECT business_id, count(*) AS n, CAST(ceil((count(*) + 1) * 0.95) AS BIGINT) AS rank, list(score ORDER BY score) AS sc FROM scores GROUP BY 1)
""",
    "scores",
)


def naive_cv(spark, sf):
    hist = cut_lineage(history_table(spark, sf))
    folds = forecast.fold_plan(hist, CV_HORIZON, N_FOLDS)
    return hist, forecast.naive_residuals(hist, folds, VALUE, CV_HORIZON)


@query(
    "seasonal_naive_forecast",
    twin(
        f"""SELECT business_id, CAST(DATE '{AS_OF}' AS VARCHAR) AS as_of, h, CAST(DATE '{AS_OF}' + CAST(h AS INTEGER) AS VARCHAR) AS target_date,
  round(point, 4) AS point, round(point - half, 4) AS lower, round(point + half, 4) AS upper FROM naive_path""",
        "naive_path",
    ),
)
def seasonal_naive_forecast(spark, sf):
    return shown(naive_path(history_table(spark, sf)), digits=4)


@query(
    "walk_forward_residuals",
    twin(
        """SELECT business_id, 'seasonal_naive' AS model, fold, h, CAST(date AS VARCHAR) AS date, round(actual, 4) AS actual, round(predicted, 4) AS predicted,
  round(residual, 4) AS residual, round(scale, 4) AS scale FROM resid""",
        "resid",
    ),
)
def walk_forward_residuals(spark, sf):
    return shown(naive_cv(spark, sf)[1], digits=4)


@query(
    "walk_forward_rmse",
    twin(
        """SELECT business_id, 'seasonal_naive' AS model, count(*) AS n_folds, round(avg(rmse), 4) AS mean_rmse, round(log10(1 + avg(mape)), 6) AS log10_mape,
  string_agg(CAST(CAST(round(rmse) AS BIGINT) AS VARCHAR), ',' ORDER BY fold) AS fold_rmses
FROM (SELECT business_id, fold, sqrt(avg(residual * residual)) AS rmse, avg(abs(residual / greatest(abs(actual), 1e-8))) * 100 AS mape FROM resid GROUP BY 1, 2)
GROUP BY 1""",
        "resid",
    ),
)
def walk_forward_rmse(spark, sf):
    s = forecast.model_scores(forecast.fold_scores(naive_cv(spark, sf)[1]))
    text = F.array_join(F.transform("fold_rmses", lambda v: F.round(v).cast("long").cast("string")), ",")
    # A day without trade has a floored denominator, so the percentage is shown on a log scale.
    s = s.withColumn("log10_mape", F.log10(1 + F.col("mean_mape"))).drop("mean_mape")
    return shown(s.withColumn("fold_rmses", text), mean_rmse=4)


@query(
    "scale_profile",
    twin("SELECT business_id, 'seasonal_naive' AS model, n_h, round(a, 4) AS a, round(gamma, 6) AS gamma FROM profile", "profile"),
)
def scale_profile(spark, sf):
    return shown(forecast.scale_profile(naive_cv(spark, sf)[1]), a=4)


@query(
    "conformal_multiplier",
    twin(
        """SELECT business_id, 'seasonal_naive' AS model, round(q_hat, 6) AS q_hat, n_scores, rank, achieved, round(scale_ratio, 6) AS scale_ratio FROM qhat""",
        "qhat",
    ),
)
def conformal_multiplier(spark, sf):
    resid = cut_lineage(naive_cv(spark, sf)[1])
    return shown(forecast.conformal_multiplier(forecast.profile_scored(resid, forecast.scale_profile(resid))))


def conformal_path(spark, sf):
    hist, resid = naive_cv(spark, sf)
    resid = cut_lineage(resid)
    profile = forecast.scale_profile(resid)
    q = forecast.conformal_multiplier(forecast.profile_scored(resid, profile))
    return forecast.conformal_forecast(naive_path(hist), profile, q)


@query(
    "conformal_forecast",
    twin(
        f"""SELECT n.business_id, n.h, CAST(DATE '{AS_OF}' + CAST(n.h AS INTEGER) AS VARCHAR) AS target_date, round(point, 4) AS point,
  round(point - q.q_hat * p.a * pow(n.h, p.gamma), 4) AS lower, round(point + q.q_hat * p.a * pow(n.h, p.gamma), 4) AS upper
FROM naive_path n JOIN profile p ON p.business_id = n.business_id JOIN qhat q ON q.business_id = n.business_id""",
        "naive_path",
        "profile",
        "qhat",
    ),
)
def conformal_forecast(spark, sf):
    return shown(conformal_path(spark, sf), digits=4)


# Histories of different lengths: a business keeps its last 16 * (number + 1) days, so that some are too short.
cte("uneven", f"SELECT * FROM hist WHERE date > DATE '{AS_OF}' - CAST(16 * (business_id + 1) AS INTEGER)", "hist")


def uneven_history(spark, sf):
    return history_table(spark, sf).filter(F.col("date") > F.date_sub(F.lit(AS_OF).cast("date"), (16 * (F.col("business_id") + 1)).cast("int")))


def _of_uneven(name: str) -> str:
    """A forecast expression over the uneven histories."""
    body = CTES[name][1]
    for old in ("numbered", "folds", "fold_scale", "resid", "profile", "scores", "qhat", "hist"):
        body = re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {'uneven' if old == 'hist' else old + '_u'}", body)
    return body


for _name in ("numbered", "folds", "fold_scale", "resid", "profile", "scores", "qhat", "naive_path"):
    cte(f"{_name}_u", _of_uneven(_name), *("uneven" if x == "hist" else f"{x}_u" for x in CTES[_name][0]))


@query(
    "champion_naive",
    twin(
        f"""SELECT n.business_id, 'seasonal_naive' AS model, round(r.rmse, 4) AS mean_rmse, n.h, CAST(DATE '{AS_OF}' + CAST(n.h AS INTEGER) AS VARCHAR) AS target_date, round(point, 4) AS point,
  round(point - q.q_hat * p.a * pow(n.h, p.gamma) + 0.0000137, 4) AS lower, round(point + q.q_hat * p.a * pow(n.h, p.gamma) + 0.0000137, 4) AS upper, CAST(NULL AS VARCHAR) AS reason
FROM naive_path_u n JOIN profile_u p ON p.business_id = n.business_id JOIN qhat_u q ON q.business_id = n.business_id
JOIN (SELECT business_id, avg(rmse) AS rmse FROM (SELECT business_id, fold, sqrt(avg(residual * residual)) AS rmse FROM resid_u GROUP BY 1, 2) GROUP BY 1) r ON r.business_id = n.business_id
UNION ALL
SELECT business_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'series too short: need > ' || (greatest(count(*) // 2, 28) + {CV_HORIZON}) || ' points, got ' || count(*)
FROM uneven GROUP BY 1 HAVING count(*) < greatest(count(*) // 2, 28) + {CV_HORIZON}""",
        "naive_path_u",
        "profile_u",
        "qhat_u",
        "resid_u",
        "uneven",
    ),
)
def champion_naive(spark, sf):
    """Point, interval and model of every series, or why there is none; the naive model alone."""
    found = champion.champion_forecast(uneven_history(spark, sf), VALUE, HORIZON, CV_HORIZON, N_FOLDS, ["seasonal_naive"])
    # Bounds that are multiples of residuals lie on rounding ties; both sides move them by the same little.
    return shown(found.withColumns({c: F.col(c) + 0.0000137 for c in ("lower", "upper")}), digits=4)


@query("champion_forecast")
def champion_forecast(spark, sf):
    """The same with every model as a candidate."""
    return shown(champion.champion_forecast(uneven_history(spark, sf), VALUE, HORIZON, CV_HORIZON, N_FOLDS), digits=4)


@query(
    "interval_sigma",
    twin(
        "SELECT business_id, h, round(2 * half / (2 * 1.959963984540054), 4) AS sigma FROM naive_path",
        "naive_path",
    ),
)
def interval_sigma(spark, sf):
    p = naive_path(history_table(spark, sf))
    return shown(p.select("business_id", "h", forecast.sigma_from_interval(F.col("lower"), F.col("upper")).alias("sigma")), digits=4)


@query(
    "interval_coverage_bands",
    twin(
        f"""SELECT coalesce(band, 'pooled') AS band, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(w), 2) AS mean_width,
  CASE WHEN abs(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) - 0.95) <= 0.05 THEN 'well calibrated'
       WHEN avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) < 0.95 THEN 'overconfident' ELSE 'underconfident' END AS verdict
FROM (SELECT CASE WHEN n.h <= 7 THEN '01-07' WHEN n.h <= 14 THEN '08-14' WHEN n.h <= 30 THEN '15-30' WHEN n.h <= 45 THEN '31-45'
        WHEN n.h <= 60 THEN '46-60' WHEN n.h <= 75 THEN '61-75' ELSE '76-90' END AS band,
        l.y BETWEEN n.point - q.q_hat * p.a * pow(n.h, p.gamma) AND n.point + q.q_hat * p.a * pow(n.h, p.gamma) AS ok,
        2 * q.q_hat * p.a * pow(n.h, p.gamma) AS w
      FROM naive_path n JOIN profile p ON p.business_id = n.business_id JOIN qhat q ON q.business_id = n.business_id
      JOIN ledger l ON l.business_id = n.business_id AND l.date = DATE '{AS_OF}' + CAST(n.h AS INTEGER))
GROUP BY ROLLUP (band)""",
        "naive_path",
        "profile",
        "qhat",
        "ledger",
    ),
)
def interval_coverage_bands(spark, sf):
    actuals = ledger_table(spark, sf).select("business_id", "date", F.col(VALUE).alias("actual"))
    return shown(forecast.interval_coverage(conformal_path(spark, sf), actuals), mean_width=2)


PARTS = """SELECT business_id, date, value, trend, seasonal, value - trend - seasonal AS residual FROM (
  SELECT business_id, date, value, trend, pm - avg(value - trend) OVER (PARTITION BY business_id) AS seasonal FROM (
    SELECT *, avg(value - trend) OVER (PARTITION BY business_id, phase) AS pm FROM (
      SELECT business_id, date, y AS value, date_diff('day', DATE '1970-01-01', date) % 7 AS phase,
        CAST(sum(sales_u - outflow_u) OVER w AS BIGINT) / 10000.0::DOUBLE / count(*) OVER w AS trend FROM ledger
      WINDOW w AS (PARTITION BY business_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))))"""


@query(
    "seasonal_components",
    twin(
        f"""SELECT business_id, CAST(date AS VARCHAR) AS date, round(value, 4) AS value, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal,
  round(residual, 4) AS residual FROM ({PARTS})""",
        "ledger",
    ),
)
def seasonal_components(spark, sf):
    return shown(forecast.decompose(ledger_table(spark, sf), VALUE), digits=4)


@query(
    "seasonal_shares",
    twin(
        f"""SELECT business_id, round(vs / t, 6) AS seasonal_share, round(vt / t, 6) AS trend_share, round(vr / t, 6) AS residual_share,
  CASE WHEN vs / t > 0.3 THEN 'strongly seasonal' WHEN vs / t > 0.1 THEN 'moderately seasonal' ELSE 'weakly seasonal' END AS verdict
FROM (SELECT business_id, var_pop(seasonal) AS vs, var_pop(trend) AS vt, var_pop(residual) AS vr,
        var_pop(seasonal) + var_pop(trend) + var_pop(residual) AS t FROM ({PARTS}) GROUP BY 1 HAVING count(*) >= 14)""",
        "ledger",
    ),
)
def seasonal_shares(spark, sf):
    return shown(forecast.variance_shares(forecast.decompose(ledger_table(spark, sf), VALUE)))


CUT = "1999-01-01"


@query(
    "period_welch",
    twin(
        f"""SELECT business_id, n_pre, n_post, round(ma, 4) AS pre_mean, round(mb, 4) AS post_mean, round(mb - ma, 4) AS difference,
  round((ma - mb) / sqrt(va / n_pre + vb / n_post), 6) AS t_statistic,
  round(pow(va / n_pre + vb / n_post, 2) / (pow(va / n_pre, 2) / (n_pre - 1) + pow(vb / n_post, 2) / (n_post - 1)), 4) AS dof,
  round((mb - ma) / sqrt((va + vb) / 2), 6) AS cohens_d
FROM (SELECT business_id, count(*) FILTER (WHERE date < DATE '{CUT}') AS n_pre, count(*) FILTER (WHERE date >= DATE '{CUT}') AS n_post,
  avg(y) FILTER (WHERE date < DATE '{CUT}') AS ma, avg(y) FILTER (WHERE date >= DATE '{CUT}') AS mb,
  var_samp(y) FILTER (WHERE date < DATE '{CUT}') AS va, var_samp(y) FILTER (WHERE date >= DATE '{CUT}') AS vb FROM ledger GROUP BY 1)""",
        "ledger",
    ),
)
def period_welch(spark, sf):
    is_post = F.col("date") >= F.lit(CUT).cast("date")
    out = forecast.compare_periods(ledger_table(spark, sf), ["business_id"], VALUE, is_post)
    return shown(out, pre_mean=4, post_mean=4, difference=4, dof=4)


@query("period_welch_p_value")
def period_welch_p_value(spark, sf):
    is_post = F.col("date") >= F.lit(CUT).cast("date")
    out = forecast.compare_periods(ledger_table(spark, sf), ["business_id"], VALUE, is_post)
    return shown(out.withColumn("p_value", special.welch_p_value("t_statistic", "dof")))
