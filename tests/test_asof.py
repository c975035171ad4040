"""As-of panel, strict features, champions and the roll-up on hand cases."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import backtest, champion, credit, delays, forecast_models

D = dt.date(2026, 1, 5)  # a Monday
PAYMENTS = "business_id long, counterparty_id long, invoice_id long, issue_date date, due_date date, amount double, delay_days long, paid boolean, paid_date date"


def day(n):
    return D + dt.timedelta(days=n)


def invoices(seed, n, hot=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        issue, paid = rng.randrange(0, 60), rng.random() < 0.8
        late = rng.randrange(-10, 40)
        out.append((1 + i % 2, 7 if i < hot else rng.randrange(3), i, day(issue), day(issue + 15), 10.0 + rng.randrange(900) / 100, late, paid, day(max(issue, issue + 15 + late)) if paid else None))
    return out


def test_asof_panel_of_two_grains(spark):
    rows = invoices(1, 300, hot=150)
    dates = [(b, day(k)) for b in (1, 2, 3) for k in (3, 20, 45, 90)]
    payments, decisions = spark.createDataFrame(rows, PAYMENTS), spark.createDataFrame(dates, "business_id long, as_of date")
    for grain, start in (("day", lambda d: d), ("week", lambda d: d - dt.timedelta(days=d.weekday()))):
        want = defaultdict(list)
        for b, as_of in dates:
            for r in rows:
                if r[0] == b and r[7] and r[8] <= as_of:
                    want[b, as_of, start(r[3]), r[1]].append(r[6])
        got = {(r.business_id, r.as_of, r.issue_period, r.counterparty_id): r.delay_days for r in delays.asof_panel(payments, decisions, grain).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - np.mean(v)) < 1e-12 for k, v in want.items())
    assert delays.asof_panel(payments.limit(0), decisions).count() == 0 and delays.asof_panel(payments, decisions.limit(0)).count() == 0


def test_strict_features_against_a_loop(spark):
    rows = invoices(2, 240, hot=120)
    got = {r.invoice_id: r for r in credit.strict_features(spark.createDataFrame(rows, PAYMENTS)).collect()}
    loose = {r.invoice_id: r for r in credit.credit_features(spark.createDataFrame(rows, PAYMENTS)).collect()}
    seen = 0
    for b, c, i, issue, due, amount, _, paid, _ in rows:
        payer = [r for r in rows if (r[0], r[1]) == (b, c)]
        before = sorted((r[3], r[2], r[5]) for r in payer if (r[3], r[2]) < (issue, i))
        if len(before) < 3:
            assert i not in got
            continue
        known = [r[6] for r in sorted((r for r in payer if r[7] and r[8] < issue), key=lambda r: (r[8], r[2]))]
        fallen = [r for r in payer if r[4] < issue]
        f = got[i]
        want = {
            "n_prior_invoices": len(before), "prior_default_rate": np.mean([not (r[7] and r[8] < issue) for r in fallen]) if fallen else 0,
            "mean_prior_delay": np.mean(known) if known else 0, "std_prior_delay": np.std(known, ddof=1) if len(known) > 1 else 0, "max_prior_delay": max(known) if known else 0,
            "delay_trend": np.polyfit(range(len(known)), known, 1)[0] if len(known) > 1 else 0, "days_since_last_invoice": (issue - before[-1][0]).days,
            "log_amount": np.log1p(amount), "amount_vs_counterparty_mean": amount / np.mean([x[2] for x in before]), "payment_terms_days": 15, "label": int(not paid),
        }
        for name, value in want.items():
            assert abs(f[name] - value) < 1e-8, (i, name)
        seen += f.mean_prior_delay != loose[i].mean_prior_delay
    assert seen > 20  # payments that came later than the next issue change the history


def series(n, business, start=D):
    rng = np.random.default_rng(business)
    return [(business, start + dt.timedelta(days=k), float(50 * (k % 7) + rng.normal(0, 5))) for k in range(n)]


def test_every_series_gets_a_forecast_or_a_reason(spark, monkeypatch):
    def broken(y, horizon):
        raise ValueError("no")

    def good(y, horizon):
        h = np.arange(1, horizon + 1)
        return y[-7:][(h - 1) % 7] * 0 + np.array([50.0 * ((len(y) + k - 1) % 7) for k in h]), np.ones(horizon)

    table = {"seasonal_naive": forecast_models.FORECASTERS["seasonal_naive"], "broken": (broken, True), "good": (good, True)}
    monkeypatch.setattr(forecast_models, "FORECASTERS", table)
    rows = series(120, 1) + series(20, 2) + series(43, 3)
    hist = spark.createDataFrame(rows, "business_id long, date date, value double")
    out = champion.champion_forecast(hist, "value", 10, 14, 3, ["seasonal_naive", "good"]).collect()
    by = {b: [r for r in out if r.business_id == b] for b in (1, 2, 3)}
    assert [r.reason for r in by[2]] == ["series too short: need > 42 points, got 20"]
    for b in (1, 3):
        assert {r.model for r in by[b]} == {"good"} and sorted(r.h for r in by[b]) == list(range(1, 11))
        assert all(r.lower < r.point < r.upper and r.reason is None for r in by[b])
        widths = {round(r.upper - r.lower, 9) for r in by[b]}
        assert len(widths) == 1  # a scale of its own that is flat stays flat
    none = champion.champion_forecast(hist.filter("business_id = 1"), "value", 10, 14, 3, ["broken"]).collect()
    assert [(r.model, r.reason) for r in none] == [(None, "fit failed: no")]
    kept = champion.champion_forecast(hist.filter("business_id = 1"), "value", 10, 14, 3, ["broken", "seasonal_naive"]).collect()
    assert {r.model for r in kept} == {"seasonal_naive"} and len(kept) == 10


def test_usage_by_model_and_strategy(spark):
    rows = [("a", "x", 1.0, 10, 9.5), ("a", "y", 1.0, 20, 19.0), ("b", "x", 3.0, 30, 30.0), ("b", "y", 3.0, 90, 90.0)]
    table = spark.createDataFrame(rows, "forecast_model string, strategy string, q_hat double, runway_at_risk_days long, conditional_runway_at_risk_days double")
    out = {(r.forecast_model, r.strategy): r for r in backtest.usage_summary(table).collect()}
    assert set(out) == {("a", None), ("b", None), (None, "x"), (None, "y"), (None, None)}
    assert {k: r.group_kind for k, r in out.items()}[(None, None)] == "all"
    assert (out["a", None].n_steps, out["a", None].mean_q_hat, out["b", None].median_runway_at_risk) == (2, 1.0, 60.0)
    every = out[None, None]
    assert (every.n_steps, every.min_q_hat, every.max_q_hat, every.median_runway_at_risk, every.min_conditional_runway) == (4, 1.0, 3.0, 25.0, 9.5)


def test_weights_cover_every_period(spark):
    """More periods than scenarios leave some out; more scenarios than periods leave none."""
    periods = spark.range(250).select(F.lit(3).cast("long").alias("business_id"), F.col("id").alias("period_no"), F.lit(250).cast("long").alias("n_periods"))
    weights = [r.w for r in periods.select(backtest.period_weight(3_000).alias("w")).collect()]
    assert set(weights) == {12} and sum(weights) == 3_000
    want = [sum((31 * s + 3) % 250 == p for s in range(777)) for p in range(250)]
    assert [r.w for r in periods.orderBy("period_no").select(backtest.period_weight(777).alias("w")).collect()] == want
