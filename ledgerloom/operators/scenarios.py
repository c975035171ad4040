"""Scenario expansion over a portfolio and the risk measures read from it.

Receivables are summed per (payer, days until due) before they meet the scenarios,
and historical scenarios share the cash path of the month they sample, so the
expansion grows with scenarios and days, not with invoices.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import amount, units

# Horizons of the ruin curve in days (fixed values).
RUIN_HORIZONS = (7, 14, 30, 45, 60, 90, 120, 180)


def receivable_cells(outstanding: DataFrame) -> DataFrame:
    """Receivables that fall due together from one payer, added up exactly."""
    return outstanding.groupBy("business_id", "counterparty_id", "days_until_due").agg(
        F.sum(units("amount")).alias("due_u")
    )


def numbered_periods(panel: DataFrame) -> DataFrame:
    """Sampled periods (issue months) of each business, numbered from zero."""
    months = panel.select("business_id", "issue_period").distinct()
    w = Window.partitionBy("business_id").orderBy("issue_period")
    return months.withColumn("period_no", F.row_number().over(w).cast("long") - 1).withColumn(
        "n_periods", F.count(F.lit(1)).over(Window.partitionBy("business_id"))
    )


def scenario_numbers(periods: DataFrame, n_scenarios: int) -> DataFrame:
    """(business_id, n_periods, scenario_id): whole rounds of a business's periods, at least ``n_scenarios`` in all."""
    sizes = periods.select("business_id", "n_periods").distinct()
    last = F.ceil(F.lit(n_scenarios) / F.col("n_periods")) * F.col("n_periods") - 1
    return sizes.withColumn("scenario_id", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))


def historical_scenarios(periods: DataFrame, n_scenarios: int) -> DataFrame:
    """Scenario -> past period, by fixed arithmetic on the scenario number; every period is drawn equally often."""
    return scenario_numbers(periods, n_scenarios).select(
        "business_id", "scenario_id", F.pmod(F.col("scenario_id") * 31 + F.col("business_id"), F.col("n_periods")).alias("period_no")
    )


def landed(day: Column, horizon: int) -> Column:
    return (day >= 0) & (day < horizon)


def period_arrivals(cells: DataFrame, panel: DataFrame, periods: DataFrame, horizon: int) -> DataFrame:
    """Cash landing per (business, period, day) when every payer repeats its delay of that month.

    A month without a delay for a payer (a default) brings no cash; arrivals before
    day zero or beyond the horizon never land.
    """
    delays = panel.join(periods, ["business_id", "issue_period"]).select("business_id", "counterparty_id", "period_no", "delay_days")
    day = F.floor(F.col("days_until_due") + F.col("delay_days"))
    return (
        cells.join(delays, ["business_id", "counterparty_id"])
        .withColumn("day0", day)
        .filter(landed(F.col("day0"), horizon))
        .groupBy("business_id", "period_no", (F.col("day0") + 1).alias("h"))
        .agg(F.sum("due_u").alias("arrival_u"))
    )


def dropped_overdue(cells: DataFrame, panel: DataFrame, periods: DataFrame) -> DataFrame:
    """Amount per (business, period) whose arrival would fall before day zero."""
    delays = panel.join(periods, ["business_id", "issue_period"]).select("business_id", "counterparty_id", "period_no", "delay_days")
    day = F.floor(F.col("days_until_due") + F.col("delay_days"))
    return (
        cells.join(delays, ["business_id", "counterparty_id"])
        .filter(day < 0)
        .groupBy("business_id", "period_no")
        .agg(amount(F.sum("due_u")).alias("dropped_overdue_amount"))
    )


def point_spine(path: DataFrame) -> DataFrame:
    return path.select("business_id", "h", units("point").alias("point_u"))


def accumulate(flows: DataFrame, unit_keys: list[str]) -> DataFrame:
    """Running sum of ``flow_u`` by day inside each path (at most ``horizon`` rows each)."""
    w = Window.partitionBy(*unit_keys).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    return flows.withColumn("walk_u", F.sum("flow_u").over(w))


def historical_paths(
    spine: DataFrame, opening: DataFrame, periods: DataFrame, arrivals: DataFrame, scenarios: DataFrame
) -> DataFrame:
    """balance = opening + running sum of (forecast point + arrivals), per scenario and day."""
    grid = periods.select("business_id", "period_no").join(spine, "business_id")
    flows = grid.join(arrivals, ["business_id", "period_no", "h"], "left").withColumn(
        "flow_u", F.col("point_u") + F.coalesce("arrival_u", F.lit(0))
    )
    per_period = accumulate(flows, ["business_id", "period_no"]).select("business_id", "period_no", "h", "walk_u")
    start = opening.select("business_id", units("opening_balance").alias("opening_u"))
    return (
        scenarios.join(per_period, ["business_id", "period_no"])
        .join(start, "business_id")
        .select("business_id", "scenario_id", F.col("h").alias("day"), amount(F.col("opening_u") + F.col("walk_u")).alias("balance"))
    )


def outcomes(paths: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per path: first passage, censored days to zero, minimum balance."""
    keys = keys or ["business_id"]
    horizon = F.max("day")
    first = F.min(F.when(F.col("balance") <= 0, F.col("day")))
    return paths.groupBy(*keys, "scenario_id").agg(
        first.alias("first_passage"),
        F.coalesce(first, horizon).alias("days_to_zero"),
        F.min("balance").alias("min_cash"),
        horizon.alias("horizon"),
    )


def runway_at_risk(out: DataFrame, confidence: float = 0.95, keys: list[str] | None = None) -> DataFrame:
    """Lower-tail runway: floor of the (1 - c) quantile, tail mean, probability of shortfall.

    Groups hold one row per scenario, a parameter of the run.
    """
    keys = keys or ["business_id"]
    q = out.groupBy(*keys).agg(F.percentile("days_to_zero", F.lit(1.0 - confidence)).alias("_q"))
    tail = F.when(F.col("days_to_zero") <= F.col("_q"), F.col("days_to_zero"))
    return out.join(q, keys).groupBy(*keys).agg(
        F.floor(F.max("_q")).alias("runway_at_risk_days"),
        F.coalesce(F.avg(tail), F.max("_q")).alias("conditional_runway_at_risk_days"),
        F.avg(F.col("first_passage").isNotNull().cast("double")).alias("probability_of_shortfall"),
        F.count(F.lit(1)).alias("n_scenarios"),
    )


def ruin_curve(out: DataFrame, horizon: int, horizons: tuple[int, ...] = RUIN_HORIZONS, z: float = 1.96) -> DataFrame:
    """Share of paths ruined by each horizon, with standard error and clipped interval."""
    grid = sorted({min(max(h, 1), horizon) for h in (*[h for h in horizons if h <= horizon], horizon)})
    hit = F.coalesce(F.col("first_passage") <= F.col("horizon_days"), F.lit(False)).cast("double")
    p = F.col("ruin_probability")
    se = F.sqrt(F.greatest(p * (1.0 - p), F.lit(0.0)) / F.col("n"))
    return (
        out.withColumn("horizon_days", F.explode(F.array(*[F.lit(h).cast("long") for h in grid])))
        .groupBy("business_id", "horizon_days")
        .agg(F.avg(hit).alias("ruin_probability"), F.count(F.lit(1)).alias("n"))
        .select(
            "business_id", "horizon_days", "ruin_probability", se.alias("standard_error"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), p - z * se)).alias("ci_lower"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), p + z * se)).alias("ci_upper"),
        )
    )


def hazard_table(out: DataFrame, horizon: int, bin_days: int = 15) -> DataFrame:
    """At risk, failed and hazard per interval of days."""
    starts = list(range(0, horizon, bin_days))
    fp = F.col("first_passage")
    spread = out.withColumn("start0", F.explode(F.array(*[F.lit(s).cast("long") for s in starts])))
    end = F.least(F.col("start0") + bin_days, F.lit(horizon))
    alive = fp.isNull() | (fp > F.col("start0"))
    failed = fp.isNotNull() & (fp > F.col("start0")) & (fp <= end)
    agg = spread.groupBy("business_id", "start0").agg(
        F.count(F.when(alive, 1)).alias("n_at_risk"), F.count(F.when(failed, 1)).alias("n_failed")
    )
    return agg.select(
        "business_id", (F.col("start0") + 1).alias("interval_start_day"), end.alias("interval_end_day"),
        "n_at_risk", "n_failed",
        F.when(F.col("n_at_risk") > 0, F.col("n_failed") / F.col("n_at_risk")).otherwise(0.0).alias("hazard"),
    )


def expected_days_to_ruin(out: DataFrame) -> DataFrame:
    """Mean first-passage day of ruined paths; NULL when none is ruined."""
    return out.groupBy("business_id").agg(
        F.avg("first_passage").alias("expected_days_to_ruin"), F.count("first_passage").alias("n_ruined")
    )


def cash_fan(paths: DataFrame, probs: tuple[float, ...] = (0.05, 0.1, 0.5, 0.9, 0.95)) -> DataFrame:
    """Percentiles of the balance per day over the scenarios."""
    p = F.percentile("balance", F.array(*[F.lit(x) for x in probs]))
    fan = paths.groupBy("business_id", "day").agg(p.alias("_p"))
    return fan.select("business_id", "day", *[F.col("_p")[i].alias(f"p{int(round(x * 100)):02d}") for i, x in enumerate(probs)])


def safe_spend(out: DataFrame, epsilon: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Largest spend that keeps P(min cash < spend) at epsilon; infeasible when zero spend already fails."""
    keys = keys or ["business_id"]
    base = F.avg((F.col("min_cash") < 0).cast("double"))
    q = out.groupBy(*keys).agg(
        F.greatest(F.lit(0.0), F.percentile("min_cash", F.lit(epsilon))).alias("safe_spend"),
        base.alias("baseline_shortfall"),
        F.count(F.lit(1)).alias("n_scenarios"),
    )
    return q.withColumn("infeasible", F.col("baseline_shortfall") > epsilon)


def achieved_shortfall(out: DataFrame, spends: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of scenarios whose minimum cash is below the planned spend."""
    keys = keys or ["business_id"]
    return out.join(spends, keys).groupBy(*keys).agg(
        F.avg((F.col("min_cash") < F.col("spend")).cast("double")).alias("achieved_shortfall")
    )


def spend_stability(out: DataFrame, epsilon: float = 0.05, resamples: int = 8, share: float = 0.5) -> DataFrame:
    """Coefficient of variation of the safe spend over hashed subsamples of the scenarios."""
    tagged = out.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = F.pmod(F.xxhash64("business_id", "scenario_id", "r"), F.lit(10_000)) / 10_000.0
    limits = tagged.filter(u < share).groupBy("business_id", "r").agg(
        F.greatest(F.lit(0.0), F.percentile("min_cash", F.lit(epsilon))).alias("lim")
    )
    m = F.avg("lim")
    return limits.groupBy("business_id").agg(F.when(m > 0, F.stddev_samp("lim") / m).otherwise(0.0).alias("cv"), m.alias("mean_limit"))


# --- sampling error of the runway ---------------------------------------------------------


def _bootstrap(confidence: float, resamples: int, seed: int):
    def se(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf["days_to_zero"].to_numpy(float)
        c = pdf["n"].to_numpy(int)
        order = np.argsort(d)
        d, c = d[order], c[order]
        n = c.sum()
        key = int(pdf["business_id"].iloc[0])
        rng = np.random.default_rng([seed, key, int(pdf["n_scenarios"].iloc[0])])
        draws = np.cumsum(rng.multinomial(n, c / n, size=resamples), axis=1)
        pos = (n - 1) * (1.0 - confidence)
        lo, hi = math.floor(pos), math.ceil(pos)
        at = lambda k: d[(draws > k).argmax(axis=1)]
        q = at(lo) + (at(hi) - at(lo)) * (pos - lo)
        return pd.DataFrame({"business_id": [key], "n_scenarios": [int(n)], "rar_se": [float(np.std(q, ddof=1))]})

    return se


def bootstrap_se(out: DataFrame, confidence: float = 0.95, resamples: int = 500, seed: int = 1) -> DataFrame:
    """Standard error of the runway quantile from multinomial resamples of its day histogram.

    The grouped function sees at most one row per day of the horizon.
    """
    hist = out.groupBy("business_id", "days_to_zero").agg(F.count(F.lit(1)).alias("n"))
    sized = hist.withColumn("n_scenarios", F.sum("n").over(Window.partitionBy("business_id")))
    return sized.groupBy("business_id").applyInPandas(
        _bootstrap(confidence, resamples, seed), "business_id long, n_scenarios long, rar_se double"
    )


def convergence_study(out: DataFrame, sizes: tuple[int, ...], confidence: float = 0.95, resamples: int = 200) -> DataFrame:
    """Bootstrap error on nested scenario prefixes and the log-log slope against the sample size."""
    grid = out.withColumn("size", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes]))).filter(F.col("scenario_id") < F.col("size"))
    hist = grid.groupBy("business_id", "size", "days_to_zero").agg(F.count(F.lit(1)).alias("n"))
    sized = hist.withColumnRenamed("size", "n_scenarios")
    se = sized.groupBy("business_id", "n_scenarios").applyInPandas(
        _bootstrap(confidence, resamples, 2), "business_id long, n_scenarios long, rar_se double"
    )
    pos = F.when(F.col("rar_se") > 0, F.log("rar_se"))
    return se.groupBy("business_id").agg(
        F.sort_array(F.collect_list(F.struct("n_scenarios", "rar_se"))).alias("points"),
        F.regr_slope(pos, F.log(F.col("n_scenarios").cast("double"))).alias("log_log_slope"),
    )


# --- parametric scenarios ------------------------------------------------------------------


def hash_uniform(*cols: Column | str) -> Column:
    """Reproducible uniform in (0, 1) from a 64-bit hash of the given columns."""
    return (F.pmod(F.xxhash64(*cols), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def hash_normal(tag: str, *cols: Column | str) -> Column:
    """Reproducible standard normal by Box-Muller on two hashes."""
    u1 = hash_uniform(F.lit(f"{tag}-a"), *cols)
    u2 = hash_uniform(F.lit(f"{tag}-b"), *cols)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def student_t4_cdf(t: Column) -> Column:
    """Closed-form CDF of Student's t with four degrees of freedom."""
    r = t * t / (1.0 + t * t / 4.0)
    return 0.5 + 0.375 * t / F.sqrt(1.0 + t * t / 4.0) * (1.0 - r / 12.0)


def copula_uniforms(spark: SparkSession, correlation: DataFrame, n_scenarios: int, seed: int, family: str = "student_t") -> DataFrame:
    """Dependent uniforms per (business, scenario, payer): Cholesky rows times hashed normals."""
    ids = spark.range(n_scenarios).withColumnRenamed("id", "scenario_id")
    drawn = correlation.filter(F.col("chol") != 0).crossJoin(F.broadcast(ids))
    eps = hash_normal("copula", F.lit(seed), "business_id", "scenario_id", "cp_j")
    z = drawn.groupBy("business_id", "scenario_id", F.col("cp_i").alias("counterparty_id")).agg(F.sum(F.col("chol") * eps).alias("z"))
    if family == "gaussian":
        from ledgerloom.functions.special import normal_cdf

        u = normal_cdf("z")
    else:
        chi2 = sum(
            (F.pow(hash_normal(f"chi{i}", F.lit(seed), "business_id", "scenario_id"), F.lit(2.0)) for i in range(4)), F.lit(0.0)
        )
        u = student_t4_cdf(F.col("z") / F.sqrt(chi2 / 4.0))
    return z.select("business_id", "scenario_id", "counterparty_id", F.greatest(F.lit(1e-10), F.least(F.lit(1.0 - 1e-10), u)).alias("u"))


def copula_delays(uniforms: DataFrame, grid: DataFrame) -> DataFrame:
    """Delay by linear interpolation in each payer's quantile grid."""
    n = F.size("quantiles") - 2
    x = F.greatest(F.lit(0.0), F.least((n + 1).cast("double"), F.col("u") * n + 0.5))
    lo = F.least(F.floor(x).cast("int"), n)
    q = lambda i: F.element_at("quantiles", i)
    return uniforms.join(grid, ["business_id", "counterparty_id"]).select(
        "business_id", "scenario_id", "counterparty_id", "u", (q(lo + 1) + (q(lo + 2) - q(lo + 1)) * (x - lo)).alias("delay_days")
    )


def parametric_paths(
    path: DataFrame, opening: DataFrame, cells: DataFrame, delays: DataFrame, n_scenarios: int, horizon: int, seed: int
) -> DataFrame:
    """balance = opening + running sum of (point + sigma * shock + arrivals)."""
    from ledgerloom.operators.forecast import sigma_from_interval

    day = F.floor(F.col("days_until_due") + F.col("delay_days"))
    arrivals = (
        cells.join(delays, ["business_id", "counterparty_id"])
        .withColumn("day0", day)
        .filter(landed(F.col("day0"), horizon))
        .groupBy("business_id", "scenario_id", (F.col("day0") + 1).alias("h"))
        .agg(F.sum("due_u").alias("arrival_u"))
    )
    sigma = sigma_from_interval(F.col("lower"), F.col("upper"))
    ids = path.sparkSession.range(n_scenarios).withColumnRenamed("id", "scenario_id")
    shock = hash_normal("shock", F.lit(seed), "business_id", "scenario_id", "h")
    spine = path.crossJoin(F.broadcast(ids)).select("business_id", "scenario_id", "h", units(F.col("point") + sigma * shock).alias("point_u"))
    flows = spine.join(arrivals, ["business_id", "scenario_id", "h"], "left").withColumn(
        "flow_u", F.col("point_u") + F.coalesce("arrival_u", F.lit(0))
    )
    start = opening.select("business_id", units("opening_balance").alias("opening_u"))
    return accumulate(flows, ["business_id", "scenario_id"]).join(start, "business_id").select(
        "business_id", "scenario_id", F.col("h").alias("day"), amount(F.col("opening_u") + F.col("walk_u")).alias("balance")
    )


# --- solvency --------------------------------------------------------------------------------

# Published coefficients and zone limits of the four-ratio Z''-score (fixed values).
Z2_COEFFICIENTS = (6.56, 3.26, 6.72, 1.05)
Z2_SAFE, Z2_DISTRESS = 2.60, 1.10


def altman_z(sheets: DataFrame) -> DataFrame:
    """Z''-score, zone and input provenance; refused inputs carry a reason and no score."""
    ta, tl = F.col("total_assets"), F.col("total_liabilities")
    nulls = F.concat_ws(
        ", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("retained_earnings", "ebit", "current_assets", "current_liabilities")]
    )
    reason = (
        F.when(ta.isNull() | (ta <= 0), F.lit("total_assets must be positive"))
        .when(tl.isNull() | (tl <= 0), F.lit("total_liabilities must be positive"))
        .when(nulls != "", F.concat(F.lit("missing "), nulls))
    )
    ok = reason.isNull()
    equity = F.coalesce("equity", ta - tl)
    x1 = (F.col("current_assets") - F.col("current_liabilities")) / ta
    x2, x3, x4 = F.col("retained_earnings") / ta, F.col("ebit") / ta, equity / tl
    a, b, c, d = Z2_COEFFICIENTS
    z = a * x1 + b * x2 + c * x3 + d * x4
    zone = F.when(z > Z2_SAFE, "safe").when(z < Z2_DISTRESS, "distress").otherwise("grey")
    only = lambda e: F.when(ok, e)
    return sheets.select(
        "business_id", only(z).alias("z_score"), only(zone).alias("zone"), only(x1).alias("x1"), only(x2).alias("x2"),
        only(x3).alias("x3"), only(x4).alias("x4"),
        only(F.when(F.col("equity").isNull(), "derived_from_ledger").otherwise("supplied_by_business")).alias("equity_provenance"),
        reason.alias("reject_reason"),
    )


def failure_report(curve: DataFrame, expected: DataFrame, altman: DataFrame, horizon: int, threshold: float = 0.20) -> DataFrame:
    """Cash-flow view and balance-sheet view side by side; never averaged."""
    head = curve.filter(F.col("horizon_days") == horizon).select("business_id", F.col("ruin_probability").alias("headline"))
    j = head.join(expected, "business_id", "left").join(altman.select("business_id", "z_score", "zone", "reject_reason"), "business_id", "left")
    cash, sheet = F.col("headline") >= threshold, F.col("zone").isin("distress", "grey")
    view = (
        F.when(F.col("zone").isNull(), F.lit(None))
        .when(cash & sheet, "both stressed").when(cash, "solvent but illiquid").when(sheet, "structural decline").otherwise("both benign")
    )
    pct = F.concat(F.format_string("%.1f", F.round(F.col("headline") * 100.0, 1)), F.lit("%"))
    text = F.when(F.col("zone").isNotNull(), F.concat(view, F.lit(": P(ruin) "), pct, F.lit(f" over {horizon} days, balance sheet "), F.col("zone")))
    caveat = F.when(F.col("reject_reason").isNotNull(), F.concat(F.lit("no Z''-score: "), F.col("reject_reason")))
    return j.select("business_id", "headline", "expected_days_to_ruin", "z_score", "zone", view.alias("agreement"), text.alias("agreement_text"), caveat.alias("caveat"))


def first_passage_inputs(history: DataFrame, value: str = "net") -> DataFrame:
    """Plug-in drift and volatility of the daily net flow."""
    return history.groupBy("business_id").agg(
        F.max_by("balance", "date").alias("opening"), F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"), F.count(F.lit(1)).alias("n_history")
    )


def predictive_draws(inputs: DataFrame, draws: int, seed: int) -> DataFrame:
    """Parameter uncertainty: sigma^2 ~ s^2 (n-1)/chi2, mu ~ N(m, sigma/sqrt(n)), from hashed normals.

    chi2 uses the Wilson-Hilferty cube, accurate to a few parts in 1e4 at daily history lengths.
    """
    d = inputs.filter(F.col("n_history") > 2).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    df = (F.col("n_history") - 1).cast("double")
    zc = hash_normal("scale", F.lit(seed), "business_id", "draw")
    chi2 = df * F.pow(1.0 - 2.0 / (9.0 * df) + zc * F.sqrt(2.0 / (9.0 * df)), F.lit(3.0))
    sig = F.col("sigma") * F.sqrt(df / chi2)
    zm = hash_normal("drift", F.lit(seed), "business_id", "draw")
    return d.select("business_id", "draw", "opening", (F.col("mu") + zm * sig / F.sqrt(F.col("n_history").cast("double"))).alias("mu"), sig.alias("sigma"))
