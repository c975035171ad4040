"""Scenario paths, runway at risk, ruin measures and solvency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.special import first_passage_udf
from ledgerloom.operators import credit, delays, ledger, scenarios
from ledgerloom.plans.base_sql import AS_OF, GRAIN, HORIZON, SCENARIOS, cte, twin
from ledgerloom.plans.registry import query, shown
from ledgerloom.plans.views import history_table, ledger_table, naive_path
from ledgerloom.session import cut_lineage
from ledgerloom.sources import tables

cte(
    "periods",
    """SELECT business_id, issue_month, row_number() OVER (PARTITION BY business_id ORDER BY issue_month) - 1 AS period_no,
  count(*) OVER (PARTITION BY business_id) AS n_periods FROM (
  SELECT DISTINCT business_id, CAST(date_trunc('month', issue_date) AS DATE) AS issue_month FROM settled)""",
    "settled",
)
cte(
    "cells_by_month",
    """SELECT business_id, CAST(date_trunc('month', issue_date) AS DATE) AS issue_month, counterparty_id, avg(delay_days) AS delay_days FROM settled GROUP BY 1, 2, 3""",
    "settled",
)
# Whole rounds of a business's periods, so that each is drawn equally often: at least as many scenarios as asked for.
cte(
    "draws",
    f"""SELECT business_id, n_periods, unnest(generate_series(0, CAST(({SCENARIOS} + n_periods - 1) // n_periods * n_periods - 1 AS BIGINT))) AS scenario_id
FROM (SELECT DISTINCT business_id, n_periods FROM periods)""",
    "periods",
)
_SPLIT = "(s.scenario_id * 31 + s.business_id{extra}) % s.n_periods"


def _paths(extra: str, name: str) -> None:
    sample = (
        f"""SELECT o.business_id, s.scenario_id, CAST(floor(o.days_until_due + c.delay_days) AS BIGINT) + 1 AS h, sum(o.cents * 100) AS arrival_u
FROM open_items o JOIN draws s ON s.business_id = o.business_id
JOIN periods p ON p.business_id = o.business_id AND p.period_no = {_SPLIT.format(extra=extra)}
JOIN cells_by_month c ON c.business_id = o.business_id AND c.counterparty_id = o.counterparty_id AND c.issue_month = p.issue_month
WHERE floor(o.days_until_due + c.delay_days) BETWEEN 0 AND {HORIZON - 1} GROUP BY 1, 2, 3"""
    )
    cte(
        name,
        f"""
SELECT n.business_id, s.scenario_id, n.h AS day, (CAST(round(op.opening_balance * 10000) AS BIGINT) + CAST(sum(CAST(round(n.point * 10000) AS BIGINT) + coalesce(a.arrival_u, 0))
   OVER (PARTITION BY n.business_id, s.scenario_id ORDER BY n.h ROWS UNBOUNDED PRECEDING) AS BIGINT)) / 10000.0::DOUBLE AS balance
FROM naive_path n JOIN opening op ON op.business_id = n.business_id
JOIN draws s ON s.business_id = n.business_id
LEFT JOIN ({sample}) a ON a.business_id = n.business_id AND a.scenario_id = s.scenario_id AND a.h = n.h
""",
        "naive_path",
        "opening",
        "open_items",
        "periods",
        "draws",
        "cells_by_month",
    )


_paths("", "paths")
_paths(" + 17 * o.counterparty_id", "paths_indep")
OUT = """SELECT business_id, scenario_id, min(CASE WHEN balance <= 0 THEN day END) AS fp, coalesce(min(CASE WHEN balance <= 0 THEN day END), {h}) AS d, min(balance) AS mc
FROM {t} GROUP BY 1, 2"""
cte("outcomes", OUT.format(h=HORIZON, t="paths"), "paths")
cte("outcomes_indep", OUT.format(h=HORIZON, t="paths_indep"), "paths_indep")
RAR = """SELECT business_id, CAST(floor(any_value(q)) AS BIGINT) AS rar, avg(CASE WHEN d <= q THEN d END) AS crar, avg(CASE WHEN fp IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS ps, count(*) AS n
FROM {t} JOIN (SELECT business_id, quantile_cont(d, 0.05) AS q FROM {t} GROUP BY 1) USING (business_id) GROUP BY 1"""
cte("rar", RAR.format(t="outcomes"), "outcomes")
cte("rar_indep", RAR.format(t="outcomes_indep"), "outcomes_indep")
cte("curve", f"""SELECT business_id, h AS horizon_days, avg(CASE WHEN fp <= h THEN 1.0::DOUBLE ELSE 0 END) AS p, count(*) AS n
FROM outcomes CROSS JOIN (SELECT unnest([7, 14, 30, 45, 60, {HORIZON}]) AS h) GROUP BY 1, 2""", "outcomes")


def parts(spark, sf):
    """Inputs of the scenario engine at the decision date.

    The history and the receivable cells are small daily aggregates used several times,
    so they are written once.
    """
    hist = cut_lineage(history_table(spark, sf))
    inv = tables.invoices(spark, sf)
    cells = cut_lineage(scenarios.receivable_cells(ledger.outstanding(inv, AS_OF)))
    panel = cut_lineage(delays.delay_panel(ledger.settled(inv, AS_OF), GRAIN))
    return hist, inv, cells, panel


def hist_paths(spark, sf):
    hist, _, cells, panel = parts(spark, sf)
    periods = scenarios.numbered_periods(panel)
    arrivals = scenarios.period_arrivals(cells, panel, periods, HORIZON)
    return scenarios.historical_paths(
        scenarios.point_spine(naive_path(hist)), ledger.opening_balance(hist, AS_OF), periods, arrivals,
        scenarios.historical_scenarios(periods, SCENARIOS),
    )


def hist_outcomes(spark, sf):
    return scenarios.outcomes(hist_paths(spark, sf))


@query("scenario_paths_hist", twin("SELECT business_id, scenario_id, day, balance FROM paths", "paths"))
def scenario_paths_hist(spark, sf):
    return shown(hist_paths(spark, sf), digits=4)


@query(
    "runway_at_risk",
    twin(
        "SELECT business_id, rar AS runway_at_risk_days, round(crar, 6) AS conditional_runway_at_risk_days, round(ps, 6) AS probability_of_shortfall, n AS n_scenarios FROM rar",
        "rar",
    ),
)
def runway_at_risk(spark, sf):
    return shown(scenarios.runway_at_risk(hist_outcomes(spark, sf)))


@query(
    "ruin_curve",
    twin(
        """SELECT business_id, horizon_days, round(p, 6) AS ruin_probability, round(sqrt(p * (1 - p) / n), 6) AS standard_error,
  round(greatest(0.0, p - 1.96 * sqrt(p * (1 - p) / n)), 6) + 0.0 AS ci_lower, round(least(1.0, p + 1.96 * sqrt(p * (1 - p) / n)), 6) AS ci_upper FROM curve""",
        "curve",
    ),
)
def ruin_curve(spark, sf):
    return shown(scenarios.ruin_curve(hist_outcomes(spark, sf), HORIZON))


HAZARD = f"""SELECT business_id, s + 1 AS interval_start_day, s + 15 AS interval_end_day, count(*) FILTER (WHERE fp IS NULL OR fp > s) AS n_at_risk,
  count(*) FILTER (WHERE fp > s AND fp <= s + 15) AS n_failed,
  coalesce(round(count(*) FILTER (WHERE fp > s AND fp <= s + 15) / nullif(count(*) FILTER (WHERE fp IS NULL OR fp > s), 0)::DOUBLE, 6), 0.0) AS hazard
FROM outcomes CROSS JOIN (SELECT unnest(generate_series(0, {HORIZON - 1}, 15)) AS s) GROUP BY business_id, s"""


@query("hazard_table", twin(HAZARD, "outcomes"))
def hazard_table(spark, sf):
    return shown(scenarios.hazard_table(hist_outcomes(spark, sf), HORIZON))


@query(
    "expected_days_to_ruin",
    twin("SELECT business_id, round(avg(fp), 6) AS expected_days_to_ruin, count(fp) AS n_ruined FROM outcomes GROUP BY 1", "outcomes"),
)
def expected_days_to_ruin(spark, sf):
    return shown(scenarios.expected_days_to_ruin(hist_outcomes(spark, sf)))


@query(
    "cash_fan",
    twin(
        "SELECT business_id, day, "
        + ", ".join(f"round(quantile_cont(balance, {p / 100}), 6) AS p{p:02d}" for p in (5, 10, 50, 90, 95))
        + " FROM paths GROUP BY 1, 2",
        "paths",
    ),
)
def cash_fan(spark, sf):
    return shown(scenarios.cash_fan(hist_paths(spark, sf)))


SAFE = """SELECT business_id, greatest(0.0, quantile_cont(mc, 0.05)) AS safe_spend, avg(CASE WHEN mc < 0 THEN 1.0::DOUBLE ELSE 0 END) AS base, count(*) AS n FROM outcomes GROUP BY 1"""
cte("safe", SAFE, "outcomes")


@query(
    "safe_spend",
    twin(
        """SELECT s.business_id, round(safe_spend, 6) AS safe_spend, round(base, 6) AS baseline_shortfall, n AS n_scenarios, base > 0.05 AS infeasible,
  round((SELECT avg(CASE WHEN o.mc < s.safe_spend THEN 1.0::DOUBLE ELSE 0 END) FROM outcomes o WHERE o.business_id = s.business_id), 6) AS achieved_shortfall FROM safe s""",
        "safe",
    ),
)
def safe_spend(spark, sf):
    out = cut_lineage(hist_outcomes(spark, sf))
    limits = scenarios.safe_spend(out)
    achieved = scenarios.achieved_shortfall(out, limits.select("business_id", F.col("safe_spend").alias("spend")))
    return shown(limits.join(achieved, "business_id"))


@query("safe_spend_stability")
def safe_spend_stability(spark, sf):
    return shown(scenarios.spend_stability(hist_outcomes(spark, sf)))


@query(
    "dropped_overdue",
    twin(
        """SELECT o.business_id, p.period_no, CAST(sum(o.cents) AS BIGINT) / 100.0::DOUBLE AS dropped_overdue_amount
FROM open_items o JOIN cells_by_month c ON c.business_id = o.business_id AND c.counterparty_id = o.counterparty_id
JOIN periods p ON p.business_id = c.business_id AND p.issue_month = c.issue_month
WHERE floor(o.days_until_due + c.delay_days) < 0 GROUP BY 1, 2""",
        "open_items",
        "cells_by_month",
        "periods",
    ),
)
def dropped_overdue(spark, sf):
    _, _, cells, panel = parts(spark, sf)
    return shown(scenarios.dropped_overdue(cells, panel, scenarios.numbered_periods(panel)), digits=2)


@query(
    "stress_independence",
    twin(
        """SELECT d.business_id, d.rar AS dependent_days, i.rar AS independent_days, round(d.crar, 6) AS dependent_tail_days, round(i.crar, 6) AS independent_tail_days
FROM rar d JOIN rar_indep i ON i.business_id = d.business_id""",
        "rar",
        "rar_indep",
    ),
)
def stress_independence(spark, sf):
    """Each payer samples its own month instead of sharing one: dependence removed."""
    hist, _, cells, panel = parts(spark, sf)
    periods = scenarios.numbered_periods(panel)
    spine, opening = scenarios.point_spine(naive_path(hist)), ledger.opening_balance(hist, AS_OF)
    scen = scenarios.historical_scenarios(periods, SCENARIOS)
    dependent = scenarios.historical_paths(spine, opening, periods, scenarios.period_arrivals(cells, panel, periods, HORIZON), scen)
    own = F.pmod(F.col("scenario_id") * 31 + F.col("business_id") + 17 * F.col("counterparty_id"), F.col("n_periods"))
    sizes = scenarios.scenario_numbers(periods, SCENARIOS)
    months = panel.join(periods, ["business_id", "issue_period"]).select("business_id", "counterparty_id", "period_no", "delay_days")
    payers = panel.select("business_id", "counterparty_id").distinct().join(sizes, "business_id")
    drawn = payers.withColumn("period_no", own).join(months, ["business_id", "counterparty_id", "period_no"])
    day = F.floor(F.col("days_until_due") + F.col("delay_days"))
    arrivals = (
        cells.join(drawn, ["business_id", "counterparty_id"]).withColumn("day0", day)
        .filter(scenarios.landed(F.col("day0"), HORIZON))
        .groupBy("business_id", "scenario_id", (F.col("day0") + 1).alias("h")).agg(F.sum("due_u").alias("arrival_u"))
    )
    one_each = scen.select("business_id", "scenario_id").withColumn("period_no", F.col("scenario_id"))
    independent = scenarios.historical_paths(
        spine, opening, one_each.select("business_id", "period_no"), arrivals.withColumnRenamed("scenario_id", "period_no"), one_each
    )
    name = lambda d, tag: scenarios.runway_at_risk(scenarios.outcomes(d)).select(
        "business_id", F.col("runway_at_risk_days").alias(f"{tag}_days"), F.col("conditional_runway_at_risk_days").alias(f"{tag}_tail_days")
    )
    return shown(name(dependent, "dependent").join(name(independent, "independent"), "business_id"))


# Balance sheets from the ledger and open items; business 3, 10, 17, 24 leave earnings unknown.
cte(
    "sheets",
    f"""
SELECT o.business_id, round(o.opening_balance + coalesce(r.v, 0), 2) AS current_assets, round(t.o90, 2) AS current_liabilities,
  round(o.opening_balance + coalesce(r.v, 0) + t.i365, 2) AS total_assets, round(t.o90 * 2, 2) AS total_liabilities,
  CASE WHEN o.business_id % 7 <> 3 THEN round(t.n_all, 2) END AS retained_earnings, round(t.n365, 2) AS ebit
FROM opening o LEFT JOIN (SELECT business_id, sum(cents) / 100.0::DOUBLE AS v FROM open_items GROUP BY 1) r ON r.business_id = o.business_id
JOIN (SELECT business_id, CAST(sum(CASE WHEN date > DATE '{AS_OF}' - 90 THEN outflow_u ELSE 0 END) AS BIGINT) / 10000.0::DOUBLE AS o90,
   CAST(sum(CASE WHEN date > DATE '{AS_OF}' - 365 THEN receipts_u + sales_u ELSE 0 END) AS BIGINT) / 10000.0::DOUBLE AS i365,
   CAST(sum(CASE WHEN date > DATE '{AS_OF}' - 365 THEN receipts_u + sales_u - outflow_u ELSE 0 END) AS BIGINT) / 10000.0::DOUBLE AS n365,
   CAST(sum(receipts_u + sales_u - outflow_u) AS BIGINT) / 10000.0::DOUBLE AS n_all FROM hist GROUP BY 1) t ON t.business_id = o.business_id
""",
    "opening",
    "open_items",
    "hist",
)
cte(
    "altman",
    """
SELECT *, CASE WHEN reason IS NULL THEN 6.56 * x1 + 3.26 * x2 + 6.72 * x3 + 1.05 * x4 END AS z FROM (
 SELECT business_id, (current_assets - current_liabilities) / total_assets AS x1, retained_earnings / total_assets AS x2, ebit / total_assets AS x3,
  (total_assets - total_liabilities) / total_liabilities AS x4,
  CASE WHEN total_assets <= 0 THEN 'total_assets must be positive' WHEN total_liabilities <= 0 THEN 'total_liabilities must be positive'
       WHEN retained_earnings IS NULL THEN 'missing retained_earnings' END AS reason FROM sheets)
""",
    "sheets",
)
ZONE = "CASE WHEN reason IS NULL THEN CASE WHEN z > 2.6 THEN 'safe' WHEN z < 1.1 THEN 'distress' ELSE 'grey' END END"


def sheets(hist, inv):
    from ledgerloom.functions.money import amount, units

    day = lambda n: F.col("date") > F.date_sub(F.lit(AS_OF).cast("date"), n)
    s = lambda c, n=None: amount(F.sum(units(c) if n is None else F.when(day(n), units(c)).otherwise(0)))
    trail = hist.groupBy("business_id").agg(
        F.max_by("balance", "date").alias("cash"), s("outflow", 90).alias("o90"), s("inflow", 365).alias("i365"),
        s("net", 365).alias("n365"), s("net").alias("n_all"),
    )
    open_value = ledger.outstanding(inv, AS_OF).groupBy("business_id").agg(amount(F.sum(units("amount"))).alias("v"))
    assets = F.col("cash") + F.coalesce("v", F.lit(0.0))
    r2 = lambda c: F.round(c, 2)
    return trail.join(open_value, "business_id", "left").select(
        "business_id", r2(assets).alias("current_assets"), r2(F.col("o90")).alias("current_liabilities"),
        r2(assets + F.col("i365")).alias("total_assets"), r2(F.col("o90") * 2).alias("total_liabilities"),
        F.when(F.col("business_id") % 7 != 3, r2(F.col("n_all"))).alias("retained_earnings"), r2(F.col("n365")).alias("ebit"),
        F.lit(None).cast("double").alias("equity"),
    )


@query(
    "altman_z",
    twin(
        f"""SELECT business_id, round(z, 4) AS z_score, {ZONE} AS zone, CASE WHEN reason IS NULL THEN round(x1, 4) END AS x1, CASE WHEN reason IS NULL THEN round(x2, 4) END AS x2,
  CASE WHEN reason IS NULL THEN round(x3, 4) END AS x3, CASE WHEN reason IS NULL THEN round(x4, 4) END AS x4,
  CASE WHEN reason IS NULL THEN 'derived_from_ledger' END AS equity_provenance, reason AS reject_reason FROM altman""",
        "altman",
    ),
)
def altman_z(spark, sf):
    hist, inv, _, _ = parts(spark, sf)
    return shown(scenarios.altman_z(sheets(hist, inv)), digits=4)


@query(
    "agreement_report",
    twin(
        f"""SELECT business_id, headline, expected_days_to_ruin, z_score, zone, agreement,
  CASE WHEN zone IS NOT NULL THEN agreement || ': P(ruin) ' || printf('%.1f', round(headline * 100, 1)) || '% over {HORIZON} days, balance sheet ' || zone END AS agreement_text,
  'no Z''''-score: ' || reason AS caveat
FROM (SELECT *, CASE WHEN zone IS NULL THEN NULL WHEN headline >= 0.2 AND zone <> 'safe' THEN 'both stressed' WHEN headline >= 0.2 THEN 'solvent but illiquid'
   WHEN zone <> 'safe' THEN 'structural decline' ELSE 'both benign' END AS agreement FROM (
  SELECT c.business_id, round(c.p, 6) AS headline, round(e.e, 6) AS expected_days_to_ruin, round(a.z, 4) AS z_score, {ZONE} AS zone, a.reason
  FROM curve c JOIN (SELECT business_id, avg(fp) AS e FROM outcomes GROUP BY 1) e ON e.business_id = c.business_id
  JOIN altman a ON a.business_id = c.business_id WHERE c.horizon_days = {HORIZON}))""",
        "curve",
        "altman",
    ),
)
def agreement_report(spark, sf):
    hist, inv, _, _ = parts(spark, sf)
    out = cut_lineage(hist_outcomes(spark, sf))
    report = scenarios.failure_report(
        scenarios.ruin_curve(out, HORIZON), scenarios.expected_days_to_ruin(out).drop("n_ruined"), scenarios.altman_z(sheets(hist, inv)), HORIZON
    )
    return shown(report, z_score=4)


@query(
    "ruin_calibration",
    twin(
        f"""SELECT n, round(brier, 6) AS brier, round(base, 6) AS base_rate, round(mp, 6) AS mean_predicted, round(CASE WHEN base * (1 - base) > 0 THEN 1 - brier / (base * (1 - base)) ELSE 0 END, 6) AS skill,
  round(CASE WHEN np = 0 OR np = n THEN 0.5 ELSE (rs - np * (np + 1) / 2.0) / (np::DOUBLE * (n - np)) END, 6) AS auc
FROM (SELECT count(*) AS n, avg(pow(p - y, 2)) AS brier, avg(y) AS base, avg(p) AS mp, sum(y) AS np, sum(CASE WHEN y = 1 THEN rk END) AS rs FROM (
  SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM (
    SELECT c.p, CASE WHEN w.low <= 0 THEN 1 ELSE 0 END AS y FROM curve c JOIN (
      SELECT business_id, min(balance_u) AS low FROM ledger WHERE date > DATE '{AS_OF}' AND date <= DATE '{AS_OF}' + {HORIZON} GROUP BY 1) w
    ON w.business_id = c.business_id WHERE c.horizon_days = {HORIZON})))""",
        "curve",
        "ledger",
    ),
)
def ruin_calibration(spark, sf):
    curve = scenarios.ruin_curve(hist_outcomes(spark, sf), HORIZON).filter(F.col("horizon_days") == HORIZON)
    day = F.datediff("date", F.lit(AS_OF).cast("date"))
    realized = ledger_table(spark, sf).filter((day > 0) & (day <= HORIZON)).groupBy("business_id").agg(
        (F.min("balance") <= 0).cast("long").alias("label")
    )
    scored = cut_lineage(curve.join(realized, "business_id").select(F.col("ruin_probability").alias("score"), "label"))
    return shown(credit.brier_skill(scored).crossJoin(credit.roc_auc(scored).select("auc")))


@query("runway_bootstrap_se")
def runway_bootstrap_se(spark, sf):
    return shown(scenarios.bootstrap_se(hist_outcomes(spark, sf)))


def parametric(spark, sf, n_scenarios):
    hist, inv, cells, panel = parts(spark, sf)
    fits = delays.fit_delays(delays.delay_counts(ledger.settled(inv, AS_OF)))
    corr = delays.nearest_positive_definite(delays.spearman_pairs(panel))
    u = scenarios.copula_uniforms(spark, corr, n_scenarios, 42)
    return hist, cells, scenarios.copula_delays(u, delays.quantile_grid(fits))


@query("copula_delays")
def copula_delays(spark, sf):
    return shown(parametric(spark, sf, SCENARIOS)[2])


@query("parametric_runway")
def parametric_runway(spark, sf):
    hist, cells, drawn = parametric(spark, sf, SCENARIOS)
    paths = scenarios.parametric_paths(naive_path(hist), ledger.opening_balance(hist, AS_OF), cells, drawn, SCENARIOS, HORIZON, 42)
    return shown(scenarios.runway_at_risk(scenarios.outcomes(paths)))


@query("runway_convergence")
def runway_convergence(spark, sf):
    hist, cells, drawn = parametric(spark, sf, 400)
    paths = scenarios.parametric_paths(naive_path(hist), ledger.opening_balance(hist, AS_OF), cells, drawn, 400, HORIZON, 42)
    return shown(scenarios.convergence_study(scenarios.outcomes(paths), (50, 100, 200, 400)).select("business_id", "log_log_slope"))


@query("first_passage")
def first_passage(spark, sf):
    """Plug-in and predictive probability of reaching zero within the horizon."""
    p = first_passage_udf(float(HORIZON))
    inputs = cut_lineage(scenarios.first_passage_inputs(history_table(spark, sf)))
    draws = scenarios.predictive_draws(inputs, 2_000, 7).withColumn("p", p("opening", "mu", "sigma"))
    predictive = draws.groupBy("business_id").agg(F.avg("p").alias("predictive"))
    return shown(inputs.withColumn("plug_in", p("opening", "mu", "sigma")).join(predictive, "business_id", "left"))
