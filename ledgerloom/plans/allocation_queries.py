"""Allocation strategies, plans, replay and regret."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import allocation, backtest, delays, forecast, ledger
from ledgerloom.operators.forecast import Z_95
from ledgerloom.plans import ledger_queries  # noqa: F401  (defines the decision dates)
from ledgerloom.plans.base_sql import AS_OF, GRAIN, HORIZON, MIN_HISTORY, OBLIGATION_ROWS, STEP_DAYS, cte, twin
from ledgerloom.plans.forecast_queries import CV_HORIZON, N_FOLDS, VALUE
from ledgerloom.plans.registry import query, shown
from ledgerloom.plans.views import ledger_table
from ledgerloom.session import cut_lineage, ensure_checkpoint_dir
from ledgerloom.sources import summaries, tables

REPLAY_SCENARIOS = 3_000

_CATS = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS no, '{n}' AS name, {s} AS share, {f}::DOUBLE AS fee, '{x}' AS flexibility" for i, (n, s, f, x) in enumerate(allocation.CATEGORIES)
)
cte(
    "obligations",
    f"""
SELECT *, cents / 100.0::DOUBLE AS amount, cents * 100 AS need, fee * (30 - days_until_due) AS penalty_rate FROM (
  SELECT d.business_id, d.as_of, c.name || '-' || CAST(d.as_of AS VARCHAR) AS obligation_id, c.flexibility, c.fee,
    (CAST(round(d.trailing_outflow * 10000) AS BIGINT) * c.share + 5000) // 10000 AS cents,
    1 + (d.business_id * 7 + c.no * 11 + date_diff('day', DATE '1970-01-01', d.as_of)) % 29 AS days_until_due
  FROM decisions d CROSS JOIN ({_CATS}) c)
""",
    "decisions",
)
cte("instances", "SELECT business_id, as_of, CAST(round(greatest(0.0, opening_balance) * 10000) AS BIGINT) AS cash FROM decisions", "decisions")
cte("perfect", "SELECT business_id, as_of, CAST(round(realized_cash * 10000) AS BIGINT) AS cash FROM decisions", "decisions")
cte(
    "ranked",
    "SELECT *, row_number() OVER (PARTITION BY business_id, as_of ORDER BY penalty_rate DESC, days_until_due, amount DESC, obligation_id) AS rank FROM obligations",
    "obligations",
)
FOLD = """
SELECT business_id, as_of, {tag} 0::BIGINT AS rank, CAST(NULL AS VARCHAR) AS obligation_id, 0::BIGINT AS take, cash AS rest FROM {cash}
UNION ALL
SELECT business_id, as_of, {tag} rank, obligation_id, take, rest - take FROM (
  SELECT r.business_id, r.as_of, {rtag} r.rank, r.obligation_id, g.rest,
    CASE WHEN g.rest <= 0 THEN 0 WHEN r.flexibility = 'rigid' THEN CASE WHEN g.rest >= r.need THEN r.need ELSE 0 END ELSE least(r.need, g.rest) END AS take
  FROM {name} g JOIN {items} r ON r.business_id = g.business_id AND r.as_of = g.as_of {join} AND r.rank = g.rank + 1)
"""
cte("greedy", FOLD.format(tag="", rtag="", cash="instances", name="greedy", items="ranked", join=""), "instances", "ranked")
cte("rigid", "SELECT *, row_number() OVER (PARTITION BY business_id, as_of ORDER BY obligation_id) - 1 AS pos FROM obligations WHERE flexibility = 'rigid'", "obligations")
cte(
    "flex",
    """SELECT *, coalesce(sum(need) OVER (PARTITION BY business_id, as_of ORDER BY penalty_rate DESC, obligation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM obligations WHERE flexibility <> 'rigid'""",
    "obligations",
)


def _exact(name: str, cash: str) -> None:
    cte(
        name,
        f"""
SELECT b.business_id, b.as_of, o.obligation_id, CAST(CASE WHEN o.flexibility = 'rigid' THEN CASE WHEN (b.m >> o.pos) & 1 = 1 THEN o.need ELSE 0 END
   ELSE greatest(0, least(o.need, b.rest - o.before)) END AS BIGINT) AS take
FROM (SELECT business_id, as_of, m, rest FROM (
   SELECT k.business_id, k.as_of, k.m, k.rest, row_number() OVER (PARTITION BY k.business_id, k.as_of ORDER BY round(k.missed
      + sum(f.penalty_rate * (f.need - greatest(0, least(f.need, k.rest - f.before))) / 10000.0::DOUBLE), 6), k.m) AS rn
   FROM (SELECT i.business_id, i.as_of, m, i.cash - sum(CASE WHEN (m >> r.pos) & 1 = 1 THEN r.need ELSE 0 END) AS rest,
           sum(CASE WHEN (m >> r.pos) & 1 = 1 THEN 0 ELSE r.penalty_rate * (r.need / 10000.0::DOUBLE) END) AS missed
         FROM {cash} i CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS m) JOIN rigid r ON r.business_id = i.business_id AND r.as_of = i.as_of
         GROUP BY i.business_id, i.as_of, m, i.cash) k
   JOIN flex f ON f.business_id = k.business_id AND f.as_of = k.as_of WHERE k.rest >= 0 GROUP BY k.business_id, k.as_of, k.m, k.rest, k.missed) WHERE rn = 1) b
JOIN (SELECT business_id, as_of, obligation_id, flexibility, need, pos, 0 AS before FROM rigid UNION ALL SELECT business_id, as_of, obligation_id, flexibility, need, 0, before FROM flex) o
  ON o.business_id = b.business_id AND o.as_of = b.as_of
""",
        cash,
        "rigid",
        "flex",
    )


_exact("exact", "instances")
_exact("hind", "perfect")


def _replay(tag: str, decisions: str, grain: str) -> None:
    """Panel, scenarios and limits of decision dates, written scenario by scenario, with periods of a grain."""
    cte(
        f"as_of_points{tag}",
        f"""SELECT d.business_id, d.as_of, g.h, l.sales_u - l.outflow_u AS point_u FROM {decisions} d CROSS JOIN (SELECT unnest(generate_series(1, {HORIZON})) AS h) g
JOIN ledger l ON l.business_id = d.business_id AND l.date = d.as_of - CAST(6 - (g.h - 1) % 7 AS INTEGER)""",
        decisions, "ledger",
    )
    cte(
        f"as_of_panel{tag}",
        f"""SELECT d.business_id, d.as_of, p.counterparty_id, date_trunc('{grain}', p.issue_date) AS issue_month, avg(p.delay_days) AS delay_days
FROM {decisions} d JOIN payments p ON p.business_id = d.business_id AND p.paid AND p.paid_date <= d.as_of GROUP BY 1, 2, 3, 4""",
        decisions, "payments",
    )
    cte(
        f"as_of_periods{tag}",
        f"""SELECT business_id, as_of, issue_month, row_number() OVER (PARTITION BY business_id, as_of ORDER BY issue_month) - 1 AS period_no,
  count(*) OVER (PARTITION BY business_id, as_of) AS n_periods FROM (SELECT DISTINCT business_id, as_of, issue_month FROM as_of_panel{tag})""",
        f"as_of_panel{tag}",
    )
    cte(
        f"as_of_arrivals{tag}",
        f"""SELECT d.business_id, d.as_of, q.period_no, CAST(floor(date_diff('day', d.as_of, i.due_date) + c.delay_days) AS BIGINT) + 1 AS h, sum(i.cents * 100) AS arrival_u
FROM {decisions} d JOIN payments i ON i.business_id = d.business_id AND i.issue_date <= d.as_of AND NOT coalesce(i.paid AND i.paid_date <= d.as_of, FALSE)
JOIN as_of_panel{tag} c ON c.business_id = d.business_id AND c.as_of = d.as_of AND c.counterparty_id = i.counterparty_id
JOIN as_of_periods{tag} q ON q.business_id = c.business_id AND q.as_of = c.as_of AND q.issue_month = c.issue_month
WHERE floor(date_diff('day', d.as_of, i.due_date) + c.delay_days) BETWEEN 0 AND {HORIZON - 1} GROUP BY 1, 2, 3, 4""",
        decisions, "payments", f"as_of_panel{tag}", f"as_of_periods{tag}",
    )
    cte(
        f"as_of_outcomes{tag}",
        f"""
SELECT m.business_id, m.as_of, m.mc, m.days FROM (
  SELECT business_id, as_of, period_no, min(balance) AS mc, coalesce(min(CASE WHEN balance <= 0 THEN h END), {HORIZON}) AS days FROM (
   SELECT p.business_id, p.as_of, n.period_no, p.h, (CAST(round(d.opening_balance * 10000) AS BIGINT) + CAST(sum(p.point_u + coalesce(a.arrival_u, 0)) OVER (
     PARTITION BY p.business_id, p.as_of, n.period_no ORDER BY p.h ROWS UNBOUNDED PRECEDING) AS BIGINT)) / 10000.0::DOUBLE AS balance
   FROM as_of_points{tag} p JOIN {decisions} d ON d.business_id = p.business_id AND d.as_of = p.as_of
   JOIN (SELECT DISTINCT business_id, as_of, period_no FROM as_of_periods{tag}) n ON n.business_id = p.business_id AND n.as_of = p.as_of
   LEFT JOIN as_of_arrivals{tag} a ON a.business_id = p.business_id AND a.as_of = p.as_of AND a.period_no = n.period_no AND a.h = p.h) GROUP BY 1, 2, 3) m
 JOIN (SELECT n.business_id, n.as_of, (sc.scenario_id * 31 + n.business_id) % n.n_periods AS period_no
  FROM (SELECT DISTINCT business_id, as_of, n_periods FROM as_of_periods{tag}) n
  CROSS JOIN (SELECT unnest(generate_series(0, {REPLAY_SCENARIOS - 1})) AS scenario_id) sc) c
 ON c.business_id = m.business_id AND c.as_of = m.as_of AND c.period_no = m.period_no
""",
        f"as_of_points{tag}", f"as_of_arrivals{tag}", f"as_of_periods{tag}", decisions,
    )
    cte(
        f"limits{tag}",
        f"""SELECT business_id, as_of, greatest(0.0, floor(quantile_cont(mc, 0.05) * 10000 + 0.001) / 10000) AS safe_spend, avg(CASE WHEN mc < 0 THEN 1.0::DOUBLE ELSE 0 END) AS base
FROM as_of_outcomes{tag} GROUP BY 1, 2""",
        f"as_of_outcomes{tag}",
    )
    cte(
        f"as_of_runway{tag}",
        f"""SELECT business_id, as_of, CAST(floor(any_value(q)) AS BIGINT) AS rar, avg(CASE WHEN days <= q THEN days END) AS crar
FROM as_of_outcomes{tag} JOIN (SELECT business_id, as_of, quantile_cont(days, 0.05) AS q FROM as_of_outcomes{tag} GROUP BY 1, 2) USING (business_id, as_of) GROUP BY 1, 2""",
        f"as_of_outcomes{tag}",
    )


_replay("", "decisions", GRAIN)
cte("now_only", f"SELECT business_id, DATE '{AS_OF}' AS as_of, opening_balance FROM opening", "opening")
_replay("_weeks", "now_only", "week")
cte(
    "as_of_panel_days",
    """SELECT d.business_id, d.as_of, p.counterparty_id, p.issue_date, avg(p.delay_days) AS delay_days
FROM decisions d JOIN payments p ON p.business_id = d.business_id AND p.paid AND p.paid_date <= d.as_of GROUP BY 1, 2, 3, 4""",
    "decisions",
    "payments",
)
cte("capped", "SELECT i.business_id, i.as_of, least(i.cash, CAST(round(l.safe_spend * 10000) AS BIGINT)) AS cash FROM instances i JOIN limits l ON l.business_id = i.business_id AND l.as_of = i.as_of", "instances", "limits")
_exact("chance", "capped")
cte(
    "plans",
    """SELECT o.business_id, o.as_of, t.strategy, o.obligation_id, o.amount, o.need AS full_need, o.penalty_rate, o.flexibility, o.days_until_due,
  round(t.take / 10000.0::DOUBLE, 2) AS allocated, t.take = o.need AS funded, o.penalty_rate * ((o.need - t.take) / 10000.0::DOUBLE) AS penalty
FROM obligations o JOIN (SELECT 'rules_baseline' AS strategy, business_id, as_of, obligation_id, take FROM greedy WHERE rank > 0
  UNION ALL SELECT 'exact', business_id, as_of, obligation_id, take FROM exact
  UNION ALL SELECT 'chance_constrained', business_id, as_of, obligation_id, take FROM chance) t
ON t.business_id = o.business_id AND t.as_of = o.as_of AND t.obligation_id = o.obligation_id""",
    "obligations",
    "greedy",
    "exact",
    "chance",
)
cte(
    "committed",
    """SELECT business_id, as_of, strategy, obligation_id, flexibility, CAST(round(allocated * 10000) AS BIGINT) AS need,
  row_number() OVER (PARTITION BY business_id, as_of, strategy ORDER BY penalty_rate DESC, obligation_id) AS rank FROM plans WHERE allocated > 0""",
    "plans",
)
cte("perfect3", "SELECT p.business_id, p.as_of, s.strategy, p.cash FROM perfect p CROSS JOIN (SELECT DISTINCT strategy FROM plans) s", "perfect", "plans")
cte(
    "honoured",
    FOLD.format(tag="strategy,", rtag="r.strategy,", cash="perfect3", name="honoured", items="committed", join="AND r.strategy = g.strategy"),
    "perfect3",
    "committed",
)
cte(
    "steps",
    """
SELECT p.business_id, p.as_of, p.strategy, p.realized, h.pen AS hindsight, p.realized - h.pen AS regret, p.planned, d.realized_cash, p.planned > d.realized_cash + 1.0 AS over
FROM (SELECT q.business_id, q.as_of, q.strategy, sum(q.penalty_rate * ((q.full_need - coalesce(k.take, 0)) / 10000.0::DOUBLE)) AS realized, sum(q.allocated) AS planned
      FROM plans q LEFT JOIN honoured k ON k.rank > 0 AND k.business_id = q.business_id AND k.as_of = q.as_of AND k.strategy = q.strategy AND k.obligation_id = q.obligation_id GROUP BY 1, 2, 3) p
JOIN (SELECT o.business_id, o.as_of, sum(o.penalty_rate * ((o.need - x.take) / 10000.0::DOUBLE)) AS pen FROM obligations o
      JOIN hind x ON x.business_id = o.business_id AND x.as_of = o.as_of AND x.obligation_id = o.obligation_id GROUP BY 1, 2) h ON h.business_id = p.business_id AND h.as_of = p.as_of
JOIN decisions d ON d.business_id = p.business_id AND d.as_of = p.as_of
""",
    "plans",
    "honoured",
    "hind",
    "decisions",
)
ALLOC = """SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, strategy, obligation_id, amount, round(penalty_rate, 6) AS penalty_rate, flexibility, days_until_due,
  allocated AS allocated_amount, funded AS fully_funded, round(penalty, 6) AS penalty FROM plans WHERE strategy = '{}'"""
TEXT = {"amount": 2, "allocated_amount": 2}


def decisions(spark, sf):
    return cut_lineage(ledger.decision_points(cut_lineage(ledger_table(spark, sf)), STEP_DAYS, HORIZON, MIN_HISTORY, OBLIGATION_ROWS))


def problem(spark, sf):
    d = decisions(spark, sf)
    return d, allocation.template_obligations(d), allocation.template_instances(d)


def walks(spark, sf, led, d, grain=GRAIN):
    inv = tables.invoices(spark, sf)
    return cut_lineage(backtest.scenario_walks(
        backtest.naive_points(led, d, "net_ex_receipts", HORIZON), d, cut_lineage(backtest.open_cells(inv, d)),
        cut_lineage(delays.asof_panel(inv, d, grain)), REPLAY_SCENARIOS, HORIZON,
    ))


def limits(spark, sf, led, d, grain=GRAIN):
    return backtest.safe_spend_limits(walks(spark, sf, led, d, grain))


def replay(spark, sf, names):
    led = cut_lineage(ledger_table(spark, sf))
    d = cut_lineage(ledger.decision_points(led, STEP_DAYS, HORIZON, MIN_HISTORY, OBLIGATION_ROWS))
    obligations = cut_lineage(allocation.template_obligations(d))
    cap = cut_lineage(limits(spark, sf, led, d)) if "chance_constrained" in names else None
    plans = backtest.run_strategies(names, obligations, allocation.template_instances(d), cap)
    return d, obligations, cut_lineage(plans)


CHECKED = ["rules_baseline", "exact", "chance_constrained"]


@query(
    "priority_rank",
    twin(
        """SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, obligation_id, amount, round(penalty_rate, 6) AS penalty_rate, flexibility, days_until_due, rank FROM ranked""",
        "ranked",
    ),
)
def priority_rank(spark, sf):
    return shown(allocation.priority_rank(problem(spark, sf)[1]).drop("reason"))


@query("greedy_allocation", twin(ALLOC.format("rules_baseline"), "plans"))
def greedy_allocation(spark, sf):
    _, o, i = problem(spark, sf)
    return shown(allocation.greedy_allocation(o, i), **TEXT)


@query("exact_allocation", twin(ALLOC.format("exact"), "plans"))
def exact_allocation(spark, sf):
    _, o, i = problem(spark, sf)
    return shown(allocation.exact_allocation(o, i), **TEXT)


@query(
    "replay_safe_spend",
    twin("SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, safe_spend, round(base, 6) AS baseline_shortfall FROM limits", "limits"),
)
def replay_safe_spend(spark, sf):
    led = cut_lineage(ledger_table(spark, sf))
    d = cut_lineage(ledger.decision_points(led, STEP_DAYS, HORIZON, MIN_HISTORY, OBLIGATION_ROWS))
    return shown(limits(spark, sf, led, d))


@query(
    "asof_panel_issue_dates",
    twin(
        """SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, counterparty_id, count(*) AS n_periods, round(avg(delay_days), 6) AS mean_delay, min(delay_days) AS shortest, max(delay_days) AS longest,
  CAST(max(issue_date) AS VARCHAR) AS last_issue_date FROM as_of_panel_days GROUP BY 1, 2, 3""",
        "as_of_panel_days",
    ),
)
def asof_panel_issue_dates(spark, sf):
    """The as-of panel by issue date, summed up for each decision date and payer."""
    panel = delays.asof_panel(tables.invoices(spark, sf), decisions(spark, sf))
    d = F.col("delay_days")
    return shown(panel.groupBy("business_id", "as_of", "counterparty_id").agg(
        F.count(F.lit(1)).alias("n_periods"), F.avg(d).alias("mean_delay"), F.min(d).alias("shortest"), F.max(d).alias("longest"), F.max("issue_period").alias("last_issue_date"),
    ))


@query(
    "runway_at_risk_weeks",
    twin(
        """SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, rar AS runway_at_risk_days, round(crar, 6) AS conditional_runway_at_risk_days, safe_spend, round(base, 6) AS baseline_shortfall
FROM as_of_runway_weeks JOIN limits_weeks USING (business_id, as_of)""",
        "as_of_runway_weeks",
        "limits_weeks",
    ),
)
def runway_at_risk_weeks(spark, sf):
    """Runway and safe spend at one date from scenarios that sample past issue weeks."""
    led = cut_lineage(ledger_table(spark, sf))
    d = cut_lineage(ledger.opening_balance(led, AS_OF).select("business_id", F.lit(AS_OF).cast("date").alias("as_of"), "opening_balance"))
    w = walks(spark, sf, led, d, "week")
    return shown(backtest.replay_runway(w, HORIZON).join(backtest.safe_spend_limits(w), backtest.VIEW))


CALIBRATED = """SELECT d.business_id, d.as_of, d.history_rows + 1 AS n, greatest((d.history_rows + 1) // 2, 28) AS mt FROM decisions d"""
cte("led_numbered", "SELECT business_id, y, row_number() OVER (PARTITION BY business_id ORDER BY date) - 1 AS idx FROM ledger", "ledger")
cte(
    "as_of_resid",
    f"""
SELECT f.business_id, f.as_of, f.fold, f.h, a.y - p.y AS residual FROM (
  SELECT business_id, as_of, fold, h, train_end + h - 1 AS target, train_end - 7 + (h - 1) % 7 AS source FROM (
    SELECT business_id, as_of, fold, n - (k - 1 - fold) * {CV_HORIZON} - {CV_HORIZON} AS train_end, mt FROM (
      SELECT business_id, as_of, n, mt, k, unnest(generate_series(0, k - 1)) AS fold FROM (
        SELECT *, greatest(1, least({N_FOLDS}, (n - mt) // {CV_HORIZON})) AS k FROM ({CALIBRATED}) WHERE n - mt >= {CV_HORIZON})))
  CROSS JOIN (SELECT unnest(generate_series(1, {CV_HORIZON})) AS h) WHERE train_end >= mt) f
LEFT JOIN led_numbered a ON a.business_id = f.business_id AND a.idx = f.target
LEFT JOIN led_numbered p ON p.business_id = f.business_id AND p.idx = f.source
""",
    "decisions",
    "led_numbered",
)
cte(
    "as_of_qhat",
    """
SELECT business_id, as_of, list_extract(sc, least(rank, n)) AS q_hat FROM (
  SELECT business_id, as_of, count(*) AS n, CAST(ceil((count(*) + 1) * 0.95) AS BIGINT) AS rank, list(score ORDER BY score) AS sc FROM (
    SELECT r.business_id, r.as_of, abs(r.residual) / (p.a * pow(r.h, p.gamma)) AS score FROM as_of_resid r JOIN (
      SELECT business_id, as_of, exp(regr_intercept(ln(rms), ln(h))) AS a, greatest(0.0, least(1.0, regr_slope(ln(rms), ln(h)))) AS gamma
      FROM (SELECT business_id, as_of, h, greatest(sqrt(avg(residual * residual)), 1e-9) AS rms FROM as_of_resid GROUP BY 1, 2, 3) GROUP BY 1, 2) p USING (business_id, as_of)) GROUP BY 1, 2)
""",
    "as_of_resid",
)


def calibration(led, d):
    """Conformal multiplier of every decision date, from the folds before it."""
    keys = ["business_id", "as_of", "model"]
    resid = cut_lineage(forecast.naive_residuals(led, forecast.asof_folds(d, CV_HORIZON, N_FOLDS), VALUE, CV_HORIZON, ["business_id", "as_of"]))
    return forecast.conformal_multiplier(forecast.profile_scored(resid, forecast.scale_profile(resid, keys=keys), keys), keys=keys)


@query(
    "usage_rollup",
    twin(
        f"""SELECT CASE WHEN grouping(forecast_model) = 0 THEN 'model' WHEN grouping(strategy) = 0 THEN 'strategy' ELSE 'all' END AS group_kind, forecast_model, strategy, count(*) AS n_steps,
  round(avg(q_hat), 6) AS mean_q_hat, round(avg(q_hat) / {Z_95}, 6) AS scale_ratio, round(min(q_hat), 6) AS min_q_hat, round(max(q_hat), 6) AS max_q_hat,
  min(rar) AS min_runway_at_risk, quantile_cont(rar, 0.5) AS median_runway_at_risk, max(rar) AS max_runway_at_risk,
  round(min(crar), 6) AS min_conditional_runway, round(quantile_cont(crar, 0.5), 6) AS median_conditional_runway, round(max(crar), 6) AS max_conditional_runway
FROM (SELECT s.*, 'seasonal_naive' AS forecast_model, r.rar, r.crar, q.q_hat FROM steps s JOIN as_of_runway r USING (business_id, as_of) JOIN as_of_qhat q USING (business_id, as_of))
GROUP BY GROUPING SETS ((forecast_model), (strategy), ())""",
        "steps",
        "as_of_runway",
        "as_of_qhat",
    ),
)
def usage_rollup(spark, sf):
    led = cut_lineage(ledger_table(spark, sf))
    d = cut_lineage(ledger.decision_points(led, STEP_DAYS, HORIZON, MIN_HISTORY, OBLIGATION_ROWS))
    w = walks(spark, sf, led, d)
    obligations = cut_lineage(allocation.template_obligations(d))
    plans = backtest.run_strategies(CHECKED, obligations, allocation.template_instances(d), cut_lineage(backtest.safe_spend_limits(w)))
    steps = backtest.step_regret(cut_lineage(plans), obligations, d)
    return shown(backtest.usage_summary(backtest.step_table(steps, backtest.replay_runway(w, HORIZON), calibration(led, d))))


@query("chance_constrained", twin(ALLOC.format("chance_constrained"), "plans"))
def chance_constrained(spark, sf):
    _, _, plans = replay(spark, sf, ["chance_constrained"])
    return shown(plans, **TEXT)


@query("grid_dp")
def grid_dp(spark, sf):
    _, o, i = problem(spark, sf)
    return shown(allocation.grid_dp(o, i))


@query("solver_agreement")
def solver_agreement(spark, sf):
    _, o, i = problem(spark, sf)
    return shown(allocation.solver_agreement(o, allocation.exact_allocation(o, i), allocation.grid_dp(o, i)))


@query(
    "allocation_feasibility",
    twin(
        """SELECT p.business_id, CAST(p.as_of AS VARCHAR) AS as_of, p.strategy, bool_and(allocated BETWEEN -0.01 AND amount + 0.01
  AND (flexibility <> 'rigid' OR abs(allocated) <= 0.01 OR abs(allocated - amount) <= 0.01)) AND sum(allocated) <= any_value(i.cash) / 10000.0::DOUBLE + count(*) * 0.01 AS feasible
FROM plans p JOIN instances i ON i.business_id = p.business_id AND i.as_of = p.as_of WHERE strategy <> 'chance_constrained' GROUP BY 1, 2, 3""",
        "plans",
        "instances",
    ),
)
def allocation_feasibility(spark, sf):
    _, o, i = problem(spark, sf)
    return shown(allocation.feasibility(backtest.run_strategies(["rules_baseline", "exact"], o, i, None), i))


@query(
    "optimizer_lift",
    twin(
        """SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, round(b, 6) AS baseline_penalty, round(x, 6) AS optimized_penalty, round(b - x, 6) + 0.0 AS penalty_saved,
  round(CASE WHEN b > 0 THEN (b - x) / b * 100 ELSE 0 END, 6) + 0.0 AS penalty_saved_pct
FROM (SELECT business_id, as_of, sum(CASE WHEN strategy = 'rules_baseline' THEN penalty END) AS b, sum(CASE WHEN strategy = 'exact' THEN penalty END) AS x FROM plans GROUP BY 1, 2)""",
        "plans",
    ),
)
def optimizer_lift(spark, sf):
    _, o, i = problem(spark, sf)
    return shown(allocation.optimizer_lift(allocation.objective(backtest.run_strategies(["rules_baseline", "exact"], o, i, None)), "rules_baseline", "exact"))


@query(
    "solver_comparison",
    twin(
        """SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, strategy, round(sum(penalty), 8) AS objective, round(sum(allocated), 2) AS planned_spend,
  count(*) FILTER (WHERE funded) AS n_funded FROM plans GROUP BY 1, 2, 3""",
        "plans",
    ),
)
def solver_comparison(spark, sf):
    return shown(allocation.objective(replay(spark, sf, CHECKED)[2]), objective=8, planned_spend=2)


@query(
    "plan_status",
    twin(
        """SELECT p.*, round(l.safe_spend, 6) AS safe_spend, round(l.base, 6) AS baseline_shortfall, CASE WHEN l.base > 0.05 THEN 'infeasible' ELSE 'feasible' END AS status
FROM (SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, strategy, round(sum(penalty), 8) AS objective, round(sum(allocated), 2) AS planned_spend, count(*) FILTER (WHERE funded) AS n_funded
  FROM plans WHERE strategy = 'chance_constrained' GROUP BY 1, 2, 3) p JOIN limits l ON l.business_id = p.business_id AND CAST(l.as_of AS VARCHAR) = p.as_of""",
        "plans",
        "limits",
    ),
)
def plan_status(spark, sf):
    led = cut_lineage(ledger_table(spark, sf))
    d = cut_lineage(ledger.decision_points(led, STEP_DAYS, HORIZON, MIN_HISTORY, OBLIGATION_ROWS))
    cap = cut_lineage(limits(spark, sf, led, d))
    plans = backtest.run_strategies(["chance_constrained"], cut_lineage(allocation.template_obligations(d)), allocation.template_instances(d), cap)
    return shown(allocation.plan_status(allocation.objective(plans), cap), objective=8, planned_spend=2)


LABEL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in allocation.LABELS.items()) + " END"
cte(
    "plan_rows",
    f"""SELECT *, {LABEL} AS label, CASE WHEN allocated >= amount - 0.01 THEN 'pay_now' WHEN allocated > 0.01 THEN 'pay_partial' ELSE 'defer' END AS action_type,
  CASE WHEN amount - allocated > 0.01 THEN amount - allocated ELSE 0.0 END AS shortfall,
  CASE WHEN days_until_due <= 0 THEN 'no days left' WHEN days_until_due = 1 THEN '1 day left' WHEN days_until_due <= 7 THEN days_until_due || ' days left'
    ELSE 'over ' || (days_until_due // 7) || CASE WHEN days_until_due // 7 > 1 THEN ' weeks left' ELSE ' week left' END END AS due,
  penalty_rate * CASE WHEN amount - allocated > 0.01 THEN amount - allocated ELSE amount END AS fee
FROM (SELECT *, regexp_replace(obligation_id, '-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$', '') AS category FROM plans WHERE strategy = 'exact')""",
    "plans",
)
_N = "format('{{:,}}', CAST(floor({} + 0.5) AS BIGINT))"


@query(
    "payment_plan",
    twin(
        f"""SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, obligation_id, label, category, action_type, amount AS amount_due, allocated AS allocated_amount, round(shortfall, 2) AS shortfall,
  days_until_due, flexibility = 'rigid' AS is_rigid, round(fee, 6) AS late_fee_if_unpaid,
  label || ', ' || due || ': ' || CASE action_type WHEN 'pay_now' THEN 'settle all' || CASE WHEN flexibility = 'rigid' THEN ' (no part payment)' ELSE '' END || '; fee avoided ' || {_N.format('fee')}
   WHEN 'pay_partial' THEN 'settle ' || {_N.format('allocated')} || ', carry over ' || {_N.format('amount - allocated')} ELSE 'wait; fee ' || {_N.format('fee')} || ', others cost more' END AS justification,
  row_number() OVER (PARTITION BY business_id, as_of ORDER BY days_until_due, obligation_id) AS place FROM plan_rows""",
        "plan_rows",
    ),
)
def payment_plan(spark, sf):
    _, o, i = problem(spark, sf)
    return shown(allocation.payment_plan(allocation.exact_allocation(o, i)), digits=2, late_fee_if_unpaid=6)


@query(
    "plan_summary",
    twin(
        """SELECT r.business_id, CAST(r.as_of AS VARCHAR) AS as_of, count(*) AS n_obligations, count(*) FILTER (WHERE action_type = 'pay_now') AS n_paid_in_full,
  round(sum(CASE WHEN shortfall > 0.01 THEN fee ELSE 0 END), 6) AS expected_late_fees, round(greatest(0.0, sum(amount) - any_value(i.cash) / 10000.0::DOUBLE), 6) AS shortfall
FROM plan_rows r JOIN instances i ON i.business_id = r.business_id AND i.as_of = r.as_of GROUP BY 1, 2""",
        "plan_rows",
        "instances",
    ),
)
def plan_summary(spark, sf):
    _, o, i = problem(spark, sf)
    return shown(allocation.plan_summary(allocation.payment_plan(allocation.exact_allocation(o, i)), i))


STEP = """SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, strategy, round(realized, 8) AS realized_penalty, round(hindsight, 8) AS hindsight_penalty, round(regret, 8) + 0.0 AS regret,
  round(planned, 2) AS planned_spend, realized_cash, over AS over_committed FROM steps"""


@query("backtest_steps", twin(STEP, "steps"))
def backtest_steps(spark, sf):
    d, o, plans = replay(spark, sf, CHECKED)
    return shown(backtest.step_regret(plans, o, d), digits=8, planned_spend=2)


@query(
    "regret_metrics",
    twin(
        """SELECT business_id, strategy, count(*) AS n_steps, round(avg(regret), 8) + 0.0 AS mean_regret, round(quantile_cont(regret, 0.5), 8) + 0.0 AS median_regret, round(quantile_cont(regret, 0.95), 8) + 0.0 AS p95_regret,
  round(sum(realized), 8) AS total_realized_penalty, round(sum(hindsight), 8) AS total_hindsight_penalty,
  round(CASE WHEN sum(hindsight) > 0 THEN (sum(realized) - sum(hindsight)) / sum(hindsight) ELSE 0 END, 8) AS relative_regret FROM steps GROUP BY 1, 2""",
        "steps",
    ),
)
def regret_metrics(spark, sf):
    d, o, plans = replay(spark, sf, CHECKED)
    return shown(backtest.regret_metrics(backtest.step_regret(plans, o, d)), digits=8)


@query(
    "overcommit_summary",
    twin(
        """SELECT strategy, n AS n_steps, round(t, 6) AS total_realized_penalty, o AS over_commitment_steps, round((t - b) / b, 6) AS vs_baseline, strategy = best AS cheapest
FROM (SELECT strategy, count(*) AS n, sum(realized) AS t, count(*) FILTER (WHERE over) AS o FROM steps GROUP BY 1)
CROSS JOIN (SELECT sum(CASE WHEN strategy = 'rules_baseline' THEN realized END) AS b FROM steps)
CROSS JOIN (SELECT arg_min(strategy, t) AS best FROM (SELECT strategy, sum(realized) AS t FROM steps GROUP BY 1))""",
        "steps",
    ),
)
def overcommit_summary(spark, sf):
    d, o, plans = replay(spark, sf, CHECKED)
    return shown(backtest.strategy_summary(backtest.step_regret(plans, o, d)))


@query("backtest_four_strategies")
def backtest_four_strategies(spark, sf):
    d, o, plans = replay(spark, sf, [*CHECKED, "grid_dp"])
    return shown(backtest.strategy_summary(backtest.step_regret(plans, o, d)))


@query(
    "summary_roundtrip",
    twin(
        """SELECT business_id, strategy, n_steps, total_realized_penalty, CAST(n_steps AS BIGINT) AS series_length FROM (
  SELECT business_id, strategy, count(*) AS n_steps, round(sum(realized), 8) AS total_realized_penalty FROM steps WHERE strategy <> 'chance_constrained' GROUP BY 1, 2)""",
        "steps",
    ),
)
def summary_roundtrip(spark, sf):
    """Write the nested summary as JSON and read it back under its schema."""
    ensure_checkpoint_dir(spark)
    d, o, plans = replay(spark, sf, ["rules_baseline", "exact"])
    doc = backtest.summary_document(backtest.step_regret(plans, o, d))
    path = f"{spark.sparkContext.getCheckpointDir()}/summary-{uuid.uuid4().hex}"
    summaries.write_summary(doc, path)
    back = summaries.read_summary(spark, path, doc.schema)
    return shown(back.select("business_id", "strategy", "n_steps", "total_realized_penalty", F.size("regret_series").alias("series_length")), digits=8)
