"""Replay over decision dates: as-of views as a column, strategies as a union, regret."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import amount, units
from ledgerloom.operators import allocation
from ledgerloom.operators.forecast import SEASON, Z_95

VIEW = ["business_id", "as_of"]


def naive_points(ledger: DataFrame, decisions: DataFrame, value: str, horizon: int) -> DataFrame:
    """Seasonal-naive path of every decision date from seven lags of one window."""
    w = Window.partitionBy("business_id").orderBy("date")
    cycle = F.array(*[F.lag(value, SEASON - 1 - i).over(w) for i in range(SEASON)])
    rows = ledger.select("business_id", F.col("date").alias("as_of"), cycle.alias("cycle"))
    return (
        rows.join(decisions.select(*VIEW), VIEW, "left_semi")
        .withColumn("h", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))
        .select(*VIEW, "h", units(F.element_at("cycle", ((F.col("h") - 1) % SEASON + 1).cast("int"))).alias("point_u"))
    )


def month_no(d) -> F.Column:
    return F.year(d) * 12 + F.month(d)


def open_cells(payments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Receivables outstanding at every decision date, summed per payer and days until due.

    An invoice meets only the decision months between its issue and the last date from
    which its cash could still land (due date plus the longest delay seen), through an
    equi-join on the month.
    """
    longest = payments.filter("paid").agg(F.max("delay_days").alias("_longest"))
    last = F.least(
        F.coalesce(F.date_sub("paid_date", 1), F.date_add("due_date", F.col("_longest").cast("int"))),
        F.date_add("due_date", F.col("_longest").cast("int")),
    )
    spread = (
        payments.crossJoin(F.broadcast(longest))
        .withColumn("_last", last)
        .filter(F.col("_last") >= F.col("issue_date"))
        .select(
            "business_id", "counterparty_id", "issue_date", "due_date", "_last", units("amount").alias("_u"),
            F.explode(F.sequence(month_no("issue_date"), month_no("_last"))).alias("_month"),
        )
    )
    d = decisions.select(*VIEW, month_no("as_of").alias("_month"))
    hit = spread.join(d, ["business_id", "_month"]).filter((F.col("issue_date") <= F.col("as_of")) & (F.col("as_of") <= F.col("_last")))
    return hit.groupBy(*VIEW, "counterparty_id", F.datediff("due_date", "as_of").cast("long").alias("days_until_due")).agg(F.sum("_u").alias("due_u"))


def scenario_walks(points: DataFrame, decisions: DataFrame, cells: DataFrame, panel: DataFrame, n_scenarios: int, horizon: int) -> DataFrame:
    """Historical scenarios of every decision date: their weight, lowest cash and first day without cash.

    Scenarios that sample the same period share a path; its weight is how many scenarios chose it.
    ``panel`` is an as-of panel of any grain.
    """
    sampled = panel.select(*VIEW, "issue_period").distinct()
    w = Window.partitionBy(*VIEW).orderBy("issue_period")
    n = F.count(F.lit(1)).over(Window.partitionBy(*VIEW))
    numbered = sampled.withColumn("period_no", F.row_number().over(w) - 1).withColumn("n_periods", n)
    periods = numbered.withColumn("weight", period_weight(n_scenarios)).filter(F.col("weight") > 0)
    day = F.floor(F.col("days_until_due") + F.col("delay_days"))
    arrivals = (
        cells.join(panel, [*VIEW, "counterparty_id"])
        .withColumn("_day", day)
        .filter((F.col("_day") >= 0) & (F.col("_day") < horizon))
        .groupBy(*VIEW, "issue_period", (F.col("_day") + 1).alias("h"))
        .agg(F.sum("due_u").alias("arrival_u"))
    )
    flows = (
        periods.join(points, VIEW)
        .join(arrivals, [*VIEW, "issue_period", "h"], "left")
        .withColumn("flow_u", F.col("point_u") + F.coalesce("arrival_u", F.lit(0)))
    )
    walk = Window.partitionBy(*VIEW, "issue_period").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    opening = decisions.select(*VIEW, units("opening_balance").alias("open_u"))
    return (
        flows.withColumn("walk_u", F.sum("flow_u").over(walk))
        .join(opening, VIEW)
        .withColumn("cash_u", F.col("open_u") + F.col("walk_u"))
        .groupBy(*VIEW, "issue_period", "weight")
        .agg(amount(F.min("cash_u")).alias("min_cash"), F.min(F.when(F.col("cash_u") <= 0, F.col("h"))).alias("first_passage"))
    )


def period_weight(n_scenarios: int) -> F.Column:
    """How many of the scenarios s choose a period by (31 s + business) mod n_periods: whole rounds of n, and the rest of one."""

    def taken(count):
        chosen = F.filter(F.sequence(F.lit(0).cast("long"), count - 1), lambda s: F.pmod(s * 31 + F.col("business_id"), F.col("n_periods")) == F.col("period_no"))
        return F.when(count > 0, F.size(chosen)).otherwise(0)

    total = F.lit(n_scenarios).cast("long")
    return (F.floor(total / F.col("n_periods")) * taken(F.col("n_periods")) + taken(total % F.col("n_periods"))).cast("long")


def safe_spend_limits(walks: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """Safe spend of every decision date from its weighed scenarios."""
    q = F.percentile("min_cash", F.lit(epsilon), F.col("weight"))
    short = F.sum(F.when(F.col("min_cash") < 0, F.col("weight")).otherwise(0)) / F.sum("weight")
    return walks.groupBy(*VIEW).agg(
        # rounded down to the money grid: a limit may not be exceeded by rounding
        F.greatest(F.lit(0.0), F.floor(q * 10000 + 0.001) / 10000.0).alias("safe_spend"), short.alias("baseline_shortfall")
    )


def replay_runway(walks: DataFrame, horizon: int, confidence: float = 0.95) -> DataFrame:
    """Runway at risk of every decision date and the mean of the scenarios at or below it."""
    days = walks.withColumn("days", F.coalesce("first_passage", F.lit(horizon)).cast("double"))
    q = days.groupBy(*VIEW).agg(F.percentile("days", F.lit(1.0 - confidence), F.col("weight")).alias("_q"))
    tail = F.when(F.col("days") <= F.col("_q"), F.col("weight"))
    return days.join(q, VIEW).groupBy(*VIEW).agg(
        F.floor(F.max("_q")).alias("runway_at_risk_days"), F.coalesce(F.sum(F.col("days") * tail) / F.sum(tail), F.max("_q")).alias("conditional_runway_at_risk_days")
    )


def step_table(steps: DataFrame, runway: DataFrame, calibration: DataFrame) -> DataFrame:
    """The replay's steps with the forecast model in use, its conformal multiplier and the runway at that date.

    ``calibration``: business_id, as_of, model, q_hat.
    """
    return steps.join(runway, VIEW).join(calibration.select(*VIEW, F.col("model").alias("forecast_model"), "q_hat"), VIEW)


def usage_summary(table: DataFrame) -> DataFrame:
    """Steps, multiplier and runway spread by model, by strategy, and over all steps, in one pass of grouping sets.

    Medians come from counts of days, which are whole numbers up to the horizon for the runway at risk; group_kind tells the sets apart.
    """
    q, r, c = F.col("q_hat"), F.col("runway_at_risk_days"), F.col("conditional_runway_at_risk_days")
    sets = [[F.col("forecast_model")], [F.col("strategy")], []]
    kind = F.when(F.grouping("forecast_model") == 0, "model").when(F.grouping("strategy") == 0, "strategy").otherwise("all")
    return table.groupingSets(sets, F.col("forecast_model"), F.col("strategy")).agg(
        kind.alias("group_kind"), F.count(F.lit(1)).alias("n_steps"),
        F.avg(q).alias("mean_q_hat"), (F.avg(q) / Z_95).alias("scale_ratio"), F.min(q).alias("min_q_hat"), F.max(q).alias("max_q_hat"),
        F.min(r).alias("min_runway_at_risk"), F.percentile(r, F.lit(0.5)).alias("median_runway_at_risk"), F.max(r).alias("max_runway_at_risk"),
        F.min(c).alias("min_conditional_runway"), F.percentile(c, F.lit(0.5)).alias("median_conditional_runway"), F.max(c).alias("max_conditional_runway"),
    )


Strategy = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]

STRATEGIES: Mapping[str, Strategy] = {
    "rules_baseline": lambda o, i, limits: allocation.greedy_allocation(o, i, "rules_baseline"),
    "exact": lambda o, i, limits: allocation.exact_allocation(o, i, "exact"),
    "grid_dp": lambda o, i, limits: allocation.grid_dp(o, i, strategy="grid_dp").drop("grid_unit"),
    "chance_constrained": lambda o, i, limits: allocation.chance_constrained(o, i, limits, "chance_constrained"),
}


def run_strategies(names: list[str], obligations: DataFrame, instances: DataFrame, limits: DataFrame | None, registry: Mapping[str, Strategy] = STRATEGIES) -> DataFrame:
    """Allocations of several strategies on the same instances, tagged by strategy."""
    out = None
    for n in names:
        part = registry[n](obligations, instances, limits)
        out = part if out is None else out.unionByName(part)
    return out


def realized_penalty(allocations: DataFrame, realized: DataFrame) -> DataFrame:
    """Honour commitments by penalty rate within the cash that really was there.

    ``realized`` has business_id, as_of, realized_cash.  Unfunded obligations pay in full.
    """
    keys = [*VIEW, "strategy"]
    committed = allocations.filter(F.col("allocated_amount") > 0)
    cash = allocations.select(*keys).distinct().join(realized.select(*VIEW, "realized_cash"), VIEW)
    taken = allocation.ordered_budget(committed, cash, [-F.col("penalty_rate")], keys, need="allocated_amount", cash="realized_cash")
    done = allocations.join(taken, [*keys, "obligation_id"], "left")
    missed = units("amount") - F.coalesce("_take", F.lit(0))
    return done.groupBy(*keys).agg(
        F.sum(F.col("penalty_rate") * amount(missed)).alias("realized_penalty"), F.sum("allocated_amount").alias("planned_spend")
    )


def hindsight(obligations: DataFrame, realized: DataFrame) -> DataFrame:
    """Exact plan with the realized minimum cash: the benchmark for regret."""
    perfect = realized.select(*VIEW, F.col("realized_cash").alias("available_cash"))
    return (
        allocation.exact_allocation(obligations, perfect, "hindsight").groupBy(*VIEW).agg(F.sum("penalty").alias("hindsight_penalty"))
    )


def step_regret(allocations: DataFrame, obligations: DataFrame, decisions: DataFrame) -> DataFrame:
    real = decisions.select(*VIEW, "realized_cash")
    return (
        realized_penalty(allocations, real)
        .join(hindsight(obligations, real), VIEW)
        .join(real, VIEW)
        .select(
            *VIEW, "strategy", "realized_penalty", "hindsight_penalty", (F.col("realized_penalty") - F.col("hindsight_penalty")).alias("regret"),
            "planned_spend", "realized_cash", (F.col("planned_spend") > F.col("realized_cash") + 1.0).alias("over_committed"),
        )
    )


def regret_metrics(steps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, median, p95, totals and relative regret; a group has one row per decision date."""
    keys = keys or ["business_id", "strategy"]
    tr, th = F.sum("realized_penalty"), F.sum("hindsight_penalty")
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"), F.avg("regret").alias("mean_regret"), F.percentile("regret", F.lit(0.5)).alias("median_regret"),
        F.percentile("regret", F.lit(0.95)).alias("p95_regret"), tr.alias("total_realized_penalty"), th.alias("total_hindsight_penalty"),
        F.when(th > 0, (tr - th) / th).otherwise(0.0).alias("relative_regret"),
    )


def strategy_summary(steps: DataFrame, baseline: str = "rules_baseline") -> DataFrame:
    """Portfolio totals per strategy, over-commitment, difference to the baseline, cheapest flag."""
    s = steps.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_steps"), F.sum("realized_penalty").alias("total_realized_penalty"),
        F.count(F.when(F.col("over_committed"), 1)).alias("over_commitment_steps"),
    )
    base = s.agg(
        F.max(F.when(F.col("strategy") == baseline, F.col("total_realized_penalty"))).alias("_base"),
        F.min_by("strategy", F.struct("total_realized_penalty", "strategy")).alias("_best"),
    )
    t = F.col("total_realized_penalty")
    return s.crossJoin(F.broadcast(base)).select(
        "strategy", "n_steps", "total_realized_penalty", "over_commitment_steps",
        F.when(F.col("_base") > 0, (t - F.col("_base")) / F.col("_base")).otherwise(0.0).alias("vs_baseline"),
        (F.col("strategy") == F.col("_best")).alias("cheapest"),
    )


def summary_document(steps: DataFrame) -> DataFrame:
    """One row per strategy with nested regret series, ready for a JSON or parquet sink.

    A series has one element per (business, decision date).
    """
    point = F.struct("business_id", F.col("as_of").cast("string").alias("as_of"), "regret", "realized_penalty", "hindsight_penalty", "planned_spend", "realized_cash", "over_committed")
    metrics = regret_metrics(steps, ["business_id", "strategy"])
    series = steps.groupBy("business_id", "strategy").agg(F.array_sort(F.collect_list(point)).alias("regret_series"))
    return metrics.join(series, ["business_id", "strategy"])
