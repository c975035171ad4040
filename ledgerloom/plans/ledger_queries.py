"""Ledger, point-in-time views and point runway."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.money import amount, sum_units
from ledgerloom.operators import forecast, ledger
from ledgerloom.plans.base_sql import AS_OF, HORIZON, MIN_HISTORY, OBLIGATION_ROWS, STEP_DAYS, cte, twin
from ledgerloom.plans.registry import query, shown
from ledgerloom.plans.views import history_table, ledger_table, naive_path
from ledgerloom.sources import tables

cte(
    "point_runway",
    """
SELECT business_id, max(opening_balance) AS opening_balance, min(CASE WHEN bal <= 0 THEN h END) AS days_to_zero, min(bal) AS lowest_balance
FROM (SELECT n.business_id, h, o.opening_balance,
        o.opening_balance + sum(point) OVER (PARTITION BY n.business_id ORDER BY h ROWS UNBOUNDED PRECEDING) AS bal
      FROM naive_path n JOIN opening o ON o.business_id = n.business_id) GROUP BY 1
""",
    "naive_path",
    "opening",
)
cte(
    "decisions",
    f"""
SELECT business_id, date AS as_of, rn AS history_rows, balance_u / 10000.0::DOUBLE AS opening_balance,
  CAST(trail AS BIGINT) / 10000.0::DOUBLE AS trailing_outflow, greatest(0.0, low / 10000.0::DOUBLE) AS realized_cash
FROM (SELECT business_id, date, balance_u, row_number() OVER w - 1 AS rn,
        sum(outflow_u) OVER (PARTITION BY business_id ORDER BY date ROWS BETWEEN {OBLIGATION_ROWS - 1} PRECEDING AND CURRENT ROW) AS trail,
        min(balance_u) OVER (PARTITION BY business_id ORDER BY date ROWS BETWEEN CURRENT ROW AND {HORIZON} FOLLOWING) AS low,
        max(date) OVER (PARTITION BY business_id) AS last_day
      FROM ledger WINDOW w AS (PARTITION BY business_id ORDER BY date))
WHERE rn >= {MIN_HISTORY} AND (rn - {MIN_HISTORY}) % {STEP_DAYS} = 0 AND date + {HORIZON} <= last_day
""",
    "ledger",
)


@query(
    "ledger_daily",
    twin(
        """SELECT business_id, CAST(date AS VARCHAR) AS date, (receipts_u + sales_u) / 10000.0::DOUBLE AS inflow, receipts_u / 10000.0::DOUBLE AS receipts,
  sales_u / 10000.0::DOUBLE AS cash_sales, outflow_u / 10000.0::DOUBLE AS outflow, (receipts_u + sales_u - outflow_u) / 10000.0::DOUBLE AS net,
  y AS net_ex_receipts, balance_u / 10000.0::DOUBLE AS balance FROM ledger""",
        "ledger",
    ),
)
def ledger_daily(spark, sf):
    return shown(ledger_table(spark, sf), digits=4)


@query(
    "runway_point",
    twin(
        "SELECT business_id, round(opening_balance, 2) AS opening_balance, days_to_zero, round(lowest_balance, 2) AS lowest_balance FROM point_runway",
        "point_runway",
    ),
)
def runway_point(spark, sf):
    hist = history_table(spark, sf)
    opening = ledger.opening_balance(hist, AS_OF)
    return shown(forecast.days_to_zero(naive_path(hist), opening, HORIZON), digits=2)


EARLY = "1995-01-02"


@query(
    "history_refusals",
    twin(f"SELECT business_id, 'no history on or before {EARLY}' AS reject_reason FROM ledger GROUP BY 1 HAVING min(date) > DATE '{EARLY}'", "ledger"),
)
def history_refusals(spark, sf):
    """Businesses that have no day yet at an early decision date."""
    return ledger.require_history(ledger_table(spark, sf), EARLY)


@query(
    "asof_receivables",
    twin("SELECT business_id, invoice_id, counterparty_id, amount, days_until_due FROM open_items", "open_items"),
)
def asof_receivables(spark, sf):
    return shown(ledger.outstanding(tables.invoices(spark, sf), AS_OF), digits=2)


@query(
    "asof_receivables_antijoin",
    twin("SELECT business_id, invoice_id, counterparty_id, amount, days_until_due FROM open_items", "open_items"),
)
def asof_receivables_antijoin(spark, sf):
    inv = tables.invoices(spark, sf)
    return shown(ledger.outstanding_between(inv, ledger.settled(inv, AS_OF).select("business_id", "invoice_id"), AS_OF), digits=2)


@query(
    "asof_settled_delays",
    twin(
        """SELECT business_id, counterparty_id, count(*) AS n_delays, count(*) >= 10 AS usable,
  CASE WHEN count(*) < 10 THEN CAST(count(*) AS VARCHAR) || ' usable delays; need >= 10' END AS reject_reason
FROM settled WHERE delay_days >= 0 GROUP BY 1, 2""",
        "settled",
    ),
)
def asof_settled_delays(spark, sf):
    from ledgerloom.operators.delays import usable_delays

    return shown(usable_delays(ledger.settled(tables.invoices(spark, sf), AS_OF)))


@query(
    "full_view",
    twin(
        """SELECT business_id, CAST(max(date) AS VARCHAR) AS as_of, arg_max(balance_u, date) / 10000.0::DOUBLE AS opening_balance,
  count(*) AS n_days, 0::BIGINT AS n_receivables FROM ledger GROUP BY 1""",
        "ledger",
    ),
)
def full_view(spark, sf):
    return shown(ledger.full_view(ledger_table(spark, sf)), digits=4)


@query(
    "financial_summary",
    twin(
        """SELECT o.business_id, round(o.opening_balance, 2) AS cash, coalesce(r.n, 0) AS n_receivables, coalesce(r.v, 0.0) AS receivable_value, p.days_to_zero
FROM opening o LEFT JOIN (SELECT business_id, count(*) AS n, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS v FROM open_items GROUP BY 1) r
  ON r.business_id = o.business_id LEFT JOIN point_runway p ON p.business_id = o.business_id""",
        "point_runway",
        "open_items",
    ),
)
def financial_summary(spark, sf):
    hist = history_table(spark, sf)
    runway = forecast.days_to_zero(naive_path(hist), ledger.opening_balance(hist, AS_OF), HORIZON)
    return shown(ledger.financial_summary(hist, tables.invoices(spark, sf), runway, AS_OF), digits=2)


@query(
    "replay_decision_points",
    twin(
        """SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, history_rows, opening_balance, trailing_outflow, realized_cash FROM decisions""",
        "decisions",
    ),
)
def replay_decision_points(spark, sf):
    return shown(ledger.decision_points(ledger_table(spark, sf), STEP_DAYS, HORIZON, MIN_HISTORY, OBLIGATION_ROWS), digits=4)


@query(
    "counterparty_exposure",
    twin(
        """SELECT business_id, counterparty_id, count(*) AS n_open, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS open_value,
  min(days_until_due) AS earliest_due, count(*) FILTER (WHERE days_until_due < 0) AS n_overdue FROM open_items GROUP BY 1, 2""",
        "open_items",
    ),
)
def counterparty_exposure(spark, sf):
    open_items = ledger.outstanding(tables.invoices(spark, sf), AS_OF)
    return shown(
        open_items.groupBy("business_id", "counterparty_id").agg(
            F.count(F.lit(1)).alias("n_open"),
            amount(sum_units("amount")).alias("open_value"),
            F.min("days_until_due").alias("earliest_due"),
            F.count(F.when(F.col("days_until_due") < 0, 1)).alias("n_overdue"),
        ),
        digits=2,
    )
