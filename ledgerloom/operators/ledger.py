"""Daily ledger, running balance and point-in-time views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import amount

LEDGER_COLUMNS = [
    "business_id", "date", "inflow", "receipts", "cash_sales", "outflow", "net", "net_ex_receipts", "balance",
]


def build_ledger(flows: DataFrame, opening_days: int = 30) -> DataFrame:
    """Calendar spine per business, zeros where nothing happened, running balance.

    The flows are already one row per (business, day), so the balance window holds
    at most one row per calendar day whatever the number of transactions.
    Opening balance = ``opening_days`` times the mean daily outflow.
    """
    span = flows.groupBy("business_id").agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.sum("outflow_u").alias("all_out")
    )
    spine = span.select(
        "business_id",
        F.expr(f"(all_out * {opening_days}) div (datediff(last_day, first_day) + 1)").alias("opening_u"),
        F.explode(F.sequence("first_day", "last_day")).alias("date"),
    )
    filled = spine.join(flows, ["business_id", "date"], "left").na.fill(0, ["receipts_u", "sales_u", "outflow_u"])
    net = F.col("receipts_u") + F.col("sales_u") - F.col("outflow_u")
    upto = Window.partitionBy("business_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("balance_u", F.col("opening_u") + F.sum(net).over(upto)).select(
        "business_id",
        "date",
        amount(F.col("receipts_u") + F.col("sales_u")).alias("inflow"),
        amount("receipts_u").alias("receipts"),
        amount("sales_u").alias("cash_sales"),
        amount("outflow_u").alias("outflow"),
        amount(net).alias("net"),
        amount(F.col("sales_u") - F.col("outflow_u")).alias("net_ex_receipts"),
        amount("balance_u").alias("balance"),
    )


def as_date(value: str | dt.date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def history(ledger: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Rows dated on or before the decision date."""
    return ledger.filter(F.col("date") <= as_date(as_of))


def require_history(ledger: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Businesses with no history at the decision date, as a reject table."""
    return (
        ledger.groupBy("business_id")
        .agg(F.min("date").alias("first_day"))
        .filter(F.col("first_day") > as_date(as_of))
        .select("business_id", F.concat(F.lit("no history on or before "), F.lit(str(as_of))).alias("reject_reason"))
    )


def opening_balance(ledger: DataFrame, as_of: str | dt.date) -> DataFrame:
    return history(ledger, as_of).groupBy("business_id").agg(F.max_by("balance", "date").alias("opening_balance"))


def settled(payments: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Paid, and paid by the decision date; the issue date never decides this."""
    return payments.filter(F.col("paid") & (F.col("paid_date") <= as_date(as_of)))


def outstanding(payments: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Issued by the decision date and not settled; days_until_due may be negative.

    The anti-join against the settled set is a row predicate here because both sides
    are the same row of the same table.
    """
    day = as_date(as_of)
    is_settled = F.col("paid") & (F.col("paid_date") <= day)
    return payments.filter((F.col("issue_date") <= day) & ~F.coalesce(is_settled, F.lit(False))).select(
        "business_id",
        "invoice_id",
        "counterparty_id",
        "amount",
        F.datediff("due_date", day).cast("long").alias("days_until_due"),
    )


def outstanding_between(issued: DataFrame, settled_ids: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Same view when the settled ids arrive as a table of their own."""
    day = as_date(as_of)
    return (
        issued.filter(F.col("issue_date") <= day)
        .join(settled_ids, ["business_id", "invoice_id"], "left_anti")
        .select(
            "business_id",
            "invoice_id",
            "counterparty_id",
            "amount",
            F.datediff("due_date", day).cast("long").alias("days_until_due"),
        )
    )


def full_view(ledger: DataFrame) -> DataFrame:
    """Whole-history view: decision date = last ledger day, no receivables."""
    return ledger.groupBy("business_id").agg(
        F.max("date").alias("as_of"),
        F.max_by("balance", "date").alias("opening_balance"),
        F.count(F.lit(1)).alias("n_days"),
        F.lit(0).cast("long").alias("n_receivables"),
    )


def decision_points(
    ledger: DataFrame, step_days: int, horizon_days: int, min_history: int, trailing_rows: int
) -> DataFrame:
    """One row per (business, decision date) with everything that is a prefix or forward aggregate.

    All decision dates come from the same three windows over the daily ledger; the
    history is never multiplied by the number of dates.
    """
    by_day = Window.partitionBy("business_id").orderBy("date")
    day_no = F.datediff("date", F.lit("1970-01-01").cast("date"))
    forward = Window.partitionBy("business_id").orderBy("day_no").rangeBetween(0, horizon_days)
    marked = (
        ledger.withColumn("day_no", day_no)
        .withColumn("row_no", F.row_number().over(by_day) - 1)
        .withColumn("last_day", F.max("day_no").over(Window.partitionBy("business_id")))
        .withColumn("trailing_u", F.sum(F.round(F.col("outflow") * 10000).cast("long")).over(
            by_day.rowsBetween(-(trailing_rows - 1), 0)))
        .withColumn("realized_cash", F.greatest(F.lit(0.0), F.min("balance").over(forward)))
    )
    due = (
        (F.col("row_no") >= min_history)
        & ((F.col("row_no") - min_history) % step_days == 0)
        & (F.col("day_no") + horizon_days <= F.col("last_day"))
    )
    return marked.filter(due).select(
        "business_id",
        F.col("date").alias("as_of"),
        F.col("row_no").cast("long").alias("history_rows"),
        F.col("balance").alias("opening_balance"),
        amount("trailing_u").alias("trailing_outflow"),
        "realized_cash",
    )


def financial_summary(ledger: DataFrame, payments: DataFrame, runway: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Cash, outstanding receivables and point runway per business."""
    from ledgerloom.functions.money import sum_units

    cash = opening_balance(ledger, as_of).withColumnRenamed("opening_balance", "cash")
    open_items = (
        outstanding(payments, as_of)
        .groupBy("business_id")
        .agg(F.count(F.lit(1)).alias("n_receivables"), amount(sum_units("amount")).alias("receivable_value"))
    )
    return (
        cash.join(open_items, "business_id", "left")
        .join(runway.select("business_id", "days_to_zero"), "business_id", "left")
        .na.fill({"n_receivables": 0, "receivable_value": 0.0})
    )
