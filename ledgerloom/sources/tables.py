"""Domain tables (payments, daily flows, ledger) read from the star schema files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.money import cents

OPENING_DAYS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice payments: one row per order, keyed by the buyer's nation as business.

    The terms, delay and default rules are fixed arithmetic on ids, so that any SQL
    engine can rebuild the same table.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    issue = F.col("o_orderdate").cast("date")
    month_no = F.year(issue) * 12 + F.month(issue)
    unpaid = (F.col("o_orderstatus") == "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    base = joined.select(
        F.col("c_nationkey").cast("long").alias("business_id"),
        F.col("o_orderkey").alias("invoice_id"),
        F.col("o_custkey").alias("payer_id"),
        (F.col("o_custkey") % 12).alias("counterparty_id"),
        issue.alias("issue_date"),
        F.date_add(issue, (15 * (1 + F.col("o_custkey") % 4)).cast("int")).alias("due_date"),
        F.col("o_totalprice").alias("amount"),
        (1 + (F.col("o_orderkey") * 7919) % 40 + (month_no * 37) % 20).cast("long").alias("delay_days"),
        (~unpaid).alias("paid"),
    )
    paid_on = F.date_add("due_date", F.col("delay_days").cast("int"))
    return base.withColumn("paid_date", F.when(F.col("paid"), paid_on)).withColumn(
        "days_overdue", F.when(F.col("paid"), F.col("delay_days").cast("double"))
    )


def daily_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(business, date) totals in whole ten-thousandths; never more rows than calendar days."""
    inv = invoices(spark, sf_dir)
    zero = F.lit(0).cast("long")
    flow = lambda date, r, s: F.struct(date.alias("date"), r.alias("receipts_u"), s.alias("sales_u"))
    sale = flow(F.col("issue_date"), zero, cents("amount") * 25)
    receipt = flow(F.col("paid_date"), cents("amount") * 75, zero)
    both = inv.select("business_id", F.explode(F.when(F.col("paid"), F.array(sale, receipt)).otherwise(F.array(sale))).alias("f"))
    money = both.groupBy("business_id", "f.date").agg(F.sum("f.receipts_u").alias("receipts_u"), F.sum("f.sales_u").alias("sales_u"))
    net_price = cents("l_extendedprice") * (100 - F.round(F.col("l_discount") * 100).cast("long"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("date"), net_price.alias("net_u"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("business_id"))
    # orders meet their customers before their lines, so that lines move once
    owners = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "business_id")
    spend = lines.join(owners, lines.l_orderkey == owners.o_orderkey).groupBy("business_id", "date").agg(F.sum("net_u").alias("outflow_u"))
    parts = money.withColumn("outflow_u", zero).unionByName(spend.select("business_id", "date", zero.alias("receipts_u"), zero.alias("sales_u"), "outflow_u"))
    return parts.groupBy("business_id", "date").agg(
        F.sum("receipts_u").alias("receipts_u"),
        F.sum("sales_u").alias("sales_u"),
        F.sum("outflow_u").alias("outflow_u"),
    )
