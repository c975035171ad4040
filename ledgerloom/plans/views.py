"""Plans shared by several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import forecast, ledger
from ledgerloom.plans.base_sql import AS_OF, HORIZON
from ledgerloom.sources import tables


def ledger_table(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.build_ledger(tables.daily_flows(spark, sf))


def history_table(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.history(ledger_table(spark, sf), AS_OF)


def naive_path(history: DataFrame, horizon: int = HORIZON) -> DataFrame:
    return forecast.seasonal_naive(history, "net_ex_receipts", horizon)
