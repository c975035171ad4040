"""Trailing-window usage meter of metered calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usage_status(calls: DataFrame, keys: list[str], ts: str, now: str, allowed: int, window_days: int) -> DataFrame:
    """Calls used, remaining, exhausted and reset day per key at one moment; failed calls count.

    One aggregate per key; no ordering of the calls is needed.
    """
    at = F.lit(now).cast("timestamp_ntz")
    live = calls.filter((F.col(ts) <= at) & (F.col(ts) > at - F.expr(f"INTERVAL '{window_days}' DAY")))
    used = live.groupBy(*keys).agg(F.count(F.lit(1)).alias("u"), F.min(ts).alias("oldest"))
    every = calls.select(*keys).distinct().join(used, keys, "left")
    n = F.coalesce("u", F.lit(0))
    return every.select(
        *keys, n.alias("calls_used"), F.greatest(F.lit(0), F.lit(allowed) - n).alias("calls_remaining"), (n >= allowed).alias("exhausted"),
        F.date_add(F.coalesce("oldest", at).cast("date"), window_days).alias("window_resets_on"),
    )


def rolling_usage(calls: DataFrame, keys: list[str], day: str, window_days: int) -> DataFrame:
    """Calls in the trailing window per (key, day), from daily counts."""
    daily = calls.groupBy(*keys, F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    no = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy("no").rangeBetween(-(window_days - 1), 0)
    return daily.withColumn("no", no).withColumn("used", F.sum("n").over(w)).drop("no")
