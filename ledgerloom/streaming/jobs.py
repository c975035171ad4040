"""Streaming forms of the ledger ingest, the daily totals and the call budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int = 8) -> DataFrame:
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(records: DataFrame, id_cols: list[str], ts: str, late: str = "40 days") -> DataFrame:
    """Overlapping pulls post once: a record id seen within the watermark is dropped."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark(id_cols)


def daily_totals(events: DataFrame, ts: str, keys: list[str], cents: str, late: str = "2 days") -> DataFrame:
    """Tumbling one-day totals that still accept rows up to two days late."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents"))
        .select(F.col("w.start").cast("date").alias("day"), *keys, "n", "cents")
    )


def call_budget(calls: DataFrame, key: str, ts: str, allowed: int, window_days: int) -> DataFrame:
    """Accept or refuse every call against a trailing window; refused calls are not stored.

    State per key is the accepted timestamps still inside the window: at most ``allowed``.  It goes once the
    watermark, which trails by the window, has left the last call behind by a window; calls older than the watermark are dropped.
    Calls of a micro-batch are taken in order of their timestamps.
    """
    span = pd.Timedelta(days=window_days)
    out = T.StructType([T.StructField(key, T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("accepted", T.BooleanType()), T.StructField("used", T.LongType())])
    state_type = T.StructType([T.StructField("times", T.ArrayType(T.LongType()))])

    def step(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values([ts, "event_id"])
        rows = []
        for t, e in zip(pdf[ts], pdf["event_id"]):
            now = pd.Timestamp(t).value
            times = [x for x in times if x > now - span.value]
            ok = len(times) < allowed
            if ok:
                times.append(now)
            rows.append((k[0], int(e), ok, len(times)))
        state.update((times,))
        state.setTimeoutTimestamp(int(pd.Timestamp(pdf[ts].max()).value // 1_000_000 + span.value // 1_000_000 + 1))
        yield pd.DataFrame(rows, columns=[key, "event_id", "accepted", "used"])

    timed = calls.select(key, "event_id", ts).withWatermark(ts, f"{window_days} days")
    return timed.groupBy(key).applyInPandasWithState(step, out, state_type, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Append what the source holds now to a parquet table."""
    q = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def keep_batch(changed: DataFrame, batch: int, folder: str) -> None:
    """Write the changed rows of a micro-batch under its number; the same batch again takes its own place."""
    changed.write.mode("overwrite").parquet(f"{folder}/out/batch={batch:010d}")


def latest(spark: SparkSession, folder: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The last row of each key over all batches."""
    rest = [f.name for f in schema.fields if f.name not in keys]
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/out")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*schema.names)


def run_to_keyed_table(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Totals in update mode: a batch writes the keys it changed, so work follows the input, and closed windows leave the state."""
    spark, schema = stream.sparkSession, stream.schema
    q = (
        stream.writeStream.foreachBatch(lambda df, batch: keep_batch(df, batch, folder)).option("checkpointLocation", f"{folder}/state")
        .outputMode("update").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return latest(spark, folder, schema, keys)
