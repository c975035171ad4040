"""Streams over several micro-batches: keyed totals, replay of a batch, call budgets and their state."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.streaming import jobs

T0 = dt.datetime(2026, 3, 1)
KIND = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def write(spark, folder, batches):
    for k, rows in enumerate(batches):
        data = [(i, T0 + dt.timedelta(hours=h), u, "x", float(v), None) for i, h, u, v in rows]
        spark.createDataFrame(data, KIND).coalesce(1).write.mode("overwrite").parquet(f"{folder}/raw{k}")
        part = next(p for p in (folder / f"raw{k}").iterdir() if p.name.endswith(".parquet"))
        (folder / f"events{k}.parquet").write_bytes(part.read_bytes())


def test_daily_totals_are_updated_by_key(spark, tmp_path):
    one = [(i, i, i % 2, 10) for i in range(30)]
    two = [(100, 20, 0, 5), (101, 29, 1, 7)] + [(200 + i, 40 + i, 0, 1) for i in range(3)]
    write(spark, tmp_path, [one, two])
    events = jobs.event_stream(spark, str(tmp_path), files_per_batch=1).withColumn("c", F.col("value").cast("long"))
    totals = jobs.daily_totals(events, "ts", ["user_id"], "c")
    got = jobs.run_to_keyed_table(totals, str(tmp_path / "sink"), ["day", "user_id"])
    want = {}
    for _, h, u, v in one + two:
        key = ((T0 + dt.timedelta(hours=h)).date(), u)
        n, c = want.get(key, (0, 0))
        want[key] = (n + 1, c + v)
    read = lambda df: {(r.day, r.user_id): (r.n, r.cents) for r in df.collect()}
    assert read(got) == want
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "sink" / "out").iterdir() if "=" in p.name)
    batch = spark.read.parquet(str(tmp_path / "sink" / "out" / f"batch={last:010d}")).collect()
    jobs.keep_batch(spark.createDataFrame(batch, totals.schema), last, str(tmp_path / "sink"))  # the same batch again
    assert read(jobs.latest(spark, str(tmp_path / "sink"), totals.schema, ["day", "user_id"])) == want


def test_call_budget_over_batches(spark, tmp_path):
    hours = [0, 1, 2, 3, 30, 31, 200, 201, 202, 203]
    rows = [(i, h, u, 1) for u in (1, 2) for i, h in zip(range(100 * u, 100 * u + 10), hours)]
    write(spark, tmp_path, [[r for r in rows if r[1] < 3], [r for r in rows if 3 <= r[1] < 100], [r for r in rows if r[1] >= 100]])
    calls = jobs.event_stream(spark, str(tmp_path), files_per_batch=1)
    got = {r.event_id: (r.accepted, r.used) for r in jobs.run_to_table(jobs.call_budget(calls, "user_id", "ts", 3, 1), str(tmp_path / "sink")).collect()}
    for u in (1, 2):
        times = []
        for i, h in zip(range(100 * u, 100 * u + 10), hours):
            times = [t for t in times if t > h - 24]
            ok = len(times) < 3
            times += [h] * ok
            assert got[i] == (ok, len(times)), (i, h)
