"""Cases just past the limits that earlier versions had."""

import json

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import anomaly, audit, statements


def test_delimiter_shows_after_many_lines(spark):
    lines = [(1, k, "bank statement") for k in range(60)] + [(1, 60 + k, "a;b;c") for k in range(80)]
    got = statements.sniff_delimiters(spark.createDataFrame(lines, "file_id long, line_no long, line string")).collect()
    assert [tuple(r) for r in got] == [(1, ";")]


def test_all_failing_rows(spark):
    rows = spark.range(100).select(F.lit(1).alias("file_id"), F.col("id").alias("row_idx"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(0.0).alias("residual"))
    assert statements.failing_rows(rows).count() == 50


def test_large_amounts_and_names(spark):
    cells = spark.createDataFrame([("INR 1,234,567,890,123.45",), ("(2000000000000)",)], "cell string").select(text.parse_amount(F.col("cell")).cast("string")).collect()
    assert [r[0] for r in cells] == ["1234567890123.45", "-2000000000000.00"]
    names = spark.createDataFrame([("NEFT/ACME-ORION/881",), ("UPI o'brien & sons",)], "n string").select(text.counterparty_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["Acme-Orion", "O'Brien & Sons"]


def test_cluster_of_a_long_chain(spark):
    points = spark.createDataFrame([(k, 0.4 * k) for k in range(500)] + [(900, -50.0)], "id long, x double")
    got = {r.id: r.cluster for r in anomaly.dbscan(points, "id", ["x"], eps=0.5, min_samples=3).collect()}
    assert got[900] == -1 and {got[k] for k in range(500)} == {1}  # both ends are border points


def test_audit_text_is_json(spark):
    odd = 'a "b" \\ c\t\n\u0001'
    row = {"sequence": 1, "timestamp": odd, "actor_id": odd, "action": "x", "entity_type": "y", "entity_id": "z", "payload": '{"k":1}', "previous_hash": "0"}
    got = spark.createDataFrame([row]).select(audit.canonical_json()).first()[0]
    assert json.loads(got) == row | {"payload": {"k": 1}}


def test_every_bill_is_screened(spark):
    from ledgerloom.plans import screening_queries
    from ledgerloom.sources import tables

    rows = screening_queries.duplicate_screen(spark, "/root/testdata/sf0.001").toPandas()
    assert len(rows) == tables.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert rows.row_id.is_unique and rows.flagged_by_forest.any() and not rows.flagged_by_forest.all()
    band = screening_queries.duplicate_band_join(spark, "/root/testdata/sf0.001").toPandas()
    assert (rows.reason == "exact duplicate").sum() == band[band.duplicate_of.notna()].copies.sum()


def test_lines_move_once_to_the_ledger(spark):
    from ledgerloom.sources import tables

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.daily_flows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    scan = next(k for k, x in enumerate(plan) if "FileScan" in x and "l_orderkey" in x)
    above = [k for k in range(scan) if depth[k] < depth[scan] and depth[k] < min(depth[k + 1 : scan + 1])]
    moves = [plan[k] for k in above if "Exchange hashpartitioning" in plan[k]]
    assert sum("l_orderkey" in x for x in moves) == 1 and not any("custkey" in x for x in moves)


def test_boxes_between_clusters_are_cut_finer(spark):
    from collections import Counter

    import numpy as np

    rng = np.random.default_rng(2)
    strips = [np.column_stack([rng.uniform(0, 6, 300), rng.uniform(y, y + 0.4, 300)]) for y in (0.0, 0.93, 1.7)]
    at = np.vstack([*strips, rng.uniform(-6, 12, (60, 2))])
    near = ((at[:, None] - at[None]) ** 2).sum(-1) <= 0.25
    core = near.sum(1) >= 3
    label = np.where(core, np.arange(len(at)), len(at))
    while True:
        new = np.where(core, np.where(near & core[None], label[None], len(at)).min(1), len(at))
        if (new == label).all():
            break
        label = new
    want = np.where(core, label, np.where(near & core[None], label[None], len(at)).min(1))
    want = np.where(want == len(at), -1, want)
    points = spark.createDataFrame([(k, float(x), float(y), f"p{k}") for k, (x, y) in enumerate(at)], "id long, a double, b double, name string")
    for pairs in (1 << 26, 0):
        got = anomaly.dbscan(points, "id", ["a", "b"], eps=0.5, min_samples=3, keep=["name"], pairs=pairs).collect()
        assert {r.id: (r.core, r.cluster) for r in got} == {k: (bool(core[k]), int(want[k])) for k in range(len(at))}
        assert all(r.name == f"p{r.id}" for r in got)
    assert len(Counter(want)) >= 3


def test_points_of_connected_cells_are_not_compared(spark, monkeypatch):
    points = spark.range(20_000).select("id", (F.rand(3) * 3).alias("x"), (F.rand(4) * 3).alias("y"))
    written = []
    kept = anomaly.cut_lineage
    monkeypatch.setattr(anomaly, "cut_lineage", lambda df, *a: written.append(kept(df, *a)) or written[-1])
    assert {r.cluster for r in anomaly.dbscan(kept(points), "id", ["x", "y"], eps=0.5).select("cluster").distinct().collect()} == {0}
    assert not any(df.count() for df in written if {"x0", "x1"} <= set(df.columns))  # cells and boxes, no points
