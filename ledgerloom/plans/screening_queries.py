"""Anomaly screening, duplicates, audit chain, usage meter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import anomaly, audit, usage
from ledgerloom.plans.base_sql import cte, twin
from ledgerloom.plans.registry import query, shown
from ledgerloom.session import cut_lineage
from ledgerloom.sources import tables

cte(
    "rz",
    """SELECT business_id, invoice_id, amount, CASE WHEN mad > 0 THEN 0.6745::DOUBLE * (amount - med) / mad ELSE 0 END AS z FROM (
 SELECT *, quantile_cont(abs(amount - med), 0.5) OVER (PARTITION BY business_id) AS mad FROM (
  SELECT business_id, invoice_id, amount, quantile_cont(amount, 0.5) OVER (PARTITION BY business_id) AS med FROM payments))""",
    "payments",
)


def amounts(spark, sf):
    return tables.invoices(spark, sf).select("business_id", "invoice_id", "amount")


@query("robust_z", twin("SELECT business_id, invoice_id, amount, round(z, 6) + 0.0 AS robust_z, abs(z) > 3.5 AS flagged FROM rz", "rz"))
def robust_z(spark, sf):
    return shown(anomaly.robust_z(amounts(spark, sf), ["business_id"], "amount"), amount=2)


@query(
    "detector_agreement",
    twin(
        """SELECT business_id, count(*) AS n_records, count(*) FILTER (WHERE a AND NOT b) AS n_a_only, count(*) FILTER (WHERE b AND NOT a) AS n_b_only, count(*) FILTER (WHERE a AND b) AS n_both,
  round(CASE WHEN count(*) FILTER (WHERE a OR b) > 0 THEN count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a OR b)::DOUBLE ELSE 1.0 END, 6) AS jaccard
FROM (SELECT r.business_id, abs(r.z) > 1.2 AS a, p.delay_days > 45 AS b FROM rz r JOIN payments p ON p.invoice_id = r.invoice_id) GROUP BY 1""",
        "rz",
    ),
)
def detector_agreement(spark, sf):
    """Two simple detectors on the same invoices: unusual amount, unusual delay."""
    z = anomaly.robust_z(tables.invoices(spark, sf).select("business_id", "invoice_id", "amount", "delay_days"), ["business_id"], "amount")
    f = z.select("business_id", (F.abs("robust_z") > 1.2).alias("a"), (F.col("delay_days") > 45).alias("b"))
    return shown(anomaly.compare_detectors(f, "a", "b", ["business_id"]))


# Line items as bills: supplier = vendor, whole price in hundreds, ship date as due day.
cte(
    "bills",
    """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS x, l_suppkey AS vendor,
  CAST(floor(l_extendedprice / 500) AS BIGINT) AS cents, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day, l_orderkey * 8 + l_linenumber AS bill_id FROM lineitem""",
)


def line_bills(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("vendor"), F.floor(F.col("l_extendedprice") / 500).cast("long").alias("cents"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("bill_id"), F.col("l_extendedprice").cast("double").alias("amount"),
    )


@query(
    "duplicate_band_join",
    twin(
        """SELECT a.vendor, a.cents, a.day, a.bill_id, min(b.bill_id) AS duplicate_of, count(DISTINCT a.x) AS copies FROM bills a LEFT JOIN bills b ON b.vendor = a.vendor AND abs(b.cents - a.cents) <= 1
  AND abs(b.day - a.day) <= 3 AND b.bill_id < a.bill_id GROUP BY 1, 2, 3, 4""",
        "bills",
    ),
)
def duplicate_band_join(spark, sf):
    bills = line_bills(spark, sf).select("vendor", "cents", "day", "bill_id")
    d = anomaly.first_duplicates(bills, "vendor", "cents", "day", "bill_id")
    return shown(d.groupBy("vendor", "cents", "day", "bill_id", "duplicate_of").agg(F.count(F.lit(1)).alias("copies")))


def vectors(spark, sf):
    e = tables.table(spark, sf, "embeddings")
    return anomaly.standardize(e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(2)]), ["f0", "f1"])


@query(
    "density_clusters",
    """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
z AS (SELECT vec_id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS x, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS y FROM e),
n AS (SELECT p.vec_id, q.vec_id AS o FROM z p JOIN z q ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.0025),
c AS (SELECT vec_id, count(*) >= 3 AS core FROM n GROUP BY 1)
SELECT c.vec_id, c.core, c.core OR EXISTS (SELECT 1 FROM n JOIN c k ON k.vec_id = n.o AND k.core WHERE n.vec_id = c.vec_id) AS clustered FROM c""",
)
def density_clusters(spark, sf):
    d = anomaly.dbscan(vectors(spark, sf), "vec_id", ["z_f0", "z_f1"], eps=0.05)
    return shown(d.select("vec_id", "core", (F.col("cluster") >= 0).alias("clustered")))


@query("density_labels")
def density_labels(spark, sf):
    return shown(anomaly.dbscan(vectors(spark, sf), "vec_id", ["z_f0", "z_f1"], eps=0.05))


@query("isolation_forest")
def isolation_forest(spark, sf):
    inv = tables.invoices(spark, sf).select("invoice_id", "amount", F.col("delay_days").cast("double").alias("delay_days"), F.datediff("due_date", "issue_date").cast("double").alias("terms"))
    return shown(anomaly.isolation_forest(cut_lineage(inv), "invoice_id", ["amount", "delay_days", "terms"]))


@query("duplicate_screen")
def duplicate_screen(spark, sf):
    """Exact pass over all bills, then density, forest and robust z, with the three-way reason.

    A bill_id can repeat; row_id adds the place among the rows that share it.
    """
    same = Window.partitionBy("bill_id").orderBy("vendor", "cents", "day", "amount")
    exact = anomaly.first_duplicates(line_bills(spark, sf), "vendor", "cents", "day", "bill_id")
    bills = cut_lineage(exact.select(
        (F.col("bill_id").cast("long") * (1 << 20) + F.row_number().over(same)).alias("row_id"), "bill_id", F.col("duplicate_of").alias("first_bill"),
        "amount", F.col("day").cast("double").alias("due"), F.pmod(F.xxhash64("vendor"), F.lit(10_000)).cast("double").alias("code"),
    ))
    # Each step passes on the columns of the ones before, so that no row is looked up again by its id.
    known = ["bill_id", "first_bill", "amount", "due", "code"]
    forest = anomaly.isolation_forest(bills, "row_id", ["amount", "due", "code"], keep=known).withColumnRenamed("score", "forest_score")
    z = anomaly.robust_z(forest.withColumn("g", F.lit(0)), ["g"], "amount", written=True).drop("g", "flagged")
    known = ["bill_id", "first_bill", "forest_score", "flagged_by_forest", "robust_z"]
    dens = anomaly.dbscan(anomaly.standardize(z, ["amount", "due", "code"]), "row_id", ["z_amount", "z_due", "z_code"], keep=known)
    reason = (
        F.when(F.col("duplicate_of").isNotNull(), "exact duplicate").when(F.col("cluster") >= 0, "near-duplicate candidate").otherwise("no duplicate signal")
    )
    dens = dens.withColumnRenamed("first_bill", "duplicate_of").filter(F.col("row_id").isNotNull())  # a bill without an id takes part, but is not listed
    return shown(dens.select("row_id", "bill_id", "duplicate_of", "core", "cluster", "forest_score", "flagged_by_forest", "robust_z", reason.alias("reason")))


def events_chain(spark, sf):
    e = tables.table(spark, sf, "events")
    from ledgerloom.functions.spread import running_totals

    seq = running_totals(e.select("user_id", "event_id", "event_type", "value"), ["user_id"], [], "event_id", {"sequence": F.lit(1)}, inclusive=False)
    return seq.select(
        F.col("user_id").alias("chain_id"), "sequence", F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("timestamp"), F.lit("system").alias("actor_id"),
        F.col("event_type").alias("action"), F.lit("event").alias("entity_type"), F.col("event_id").cast("string").alias("entity_id"),
        F.concat(F.lit('{"cents":'), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("}")).alias("payload"),
    )


def stored_chain(spark, sf):
    """The appended chain with every 50th event id of every fifth user tampered afterwards."""
    done = cut_lineage(audit.append(events_chain(spark, sf)))
    hit = (F.col("chain_id") % 5 == 0) & (F.col("entity_id").cast("long") % 50 == 7)
    return done.withColumn("payload", F.when(hit, F.lit('{"cents":0}')).otherwise(F.col("payload")))


cte(
    "audit_seq",
    """SELECT user_id AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence, 't' || event_id AS ts, event_type AS action, event_id,
  '{"cents":' || CAST(round(value * 100) AS BIGINT) || '}' AS payload FROM events""",
)
cte(
    "audit_chain",
    f"""SELECT chain_id, -1::BIGINT AS sequence, '{audit.GENESIS}' AS entry_hash, NULL::BIGINT AS event_id, '' AS payload FROM (SELECT DISTINCT chain_id FROM audit_seq)
UNION ALL
SELECT s.chain_id, s.sequence, sha256('{{"action":"' || s.action || '","actor_id":"system","entity_id":"' || s.event_id || '","entity_type":"event","payload":' || s.payload || ',"previous_hash":"' || c.entry_hash
  || '","sequence":' || s.sequence || ',"timestamp":"' || s.ts || '"}}'), s.event_id, s.payload FROM audit_chain c JOIN audit_seq s ON s.chain_id = c.chain_id AND s.sequence = c.sequence + 1""",
    "audit_seq",
)


@query("hash_chain_append", twin("SELECT chain_id, sequence, entry_hash FROM audit_chain WHERE sequence >= 0", "audit_chain"))
def hash_chain_append(spark, sf):
    return shown(audit.append(events_chain(spark, sf)).select("chain_id", "sequence", "entry_hash"))


@query(
    "hash_chain_verify",
    twin(
        """SELECT chain_id, coalesce(bool_and(NOT bad), TRUE) AS intact, count(*) AS n_entries, min(CASE WHEN bad THEN sequence END) AS first_broken, CASE WHEN bool_or(bad) THEN 'contents' END AS failure
FROM (SELECT *, chain_id % 5 = 0 AND event_id % 50 = 7 AND payload <> '{"cents":0}' AS bad FROM audit_seq) GROUP BY 1""",
        "audit_seq",
    ),
)
def hash_chain_verify(spark, sf):
    return shown(audit.verify(stored_chain(spark, sf)))


@query(
    "audit_heads",
    twin("SELECT chain_id, arg_max(entry_hash, sequence) AS head_hash, count(*) AS n_entries FROM audit_chain WHERE sequence >= 0 GROUP BY 1", "audit_chain"),
)
def audit_heads(spark, sf):
    return shown(audit.heads(audit.append(events_chain(spark, sf))))


@query("audit_trail", twin("SELECT chain_id, sequence, action FROM audit_seq WHERE event_id = 42", "audit_seq"))
def audit_trail(spark, sf):
    return shown(audit.trail(events_chain(spark, sf), "event", "42").select("chain_id", "sequence", "action"))


@query(
    "approval_entries",
    """SELECT o_orderkey AS invoice_id, 'approve' AS action FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def approval_entries(spark, sf):
    o = tables.table(spark, sf, "orders")
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "OWNER").otherwise("STAFF")
    return audit.approvals(o.select(F.col("o_orderkey").alias("invoice_id"), F.lit("approve").alias("action"), role.alias("role")))


cte(
    "approve_seq",
    """SELECT o_custkey % 200 AS chain_id, coalesce(n, 0) + row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) - 1 AS sequence, o_orderkey,
  '{"cents":' || CAST(round(o_totalprice * 100) AS BIGINT) || '}' AS payload
FROM orders LEFT JOIN (SELECT chain_id, count(*) AS n FROM audit_seq GROUP BY 1) h ON h.chain_id = o_custkey % 200 WHERE o_orderpriority = '1-URGENT'""",
    "audit_seq",
)
cte(
    "approve_chain",
    f"""SELECT a.chain_id, coalesce(h.last, -1) AS sequence, coalesce(h.entry_hash, '{audit.GENESIS}') AS entry_hash, NULL::BIGINT AS o_orderkey FROM (SELECT DISTINCT chain_id FROM approve_seq) a
LEFT JOIN (SELECT chain_id, max(sequence) AS last, arg_max(entry_hash, sequence) AS entry_hash FROM audit_chain WHERE sequence >= 0 GROUP BY 1) h ON h.chain_id = a.chain_id
UNION ALL
SELECT s.chain_id, s.sequence, sha256('{{"action":"approve","actor_id":"owner","entity_id":"' || s.o_orderkey || '","entity_type":"invoice","payload":' || s.payload || ',"previous_hash":"' || c.entry_hash
  || '","sequence":' || s.sequence || ',"timestamp":"o' || s.o_orderkey || '"}}'), s.o_orderkey FROM approve_chain c JOIN approve_seq s ON s.chain_id = c.chain_id AND s.sequence = c.sequence + 1""",
    "approve_seq",
    "audit_chain",
)


@query("approval_chain", twin("SELECT chain_id, sequence, CAST(o_orderkey AS VARCHAR) AS entity_id, entry_hash FROM approve_chain WHERE o_orderkey IS NOT NULL", "approve_chain"))
def approval_chain(spark, sf):
    """Approvals hashed on from the heads of the event chains."""
    o = tables.table(spark, sf, "orders")
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "OWNER").otherwise("STAFF")
    requests = o.select(
        F.col("o_orderkey").alias("request_no"), (F.col("o_custkey") % 200).alias("chain_id"), role.alias("role"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("timestamp"),
        F.lit("owner").alias("actor_id"), F.lit("invoice").alias("entity_type"), F.col("o_orderkey").cast("string").alias("entity_id"),
        F.concat(F.lit('{"cents":'), F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.lit("}")).alias("payload"),
    )
    return shown(audit.approve(requests, cut_lineage(audit.append(events_chain(spark, sf)))).select("chain_id", "sequence", "entity_id", "entry_hash"))


@query(
    "usage_meter",
    """SELECT user_id, coalesce(n, 0) AS calls_used, greatest(0, 40 - coalesce(n, 0)) AS calls_remaining, coalesce(n, 0) >= 40 AS exhausted, CAST(coalesce(d, DATE '2024-01-20') + 14 AS VARCHAR) AS window_resets_on
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, count(*) AS n, CAST(min(ts) AS DATE) AS d FROM events
  WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND ts > TIMESTAMP '2024-01-06 00:00:00' GROUP BY 1) USING (user_id)""",
)
def usage_meter(spark, sf):
    return shown(usage.usage_status(tables.table(spark, sf, "events"), ["user_id"], "ts", "2024-01-20 00:00:00", 40, 14))


@query(
    "usage_rolling",
    """SELECT user_id, CAST(day AS VARCHAR) AS day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)""",
)
def usage_rolling(spark, sf):
    e = tables.table(spark, sf, "events").select("user_id", F.col("ts").cast("date").alias("day"))
    return shown(usage.rolling_usage(e, ["user_id"], "day", 7))


@query(
    "link_integrity",
    """SELECT o_orderkey AS obligation_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'payable cannot link an inflow' WHEN o_orderstatus <> 'F' AND o_orderkey % 5 = 0 THEN 'receivable cannot link an outflow' END AS reject_reason FROM orders""",
)
def link_integrity(spark, sf):
    from ledgerloom.schemas import link_violation

    o = tables.table(spark, sf, "orders")
    is_out = F.col("o_orderstatus") == "F"
    k = F.col("o_orderkey")
    r = o.select(k.alias("obligation_id"), F.when(is_out, "payable").otherwise("receivable").alias("direction"),
                 F.when(is_out & (k % 3 == 0), k).alias("inflow_id"), F.when(~is_out & (k % 5 == 0), k).alias("outflow_id"))
    return r.select("obligation_id", link_violation().alias("reject_reason"))
