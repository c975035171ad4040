"""Hash-chained audit trail: verify in parallel, append in order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.spread import lookup_join, previous_rows, running_totals

GENESIS = "0" * 64
FIELDS = ["sequence", "timestamp", "actor_id", "action", "entity_type", "entity_id", "payload", "previous_hash"]


def _quoted(col: str) -> Column:
    """JSON string with its control characters, quotes and backslashes escaped."""
    text = F.regexp_extract(F.to_json(F.struct(F.col(col).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.when(F.col(col).isNotNull(), text)


def canonical_json(previous: str = "previous_hash") -> Column:
    """Keys in alphabetical order, no spaces; ``payload`` is already canonical JSON text."""
    parts = {
        "action": _quoted("action"), "actor_id": _quoted("actor_id"), "entity_id": _quoted("entity_id"), "entity_type": _quoted("entity_type"),
        "payload": F.col("payload"), "previous_hash": _quoted(previous), "sequence": F.col("sequence").cast("string"), "timestamp": _quoted("timestamp"),
    }
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()])
    return F.concat(F.lit("{"), body, F.lit("}"))


def verify(chain: DataFrame) -> DataFrame:
    """First broken entry per chain and which test failed.

    Every row is tested from stored values: its link against the entry before it, its hash
    against its own contents.  Rows meet their predecessor in blocks of sequence numbers.
    """
    linked = previous_rows(chain, ["chain_id"], "sequence", ["entry_hash"])
    expected = F.coalesce("prev1_entry_hash", F.when(F.col("sequence") == 0, F.lit(GENESIS)), F.lit("missing"))
    bad_link = F.col("previous_hash") != expected
    bad_hash = F.sha2(canonical_json(), 256) != F.col("entry_hash")
    failure = F.when(bad_link, "link").when(bad_hash, "contents")
    tested = linked.withColumn("failure", failure)
    broken = F.when(F.col("failure").isNotNull(), F.col("sequence"))
    return tested.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("n_entries"), F.min(broken).alias("first_broken"), F.min_by("failure", broken).alias("failure")
    ).select("chain_id", F.col("first_broken").isNull().alias("intact"), "n_entries", "first_broken", "failure")


def _chain(batches):
    heads: dict = {}
    for pdf in batches:
        prev_col, hash_col = [], []
        for chain, stored, before, after in zip(pdf["chain_id"], pdf["_head"], pdf["_before"], pdf["_after"]):
            prev = heads.get(chain, stored)
            digest = hashlib.sha256((before + prev + after).encode("utf-8")).hexdigest()
            prev_col.append(prev)
            hash_col.append(digest)
            heads = {chain: digest}
        yield pdf.drop(columns=["_before", "_after", "_head"]).assign(previous_hash=prev_col, entry_hash=hash_col)


def append(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Add previous_hash and entry_hash in sequence order, continuing from stored heads.

    A chain is sequential by definition: each hash needs the one before.  Everything else of
    the entry is prepared in the JVM; the Python step streams over a sorted partition and
    keeps one hash per chain.
    """
    marker = "\ue000previous\ue000"  # nothing in it is escaped
    text = F.split(canonical_json("_mark"), marker)
    base = entries.withColumn("_mark", F.lit(marker))
    ready = base.select(*entries.columns, text[0].alias("_before"), text[1].alias("_after"))
    if heads is None:
        ready = ready.withColumn("_head", F.lit(GENESIS))
    else:
        ready = ready.join(heads.select("chain_id", F.col("head_hash").alias("_head")), "chain_id", "left").withColumn("_head", F.coalesce("_head", F.lit(GENESIS)))
    ordered = ready.repartition("chain_id").sortWithinPartitions("chain_id", "sequence")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields)
    return ordered.mapInPandas(_chain, fields + ", previous_hash string, entry_hash string")


def heads(chain: DataFrame) -> DataFrame:
    return chain.groupBy("chain_id").agg(F.max_by("entry_hash", "sequence").alias("head_hash"), F.count(F.lit(1)).alias("n_entries"))


def trail(chain: DataFrame, entity_type: str, entity_id: str | Column) -> DataFrame:
    return chain.filter((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id))


def approvals(requests: DataFrame) -> DataFrame:
    """Approve entries of owners; any other role is refused and leaves no entry."""
    return requests.filter(F.col("role") == "OWNER").drop("role")


def approve(requests: DataFrame, chain: DataFrame) -> DataFrame:
    """Owners' approvals as new entries of their chains, hashed on from each chain's head; a chain may start here.

    ``requests``: request_no (unique), chain_id, role, timestamp, actor_id, entity_type, entity_id, payload.  Entries of a
    chain follow each other by request_no; other roles leave no entry.
    """
    ends = heads(chain)
    numbered = running_totals(approvals(requests), ["chain_id"], [], "request_no", {"nth": F.lit(1)}, inclusive=False)
    sizes = numbered.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n")).join(ends.select("chain_id", "n_entries"), "chain_id", "left")
    placed = lookup_join(numbered, sizes, ["chain_id"], "n")
    entries = placed.select("chain_id", (F.coalesce("n_entries", F.lit(0)) + F.col("nth")).alias("sequence"), "timestamp", "actor_id", F.lit("approve").alias("action"), "entity_type", "entity_id", "payload")
    return append(entries, ends)
