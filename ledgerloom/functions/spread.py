"""Building blocks that keep one hot key from landing in one task.

A window partitioned by a business, a file or a vendor puts all rows of that key
into one task.  The helpers here cut such a key into order-preserving blocks, or
answer the same question with aggregates that combine on the map side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage

BLOCK_ROWS = 65_536
HOT_SHARE = 1_000


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer partitions than cores before expensive per-row work.

    A large input already has more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def previous_rows(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    columns: Sequence[str],
    depth: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``prev{k}_{column}`` for k = 1..depth along a dense integer index.

    Rows are windowed in blocks of ``block_rows``; the last ``depth`` rows of a
    block are also sent to the next one, so a key of any size is spread over many
    tasks with a single shuffle.
    """
    pos = F.col(index).cast("long")
    block = F.floor(pos / block_rows).cast("long")
    offset = F.pmod(pos, F.lit(block_rows))
    homes = F.when(offset >= block_rows - depth, F.array(block, block + 1)).otherwise(F.array(block))
    spread = df.withColumn("_home", block).withColumn("_block", F.explode(homes))
    w = Window.partitionBy(*keys, "_block").orderBy(index)
    for k in range(1, depth + 1):
        for c in columns:
            spread = spread.withColumn(f"prev{k}_{c}", F.lag(c, k).over(w))
    return spread.filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


def block_of(id_column: str, block_rows: int = BLOCK_ROWS) -> Column:
    """Order-preserving block of a unique integer id: at most ``block_rows`` ids."""
    return F.floor(F.col(id_column).cast("long") / block_rows).cast("long")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    unique_id: str,
    measures: Mapping[str, Column],
    inclusive: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running sums along ``order + [unique_id]``, blocked so that no key is one task.

    ``order`` must be coarse columns that sort before ``unique_id``.  Each
    (keys, order, id block) is windowed on its own and shifted by the totals of the
    blocks before it, which are themselves small aggregates.
    """
    blocks = [*keys, *order, "_blk"]
    rows = df.withColumn("_blk", block_of(unique_id, block_rows))
    for name, expr in measures.items():
        rows = rows.withColumn(f"_m_{name}", expr)
    totals = rows.groupBy(*blocks).agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in measures])
    before = Window.partitionBy(*keys).orderBy(*order, "_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *blocks, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in measures]
    )
    inside = (
        Window.partitionBy(*blocks)
        .orderBy(unique_id)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = rows.select(
        "*", *[F.coalesce(F.sum(f"_m_{n}").over(inside), F.lit(0)).alias(f"_l_{n}") for n in measures]
    )
    joined = local.join(offsets, blocks)
    return joined.select(
        *df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in measures]
    )


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    weight: str,
    how: str = "left",
) -> DataFrame:
    """Join a unique-key ``lookup`` to ``facts`` whose keys may be badly skewed.

    ``weight`` is the number of fact rows per key.  Keys above 1/1000 of all rows
    number fewer than 1000, so that part is broadcast with a proven bound; the rest
    is shuffled, with the already answered hot rows scattered by a row hash.  The
    per-key table is read three times, so it is written once first.
    """
    lookup = cut_lineage(lookup)
    payload = [c for c in lookup.columns if c not in keys and c != weight]
    total = lookup.agg(F.sum(weight).alias("_total"))
    sized = lookup.crossJoin(F.broadcast(total))
    hot = sized.filter(F.col(weight) * HOT_SHARE > F.col("_total")).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(p).alias(f"_hp_{p}") for p in payload], F.lit(True).alias("_hot")
    )
    cold = sized.filter(F.col(weight) * HOT_SHARE <= F.col("_total")).select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.lit(0).alias("_c_salt"),
        *[F.col(p).alias(f"_cp_{p}") for p in payload],
        F.lit(True).alias("_cold"),
    )
    on_hot = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_h_{k}") for k in keys])
    first = facts.join(F.broadcast(hot), on_hot, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.xxhash64(*[F.col(c) for c in facts.columns])).otherwise(F.lit(0))
    )
    for k in keys:
        first = first.withColumn(f"_j_{k}", F.when(F.col("_hot").isNull(), F.col(k)))
    on_cold = reduce(
        lambda a, b: a & b,
        [F.col(f"_j_{k}") == F.col(f"_c_{k}") for k in keys] + [F.col("_salt") == F.col("_c_salt")],
    )
    second = first.join(cold, on_cold, "left")
    if how == "inner":
        second = second.filter(F.col("_hot").isNotNull() | F.col("_cold").isNotNull())
    return second.select(
        *facts.columns, *[F.coalesce(F.col(f"_hp_{p}"), F.col(f"_cp_{p}")).alias(p) for p in payload]
    )


#: Width of the first buckets of ``exact_quantiles`` in powers of e, the values below which they are one bucket, and the parts of the later ones.
_FOLDS, _TINY, _PARTS = 16, 1e-9, 4_096


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], parts: int = _PARTS) -> DataFrame:
    """Exact linearly interpolated quantiles by radix selection: all keys and all ranks at once, counts only.

    A pass counts the rows of each bucket and its smallest and largest value; the bucket that holds a
    rank is divided again, until it holds one value or the rank is its first or last row.  The first
    buckets are fixed steps of the logarithm, the next ones equal parts between the bucket's own limits.
    Counts combine before they are shuffled, and only rows of buckets that are still open are read
    on, so neither a hot key nor a hot value gathers rows in a task.  Nulls take no part, NaN is the largest value.
    """
    keys = list(keys)
    v = F.col("_v")
    first = F.when(F.isnan(v), F.lit(1 << 40)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v) / _TINY) * _FOLDS).cast("long"))
    rows = df.filter(F.col(value).isNotNull()).select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).withColumn("_b", first)
    limits = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    per_key = Window.partitionBy(*keys)
    ranks = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p)) + 1
        ranks += [F.struct(F.lit(f"f_{name}").alias("tag"), F.floor(pos).cast("long").alias("r")), F.struct(F.lit(f"c_{name}").alias("tag"), F.ceil(pos).cast("long").alias("r"))]

    def found(groups: DataFrame, within: Sequence[str], order: str) -> DataFrame:
        """The ranks of ``_want`` with the bucket that holds each, and their places inside it."""
        cum = F.sum("_c").over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        held = groups.withColumn("_below", cum - F.col("_c"))
        inside = F.filter("_want", lambda w: (w["r"] > F.col("_below")) & (w["r"] <= F.col("_below") + F.col("_c")))
        return held.withColumn("_w", F.explode(inside)).select(*keys, "n", "_b", "_lo", "_hi", "_c", F.col("_w.tag").alias("tag"), (F.col("_w.r") - F.col("_below")).alias("_r"))

    groups = rows.groupBy(*keys, "_b").agg(*limits).withColumn("n", F.sum("_c").over(per_key)).withColumn("_want", F.array(*ranks))
    picks = cut_lineage(found(groups, keys, "_b"))
    closed = (F.col("_lo").eqNullSafe(F.col("_hi"))) | (F.col("_r") == 1) | (F.col("_r") == F.col("_c"))
    at = F.when((F.col("_r") == 1) | F.col("_lo").eqNullSafe(F.col("_hi")), F.col("_lo")).otherwise(F.col("_hi"))
    done = picks.filter(closed).select(*keys, "n", "tag", at.alias("_x"))
    picks = picks.filter(~closed)
    while picks.limit(1).count():
        wanted = picks.groupBy(*keys, "n", "_b", "_lo", "_hi").agg(F.collect_list(F.struct("tag", F.col("_r").alias("r"))).alias("_want"))
        named = wanted.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_old"), "n", "_lo", "_hi", "_want")
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_b") == F.col("_old")]
        share = (v / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        rows = rows.select(*keys, "_v", "_b").join(named.drop("n", "_want"), reduce(lambda a, b: a & b, same)).withColumn("_part", F.least(F.floor(share * parts), F.lit(parts - 1)).cast("long"))
        rows = cut_lineage(rows.select(*keys, "_v", F.xxhash64("_b", "_part").alias("_b"), F.col("_b").alias("_old"), "_part"))
        groups = rows.groupBy(*keys, "_old", "_b", "_part").agg(*limits)
        again = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_old") == F.col("_from")]
        groups = groups.join(named.drop("_lo", "_hi").withColumnRenamed("_old", "_from"), reduce(lambda a, b: a & b, again))
        picks = cut_lineage(found(groups, [*keys, "_old"], "_part"))
        done = done.unionByName(picks.filter(closed).select(*keys, "n", "tag", at.alias("_x")))
        picks = picks.filter(~closed)
    wide = done.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("tag") == f"{t}_{n}", F.col("_x"))).alias(f"_{t}_{n}") for n in probs for t in "fc"])
    final = []
    for n, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p)) + 1
        f, c = F.col(f"_f_{n}"), F.col(f"_c_{n}")
        final.append((f + (c - f) * (pos - F.floor(pos))).alias(n))
    return wide.select(*keys, "n", *final)
