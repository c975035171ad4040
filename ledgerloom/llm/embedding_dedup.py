"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with verified pairs.

A table hashes a vector twice: random signs and a Hadamard transform, three times over, then the
nearest of the plus or minus unit vectors.  The two together are its bucket; multiprobe also puts it
in the buckets where either hash takes its second choice.  Vectors that share a bucket are compared
in double precision.

Equal vectors of a label are one class with a count.  A bucket with more than BLOCK classes is
compared block by block, in as many tasks as it has pairs of blocks, so it may hold any share of all
rows.  A pair that shares several buckets counts in the first alone; tasks return sums of links and a spanning
forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.chunks import tidy
from ledgerloom.llm.components import components
from ledgerloom.session import cut_lineage

COSINE = 0.98
TABLES = 8
ROUNDS = 3
BLOCK = 512
SEED = 11


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def codes(unit: np.ndarray, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """(vectors, tables, 3): the bucket of each vector and its two probes, in each table."""
    n, d = unit.shape
    size = 1 << max(1, (d - 1).bit_length())
    rng = np.random.default_rng([seed, size])
    signs = rng.choice([-1.0, 1.0], (tables, 2, ROUNDS, size))
    padded = np.zeros((n, size))
    padded[:, :d] = unit
    out = np.zeros((n, tables, 3), np.int32)
    for t in range(tables):
        best, second = [], []
        for k in range(2):
            x = padded
            for r in range(ROUNDS):
                x = _hadamard(x * signs[t, k, r])
            both = np.concatenate((x, -x), axis=1)
            order = np.argpartition(-both, 1, axis=1)[:, :2]
            swap = both[np.arange(n), order[:, 0]] < both[np.arange(n), order[:, 1]]
            order[swap] = order[swap][:, ::-1]
            best.append(order[:, 0])
            second.append(order[:, 1])
        out[:, t] = np.stack((best[0] * 2 * size + best[1], second[0] * 2 * size + best[1], best[0] * 2 * size + second[1]), axis=1)
    return out


def _unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(float)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _compared(group: pa.Table, threshold: float, tables: int) -> pa.Table:
    """Links inside the buckets' blocks that one task holds."""
    bucket = np.stack([group.column(c).to_numpy() for c in ("label", "size", "tab", "code", "i", "j")])
    node, count, block = (group.column(c).to_numpy() for c in ("node", "n", "block"))
    order = np.lexsort((block, *bucket[::-1]))
    changed = np.any(bucket[:, order][:, 1:] != bucket[:, order][:, :-1], axis=0)
    heads = np.flatnonzero(np.concatenate(([True], changed, [True])))
    vectors, every = group.column("v").combine_chunks(), group.column("codes").combine_chunks()
    offs, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy()
    all_codes = every.values.to_numpy().reshape(-1, tables, 3)
    links: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    for a, b in zip(heads[:-1], heads[1:]):
        at = order[a:b]
        if b - a < 2:
            continue
        label, size, tab, code, i, j = bucket[:, at[0]]
        unit = _unit(np.stack([flat[offs[x] : offs[x + 1]] for x in at]))
        near = unit @ unit.T >= threshold
        if i == j:
            near = np.triu(near, 1)
        else:
            near &= (block[at][:, None] == i) & (block[at][None, :] == j)
        x, y = np.nonzero(near)
        if not len(x):
            continue
        p, q = all_codes[at[x]], all_codes[at[y]]
        shared = (p[:, :, :, None] == q[:, :, None, :]).any(axis=3)  # of the first one's buckets
        earlier = shared[:, : int(tab)].any(axis=(1, 2)) | (shared[:, int(tab)] & (p[:, int(tab)] < code)).any(axis=1)
        for u, w in zip(np.concatenate((x[~earlier], y[~earlier])), np.concatenate((y[~earlier], x[~earlier]))):
            links[int(node[at[u]])] = links.get(int(node[at[u]]), 0) + int(count[at[w]])
        low = np.arange(len(at))
        while True:
            new = low.copy()
            np.minimum.at(new, x, low[y])
            np.minimum.at(new, y, low[x])
            if (new == low).all():
                break
            low = new
        edges += [(int(node[at[u]]), int(node[at[w]])) for u, w in enumerate(low) if u != w]
    nodes = [*links, *(a for a, _ in edges)]
    return pa.table([pa.array(nodes, pa.int64()), pa.array([None] * len(links) + [b for _, b in edges], pa.int64()), pa.array([*links.values()] + [0] * len(edges), pa.int64())], ["a", "b", "n"])


def near_vectors(rows: DataFrame, threshold: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", tables: int = TABLES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows link when their labels are equal and their cosine is at least ``threshold``.  Vectors that
    are null, empty, zero or hold null, NaN or infinity link with nothing, as do rows without a label
    and vectors of different lengths.  Repeated rows count as vectors of their own.  A null vec_id names no
    component where its class has another.  Other columns are not read.
    """
    spark = rows.sparkSession
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.col(label).cast("long").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    base = base.withColumn("node", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", F.size("v"), "v")))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            vectors = column["v"].to_pylist()
            lens = np.array([len(x) for x in vectors])
            for d in np.unique(lens):
                pick = np.flatnonzero(lens == d)
                found = codes(_unit(np.array([vectors[k] for k in pick])), tables)
                n, entries = len(pick), 3 * tables
                spread = pa.array(np.repeat(pick, entries))
                whole = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * entries, entries), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([column["label"].take(spread), pa.array(np.full(n * entries, d)), pa.array(np.tile(np.repeat(np.arange(tables), 3), n)), pa.array(found.ravel().astype(np.int64)), column["node"].take(spread), column["n"].take(spread), column["v"].take(spread), whole.take(pa.array(np.repeat(np.arange(n), entries)))], ["label", "size", "tab", "code", "node", "n", "v", "codes"])

    with tidy(spark):
        base = cut_lineage(base)
        classes = cut_lineage(base.filter("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least")))
        entries = cut_lineage(classes.select("label", "node", "n", "v").mapInArrow(placed, "label long, size long, tab long, code long, node long, n long, v array<double>, codes array<int>"))
        key = ["label", "size", "tab", "code"]
        blocks = entries.groupBy(*key).agg(F.count("*").alias("held")).filter("held > 1").withColumn("blocks", F.ceil(F.col("held") / BLOCK))
        dealt = entries.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        n_parts = max(8, int(entries.count() // 20_000))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64(*key, "i", "j"), F.lit(n_parts)))
        found = cut_lineage(dealt.groupBy("part").applyInArrow(lambda group: _compared(group, threshold, tables), "a long, b long, n long"))
    together = components(found.filter("b is not null"))
    with tidy(spark):
        links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
        named = classes.select("node", "n", "least").join(together, "node", "left").join(links, "node", "left").withColumn("class", F.coalesce("component", "node"))
        named = cut_lineage(named)
        least = named.groupBy("class").agg(F.min("least").alias("component_id"))
        named = cut_lineage(named.join(least, "class").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    out = base.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
