"""Nearest vectors by stable projections, a kd-tree and a chi-square stopping test.

Largest inner product becomes smallest distance: a candidate gets one more component that brings it to
the largest norm, a query gets zero there.  Gaussian (2-stable) projections to DIMENSIONS numbers
follow: a projected squared distance over the true one is chi-square with so many degrees of freedom.

1. Equal vectors are one class with its smallest ids (as many as can be asked for).
2. A kd-tree fitted on at most SAMPLE projected classes cuts the projected space into cells; every
   class is put into its cell, and a cell of any size is dealt out in blocks of BLOCK classes.
3. A query takes its projected neighbours nearest first: its own cell, then the next few by the
   distance of their boxes, then the others; inside a block, leaf by leaf of a smaller kd-tree.
   Neighbours are verified by the inner product.  It stops where a vector as near as the k-th best so far would
   have had to come earlier with probability CONFIDENCE: Psi(next projected / k-th distance, squared) >= CONFIDENCE.

No step holds more than a block of classes and a part of QUERIES queries.  Vectors that are null, empty,
zero or hold null or non-finite components take no part, nor do rows without an id; vectors of
another length than the query's are no candidates.  A vec_id with several vectors asks for each and
never finds itself; rows repeated whole count once.  Components are meant to be below 1e150, so that products are finite.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.spread import lookup_join
from ledgerloom.llm.chunks import share, tidy
from ledgerloom.session import cut_lineage

NEIGHBOURS = 20
QUERY_STEP = 20
#: Even, so that the chi-square distribution is a finite sum.
DIMENSIONS = 8
CONFIDENCE = 0.95
#: Projected classes that the tree of cells is fitted on, at most; every class is indexed.
SAMPLE = 1 << 16
BLOCK = 1 << 13
LEAF = 256
QUERIES = 1 << 12
#: Cells after the first that a query visits before the rest is judged.
NEXT = 4
SEED = 23


def chi_square(x: float, m: int = DIMENSIONS) -> float:
    """Distribution function with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))


def stopping_ratio(confidence: float = CONFIDENCE, m: int = DIMENSIONS) -> float:
    """Squared ratio of projected to true distance that chi-square stays below with this probability."""
    low, high = 0.0, 1e3
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < confidence else (low, mid)
    return high


def projection(size: int, m: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng([SEED, size, m]).standard_normal((size + 1, m))


def projected(vectors: np.ndarray, scale: float, norm2: float | None, m: int = DIMENSIONS) -> np.ndarray:
    """Projections of vectors over ``scale``; candidates are lifted to the squared norm ``norm2``."""
    x = vectors / scale
    g = projection(x.shape[1], m)
    lifted = 0 if norm2 is None else np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))[:, None] * g[-1]
    return x @ g[:-1] + lifted


def split(points: np.ndarray, least: int) -> list:
    """A kd-tree: [axis, value, left, right] or None; halves at the median of the widest axis while both keep ``least``."""
    if len(points) < 2 * least:
        return None
    axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
    value = float(np.median(points[:, axis]))
    left = points[:, axis] <= value
    if left.all() or not left.any():
        return None
    return [axis, value, split(points[left], least), split(points[~left], least)]


def cell_of(tree: list | None, points: np.ndarray) -> np.ndarray:
    """Number of the leaf that each point falls into, left to right in bits below a leading one."""
    out = np.ones(len(points), np.int64)

    def go(node: list | None, at: np.ndarray) -> None:
        if node is None or not len(at):
            return
        right = points[at, node[0]] > node[1]
        out[at] = 2 * out[at] + right
        go(node[2], at[~right])
        go(node[3], at[right])

    go(tree, np.arange(len(points)))
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bounds(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points, boxes): squared distance to each box, 0 inside."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        x = points[:, k : k + 1]
        out += np.maximum(np.maximum(low[None, :, k] - x, x - high[None, :, k]), 0) ** 2
    return out


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    done, left = [], [np.arange(len(points))]
    while left:
        at = left.pop()
        if len(at) <= LEAF:
            done.append(at)
            continue
        axis = int(np.argmax(np.ptp(points[at], axis=0)))
        order = at[np.argsort(points[at, axis], kind="stable")]
        left += [order[: len(at) // 2], order[len(at) // 2 :]]
    return done


def search_block(vectors: np.ndarray, proj: np.ndarray, queries: np.ndarray, query_proj: np.ndarray, worst: np.ndarray, base: np.ndarray, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k`` rows of a block for each query and their inner products (-1 and -inf where there are fewer).

    ``worst``: inner product that a row must reach; ``base``: squared norm of the query plus that of the candidates.
    """
    leaves = _leaves(proj)
    bound = _bounds(query_proj, np.array([proj[x].min(axis=0) for x in leaves]), np.array([proj[x].max(axis=0) for x in leaves]))
    order = np.argsort(bound, axis=1, kind="stable")
    n = len(queries)
    best, at = np.full((n, k), -np.inf), np.full((n, k), -1)
    floor = worst.copy()
    for step in range(len(leaves)):
        leaf = order[:, step]
        reach = ratio * np.maximum(base - 2 * floor, 0)
        going = np.flatnonzero(bound[np.arange(n), leaf] <= reach)
        if not len(going):
            break
        for x in np.unique(leaf[going]):
            q, rows = going[leaf[going] == x], leaves[x]
            gap = (query_proj[q] ** 2).sum(axis=1)[:, None] + (proj[rows] ** 2).sum(axis=1)[None, :] - 2 * query_proj[q] @ proj[rows].T
            score = np.where(gap <= reach[q][:, None] + 1e-9, queries[q] @ vectors[rows].T, -np.inf)
            both = np.concatenate((best[q], score), axis=1)
            where = np.concatenate((at[q], np.broadcast_to(rows, (len(q), len(rows)))), axis=1)
            keep = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best[q], at[q] = np.take_along_axis(both, keep, axis=1), np.take_along_axis(where, keep, axis=1)
            floor[q] = np.maximum(floor[q], best[q][:, -1])
    at[~np.isfinite(best)] = -1
    return at, best


def _key(v: Column) -> list[Column]:
    return [F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(SEED), v).alias("k2")]


def nearest(rows: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP, vec_id: str = "vec_id", vector: str = "embedding", m: int = DIMENSIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows by inner product of each row whose id ``step`` divides."""
    spark, ratio, keep = rows.sparkSession, stopping_ratio(confidence, m), k + 1
    key = ["k1", "k2"]
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(F.coalesce(sound, F.lit(False)))
    base = base.select("vec_id", "v", F.size("v").alias("size"), *_key(F.col("v")))
    with tidy(spark):
        base = cut_lineage(base.dropDuplicates([*key, "vec_id"]))
        # The smallest ids of each class; ranks are limited before rows move.
        first = base.select(*key, "size", "vec_id", "v").withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).filter(F.col("rank") <= keep)
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
        scales = base.groupBy("size").agg(F.max(norm).alias("scale"))
        norms = base.join(F.broadcast(scales), "size").groupBy("size", "scale").agg(F.max(F.aggregate(F.transform("v", lambda x: (x / F.col("scale")) * (x / F.col("scale"))), F.lit(0.0), lambda s, x: s + x)).alias("norm2"))
        facts = share(spark, {r["size"]: (r["scale"], r["norm2"]) for r in norms.collect()})  # one row for each length of vector

        def project(query: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    sizes = batch.column(batch.schema.get_field_index("size")).to_numpy()
                    for size in np.unique(sizes):
                        part = batch.filter(pa.array(sizes == size))
                        scale, norm2 = facts()[int(size)]
                        p = projected(_matrix(part.column(part.schema.get_field_index("v"))), scale, None if query else norm2, m)
                        yield part.append_column("p", pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, m), pa.int32()), pa.array(p.ravel())))

            return run

        classes = first.groupBy(*key).agg(F.first("size").alias("size"), F.first("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
        classes = cut_lineage(classes.mapInArrow(project(False), "k1 long, k2 long, size int, v array<double>, ids array<long>, p array<double>"))
        asked = cut_lineage(base.filter(F.col("vec_id") % step == 0).select("vec_id", *key, "size", "v"))
        queries = asked.groupBy(*key).agg(F.first("size").alias("size"), F.first("v").alias("v"), F.count("*").alias("n"))
        queries = cut_lineage(queries.mapInArrow(project(True), "k1 long, k2 long, size int, v array<double>, n long, p array<double>"))

        # Cells: a tree for each length of vector, from one bounded sample.
        held = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count("*").alias("n")).collect()}
        sample = classes.orderBy("k2").limit(SAMPLE).select("size", "p").toArrow()
        sizes, points = sample.column("size").to_numpy(), _matrix(sample.column("p")) if len(sample) else np.zeros((0, m))
        trees = share(spark, {s: split(points[sizes == s], max(16, int((sizes == s).sum() * BLOCK / n))) for s, n in held.items()})

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = batch.column(2).to_numpy()
                cell, p = np.ones(len(size), np.int64), _matrix(batch.column(5))
                for s in np.unique(size):
                    cell[size == s] = cell_of(trees()[int(s)], p[size == s])
                yield batch.append_column("cell", pa.array(cell))

        index = cut_lineage(classes.mapInArrow(placed, "k1 long, k2 long, size int, v array<double>, ids array<long>, p array<double>, cell long"))
        edge = [f(F.col("p")[i]).alias(f"{c}{i}") for i in range(m) for f, c in ((F.min, "lo"), (F.max, "hi"))]
        found = index.groupBy("size", "cell").agg(F.count("*").alias("n"), *edge).orderBy("size", "cell").collect()  # at most SAMPLE / 16 cells, and one for each length
        boxes = {}
        for r in found:
            boxes.setdefault(r["size"], []).append((r["cell"], -(-r["n"] // BLOCK), [r[f"lo{i}"] for i in range(m)], [r[f"hi{i}"] for i in range(m)]))
        boxes = share(spark, {s: tuple(map(np.array, zip(*b))) for s, b in boxes.items()})
        blocks = spark.createDataFrame([(r["size"], r["cell"], -(-r["n"] // BLOCK)) for r in found], "size int, cell long, blocks long")
        index = index.join(F.broadcast(blocks), ["size", "cell"]).withColumn("block", F.pmod("k1", F.col("blocks")))

        def visits(low: int, high: int):
            """Cells from the low-th to the high-th nearest that the stopping test still asks for."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    size, worst = batch.column(2).to_numpy(), batch.column(6).to_numpy()
                    for s in np.unique(size):
                        at = np.flatnonzero(size == s)
                        if int(s) not in boxes():
                            continue
                        cell, n_blocks, lo, hi = boxes()[int(s)]
                        scale, norm2 = facts()[int(s)]
                        part = batch.take(pa.array(at))
                        x = _matrix(part.column(3)) / scale
                        bound = _bounds(_matrix(part.column(5)), lo, hi)
                        order = np.argsort(bound, axis=1, kind="stable")[:, low:high]
                        with np.errstate(invalid="ignore"):
                            reach = ratio * np.maximum((x * x).sum(axis=1) + norm2 - 2 * worst[at], 0)
                        near = np.take_along_axis(bound, order, axis=1) <= reach[:, None]
                        q, c = np.nonzero(near)
                        c = order[q, c]
                        spread = np.repeat(np.arange(len(q)), n_blocks[c])
                        block = np.arange(len(spread)) - np.repeat(np.cumsum(n_blocks[c]) - n_blocks[c], n_blocks[c])
                        out = part.take(pa.array(q[spread]))
                        yield out.append_column("cell", pa.array(cell[c[spread]])).append_column("block", pa.array(block.astype(np.int64)))

            return run

        def compared(there: pa.Table, asking: pa.Table) -> pa.Table:
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            if not len(there) or not len(asking):
                return pa.table([pa.array([], t) for t in kinds], ["k1", "k2", "score", "vec_id"])
            scale, norm2 = facts()[int(there.column("size")[0].as_py())]
            raw, raw_queries = _matrix(there.column("v")), _matrix(asking.column("v"))
            x, q = raw / scale, raw_queries / scale
            at, _ = search_block(x, _matrix(there.column("p")), q, _matrix(asking.column("p")), asking.column("worst").to_numpy(), (q * q).sum(axis=1) + norm2, keep, ratio)
            ids = there.column("ids").to_pylist()
            who, score, whom = [], [], []
            for a, line in enumerate(at):
                for b in line[line >= 0]:
                    s = math.fsum(raw_queries[a] * raw[b])
                    who += [a] * len(ids[b])
                    score += [s] * len(ids[b])
                    whom += ids[b]
            who = pa.array(who, pa.int64())
            return pa.table([asking.column("k1").take(who), asking.column("k2").take(who), pa.array(score, pa.float64()), pa.array(whom, pa.int64())], ["k1", "k2", "score", "vec_id"])

        best = None
        for low, high in ((0, 1), (1, 1 + NEXT), (1 + NEXT, None)):
            now = queries.withColumn("worst", F.lit(float("-inf"))) if best is None else queries.join(best, key, "left").select(*queries.columns, F.coalesce(F.when(F.size("top") == keep, -F.element_at("top", -1)["less"] / F.col("top_scale")), F.lit(float("-inf"))).alias("worst"))
            going = cut_lineage(now.mapInArrow(visits(low, high), "k1 long, k2 long, size int, v array<double>, n long, p array<double>, worst double, cell long, block long"))
            parts = going.groupBy("size", "cell", "block").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
            left = index.drop("blocks").join(parts, ["size", "cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
            right = going.join(parts, ["size", "cell", "block"]).withColumn("part", F.pmod("k2", "parts"))
            by = ["size", "cell", "block", "part"]
            got = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compared, "k1 long, k2 long, score double, vec_id long")
            got = got.groupBy(*key).agg(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id")).alias("new"))
            if best is not None:
                got = got.withColumnRenamed("new", "more").join(best.select(*key, "top"), key, "full").select(*key, F.concat(F.coalesce("more", F.slice("top", 1, 0)), F.coalesce("top", F.slice("more", 1, 0))).alias("new"))
            best = got.select(*key, F.slice(F.array_sort("new"), 1, keep).alias("top"))
            sized = queries.join(F.broadcast(norms.select("size", (F.col("scale") * F.col("scale")).alias("top_scale"))), "size").select(*key, "top_scale")
            best = cut_lineage(best.join(sized, key))
        answers = queries.select(*key, "n").join(best.select(*key, "top"), key)
        out = lookup_join(asked.select("vec_id", *key), answers, key, "n")
        mine = out.select(F.col("vec_id").alias("query_id"), F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("vec_id")), 1, k).alias("top"))
        return mine.select("query_id", F.posexplode("top")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "col.vec_id", (-F.col("col.less") + F.lit(0.0)).alias("score"))
