"""Fitted credit models: stratified split, logistic, boosted trees, occlusion attribution."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.credit import FEATURES
from ledgerloom.session import cut_lineage

Z_95 = 1.959963984540054


def stratified_split(features: DataFrame, id_col: str = "invoice_id", train: float = 0.7, seed: int = 42) -> DataFrame:
    """Hashed split inside each label: exact to sampling error, with no ordering of a class."""
    u = F.pmod(F.xxhash64(F.lit(seed), id_col, "label"), F.lit(2**40)) / float(2**40)
    return features.withColumn("is_train", u < train)


def standard_scaler(train: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population sd of the ten features: twenty numbers to the driver."""
    row = train.agg(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]).first()
    return {f: (row[f"m_{f}"], row[f"s_{f}"] or 1.0) for f in FEATURES}


def scaled(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    cols = [((F.col(f) - m) / s).alias(f"z_{f}") for f, (m, s) in scaler.items()]
    return VectorAssembler(inputCols=[f"z_{f}" for f in FEATURES], outputCol="vec").transform(df.select("*", *cols))


def fit_logistic(train: DataFrame, c: float = 1.0, max_iter: int = 100):
    """L2 logistic on standardized features without class weights, which would spoil calibration."""
    scaler = standard_scaler(train)
    data = scaled(train, scaler).select("vec", F.col("label").cast("double").alias("label"))
    n = data.count()
    model = LogisticRegression(featuresCol="vec", labelCol="label", maxIter=max_iter, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, tol=1e-7).fit(data)
    return scaler, model


def score_logistic(df: DataFrame, scaler, model) -> DataFrame:
    return model.transform(scaled(df, scaler)).withColumn("score", vector_to_array("probability")[1]).drop("vec", "rawPrediction", "probability", "prediction", *[f"z_{f}" for f in FEATURES])


def wald_intervals(train: DataFrame, scaler, model) -> dict[str, tuple[float, float, float]]:
    """Coefficient, lower and upper bound: the 11 x 11 information matrix is summed on the executors."""
    zs = [F.lit(1.0), *[((F.col(f) - m) / s) for f, (m, s) in scaler.items()]]
    p = F.col("score")
    w = p * (1.0 - p)
    k = len(zs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = score_logistic(train, scaler, model).agg(*[F.sum(w * zs[i] * zs[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    info = np.zeros((k, k))
    for i, j in pairs:
        info[i, j] = info[j, i] = row[f"g{i}_{j}"]
    se = np.sqrt(np.clip(np.diag(np.linalg.pinv(info))[1:], 0.0, None))
    return {f: (float(b), float(b - Z_95 * s), float(b + Z_95 * s)) for f, b, s in zip(FEATURES, model.coefficients.toArray(), se)}


# --- boosted trees ----------------------------------------------------------------------------

#: Bins of a feature, rows that its limits are found from, and rounds after which margins are kept.
BINS, LIMIT_ROWS, KEPT_ROUNDS = 32, 10_000, 8
#: Instead of a bin, for a node that sends all rows to its left.
NO_SPLIT = 255


@dataclass(frozen=True)
class Boosted:
    """Limits of each feature's bins, and per round its weight, the feature and bin that each node splits after, and the leaf values.

    Trees are complete; a node without a split sends all rows to its left."""

    limits: list[np.ndarray]
    trees: list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]


def _limits(values: np.ndarray, n: float, bins: int) -> np.ndarray:
    """Midpoints between values that cut ``n`` expected rows into parts as equal as they get; what the sample has fewer counts as zeros."""
    found, counts = np.unique(values[values != 0.0], return_counts=True)
    if not len(found):
        return np.array([])
    zeros = n - counts.sum()
    if zeros > np.finfo(float).eps * counts.sum() * 100:
        at = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, at, 0.0), np.insert(counts.astype(float), at, zeros)
    if len(found) <= bins:
        return (found[:-1] + found[1:]) / 2.0
    out, step = [], n / bins
    target, seen = step, float(counts[0])
    for i in range(1, len(found)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append((found[i - 1] + found[i]) / 2.0)
            target += step
    return np.array(out)


def _codes(columns: list[np.ndarray], limits: list[np.ndarray]) -> list[np.ndarray]:
    if any(np.isnan(c).any() for c in columns):
        raise ValueError("a feature is missing or not a number")
    return [np.searchsorted(t, c, side="left").astype(np.uint8) for c, t in zip(columns, limits)]


def _places(codes: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Number of the node, within its level, that each row reaches."""
    at = np.zeros(len(codes[0]), dtype=np.uint8)
    for level in range(levels):
        right = np.zeros(len(at), dtype=bool)
        for k in range(1 << level):
            node = (1 << level) - 1 + k
            if cut[node] != NO_SPLIT:
                over = codes[feature[node]] > cut[node]
                right |= over if level == 0 else over & (at == k)
        at = at * 2 + right
    return at


def _margin(codes: list[np.ndarray], trees, start: np.ndarray | float = 0.0) -> np.ndarray:
    total = np.zeros(len(codes[0])) + start
    for weight, feature, cut, leaf in trees:
        total += weight * leaf[_places(codes, feature, cut, int(np.log2(len(leaf))))]
    return total


def _sampled(data: DataFrame, n: int, seed: int) -> np.ndarray:
    """About ``LIMIT_ROWS`` rows, drawn as MLlib draws them; all of a smaller table."""
    if n > LIMIT_ROWS:
        spark = data.sparkSession
        number = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        rows = data._jdf.rdd().sample(False, LIMIT_ROWS / n, number)
        data = DataFrame(spark._jsparkSession.createDataFrame(rows, data._jdf.schema()), spark)
    return data.select(*FEATURES).toPandas().to_numpy(float)


def fit_boosted(train: DataFrame, rounds: int = 200, rate: float = 0.06, depth: int = 3, seed: int = 42) -> Boosted:
    """Boosted trees on the log loss without an L2 term on the leaves.

    Rows are bin numbers, two features in one 16-bit number, in blocks that stay in memory beside their margins; a pass
    over them counts and adds what each bin of each node holds, and only these sums reach the driver.
    """
    data = train.select(*[F.col(f).cast("double").alias(f) for f in FEATURES], F.col("label").cast("double").alias("label"))
    n = data.count()
    if n == 0:
        raise ValueError("no row to learn from")
    bins, width = min(BINS, n), len(FEATURES)
    sample = _sampled(data, n, seed)
    limits = [_limits(sample[:, k], min(1.0, LIMIT_ROWS / n) * n, bins) for k in range(width)]
    bits = max(len(x) for x in limits).bit_length()  # a sample of more rows than expected has more than BINS bins
    slots = 1 << bits

    def pack(batches):
        for b in batches:
            columns = [b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]
            codes = _codes([c.astype(float) for c in columns], limits)
            y = b.column("label").to_numpy(zero_copy_only=False).astype(float)
            if not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("a label is neither 0 nor 1")
            codes += [np.zeros(len(y), np.uint8)] * (width % 2)
            two = [codes[k].astype(np.uint16) * slots + codes[k + 1] for k in range(0, len(codes), 2)]
            yield pa.RecordBatch.from_pydict({"two": [np.concatenate(two).tobytes()], "y": [(2 * y - 1).astype(np.int8).tobytes()]})

    half = (width + 1) // 2

    def opened(r):
        y = np.frombuffer(r["y"], np.int8)
        return np.frombuffer(r["two"], np.uint16).reshape(half, len(y)), y, np.zeros(len(y))

    unpacked = lambda two: [x for t in two for x in ((t >> bits).astype(np.uint8), (t & (slots - 1)).astype(np.uint8))]
    state = cut_lineage(data.mapInArrow(pack, "two binary, y binary")).rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(feature, cut, level, pending, first):
        nodes = 1 << level

        def partition(blocks):
            total = np.zeros((2, width + width % 2, nodes, slots))
            square = np.zeros(nodes)
            for two, y, margin in blocks:
                codes = unpacked(two) if level or pending else None
                margin = _margin(codes, pending, margin) if pending else margin
                r = y.astype(float) if first else 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
                at = _places(codes, feature, cut, level) if level else np.zeros(len(y), np.uint8)
                square += np.bincount(at, r * r, nodes)
                base = at.astype(np.int64) * (slots * slots)
                for k in range(half):
                    place = base + two[k]
                    for w, x in ((0, None), (1, r)):
                        both = np.bincount(place, x, nodes * slots * slots).reshape(nodes, slots, slots)
                        total[w, 2 * k] += both.sum(2)
                        total[w, 2 * k + 1] += both.sum(1)
            yield total[:, :width], square

        return partition

    trees, pending = [], []
    for m in range(rounds):
        feature, cut = np.zeros((1 << depth) - 1, dtype=int), np.full((1 << depth) - 1, NO_SPLIT)
        leaf, open_nodes = np.zeros(1 << depth), {0}
        for level in range(depth):
            found = state.mapPartitions(sums(feature, cut, level, list(pending), m == 0)).collect()
            (count, added), square = sum(x for x, _ in found), sum(x for _, x in found)
            following = set()
            for k in sorted(open_nodes):
                c, a = count[:, k], added[:, k]
                size, whole = c[0].sum(), a[0].sum()
                left, low = np.cumsum(c, 1)[:, :-1], np.cumsum(a, 1)[:, :-1]
                right, high = size - left, whole - low
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = (low * low / left + high * high / right - whole * whole / size) / size
                for f in range(width):
                    gain[f, len(limits[f]):] = -np.inf
                gain[(left < 1) | (right < 1)] = -np.inf
                f, b = divmod(int(np.argmax(gain)), slots - 1) if slots > 1 else (0, 0)
                span = 1 << (depth - level)
                pure = level > 0 and abs((square[k] - whole * whole / size) / size) < np.finfo(float).eps
                if slots == 1 or gain[f, b] <= 0 or pure:
                    leaf[k * span:(k + 1) * span] = whole / size
                    continue
                node = (1 << level) - 1 + k
                feature[node], cut[node] = f, b
                middle = k * span + span // 2
                leaf[k * span:middle], leaf[middle:(k + 1) * span] = low[f, b] / left[f, b], high[f, b] / right[f, b]
                following |= {2 * k, 2 * k + 1}
            open_nodes = following
            if not open_nodes:
                break
        trees.append((rate if m else 1.0, feature, cut, leaf))
        pending.append(trees[-1])
        if len(pending) == KEPT_ROUNDS and m + 1 < rounds:
            add = lambda b, new=tuple(pending): (b[0], b[1], _margin(unpacked(b[0]), new, b[2]))
            old, state, pending = state, state.map(add).persist(StorageLevel.MEMORY_AND_DISK), []
            state.count()
            old.unpersist()
    state.unpersist()
    return Boosted(limits, trees)


def score_boosted(df: DataFrame, model: Boosted) -> DataFrame:
    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        return pd.Series(1.0 / (1.0 + np.exp(-2.0 * _margin(_codes([f.to_numpy(float) for f in features], model.limits), model.trees))))

    return df.withColumn("score", score(*[F.col(f).cast("double") for f in FEATURES]))


def occlusion(df: DataFrame, model: Boosted, means: dict[str, float], id_col: str = "invoice_id") -> DataFrame:
    """Log-odds change when one feature is set to its mean: occlusion, not Shapley values.

    All variants of a row are scored where the row is; a hidden feature changes only the trees that split by it.
    """
    own = {k: [t for t in model.trees if (t[1][t[2] != NO_SPLIT] == k).any()] for k in range(len(FEATURES))}
    hidden = [_codes([np.array([float(means[f])])], [t])[0][0] for f, t in zip(FEATURES, model.limits)]

    @F.pandas_udf("array<double>")
    def change(*features: pd.Series) -> pd.Series:
        def odds(margin):
            p = np.clip(1.0 / (1.0 + np.exp(-2.0 * margin)), 1e-9, 1 - 1e-9)
            return np.log(p / (1.0 - p))

        codes = _codes([f.to_numpy(float) for f in features], model.limits)
        full = _margin(codes, model.trees)
        out = np.empty((len(full), len(codes)))
        for k in range(len(codes)):
            other = [*codes[:k], np.full(len(full), hidden[k]), *codes[k + 1:]]
            out[:, k] = odds(full) - odds(full - _margin(codes, own[k]) + _margin(other, own[k]))
        return pd.Series(list(out))

    changes = df.select(id_col, change(*[F.col(f).cast("double") for f in FEATURES]).alias("_v"))
    named = F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in FEATURES]).alias("feature"), F.col("_v").alias("contribution")))
    return changes.select(id_col, named.alias("c")).select(id_col, F.col("c.feature").alias("feature"), F.col("c.contribution").alias("contribution"))
