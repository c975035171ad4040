import math
from collections import defaultdict

import numpy as np

from ledgerloom.llm import projected_search as ps

KIND = "vec_id long, embedding array<double>"


def sound(i, v):
    return i is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, k=20, step=20):
    kept = list({(i, tuple(v)) for i, v in rows if sound(i, v)})
    out = []
    for i, v in kept:
        if math.fmod(i, step) == 0:
            best = sorted((-math.fsum(np.array(v) * np.array(w)), j) for j, w in kept if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def found(df):
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    return sorted(tuple(r) for r in df.collect())


def recall(got, want):
    g, w = defaultdict(set), defaultdict(set)
    for rows, out in ((got, g), (want, w)):
        for q, _, v, _ in rows:
            out[q].add(v)
    return sum(len(g[q] & w[q]) for q in w) / sum(map(len, w.values()))


def test_distribution():
    draws = (np.random.default_rng(1).standard_normal((40_000, 8)) ** 2).sum(axis=1)
    for p in (0.5, 0.9, 0.95):
        assert abs((draws <= ps.stopping_ratio(p)).mean() - p) < 0.01


def test_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(2)
    hot = [round(float(x), 3) for x in rng.standard_normal(5)]
    rows = [(int(i), [round(float(x), 2) for x in rng.standard_normal(5)]) for i in range(-30, 120)]
    rows += [(i, hot) for i in range(200, 290)]  # more copies than neighbours
    rows += [(300, None), (320, []), (340, [0.0] * 5), (360, [1.0, None, 0.0, 0.0, 0.0]), (380, [math.nan] + hot[1:]), (400, [math.inf] + hot[1:]), (None, hot), (420, hot), (420, hot), (440, [-0.0, 1.0]), (441, [2.0, 1.0]), (460, [3.0]), (480, hot[::-1]), (480, hot)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as k1", "2 as cell", "'x' as P")
    got, want = found(ps.nearest(df, confidence=0.999999)), brute(rows)
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(a[3] == b[3] for a, b in zip(got, want))


def test_recall_over_cells_and_blocks(spark, monkeypatch):
    """Several cells, a cell of many blocks and parts of queries; all rows are indexed."""
    for name, value in (("BLOCK", 64), ("LEAF", 16), ("QUERIES", 8), ("SAMPLE", 600)):
        monkeypatch.setattr(ps, name, value)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(2_000)]
    rows += [(10_000 + i, (5 * centres[0] + 1e-3 * rng.standard_normal(16)).tolist()) for i in range(700)]  # a third in one place
    got, want = found(ps.nearest(spark.createDataFrame(rows, KIND))), brute(rows)
    assert len(got) == len(want) and recall(got, want) >= 0.9


def test_recall_on_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got, want = found(ps.nearest(spark.createDataFrame(rows, KIND))), brute(rows)
    assert recall(got, want) >= 0.9


def test_few_and_none(spark):
    assert found(ps.nearest(spark.createDataFrame([], KIND))) == []
    assert found(ps.nearest(spark.createDataFrame([(0, [1.0])], KIND))) == []
    assert found(ps.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], KIND))) == [(0, 1, 1, 2.0)]
