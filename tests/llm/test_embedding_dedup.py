import math
import random

import numpy as np

from ledgerloom.llm import embedding_dedup

DATA = "/root/testdata/sf0.01/embeddings.parquet"


def brute(rows):
    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def unit(v):
        v = np.array(v, float) / max(map(abs, v))
        return v / np.linalg.norm(v)

    units = [unit(v) if sound(v) and label is not None else None for _, v, label in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    out = []
    for a, (i, _, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root(b) == root(a) and rows[b][0] is not None]
        least = min(ids) if ids else None
        out.append((i, links[a], least, i is not None and i == least))
    return out


def test_odd_vectors_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = random.Random(3)
    base = [rng.gauss(0, 1) for _ in range(10)]
    rows = [(k, [x + rng.gauss(0, 0.02) for x in base], 1) for k in range(60)]
    rows += [(100, None, 1), (101, [0.0] * 10, 1), (102, [1.0, None] + [0.0] * 8, 1), (103, [float("nan")] * 10, 1), (104, base, None), (105, base, 2), (106, [2 * x for x in base], 2), (107, base[:9], 1)]
    rows += [(108, [], 1), (109, [float("inf")] + [0.0] * 9, 1), (5, base, 1), (5, base, 1), (None, base, 3), (None, [-0.0, 1.0], 4), (110, [0.0, 1.0], 4), (111, [1e200, 0.0], 5), (112, [1e-200, 0.0], 5)]
    docs = spark.createDataFrame([(i, v, y, True) for i, v, y in rows], "vec_id long, embedding array<double>, label int, kept boolean")
    got = embedding_dedup.near_vectors(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)
    assert embedding_dedup.near_vectors(docs.limit(0)).count() == 0


def test_recall_on_sample_table(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(DATA).collect()]
    rng = np.random.default_rng(5)
    for i, v, y in rows[:300]:  # the table's own vectors with noise, at cosines around the threshold
        noise = rng.normal(0, 1, len(v))
        rows.append((10_000 + i, list(np.array(v) + noise * rng.uniform(0.1, 0.22) * np.linalg.norm(v) / np.linalg.norm(noise)), y))
    want = {r[0]: r for r in brute(rows)}
    docs = spark.createDataFrame([(i, [float(x) for x in v], y) for i, v, y in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: tuple(r) for r in embedding_dedup.near_vectors(docs).collect()}
    pairs = sum(r[1] for r in want.values())
    assert pairs > 200 and sum(r[1] for r in got.values()) >= 0.9 * pairs
    assert all(got[i][1] <= want[i][1] for i in want)  # none below the threshold
