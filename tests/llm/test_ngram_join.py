import random
import re

import pytest

from ledgerloom.llm import ngram_join


def sets_of(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets, up = sets_of(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            alike = sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])
            if alike or (rows[x][0] is not None and rows[x][0] == rows[y][0] and sets[x] and sets[y]):
                up[root(x)] = root(y)
    out = []
    for x, (i, _) in enumerate(rows):
        ids = [rows[y][0] for y in range(len(rows)) if root(y) == root(x) and rows[y][0] is not None]
        out.append((i, len(sets[x]), min(ids) if ids and sets[x] else i))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"W{k}é" if k % 9 == 0 else f"w{k}" for k in range(60)]
    line = [rng.choice(vocabulary) for _ in range(14)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 70))] for _ in range(6)]
    rows = [(i, t) for i, t in enumerate([None, "", " \t\n", "one", "ONE", "one  two", "one two", "a b c d e", "a b c d e f"])]
    for i in range(len(rows), n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            words += line
        rows.append((i, rng.choice([" ", "\n", " \v"]).join(words)))
    return rows + [(12, "twice the same id here now"), (12, "other text of that id is this"), (None, rows[20][1]), (None, "lonely null id")]


@pytest.mark.parametrize("seed, group, worth", [(1, 5, 0), (2, 5, 1), (2, 64, 32)])
def test_against_brute_force(spark, seed, group, worth, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "WORTH", worth)
    rows = corpus(seed, 260)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    got = ngram_join.similar_documents(docs, chunk_bytes=5_000).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(spark):
    assert ngram_join.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sample_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
