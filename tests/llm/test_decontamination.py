import hashlib
import random
import re

import pytest

from ledgerloom.llm import decontamination


def words_of(t):
    return [(m.group(), m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())]


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = [x[0] for x in words_of(t)]
        for p in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[p : p + 10]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w = [x[0] for x in words_of(t)]
        hit, met = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    met |= windows[tuple(w[p : p + n])]
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data(seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "d\u00e9lta", "e", "f1", "zz"]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(line(rng.choice([3, 9, 10, 11, 25])))) for k in range(12)] + [(50, None), (51, "..."), (52, "seldom word"), (53, "onceonly"), (None, "nobody knows"), (3, "same id, more text")]
    rows = []
    for i in range(60):
        parts = [" ".join(line(rng.randrange(0, 12)))]
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items)[1] or "x").split()
            a = rng.randrange(len(w))
            parts += [", ".join(w[a : a + rng.randrange(1, 20)]).upper(), " ".join(line(rng.randrange(0, 4)))]
        rows.append((i, "! ".join(parts)))
    return rows + [(100, None), (101, ""), (102, "--"), (103, "ONCEONLY"), (103, "a Seldom-WORD"), (None, "seldom word")], items


@pytest.mark.parametrize(("seed", "shard"), [(1, 10**6), (2, 10**6), (3, 60)])
def test_against_brute_force(spark, seed, shard):
    rows, items = data(seed)
    docs = spark.createDataFrame([(i, t, "was") for i, t in rows], "doc_id long, text string, n_hit string").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontamination.contamination(docs, bench, shard_words=shard).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, items)


def test_clean_cuts_spans_and_drops_covered_texts(spark):
    item = " ".join(f"word{k}" for k in range(12))
    long = " ".join(f"other{k}" for k in range(30))
    rows = [(1, f"\u00e9t\u00e9 {long}; {item.upper()}! end"), (2, item), (3, long), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontamination.clean(docs, bench).collect()}
    assert got == {1: f"\u00e9t\u00e9 {long}; ! end", 3: long, 4: None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[2:5] for r in decontamination.contamination(docs, none).drop("spans").collect()] == [(2, 0, 0)]
    assert decontamination.contamination(docs.limit(0), none).count() == 0
