import random

import duckdb
import pytest

from ledgerloom.llm import line_dedup

DATA = "/root/testdata/sf0.001/documents.parquet"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def brute(rows, threshold):
    places = [((i, k), line) for i, t in rows if t is not None for k, line in enumerate(t.split("\n")) if len(line) >= 20]
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if len(x) < 20 or not any(p < (i, k) and abs(len(x) - len(y)) <= threshold and distance(x, y) <= threshold for p, y in places)]
        n = t.count("\n") + 1
        out.append((i, n, n - len(kept), "\n".join(kept) if len(kept) < n else t))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("ab\u00e9 ") for _ in range(rng.randrange(19, 34))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "short\nshort"), (3, "\n\n")]
    for i in range(4, 60):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            line = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(0, 2)] = rng.choice(["", "a", "z", "\u00e9"])
            lines.append("".join(line))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("seed", "threshold", "hot"), [(1, 1, 64), (2, 1, 3), (3, 2, 64)])
def test_against_brute_force(spark, seed, threshold, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "was") for i, t in rows], "doc_id long, text string, kept_text string").repartition(3)
    got = line_dedup.dedup_lines(docs, threshold=threshold).select("doc_id", "n_lines", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, threshold)


def test_null_ids_and_repeats(spark):
    line = "a line that is long enough to count"
    rows = [(None, line), (5, line), (5, line), (6, line + "\nx"), (7, line + "!")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 1, ""), (5, 0, line), (5, 0, line), (6, 1, "x"), (7, 1, "")], key=str)


def test_sql_and_empty_table(spark):
    docs = spark.read.parquet(DATA)
    assert line_dedup.query(docs.limit(0)).count() == 0
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS FROM '{DATA}'")
        want = db.execute(line_dedup.SQL).fetchall()
    assert sorted(map(tuple, line_dedup.query(docs).collect())) == sorted(want)
