import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import lm_matching
from ledgerloom.llm.lm_matching import ORDER


def train_side(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2


def brute(rows, nodes):
    """Partial matching with exclusion sets, symbol by symbol."""
    grams, symbols, texts = Counter(), 0, 0
    for i, t in rows:
        if train_side(i):
            line = b"\xff" * ORDER + (t or "").encode() + b"\xff"
            texts += 1
            for p in range(ORDER, len(line)):
                symbols += 1
                for k in range(ORDER + 1):
                    grams[line[p - k : p + 1]] += 1
    least = max(1, -(-symbols // nodes))
    follow, total = defaultdict(dict), Counter()
    for g, n in grams.items():
        total[g[:-1]] += n
        if n >= least:
            follow[g[:-1]][g[-1]] = n

    def cost(context, s):
        gone, p = set(), 1.0
        for k in range(ORDER, -1, -1):
            c = context[len(context) - k :]
            if not follow.get(c):
                continue
            seen = {x: n for x, n in follow[c].items() if x not in gone}
            whole = total[c] - sum(follow[c][x] for x in gone) + len(seen)
            if s in seen:
                return math.log10(p * seen[s] / whole)
            if whole:
                p *= (whole - sum(seen.values())) / whole
            gone |= set(follow[c])
        return math.log10(p / (256 - len(gone)))

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    counts = Counter(w for i, t in rows if train_side(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        line = b"\xff" * ORDER + (t or "").encode() + b"\xff"
        w = words(t)
        out.append((i, not train_side(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), sum(cost(line[p - ORDER : p], line[p]) for p in range(ORDER, len(line)))))
    return out


def compare(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[6], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


@pytest.mark.parametrize(("nodes", "chunk_bytes"), [(lm_matching.NODES, 1 << 20), (200, 3000)])
def test_against_brute_force(spark, nodes, chunk_bytes):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()]
    rows = [(i, t[:700]) for i, t in rows] + [(900, None), (901, ""), (None, "Null id"), (902, "\x00 ü€ " * 3), (903, "The the THE"), (903, "The the THE")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    compare(lm_matching.score(docs, nodes=nodes, chunk_bytes=chunk_bytes).collect(), brute(rows, nodes))


def test_nothing_to_learn(spark):
    held = [i for i in range(100) if not train_side(i)][:2]
    rows = [(held[0], "abc"), (held[1], None)]
    compare(lm_matching.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows, lm_matching.NODES))
    assert lm_matching.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_node_is_dropped(spark, monkeypatch):
    """The model of the query does not get coarser as the corpus grows."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()]
    rows = [(i, t[:500]) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    default = lm_matching.score.__defaults__
    monkeypatch.setattr(lm_matching.score, "__defaults__", tuple(200 if x == 1 << 22 else x for x in default))
    compare(lm_matching.score(docs, chunk_bytes=3000).collect(), brute(rows, 1 << 62))
