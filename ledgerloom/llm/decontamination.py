"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

The automaton knows every run of words inside an item.  A document's words walk through it and
the longest match at each word is tracked: at 10 or more words the last 10 are a window of an item;
an item of fewer words is met where it is a suffix of the match.  Stretches of words that hold two
neighbours which no item has next to each other cannot hold a match and are not walked.

The items are the small side: shards of at most SHARD_WORDS words are broadcast.  A larger
benchmark takes a pass over the documents for each shard, with the finds written in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.chunks import share
from ledgerloom.llm.textbytes import ALNUM, LOWER, Lookup, buffer_of, cuts, span_hash, words
from ledgerloom.session import cut_lineage

WINDOW = 10
#: A document is dropped when more than this share of its words is hit; else its hit spans go.
COVERAGE = 0.5
#: About 300 bytes of a worker's memory for each word.
SHARD_WORDS = 500_000
_PAIR = np.uint64(0x9E6C63D0876A9A47)


class Automaton:
    """Suffix automaton of word lists; ``items`` of a state are those it occurs in."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.names = [name for name, _ in items]
        ends: list[tuple[int, int, int]] = []
        owners: list[set[int]] = [set()]
        for k, (_, line) in enumerate(items):
            last = 0
            for w in line.tolist():
                last = self._extend(last, w)
                while len(owners) < len(self.next):
                    owners.append(set())
                owners[last].add(k)
            if 0 < len(line) < window:
                ends.append((k, len(line), last))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.size[s]):
            if self.link[s] > 0:
                owners[self.link[s]] |= owners[s]
        self.owners = owners
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for k, n, s in ends:
            self.whole.setdefault(s, []).append((n, k))
        hashes = [line for _, line in items if len(line)]
        every = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.vocabulary = Lookup(every)
        self.pairs = Lookup(np.unique(np.concatenate([x[:-1] * _PAIR + x[1:] for x in hashes] or [every])))
        self.least = min([window, *(len(x) for x in hashes)])

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._copy(last, w, q)
        new = self._state(self.size[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._copy(p, w, q)
        return new

    def _state(self, size: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(0)
        self.size.append(size)
        return len(self.next) - 1

    def _copy(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.size[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def walk(self, line: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of words inside windows, and the items met."""
        state = length = 0
        hit: list[tuple[int, int]] = []
        met: set[int] = set()
        for p, w in enumerate(line):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if w not in self.next[state]:
                continue
            state, length = self.next[state][w], length + 1
            s, reach, longest = state, length, 0
            if length >= self.window:
                while self.size[self.link[s]] >= self.window:
                    s = self.link[s]
                met |= self.owners[s]
                s, longest = state, self.window
            while s > 0:
                for n, k in self.whole.get(s, ()):
                    if n <= reach:
                        met.add(k)
                        longest = max(longest, n)
                s = self.link[s]
                reach = self.size[s]
            if longest:
                if hit and hit[-1][1] >= p + 1 - longest:
                    while len(hit) > 1 and hit[-2][1] >= p + 1 - longest:
                        hit.pop()
                    hit[-1] = (min(hit[-1][0], p + 1 - longest), p + 1)
                else:
                    hit.append((p + 1 - longest, p + 1))
        return hit, met


def _hashed(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    buf, offs = buffer_of(column)
    for i, j in cuts(offs, 2 << 20):
        part, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, first = words(LOWER[part], at, ALNUM)
        yield i, part, at, starts, ends, first, span_hash(LOWER[part], starts, ends)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(benchmark: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> Iterator[Automaton]:
    """Automata of the items, each of a bounded number of words (or of one longer item)."""
    sized = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(text, F.lit("")).alias("text")).withColumn("n", F.floor(F.octet_length("text") / 2) + 1)
    total = sized.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-2 * total // shard_words)) if total > shard_words else 1
    for k in range(count):
        shard = sized.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).select("item", "text").toArrow()
        names, items = shard.column("item").to_pylist(), []
        for i, _, _, _, _, first, hashes in _hashed(shard.column("text")):
            items += [(names[i + d], hashes[a:b]) for d, (a, b) in enumerate(zip(first[:-1], first[1:]))]
        yield Automaton(items, window)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs with n_words, n_hit, n_items, items_sha256, contaminated and spans.

    spans: byte ranges (start, end) of the text, from the first to the last word of each hit run.  A
    null text, or one without words, has no hit; so has every text when no item has words.  Items
    that share an id count once; a null item_id counts as an empty one.  Columns of docs that bear a
    name of the result are replaced.
    """
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(*kept).withColumns({"n_words": F.lit(0).cast("long"), "hit_words": F.lit(None).cast("array<long>"), "hit_bytes": F.lit(None).cast("array<long>"), "hit_items": F.lit(None).cast("array<string>")})
    schema = rows.schema
    for k, automaton in enumerate(_shards(benchmark, item_id, item_text, window, shard_words)):
        known = share(docs.sparkSession, automaton)

        def search(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            items = known()
            for batch in batches:
                column = {c: batch.column(n) for n, c in enumerate(batch.schema.names)}
                n_words, hits, spans, met = [], column["hit_words"].to_pylist(), column["hit_bytes"].to_pylist(), column["hit_items"].to_pylist()
                for i, _, at, starts, ends, first, hashes in _hashed(column[text]):
                    n_words.append(np.diff(first))
                    inside = items.vocabulary(hashes) >= 0
                    joined = np.zeros(len(hashes), bool)
                    both = np.flatnonzero(inside[1:] & inside[:-1]) + 1
                    joined[both] = items.pairs(hashes[both - 1] * _PAIR + hashes[both]) >= 0
                    joined[first[:-1][first[:-1] < len(joined)]] = False
                    run = np.flatnonzero(inside & ~joined)
                    stop = np.flatnonzero(inside & ~np.append(joined[1:], False)) + 1
                    long = stop - run >= items.least
                    for a, b in zip(run[long].tolist(), stop[long].tolist()):
                        ranges, found = items.walk(hashes[a:b].tolist())
                        if ranges:
                            d = int(np.searchsorted(first, a, "right")) - 1
                            base, origin = int(first[d]), int(at[d])
                            hits[i + d] = (hits[i + d] or []) + [x for r in ranges for x in (a + r[0] - base, a + r[1] - base)]
                            spans[i + d] = (spans[i + d] or []) + [x for r in ranges for x in (int(starts[a + r[0]]) - origin, int(ends[a + r[1] - 1]) - origin)]
                            met[i + d] = sorted({*(met[i + d] or []), *(items.names[x] for x in found)})
                column |= {"n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), "hit_words": pa.array(hits, pa.list_(pa.int64())), "hit_bytes": pa.array(spans, pa.list_(pa.int64())), "hit_items": pa.array(met, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(column.values()), list(column))

        if k:
            rows = cut_lineage(rows)
        rows = rows.mapInArrow(search, schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(n) for n, c in enumerate(batch.schema.names)}
            hits, spans, met = (column.pop(c).to_pylist() for c in ("hit_words", "hit_bytes", "hit_items"))
            pairs = lambda x: list(zip(x[::2], x[1::2]))
            n_hit = [sum(b - a for a, b in _merged(pairs(x or []))) for x in hits]
            column |= {
                "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x or []) for x in met], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x or [])).encode()).hexdigest() for x in met], pa.string()),
                "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in _merged(pairs(x or []))] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
            yield pa.RecordBatch.from_arrays(list(column.values()), list(column))

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return rows.mapInArrow(digest, f"{base}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: long, end: long>>")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE, **names) -> DataFrame:
    """The columns of docs without what the benchmark has: hit spans are cut out of the text, and a
    document goes when they hold more than ``coverage`` of its words."""
    found = contamination(docs, benchmark, text=text, **names)
    raw = F.encode(text, "UTF-8")
    spans = F.col("spans")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    left = F.transform(F.arrays_zip(edges.alias("a"), F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text).cast("long"))).alias("b")), lambda e: F.decode(F.substring(raw, (e["a"] + 1).cast("int"), (e["b"] - e["a"]).cast("int")), "UTF-8"))
    kept = found.filter(~F.col("contaminated") | (F.col("n_hit") <= coverage * F.col("n_words")))
    return kept.withColumn(text, F.when(F.col("contaminated"), F.concat_ws("", left)).otherwise(F.col(text))).select(*docs.columns)
