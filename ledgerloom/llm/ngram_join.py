"""N-gram Jaccard join: classes of documents linked by word shingles, over token-combination prefixes.

Tokens are hashed shingles in one global order, rare ones first.  A document of n tokens needs
o = ceil(0.75 n) of them in any partner, so partners share a token among the first n - o + 1 and,
more generally, k tokens among the first n - o + k.  Hence:

- tokens that one document holds need no index entry, so most documents have none at all;
- equal token sets count once, and each set is first compared with the most typical set (that with
  the fewest tokens of its own) under each of its prefix tokens: groups of copies of any size join there;
- a token that still spans several classes is indexed with the band of the smaller partner's size, alone while
  comparing its group is cheap; where extending costs less (counted before a row is written), it is extended by
  the further tokens of the next longer prefix, to combinations of two, then three;
- at the k-th common token of two partners, what both have left must still reach the overlap they need; the
  smallest set under a key gives that bound before any two are compared;
- every candidate pair is verified on its whole token sets before it links.

Only pairs that lie in one class already are left out; no link between classes can be lost.
Token counts, the sets' first rows and typical sets come by the exchange of chunks.py, where a chunk
sends a token once, however many documents hold it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import chunks
from ledgerloom.llm.chunks import Chunk, ranges, tidy
from ledgerloom.llm.components import components
from ledgerloom.llm.textbytes import LOWER, cuts, id_array, mix, pack, span_hash, unpack, words
from ledgerloom.session import cut_lineage

WIDTH = 5
PERCENT = 75
#: An index key is extended by one more token, up to LONGEST, where more sets than GROUP may be the smaller partner
#: and comparing its sets takes more than WORTH pairs for each row that extending it can write.
GROUP, WORTH = 64, 32
LONGEST = 3
#: Sizes of two partners lie in one band or in neighbouring ones: a band is a little wider than their largest ratio.
BAND = 1.01 * math.log(100 / PERCENT)
PIECE = 1 << 20
_A = np.uint64(0x9FB21C651E98DF25)


def shingles(buf: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Ascending distinct hashed shingles of each text; a shorter text is one shingle, one without words none."""
    buf = LOWER[buf]
    starts, ends, first = words(buf, offs)
    w = span_hash(buf, starts, ends)
    n = max(0, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * _A + w[j : j + n]
    h = mix(h)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for y in range(a, b):
                x = mix(x * _A + w[y : y + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> int:
    """A positive 63-bit name of a token set."""
    return int(mix(np.array([mix(tokens).sum() + np.uint64(len(tokens))], np.uint64))[0] >> np.uint64(1))


def prefix(n: np.ndarray | int, k: int = 1) -> np.ndarray | int:
    return n - (PERCENT * n + 99) // 100 + k


def _join(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def _split(body: bytes) -> list[bytes]:
    k = int(np.frombuffer(body, np.int64, 1)[0])
    lens = np.frombuffer(body, np.int64, k, 8)
    ends = 8 * (k + 1) + np.cumsum(lens)
    return [body[e - x : e] for e, x in zip(ends.tolist(), lens.tolist())]


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts[order], head) if len(head) else counts


def _prepared(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int) -> DataFrame:
    """(doc_id, n_shingles, node, body): node names the token set; body, at the first row of a set that
    may have partners: how many tokens are its own, then all tokens in global order."""
    table = chunks.build(docs, doc_id, text, chunk_bytes)
    n_buckets = table.buckets_for(table.n_bytes / 6.4)
    bits = n_buckets.bit_length() - 1 + 32
    low = np.uint64(64 - bits)

    def sets(chunk: Chunk) -> list[np.ndarray]:
        return [s for i, j in cuts(chunk.offs, PIECE) for s in shingles(chunk.buf[chunk.offs[i] : chunk.offs[j]], chunk.offs[i : j + 1] - chunk.offs[i])]

    def counted(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.sort(np.concatenate([*found, np.zeros(0, np.uint64)]) >> low << low)
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[head], np.diff(np.append(head, len(keys)))

    def named(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Set name of each text, distinct names ascending, and the first text of each."""
        names = np.array([set_key(s) if len(s) else 0 for s in found], np.int64)
        distinct, at = np.unique(names, return_index=True)
        return names, distinct[distinct > 0], at[distinct > 0]

    def ask(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        found = sets(chunk)
        keys, n = counted(found)
        _, names, _ = named(found)
        mine = {b: (i, j) for b, i, j in ranges(names.view(np.uint64) << np.uint64(1), n_buckets)}
        theirs = {b: (i, j) for b, i, j in ranges(keys, n_buckets)}
        for b in sorted({*mine, *theirs}):
            i, j = theirs.get(b, (0, 0))
            x, y = mine.get(b, (0, 0))
            tails = ((keys[i:j] >> low) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield b, _join([pack(np.diff(tails, prepend=np.uint32(0))), pack(n[i:j].astype(np.uint32)), names[x:y].tobytes(), np.array([chunk.chunk_id], np.int64).tobytes()])

    def answer(bodies: list[bytes]) -> list[bytes]:
        asked = [_split(x) for x in bodies]
        tails = [np.cumsum(unpack(x[0], np.uint32), dtype=np.uint32) for x in asked]
        keys, n = _sums(np.concatenate(tails), np.concatenate([unpack(x[1], np.uint32) for x in asked]).astype(np.int64))
        rank = np.where(n > 1, np.minimum(255, 1 + 4 * np.log2(np.maximum(n, 1))), 0).astype(np.uint8)
        names = [np.frombuffer(x[2], np.int64) for x in asked]
        chunk_ids = np.repeat([int(np.frombuffer(x[3], np.int64)[0]) for x in asked], [len(x) for x in names])
        every = np.concatenate(names)
        order = np.lexsort((chunk_ids, every))
        first = np.zeros(len(every), np.uint8)
        first[order] = np.concatenate(([True], every[order][1:] != every[order][:-1]))[: len(order)]
        firsts = np.split(first, np.cumsum([len(x) for x in names])[:-1])
        return [_join([pack(rank[np.searchsorted(keys, t)] if len(t) else np.zeros(0, np.uint8)), f.tobytes()]) for t, f in zip(tails, firsts)]

    answers = table.exchange(ask, answer)

    def prepared(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        found = sets(chunk)
        keys, _ = counted(found)
        names, distinct, at = named(found)
        got = [_split(chunk.answers["ranks"][b]) for b in sorted(chunk.answers["ranks"])]
        ranks = np.concatenate([unpack(x[0], np.uint8) for x in got] + [np.zeros(0, np.uint8)])
        first = {int(at[k]) for k in np.flatnonzero(np.concatenate([np.frombuffer(x[1], np.uint8) for x in got] + [np.zeros(0, np.uint8)]))}
        bodies = []
        for d, s in enumerate(found):
            bodies.append(None)
            if d in first:
                rank = ranks[np.searchsorted(keys, s >> low << low)]
                own = int((rank == 0).sum())
                if own < prefix(len(s)):
                    bodies[-1] = np.array([own], np.int64).tobytes() + s[np.argsort(rank, kind="stable")].tobytes()
        yield pa.RecordBatch.from_arrays([id_array(chunk.ids), pa.array([len(s) for s in found], pa.int64()), pa.array(names, mask=names == 0), pa.array(bodies, pa.binary())], ["doc_id", "n_shingles", "node", "body"])

    with tidy(table.spark):
        out = cut_lineage(table.each(prepared, "doc_id long, n_shingles long, node long, body binary", {"ranks": answers}))
    table.drop()
    return out


def _tokens(body: pa.Scalar) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(body.as_buffer(), np.int64)
    return int(raw[0]), raw[1:].view(np.uint64)


def _near_typical(sets: DataFrame) -> DataFrame:
    """Pairs of each set and the most typical ones under its prefix tokens: (a, b)."""
    table = chunks.build(sets, "node", "body")
    n_buckets = table.buckets_for(table.n_bytes / 16)

    def entries(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, their sets' places in the chunk, own tokens and sizes of the sets."""
        raw = [chunk.buf[a:b].tobytes() for a, b in zip(chunk.offs[:-1], chunk.offs[1:])]
        own = np.array([np.frombuffer(x, np.int64, 1)[0] for x in raw], np.int64)
        size = np.diff(chunk.offs) // 8 - 1
        stop = prefix(size)
        tokens = [np.frombuffer(x, np.uint64, int(e - o), 8 + 8 * int(o)) for x, o, e in zip(raw, own, stop)]
        return np.concatenate(tokens), np.repeat(np.arange(len(raw)), stop - own), np.stack((own, size))

    def best(tokens: np.ndarray, own: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((node, own, tokens))
        head = np.flatnonzero(np.concatenate(([True], tokens[order][1:] != tokens[order][:-1])))
        return order, head

    def ask(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        tokens, at, (own, size) = entries(chunk)
        order, head = best(tokens, own[at], chunk.ids[at])
        pick = order[head]
        keys = tokens[pick]
        rows = np.stack((keys.view(np.int64), own[at[pick]], chunk.ids[at[pick]], size[at[pick]]))
        for b, i, j in ranges(keys, n_buckets):
            yield b, rows[:, i:j].tobytes()

    def answer(bodies: list[bytes]) -> list[bytes]:
        asked = [np.frombuffer(x, np.int64).reshape(4, -1) for x in bodies]
        every = np.concatenate(asked, axis=1)
        tokens = every[0].view(np.uint64)
        order, head = best(tokens, every[1], every[2])
        keys, rows = tokens[order[head]], every[2:, order[head]]
        return [rows[:, np.searchsorted(keys, x[0].view(np.uint64))].tobytes() for x in asked]

    def pairs(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        tokens, at, (_, size) = entries(chunk)
        keys = np.unique(tokens)
        got = chunk.answers["typical"]
        node, other = np.concatenate([np.frombuffer(got[b], np.int64).reshape(2, -1) for b in sorted(got)], axis=1)
        which = np.searchsorted(keys, tokens)
        node, other = node[which], other[which]
        fit = (node != chunk.ids[at]) & (100 * other >= PERCENT * size[at]) & (100 * size[at] >= PERCENT * other)
        found = np.unique(np.stack((chunk.ids[at[fit]], node[fit])), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    out = cut_lineage(table.each(pairs, "a long, b long", {"typical": table.exchange(ask, answer)}))
    table.drop()
    return out


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose token sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            keep = []
            for i in range(batch.num_rows):
                s, t = _tokens(x[i])[1], _tokens(y[i])[1]
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(x), F.col("body").alias(f"body_{x}")) for x in "ab")
    # Typical sets stand at b and have many partners; the body of a follows in a second join.
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "body_a", "body_b")
    with tidy(pairs.sparkSession):
        return cut_lineage(joined.mapInArrow(check, "a long, b long"))


def _across(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct candidate pairs of different classes, by single tokens and then combinations."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, body = batch.columns
            for i in range(batch.num_rows):
                own, tokens = _tokens(body[i])
                n = len(tokens)
                at = np.arange(own, min(n, prefix(n, LONGEST)))
                yield pa.RecordBatch.from_arrays([pa.array(tokens[at].view(np.int64)), pa.array(np.full(len(at), node[i].as_py())), pa.array(np.full(len(at), n)), pa.array(at)], ["token", "node", "n", "at"])

    # Of two partners the one with fewer tokens holds its k-th common one within `short`; what follows it must suffice.
    need = lambda total: F.ceil(total * PERCENT / (100 + PERCENT))
    stop = lambda k: F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + k
    short = lambda k: F.col("at") < F.col("n") - need(2 * F.col("n")) + k

    enough = lambda k, at: k + F.col("n") - at - 1 >= need(F.col("n") + F.col("least"))

    def spans(df: DataFrame, k: int) -> DataFrame:
        """Keys of sets of several classes, and whether extending them is worth it."""
        more = F.greatest(stop(k + 1) - 1 - F.col("at"), F.lit(0))  # rows that extending this one can write
        found = df.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.sum((F.col("own") & short(k)).cast("long")).alias("size"), F.count("*").alias("held"), F.sum(more).alias("more"))
        large = (F.col("size") > GROUP) & (F.col("size") * F.col("held") > WORTH * F.col("more")) & F.lit(k < LONGEST)
        return found.filter("low < high and size > 0").select("key", large.alias("large"))

    def within(df: DataFrame, k: int) -> DataFrame:
        """Sets whose tokens from here on suffice for ``least``, the smallest set that may be the smaller one under their key."""
        found = df.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min(F.when(F.col("own") & short(k), F.col("n"))).alias("least"))
        found = found.filter("low < high and least is not null").select("key", "least")
        return cut_lineage(df.join(found, "key").filter(enough(k, F.col("at"))))

    indexed = sets.select("node", "body").mapInArrow(entries, "token long, node long, n long, at long")
    indexed = indexed.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    band = F.floor(F.log("n") / BAND)
    with tidy(sets.sparkSession):
        indexed = cut_lineage(indexed)
        spread = indexed.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max(short(LONGEST)).alias("may")).filter("low < high and may")
        shared = cut_lineage(indexed.join(spread.select("token"), "token"))
        # A set stands in its own band, where it may be the smaller partner, and in the one below.
        sides = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band - 1).alias("band"), F.lit(False).alias("own")))).alias("side")
        level, out = shared.filter(F.col("at") < stop(1)).select("token", "node", "n", "class", "at", sides), None
        level = level.select(F.xxhash64("token", "side.band").alias("key"), "node", "n", "class", "at", "side.own")
        for k in range(1, LONGEST + 1):
            level = within(level, k)
            level = cut_lineage(level.join(spans(level, k), "key"))
            small = level.filter(~F.col("large"))
            a, b = small.filter(F.col("own") & short(k)).alias("a"), small.alias("b")
            ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node")))
            left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) - 1
            fits = (F.col("a.key") == F.col("b.key")) & ordered & (F.col("a.class") != F.col("b.class")) & (100 * F.col("a.n") >= PERCENT * F.col("b.n")) & (k + left >= need(F.col("a.n") + F.col("b.n")))
            found = cut_lineage(a.join(b, fits).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
            out = found if out is None else out.union(found)
            large = level.filter("large").drop("large")
            if k == LONGEST or not large.limit(1).count():
                break
            more = shared.filter(F.col("at") < stop(k + 1)).select("node", F.col("token"), F.col("at").alias("next"))
            # The smallest set under a longer key is no smaller, so tokens too late for this one need no row.
            level = large.join(more, "node").filter((F.col("next") > F.col("at")) & enough(k + 1, F.col("next"))).select(F.xxhash64("key", "token").alias("key"), "node", "n", "class", F.col("next").alias("at"), "own")
        return cut_lineage(out.distinct())


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = chunks.CHUNK_BYTES) -> DataFrame:
    """Per document its number of distinct shingles and the smallest doc_id that links reach.

    A null text, or one without words, has no shingles and is linked with nothing; a text of fewer words
    than a shingle is one.  Rows that share a doc_id are one document, with a row for each.  A null
    doc_id is linked like others but names no class; where a class has no other id, the result is null.
    Other columns are not read.
    """
    prepared = _prepared(docs, doc_id, text, chunk_bytes)
    sets = prepared.filter("body is not null").select("node", "body")
    spark = docs.sparkSession
    with tidy(spark):
        repeats = prepared.filter("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high")).filter("b < high").drop("high")
        same = cut_lineage(prepared.join(repeats, "doc_id").select(F.col("node").alias("a"), "b"))
    links = _verified(_near_typical(sets), sets).union(same)
    links = links.union(_verified(_across(sets, components(links)), sets))
    with tidy(spark):
        ids = prepared.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        ids = ids.join(components(links), "node", "left").withColumn("class", F.coalesce("component", "node"))
        classes = cut_lineage(ids.select("node", "class", "least"))
        least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
        names = cut_lineage(classes.join(least, "class").select("node", "component_id"))
    out = prepared.select("doc_id", "n_shingles", "node").join(names, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
