"""Cross-tokenizer alignment: where two tokenizers' tokens end together, and how often their ids do so in the corpus.

1. Each task encodes its documents with both tokenizers.  A text splits into units where a space
   follows anything but white space; neither tokenizer joins across such a place, so units are aligned once and kept.
   Where the bytes of a unit's tokens differ from the unit, its document is encoded whole.
2. A task gathers records (pair of ids, document, times).  About RUN_RECORDS of them are
   sorted side-major (B id, then A id), radix-partitioned by the B id's low bits and written as zstd runs with
   their documents; a run also has each pair's total, which is all that moves.
3. Each radix part's task merges the totals of all runs through heaps, block by block.  A step takes whole
   B ids, so it knows each pair's count and the B id's highest, and streams both back to the runs that asked.
4. The answers meet the records where they were written, and add up for each document.

A pair is sent once by each run, however many documents hold it.  Texts that are null, empty, or not given
back by the tokens' bytes have no tokens.  Rows that share an id, or have none, are documents of their own;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.chunks import CHUNK_SCHEMA, BUCKET_KEYS, Chunk, ChunkTable, tidy
from ledgerloom.llm.textbytes import buffer_of, cuts, id_array, ids_of, pack, unpack
from ledgerloom.session import cut_lineage, ensure_checkpoint_dir

#: Records (pair, document) that a run holds, about: some 30 MB of text.
RUN_RECORDS = 1 << 21
RUN_TEXT = 16 << 20
#: Distinct pairs of a run, about; with the number of runs it gives the number of radix parts.
RUN_PAIRS = 1 << 17
BLOCK_PAIRS = 1 << 14
#: Units kept with their alignment in a task, and the longest kept; memory bounds that change no result.
CACHED_UNITS = 400_000
CACHED_CHARS = 64
SHIFT = 16

OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: No token of either vocabulary joins what these places divide: a space behind anything but white space, and a mark behind a Latin letter.
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ɏ]", "[.,;:!?]"
_UNITS = re.compile(rf"(?<=\S)(?= )|(?<={_LETTER})(?={_MARK})")


class Aligner:
    """Both tokenizers and the units aligned so far."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are text
        # Byte-level tokens write printable Latin-1 as itself and the other bytes as code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)).difference(plain)))}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for t, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.name_a, self.name_b = ([str(i) for i in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        self.splits = not any(re.search(f"[^▁]▁|{_LETTER}{_MARK}", p) for p in pieces)
        # Tokenizer B puts a space before what it encodes, so a unit without one follows this letter.
        self.lead = self.b.encode("a")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.facts = np.zeros((0, 4), np.int64)  # n_a, n_b, number of pairs, whether the bytes came back
        self.pairs = np.zeros(0, np.uint32)

    def _aligned(self, raw: bytes, ids_a: list[int], ids_b: list[int]) -> tuple[bool, bytes, list[int]]:
        """Whether the tokens give the bytes back, the groups as text, and the pair that ends each group."""
        bytes_a, bytes_b = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return False, b"", []
        name_a, name_b = [self.name_a[i] for i in ids_a], [self.name_b[i] for i in ids_b]
        if len(ids_a) == 1 or len(ids_b) == 1:
            return True, f"{','.join(name_a)}|{','.join(name_b)}".encode(), [ids_b[-1] << SHIFT | ids_a[-1]]
        groups, pairs = [], []
        j = start_a = start_b = at_a = at_b = 0
        for i, x in enumerate(bytes_a, 1):
            at_a += len(x)
            while at_b < at_a:
                at_b += len(bytes_b[j])
                j += 1
            if at_b == at_a:
                groups.append(",".join(name_a[start_a:i]) + "|" + ",".join(name_b[start_b:j]))
                pairs.append(ids_b[j - 1] << SHIFT | ids_a[i - 1])
                start_a, start_b = i, j
        return True, ";".join(groups).encode(), pairs

    def add(self, units: list[str]) -> None:
        """Align new units."""
        found_a = self.a.encode_batch_fast(units, add_special_tokens=False)
        found_b = self.b.encode([u[1:] if u[0] == " " else "a" + u for u in units], num_threads=1)
        facts, pairs = [], []
        lead, n = self.lead, len(self.lead)
        for unit, a, b in zip(units, found_a, found_b):
            ids = a.ids
            if unit[0] != " ":
                b = b[n:] if b[:n] == lead else []
            good, groups, found = self._aligned(unit.encode(), ids, b)
            self.known[unit] = len(self.groups)
            self.groups.append(groups)
            facts.append((len(ids), len(b), len(found), good))
            pairs += found
        if facts:
            self.facts = np.concatenate((self.facts, np.array(facts, np.int64)))
            self.pairs = np.concatenate((self.pairs, np.array(pairs, np.uint32)))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups) by text, digests, and for each pair its text and key; no tokens: zeros."""
        if len(self.known) > CACHED_UNITS:
            self.clear()
        split = [(_UNITS.split(" " + t) if self.splits else [" " + t]) if t else [] for t in texts]
        every = set().union(*split)
        self.add(list(every.difference(self.known)))
        known, groups = self.known, self.groups
        at = np.fromiter((known[u] for units in split for u in units), np.int64)
        size = np.array([len(units) for units in split], np.int64)
        owner = np.repeat(np.arange(len(texts)), size)
        facts = self.facts[at]
        sums = np.zeros((len(texts), 4), np.int64)
        filled = np.flatnonzero(size)
        if len(filled):
            sums[filled] = np.add.reduceat(facts, (np.cumsum(size) - size)[filled])
        fine = sums[:, 3] == size  # every unit came back
        ends = np.cumsum(self.facts[:, 2])
        n = facts[:, 2] * fine[owner]
        where = np.arange(int(n.sum())) + np.repeat((ends - self.facts[:, 2])[at] - (np.cumsum(n) - n), n)
        keys, owners = [self.pairs[where]], [np.repeat(owner, n)]
        sums[~fine] = 0
        digests, place = [], at.tolist()
        i = 0
        for d, text in enumerate(texts):
            j = i + int(size[d])
            line = b""
            if fine[d]:
                line = b";".join([groups[k] for k in place[i:j]])
            else:  # a unit did not come back alone: the document as a whole
                a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
                good, line, found = self._aligned((" " + text).encode(), a, b)
                if good:
                    sums[d] = len(a), len(b), len(found), 0
                    keys.append(np.array(found, np.uint32))
                    owners.append(np.full(len(found), d))
            digests.append(hashlib.sha256(line).digest() if line else b"")
            i = j
        for u in every:
            if len(u) > CACHED_CHARS:
                groups[known.pop(u)] = b""
        return sums[:, :3], digests, np.concatenate(owners), np.concatenate(keys)


def _blocks(values: list[np.ndarray]) -> list[tuple[bytes, ...]]:
    """Arrays of one length as packed blocks."""
    return [tuple(pack(x[i : i + BLOCK_PAIRS]) for x in values) for i in range(0, len(values[0]), BLOCK_PAIRS)]


def run_body(docs: np.ndarray, keys: np.ndarray, times: np.ndarray, radix: int) -> dict[int, tuple[bytes, tuple[bytes, ...]]]:
    """By radix part: (the pairs' totals, as they move; the records, as they stay)."""
    part = (keys >> SHIFT) & (radix - 1)
    order = np.lexsort((docs, keys, part))
    docs, keys, times, part = docs[order], keys[order], times[order], part[order]
    out = {}
    edges = np.searchsorted(part, np.arange(radix + 1))
    for r in np.flatnonzero(np.diff(edges)):
        a, b = edges[r], edges[r + 1]
        heads = np.flatnonzero(np.concatenate(([True], keys[a + 1 : b] != keys[a : b - 1])))
        totals = np.add.reduceat(times[a:b], heads)
        moved = pickle.dumps(_blocks([keys[a:b][heads], totals]))
        out[int(r)] = (moved, (pack(np.diff(heads, append=b - a).astype(np.uint32)), pack(docs[a:b].astype(np.uint32)), pack(times[a:b].astype(np.uint32))))
    return out


def merged(bodies: list[bytes]) -> list[bytes]:
    """Each run's answer: count and mark of the highest of its B id, for each of its pairs in order.

    Every run shows one block.  The run whose block ends first bounds what all runs have shown in full: the
    B ids below its last one.  Those are taken from the runs whose next pair is below that bound.
    """
    runs = [pickle.loads(x) for x in bodies]
    turn, keys, totals = [0] * len(runs), [None] * len(runs), [None] * len(runs)
    at = [0] * len(runs)
    waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in runs]
    done: list[list[tuple[bytes, bytes]]] = [[] for _ in runs]
    heads: list[tuple[int, int]] = []
    ends: list[tuple[int, int]] = []
    last = 1 << 40

    def show(r: int) -> bool:
        """Put the run's next block behind what is left of the one before."""
        if turn[r] == len(runs[r]):
            return False
        block, runs[r][turn[r]] = runs[r][turn[r]], None
        turn[r] += 1
        k, t = unpack(block[0], np.uint32), unpack(block[1], np.int64)
        if keys[r] is None or at[r] == len(keys[r]):
            heapq.heappush(heads, (int(k[0]), r))
            keys[r], totals[r], at[r] = k, t, 0
        else:
            keys[r], totals[r], at[r] = np.concatenate((keys[r][at[r] :], k)), np.concatenate((totals[r][at[r] :], t)), 0
        return True

    def wrap(r: int) -> None:
        count, best = (np.concatenate(x) for x in zip(*waiting[r]))
        done[r].append((pack(count), pack(best)))
        waiting[r] = []

    for r in range(len(runs)):
        if show(r):
            heapq.heappush(ends, (int(keys[r][-1]) if turn[r] < len(runs[r]) else last, r))
    while ends:
        end, r = heapq.heappop(ends)
        bound = end >> SHIFT << SHIFT
        taken = []
        while heads and heads[0][0] < bound:
            _, x = heapq.heappop(heads)
            stop = len(keys[x]) if bound > int(keys[x][-1]) else int(np.searchsorted(keys[x], bound))
            taken.append((x, at[x], stop))
            at[x] = stop
            if stop < len(keys[x]):
                heapq.heappush(heads, (int(keys[x][stop]), x))
        if taken:
            every = np.concatenate([keys[x][a:b] for x, a, b in taken])
            pair, where = np.unique(every, return_inverse=True)
            count = np.zeros(len(pair), np.int64)
            np.add.at(count, where, np.concatenate([totals[x][a:b] for x, a, b in taken]))
            side = pair >> SHIFT
            first = np.flatnonzero(np.concatenate(([True], side[1:] != side[:-1])))
            highest = np.repeat(np.maximum.reduceat(count, first), np.diff(first, append=len(pair)))
            best = (count == highest).astype(np.uint8)
            i = 0
            for x, a, b in taken:
                w = where[i : i + b - a]
                waiting[x].append((count[w], best[w]))
                i += b - a
                if sum(len(c) for c, _ in waiting[x]) >= BLOCK_PAIRS:
                    wrap(x)
        if end < last and show(r):
            heapq.heappush(ends, (int(keys[r][-1]) if turn[r] < len(runs[r]) else last, r))
    for r in range(len(runs)):
        if waiting[r]:
            wrap(r)
    return [pickle.dumps(x) for x in done]


def write_runs(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str, run_records: int) -> ChunkTable:
    """The written runs, one row each, bucketed by run."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    total = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_runs = 1 + total * RUN_RECORDS // (RUN_TEXT * run_records)
    radix = 1 << int(np.clip(np.ceil(np.log2(n_runs * RUN_PAIRS / BUCKET_KEYS)), 3, 15))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        at, made = TaskContext.get().partitionId() << 32, 0
        ids, stats, digests, records, n_docs, n_records = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal made, ids, stats, digests, records, n_docs, n_records
            docs_, keys_, times_ = (np.concatenate(x) for x in zip(*records))
            body = pickle.dumps((digests, run_body(docs_, keys_, times_, radix)))
            row = [[at + made], [n_docs], [len(body)], [np.concatenate(ids).tobytes()], [np.concatenate(stats).tobytes()], [body]]
            made += 1
            ids, stats, digests, records, n_docs, n_records = [], [], [], [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int64()] * 3 + [pa.binary()] * 3)], ["chunk_id", "n_texts", "n_bytes", "ids", "offsets", "body"])

        for batch in batches:
            doc_ids = ids_of(batch.column(0))
            buf, offs = buffer_of(batch.column(1))
            for i, j in cuts(offs, 1 << 20):
                got, sums, owner, keys = aligner.align([buf[a:b].tobytes().decode() for a, b in zip(offs[i:j], offs[i + 1 : j + 1])])
                both, times = np.unique(owner.astype(np.uint64) << np.uint64(32) | keys, return_counts=True)
                ids.append(doc_ids[i:j])
                stats.append(got)
                digests += sums
                records.append(((both >> np.uint64(32)).astype(np.int64) + n_docs, (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), times.astype(np.int64)))
                n_docs += j - i
                n_records += len(both)
                if n_records >= run_records:
                    yield flush()
        if ids:
            yield flush()

    n_buckets = int(min(100_000, max(spark.sparkContext.defaultParallelism, 1 + 3 * n_runs // 2)))
    name = f"runs_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    source.mapInArrow(encoded, CHUNK_SCHEMA).write.option("compression", "uncompressed").bucketBy(n_buckets, "chunk_id").option("path", path).saveAsTable(name)
    return ChunkTable(spark, name, path, n_buckets, int(total))


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", run_records: int = RUN_RECORDS) -> DataFrame:
    """One row per document: tokens of either side, groups, links and what the corpus says of its linked pairs.

    Columns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.  No token of these vocabularies
    is empty, so every common end is one link.
    """

    def ask(run: Chunk) -> Iterator[tuple[int, bytes]]:
        yield from ((r, moved) for r, (moved, _) in pickle.loads(run.buf.tobytes())[1].items())

    def finish(run: Chunk) -> Iterator[pa.RecordBatch]:
        digests, parts = pickle.loads(run.buf.tobytes())
        stats = run.offs.reshape(-1, 3)
        sums = np.zeros((2, len(run.ids)), np.int64)
        for r, (_, (n_docs, owner, times)) in parts.items():
            found = pickle.loads(run.answers["count"][r])
            count, best = (np.concatenate([unpack(block[k], t) for block in found]) for k, t in ((0, np.int64), (1, np.uint8)))
            n_docs, owner, times = unpack(n_docs, np.uint32), unpack(owner, np.uint32), unpack(times, np.uint32).astype(np.int64)
            np.add.at(sums[0], owner, np.repeat(best, n_docs) * times)
            np.add.at(sums[1], owner, np.repeat(count, n_docs) * times)
        columns = [id_array(run.ids), *(pa.array(np.ascontiguousarray(stats[:, k])) for k in (0, 1, 2, 2)), pa.array(sums[0]), pa.array(sums[1]), pa.array([x.hex() for x in digests], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

    with tidy(docs.sparkSession):
        runs = write_runs(docs, path_a, path_b, doc_id, text, run_records)
        answers = runs.exchange(ask, merged)
        out = cut_lineage(runs.each(finish, OUT, {"count": answers}))
    runs.drop()
    return out
