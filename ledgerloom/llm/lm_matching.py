"""LM scoring by partial matching: code lengths of whole documents under a byte-context trie.

Training counts every byte and end of text after its last ``ORDER`` bytes, over all training
documents; shorter contexts are sums of longer ones.  The trie keeps every node unless a caller
bounds it, and grows with the corpus: it is dealt out by the last two context bytes and never
gathered.  Chunks send their distinct windows, with their training counts, to the range that has
all contexts of these two bytes, and get a log probability for each.  Only pairs of bytes, 65,536 at most, are
broadcast.  Scoring walks from the longest context in the trie:

- a symbol seen there has probability n / (total + distinct), total counting dropped nodes too;
- else the escape is paid and the next shorter context is tried, without the symbols of the
  longer one (exclusion); the symbols of a context are among those of its shorter ones, so what
  an exclusion leaves is one number for each context and is worked out once;
- a symbol seen nowhere gets an equal share of the symbols not excluded.

The model is pretrained, so each byte's probability is worked out once for each distinct window
and texts of any length are scored in stretches.  The baseline is a word unigram model with one added to each count, whose
counts come from the chunks' exchange.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import chunks
from ledgerloom.llm.chunks import Chunk, ranges, share, tidy
from ledgerloom.llm.textbytes import LOWER, NO_ID, Lookup, cuts, id_array, mix, pack, span_hash, unpack, words
from ledgerloom.session import cut_lineage

ORDER = 6
#: For a model of bounded size, if asked for: nodes with less than one in NODES of all training symbols go.
NODES = 1 << 22
#: Start and end of a text; this byte occurs in no UTF-8 text.
EDGE = 0xFF
SYMBOLS = 256
PIECE = 1 << 20
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: The end of a text among the hashed words.
END = np.uint64(0x0123456789ABCDEF)


def remainder(ids: np.ndarray, modulus: int) -> np.ndarray:
    """crc32 of the ids as text (null: empty), modulo ``modulus``."""
    return np.array([zlib.crc32(b"" if i == NO_ID else str(i).encode()) % modulus for i in ids.tolist()], np.int64)


def framed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, symbol positions per text): the last ORDER + 1 bytes at every byte and end of text as integers."""
    lens = np.diff(offs)
    size = lens + ORDER + 1
    at = np.concatenate(([0], np.cumsum(size)))
    line = np.full(int(at[-1]), EDGE, np.uint8)
    if len(buf):
        line[np.arange(len(buf)) + np.repeat(at[:-1] + ORDER - offs[:-1], lens)] = buf
    n = max(0, len(line) - ORDER)
    window = np.zeros(n, np.uint64)
    for j in range(ORDER + 1):
        window = (window << np.uint64(8)) | line[j : j + n]
    inside = np.arange(int((lens + 1).sum())) + np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(lens + 1)[:-1])), lens + 1)
    return window[inside], lens + 1, line


def _tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[head], np.diff(np.append(head, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


@dataclass
class Level:
    """One order of the trie. grams: context and symbol; contexts: those with symbols in the trie."""

    grams: Lookup
    log_count: np.ndarray
    contexts: Lookup
    log_total: np.ndarray
    log_escape: np.ndarray
    #: Of the next shorter context, without this one's symbols.
    log_rest: np.ndarray
    log_rest_escape: np.ndarray


class Model:
    """Trie; counts[k] are all nodes of k context bytes and a symbol, by ascending key. Those below ``least`` go."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], least: int) -> None:
        self.levels: list[Level] = []
        counts, below = list(counts), None
        for k, (keys, n) in enumerate(counts):
            whole, head = np.unique(keys >> np.uint64(8), return_index=True)
            totals = np.add.reduceat(n, head) if len(head) else np.zeros(0, np.int64)
            keys, n = keys[n >= least], n[n >= least]
            counts[k] = keys, n
            context, head = np.unique(keys >> np.uint64(8), return_index=True)
            kept = np.add.reduceat(n, head) if len(head) else np.zeros(0, np.int64)
            distinct = np.diff(np.append(head, len(keys)))
            total = totals[np.searchsorted(whole, context)]
            rest = rest_escape = np.zeros(len(context))
            if k and len(context):
                mask = np.uint64((1 << (8 * k)) - 1)
                one = np.searchsorted(counts[k - 1][0], keys & mask)  # the same symbol after a context one byte shorter
                left = np.searchsorted(below[0], context & np.uint64((1 << (8 * (k - 1))) - 1))
                gone = np.add.reduceat(counts[k - 1][1][one], head)
                denominator = (below[1] + below[3])[left] - gone - distinct
                seen = below[2][left] - gone
                rest = np.log10(np.maximum(denominator, 1))
                rest_escape = np.log10(np.where(denominator > 0, np.maximum(denominator - seen, 1e-300) / np.maximum(denominator, 1), 1.0))
            self.levels.append(Level(Lookup(keys), np.log10(np.maximum(n, 1)), Lookup(context), np.log10(np.maximum(total + distinct, 1)), np.log10(np.maximum(total + distinct - kept, 1) / np.maximum(total + distinct, 1)), rest, rest_escape))
            below = (context, total, kept, distinct)
        self.log_unseen = -np.log10(max(1, SYMBOLS - len(counts[0][0])))
        top = self.levels[-1]
        context = top.contexts(counts[-1][0] >> np.uint64(8))
        self.log_top = top.log_count - top.log_total[context]
        self.top_count, self.top_total = counts[-1][1], (below[1] + below[3])[context]

    def log10(self, window: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window after the others."""
        found = self.levels[-1].grams(window)
        out = self.log_top[found] if len(self.log_top) else np.zeros(len(window))
        left = np.flatnonzero(found < 0)
        out[left] = 0
        child = np.full(len(left), -1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            gram = window[left] & np.uint64((1 << (8 * k + 8)) - 1)
            g, c = level.grams(gram), level.contexts(gram >> np.uint64(8))
            first, later = (child < 0) & (c >= 0), child >= 0
            hit = (g >= 0) & (first | later)
            above = self.levels[k + 1] if k + 1 < len(self.levels) else None
            total = np.zeros(len(left))
            total[first] = np.where(g[first] >= 0, -level.log_total[c[first]], level.log_escape[c[first]])
            if above is not None and later.any():
                x = child[later]
                total[later] = np.where(g[later] >= 0, -above.log_rest[x], above.log_rest_escape[x])
            total[hit] += level.log_count[g[hit]]
            out[left] += total
            child = np.where(c >= 0, c, child)
            left, child = left[~hit], child[~hit]
        out[left] += self.log_unseen
        return out


def windows(chunk: Chunk, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of a chunk, ascending, and how often each is in the texts to use."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in cuts(chunk.offs, PIECE):
        window, lens, _ = framed(chunk.buf[chunk.offs[i] : chunk.offs[j]], chunk.offs[i : j + 1] - chunk.offs[i])
        taught = np.repeat(use[i:j], lens)
        for part, weight in ((window[taught], 1), (window[~taught], 0)):
            k, n = _tally(part)
            keys.append(k)
            counts.append(n * weight)
    return _tally(np.concatenate(keys), np.concatenate(counts))


def dealt(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of ascending windows, by their last two context bytes."""
    bucket = (mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])):
        if x < y:
            yield b, order[x:y]


def told(model: Model, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window its count and the denominator, or zeros and its log10 probability if it is not in the trie."""
    found = model.levels[-1].grams(keys)
    n, total, logs = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys))
    hit = found >= 0
    n[hit], total[hit] = model.top_count[found[hit]], model.top_total[found[hit]]
    logs[~hit] = model.log10(keys[~hit])
    return n, total, logs


def message(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "big") + x for x in parts)


def heard(body: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(body):
        end = at + 8 + int.from_bytes(body[at : at + 8], "big")
        parts.append(body[at + 8 : end])
        at = end
    n, total = unpack(parts[0], np.int64), unpack(parts[1], np.int64)
    logs = np.log10(np.maximum(n, 1)) - np.log10(np.maximum(total, 1))
    logs[n == 0] = np.frombuffer(parts[2], np.float64)
    return logs


def trained(table: chunks.ChunkTable, learns, nodes: int | None = None) -> tuple[DataFrame, int]:
    """(log10 probabilities of the windows that each chunk asked for, number of key ranges).

    ``learns(ids)`` says which texts count; ``nodes`` bounds each order of the trie.
    """
    n_buckets = table.buckets_for(table.n_bytes / 4)

    def paired(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        use, seen = learns(chunk.ids), np.zeros(1 << 16, np.int64)
        for i, j in cuts(chunk.offs, PIECE):
            window, lens, _ = framed(chunk.buf[chunk.offs[i] : chunk.offs[j]], chunk.offs[i : j + 1] - chunk.offs[i])
            seen += np.bincount((window[np.repeat(use[i:j], lens)] & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], ["gram", "n"])

    with tidy(table.spark):
        pairs = table.each(paired, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # 65,536 at most
    two = _tally(pairs.column("gram").to_numpy().astype(np.uint64), pairs.column("n").to_numpy())
    one = _tally(two[0] & np.uint64(0xFF), two[1])
    least = max(1, -(-int(one[1].sum()) // nodes)) if nodes else 1
    short = share(table.spark, [one, two])

    def ask(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        keys, n = windows(chunk, learns(chunk.ids))
        for b, at in dealt(keys, n_buckets):
            body = pack(np.diff(keys[at], prepend=np.uint64(0)))
            yield b, len(body).to_bytes(8, "big") + body + pack(n[at].astype(np.uint32))

    def asked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
        end = 8 + int.from_bytes(body[:8], "big")
        return np.cumsum(unpack(body[8:end], np.uint64), dtype=np.uint64), unpack(body[end:], np.uint32).astype(np.int64)

    def answer(bodies: list[bytes]) -> list[bytes]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        for i, body in enumerate(bodies):
            pending.append(asked(body))
            if sum(len(x) for x, _ in pending) > max(1 << 21, len(keys)) or i == len(bodies) - 1:
                keys, n = _tally(np.concatenate([keys, *(x for x, _ in pending)]), np.concatenate([n, *(x for _, x in pending)]))
                pending = []
        counts = [(keys[n > 0], n[n > 0])]
        for order in range(ORDER - 1, 1, -1):
            k, c = counts[0]
            counts.insert(0, _tally(k & np.uint64((1 << (8 * order + 8)) - 1), c))
        model = Model([*short(), *counts], least)
        pieces = [told(model, keys[i : i + PIECE]) for i in range(0, len(keys), PIECE)]
        n, total, logs = (np.concatenate(x) for x in zip(*pieces))
        out = []
        for body in bodies:
            at = np.searchsorted(keys, asked(body)[0])
            out.append(message(pack(n[at]), pack(total[at]), logs[at[n[at] == 0]].tobytes()))
        return out

    return table.exchange(ask, answer), n_buckets


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, held_out: int = 2, chunk_bytes: int = chunks.CHUNK_BYTES, nodes: int | None = None) -> DataFrame:
    """Per document the model's log10 probability and that of the word unigram baseline.

    Documents whose crc32(doc_id as text) modulo ``modulus`` is ``held_out`` teach nothing.  A null text
    is empty: its one token is the end.  A null id counts as an empty one and learns.  Rows that
    repeat are documents of their own.  Other columns are not read.  ``nodes`` bounds the nodes of each
    order of the trie; without it all stay.
    """
    table = chunks.build(docs, doc_id, text, chunk_bytes)
    learns = lambda ids: remainder(ids, modulus) != held_out
    windows_known, window_buckets = trained(table, learns, nodes)
    n_buckets = table.buckets_for(table.n_bytes / 40)

    def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Hashed words of a chunk and the ranges of its texts."""
        found, first = [], [np.zeros(1, np.int64)]
        for i, j in cuts(chunk.offs, PIECE):
            buf, offs = LOWER[chunk.buf[chunk.offs[i] : chunk.offs[j]]], chunk.offs[i : j + 1] - chunk.offs[i]
            starts, ends, at = words(buf, offs)
            found.append(span_hash(buf, starts, ends))
            first.append(at[1:] + first[-1][-1])
        return np.concatenate(found), np.concatenate(first)

    def ask(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        hashes, first = tokens(chunk)
        use = learns(chunk.ids)
        keys = np.unique(hashes)
        taught, n = _tally(hashes[np.repeat(use, np.diff(first))])
        counts = np.zeros(len(keys) + 1, np.int64)
        counts[np.searchsorted(keys, taught)] = n
        where = int(np.searchsorted(keys, END))
        keys, counts = np.insert(keys, where, END), np.insert(counts[:-1], where, int(use.sum()))
        for b, i, j in ranges(keys, n_buckets):
            yield b, np.concatenate((keys[i:j].view(np.int64), counts[i:j])).tobytes()

    def answer(bodies: list[bytes]) -> list[bytes]:
        asked = [np.frombuffer(x, np.int64).reshape(2, -1) for x in bodies]
        keys, n = _tally(np.concatenate([x[0] for x in asked]).view(np.uint64), np.concatenate([x[1] for x in asked]))
        head = int((n > 0).sum()).to_bytes(8, "big") + int(n.sum()).to_bytes(8, "big")
        return [head + pack(n[np.searchsorted(keys, x[0].view(np.uint64))]) for x in asked]

    counts = table.exchange(ask, answer)
    number = lambda at: F.conv(F.hex(F.substring("body", at, 8)), 16, 10).cast("long")
    distinct, total = (int(x or 0) for x in counts.groupBy("bucket").agg(F.max(number(1)).alias("v"), F.max(number(9)).alias("n")).agg(F.sum("v"), F.sum("n")).first())

    def scored(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        hashes, first = tokens(chunk)
        keys, which = np.unique(hashes, return_inverse=True)
        where = int(np.searchsorted(keys, END))
        got = chunk.answers["counts"]
        c = np.concatenate([unpack(got[b][16:], np.int64) for b in sorted(got)])
        end, c = int(c[where]), np.delete(c, where)[which]
        logs = np.log10((c + 1) / (total + distinct + 1))
        base = np.array([logs[a:b].sum() for a, b in zip(first[:-1], first[1:])]) + np.log10((end + 1) / (total + distinct + 1))
        known = np.concatenate(([0], np.cumsum(c > 0)))
        asked, got = windows(chunk, learns(chunk.ids))[0], chunk.answers["windows"]
        known_logs = np.zeros(len(asked))
        for b, at in dealt(asked, window_buckets):
            known_logs[at] = heard(got[b])
        asked, ppm = Lookup(asked), np.zeros(len(chunk.ids))
        for i, j in cuts(chunk.offs, PIECE):
            window, lens, _ = framed(chunk.buf[chunk.offs[i] : chunk.offs[j]], chunk.offs[i : j + 1] - chunk.offs[i])
            ppm[i:j] = np.add.reduceat(known_logs[asked(window)], np.cumsum(lens) - lens)
        n = len(chunk.ids)
        yield pa.RecordBatch.from_arrays([id_array(chunk.ids), pa.array(~learns(chunk.ids)), pa.array(np.diff(first) + 1), pa.array(known[first[1:]] - known[first[:-1]] + (end > 0)), pa.array(np.full(n, total)), pa.array(base), pa.array(ppm)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return table.each(scored, SCHEMA, {"counts": counts, "windows": windows_known})
