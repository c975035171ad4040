"""Texts of an Arrow batch as one byte array: words, hashes and slices without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Stands for a null id: it is larger than every other id.
NO_ID = np.iinfo(np.int64).max

_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)]

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space ends: [^\x20\x09-\x0D].
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words of digits, lower-case letters and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F].
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step: equal inputs stay equal, others look random."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        _POWERS[0] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, _STEP))), dtype=np.uint64)
    return _POWERS[0]


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as int64; null becomes NO_ID."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def id_array(ids: np.ndarray) -> pa.Array:
    ids = np.asarray(ids, np.int64)
    return pa.array(ids, mask=ids == NO_ID)


def cuts(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one longer text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of parts of a batch that hold about ``limit`` bytes of text each; no text is split."""
    buf, offs = buffer_of(batch.column(batch.schema.get_field_index(text)))
    for i, j in cuts(offs, limit):
        yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def words(buf: np.ndarray, offs: np.ndarray, in_word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words' byte ranges; words first[d] to first[d + 1] are those of text d."""
    m = in_word[buf]
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    edge = offs[:-1][np.diff(offs) > 0]
    before = np.empty(len(m), bool)
    before[0], before[1:] = False, m[:-1]
    before[edge] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty(len(m), bool)
    after[-1], after[:-1] = False, m[1:]
    after[edge[1:] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each non-empty byte range."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(at, lens)
    vals = (buf[pos + np.repeat(starts, lens)].astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(vals, at) + lens.astype(np.uint64))


def hash_bytes(word: bytes) -> int:
    """span_hash of one word, for tables built on the driver."""
    return int(span_hash(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


class Lookup:
    """Where keys stand in an array, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = keys
        self.reach = 0
        left, step = np.arange(len(keys)), 0
        at = self._home(keys)
        while len(left):
            spot = (at[left] + step) & (len(self.slots) - 1)
            free = self.slots[spot] < 0
            self.slots[spot[free]] = left[free]
            left = left[self.slots[spot] != left]
            step += 1
        self.reach = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        home = self._home(keys)
        found = self.slots[home]
        miss = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        for step in range(1, self.reach):
            if not len(miss):
                break
            got = self.slots[(home[miss] + step) & (len(self.slots) - 1)]
            found[miss] = got
            miss = miss[(got >= 0) & (self.keys[got] != keys[miss])]
        found[miss] = -1
        return found


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes; for ascending ones pass their differences."""
    import zstandard

    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T.tobytes() if len(raw) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(body: bytes, dtype: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()
