"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds t1 < t2 < ...
cut its sum z, and P(grade >= k) = sigmoid(z - tk).  That gives an expected grade and the tail
probability by which documents are selected.  Features of a whole text: its words, the shapes of its
tokens, whether a token repeats the one before, and steps of its length, variety, repeated lines and share
of odd bytes.  The thresholds stay ordered as their distances are exponentials.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.chunks import share
from ledgerloom.llm.labelled import sample
from ledgerloom.llm.textbytes import LOWER, SPACED, buffer_of, cuts, mix, span_hash, words

ROWS = 1 << 16
#: Rated documents of each grade in the sample, at most.
PER_GRADE = 4_000
EPOCHS = 12

#: Classes of bytes in a token's shape: control, space, digit, capital, small, beyond ASCII, sentence marks, other marks.
KIND = np.zeros(256, np.uint64)
for _k, _bytes in enumerate((range(48, 58), range(65, 91), range(97, 123), range(128, 256), b".,;:!?'\"", b"#$%&()*+-/<=>@[\\]^_`{|}~"), 1):
    KIND[list(_bytes)] = _k


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray


def _step(x: np.ndarray, kind: int) -> np.ndarray:
    return mix(np.maximum(x, 0).astype(np.uint64) * np.uint64(1000) + np.uint64(kind))


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, values, first): hashed features of each text, with those of text d from first[d] on."""
    n = len(offs) - 1
    starts, ends, first = words(buf, offs, SPACED)
    count = np.diff(first)
    text = np.repeat(np.arange(n), count)
    hashes = span_hash(LOWER[buf], starts, ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    kinds = KIND[buf]
    marks = np.concatenate(([0], np.cumsum(kinds == 6)))
    shape = kinds[starts] + np.uint64(8) * kinds[ends - 1] + np.uint64(64) * np.minimum(marks[ends] - marks[starts], 3).astype(np.uint64) + np.uint64(256) * np.minimum(np.log2(ends - starts).astype(np.int64), 7).astype(np.uint64)
    per_word = [(mix(hashes), 1.0), (_step(shape, 1), 6.0), (_step(again, 2), 12.0)]
    variety = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:])], np.int64)
    doubled = np.bincount(text, again, n)
    size = np.maximum(count, 1)
    lens = np.maximum(np.diff(offs), 1)
    odd = marks[offs[1:]] - marks[offs[:-1]]
    breaks = np.concatenate(([0], np.cumsum(buf == 10)))
    per_text = [
        (np.log2(size), 3), (10 * variety / size, 4), (10 * variety / size + 11 * np.floor(np.log2(size) / 2), 5), (20 * doubled / size, 6), (40 * odd / lens, 7),
        (np.log2(lens / size), 8), (np.log2(1 + size / (1 + breaks[offs[1:]] - breaks[offs[:-1]])), 9), (count == 0, 10), (count < 8, 11),
    ]
    rows = np.concatenate([x for x, _ in per_word] + [_step(x, k) for x, k in per_text]) % np.uint64(ROWS)
    value = np.concatenate([v / (np.sqrt(size) if v == 1.0 else size)[text] for _, v in per_word] + [np.ones(n)] * len(per_text))
    owner = np.concatenate([text] * len(per_word) + [np.arange(n)] * len(per_text))
    order = np.argsort(owner, kind="stable")
    return rows[order].astype(np.int32), value[order].astype(np.float32), np.concatenate(([0], np.cumsum(len(per_word) * count + len(per_text))))


def sums(model: Ordinal, rows: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(model.weights[rows] * value, first[:-1]).astype(float) if len(first) > 1 else np.zeros(0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tails(model: Ordinal, z: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ... in columns."""
    return _sigmoid(z[:, None] - model.thresholds[None, :])


def train(texts: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, epochs: int = EPOCHS, seed: int = 3) -> Ordinal:
    rng = np.random.default_rng(seed)
    model = Ordinal(np.zeros(ROWS, np.float32), np.linspace(-1, 1, levels - 1) if levels > 2 else np.zeros(1))
    if not len(grades):
        return model
    gap = np.log(np.maximum(np.diff(model.thresholds), 1e-3))
    base, grad_sum, grad_edge = float(model.thresholds[0]), np.full(ROWS, 1e-3, np.float32), np.full(levels - 1, 1e-3)
    epochs = max(epochs, -(-3000 // max(1, len(grades))))
    for _ in range(epochs):
        order = rng.permutation(len(grades))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            first = np.concatenate(([0], np.cumsum([len(texts[i][0]) for i in batch])))
            rows, value = (np.concatenate([texts[i][k] for i in batch]) for k in (0, 1))
            z = sums(model, rows, value, first)
            edge = np.column_stack((np.ones(len(batch)), tails(model, z), np.zeros(len(batch))))
            g = grades[batch]
            at_least, above = edge[np.arange(len(g)), g], edge[np.arange(len(g)), g + 1]
            share = np.maximum(at_least - above, 1e-9)
            slope_low, slope_high = at_least * (1 - at_least) / share, above * (1 - above) / share
            back = -(slope_low - slope_high) / len(batch)
            by_edge = np.zeros(levels - 1)
            np.add.at(by_edge, g[g > 0] - 1, slope_low[g > 0] / len(batch))
            np.add.at(by_edge, g[g < levels - 1], -slope_high[g < levels - 1] / len(batch))
            grad = np.bincount(rows, value * np.repeat(back, np.diff(first)), ROWS).astype(np.float32) + 2e-5 * model.weights
            grad_sum += grad * grad
            model.weights -= 0.15 * grad / np.sqrt(grad_sum)
            by_base, by_gap = by_edge.sum(), np.cumsum(by_edge[::-1])[::-1][1:] * np.exp(gap)
            grad_edge[0] += by_base**2
            grad_edge[1:] += by_gap**2
            base -= 0.05 * by_base / np.sqrt(grad_edge[0])
            gap -= 0.05 * by_gap / np.sqrt(grad_edge[1:])
            model.thresholds = base + np.concatenate(([0.0], np.cumsum(np.exp(gap))))
    return model


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, levels: int, doc_id: str = "doc_id", text: str = "text", per_grade: int = PER_GRADE) -> Ordinal:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, value, first = features(*buffer_of(batch.column(0)))
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([cut(rows), cut(value), batch.column(1), batch.column(2).cast(pa.int64())], ["rows", "value", "doc_id", "grade"])

    got = sample(docs, ratings, grade, per_grade, levels, doc_id, text).mapInArrow(read, "rows binary, value binary, doc_id long, grade long").toArrow().sort_by("doc_id")
    texts = [(np.frombuffer(r.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32)) for r, v in zip(got.column("rows"), got.column("value"))]
    return train(texts, got.column("grade").to_numpy().astype(np.int64), levels)


def graded(docs: DataFrame, model: Ordinal, least: int = 1, text: str = "text") -> DataFrame:
    """The rows of docs with expected_grade, tail_probability (of ``least`` or more) and keep (at least one half).

    A null or empty text has the features of no words.  Columns of docs with these names are replaced.
    """
    model_of = share(docs.sparkSession, model)
    made = ["expected_grade", "tail_probability", "keep"]
    kept = [c for c in docs.columns if c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            buf, offs = buffer_of(batch.column(kept.index(text)))
            found = [tails(model, sums(model, *features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))) for i, j in cuts(offs, 1 << 20)]
            tail = np.concatenate(found) if found else np.zeros((0, len(model.thresholds)))
            chosen = tail[:, least - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tail.sum(axis=1)), pa.array(chosen), pa.array(chosen >= 0.5)], [*kept, *made])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*kept).mapInArrow(run, f"{base}, expected_grade double, tail_probability double, keep boolean")
