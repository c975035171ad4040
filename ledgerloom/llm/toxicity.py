"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is the sum of two hashed rows, one of the word and one of its first four bytes, so
that inflected forms share what they mean.  Filters over one, two and three words run over the whole
text, keep their largest activation, and a logistic layer reads those.  Scoring sees every word of every document.

Every labelled document that is not held out takes part.  The network starts from the bounded sample of
labelled.py; then, in each round, every task goes on from the same network through its own share of all
rows, and Spark adds up the changes.  An embedding row moves by the mean over the updates that touched it,
so a word that one task alone has seen keeps what was learnt about it.

A text's language is guessed from its own function words.  A fifth of the labelled documents does not
train: by all of their logits, counted in steps of 1 / BINS, each language gets the logit that separates
its labels best, and scores are shifted by it, so that 0.5 is that threshold.  Only the text is read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.chunks import share
from ledgerloom.llm.labelled import grades, held_out, sample
from ledgerloom.llm.textbytes import ALNUM, LOWER, Lookup, buffer_of, cuts, hash_bytes, mix, span_hash, words
from ledgerloom.session import cut_lineage

ROWS = 1 << 15
WIDTH = 8
FILTERS = 8
SPANS = (1, 2, 3)
#: Labelled documents of each class in the sample the network starts from, at most.
PER_CLASS = 4_000
EPOCHS = 6
#: Passes over all labelled documents after it: as many as make VISITS, from the first to the second of these.
ROUNDS = (2, 6)
VISITS = 48_000
RATE = 0.02
BATCH = 64
#: Changes are added up as whole parts of this, so that their order does not matter.
PARTS = 2.0**32
#: Steps in which logits of the calibration part are counted.
BINS = 256
PROOF = 5
STEM = 4
#: Fewer toxic texts of a language than this in the calibration part: it takes the common threshold.
LEAST_TOXIC = 15

#: Common words by which a language is guessed.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with"),
    "fr": ("le", "les", "des", "et", "est", "une", "dans", "pour", "sur", "pas", "avec"),
    "de": ("der", "die", "und", "das", "den", "ist", "nicht", "ein", "zu", "von", "mit"),
    "es": ("el", "los", "las", "con", "por", "para", "del", "una", "como", "y", "se"),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray


def _tables(net: Network, k: int) -> list[np.ndarray]:
    return [net.embedding @ net.filters[k][j * WIDTH : (j + 1) * WIDTH] for j in range(SPANS[k])]


def _activations(act: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """Rectified; windows that would reach into the next text are 0."""
    for j in range(1, span):
        at = first[1:] - j
        act[at[at >= first[:-1]]] = 0
    return np.maximum(act, 0, out=act)


def logits(net: Network, rows: np.ndarray, first: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Of each text, before its language's threshold. rows: two for each word."""
    out = np.full(len(first) - 1, net.bias)
    some = np.flatnonzero(np.diff(first) > 0)
    for k, span in enumerate(SPANS if len(some) else ()):
        act = tables[k][0][rows[0]] + tables[k][0][rows[1]]
        for j in range(1, span):
            act[: len(act) - j] += tables[k][j][rows[0][j:]]
            act[: len(act) - j] += tables[k][j][rows[1][j:]]
        act = _activations(act + net.shifts[k], first, span)
        out[some] += np.maximum.reduceat(act, first[some], axis=0) @ net.weights[k * FILTERS : (k + 1) * FILTERS]
    return out


def hashed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, embedding rows of words and stems, and the ranges of the texts' words."""
    buf = LOWER[buf]
    starts, ends, first = words(buf, offs, ALNUM)
    whole = span_hash(buf, starts, ends)
    stem = span_hash(buf, starts, np.minimum(ends, starts + STEM))
    return whole, np.stack([(mix(x + np.uint64(k)) % np.uint64(ROWS)).astype(np.int32) for k, x in enumerate((whole, stem))]), first


def guessed(hashes: np.ndarray, first: np.ndarray, table: Lookup, owner: np.ndarray) -> np.ndarray:
    """Number of each text's language in LANGUAGES."""
    counts = np.zeros((len(first) - 1, len(LANGUAGES)), np.int64)
    found = table(hashes)
    at = np.flatnonzero(found >= 0)
    np.add.at(counts, (np.searchsorted(first, at, "right") - 1, owner[found[at]]), 1)
    return np.where(counts.any(axis=1), counts.argmax(axis=1), len(LANGUAGES) - 1)


def language_table() -> tuple[Lookup, np.ndarray]:
    pairs = sorted((hash_bytes(w.encode()), LANGUAGES.index(x)) for x, line in FUNCTION_WORDS.items() for w in line)
    keys = dict(pairs)  # a word of two languages speaks for the last
    return Lookup(np.array([*keys], np.uint64)), np.array([*keys.values()])


def _descend(net: Network, learn: Iterator[tuple[list[np.ndarray], np.ndarray, float]]) -> np.ndarray:
    """Adam over batches of (embedding rows of texts, labels, rate), in place; how often each embedding row was updated."""
    params = [net.embedding, *net.filters, *net.shifts, net.weights]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    seen = np.zeros(ROWS, np.int64)
    for step, (rows, labels, rate) in enumerate(learn, 1):
        first = np.concatenate(([0], np.cumsum([r.shape[1] for r in rows])))
        line = np.concatenate(rows, axis=1)
        x = net.embedding[line[0]] + net.embedding[line[1]]
        grads = [np.zeros_like(p) for p in params]
        pooled = np.zeros((len(rows), FILTERS * len(SPANS)), np.float32)
        where = np.zeros(pooled.shape, np.int64)
        for k, span in enumerate(SPANS):
            act = x @ net.filters[k][:WIDTH] + net.shifts[k]
            for j in range(1, span):
                act[: max(0, len(x) - j)] += x[j:] @ net.filters[k][j * WIDTH : (j + 1) * WIDTH]
            act = _activations(act, first, span)
            for d, (a, b) in enumerate(zip(first[:-1], first[1:])):
                if b > a:
                    top = act[a:b].argmax(axis=0)
                    where[d, k * FILTERS : (k + 1) * FILTERS] = a + top
                    pooled[d, k * FILTERS : (k + 1) * FILTERS] = act[a + top, np.arange(FILTERS)]
        logit = pooled @ net.weights + net.bias
        error = (1 / (1 + np.exp(-logit)) - labels) / len(rows)
        net.bias -= rate * 5 * float(error.sum())
        grads[-1] += pooled.T @ error + 1e-4 * net.weights
        back = np.outer(error, net.weights) * (pooled > 0)
        for k, span in enumerate(SPANS):
            mine = back[:, k * FILTERS : (k + 1) * FILTERS]
            d, f = np.nonzero(mine)
            g, pos = mine[d, f], where[:, k * FILTERS : (k + 1) * FILTERS][d, f]
            np.add.at(grads[1 + len(SPANS) + k], f, g)
            for j in range(span):
                inside = pos + j < len(x)
                part, f_in, g_in, at_in = slice(j * WIDTH, (j + 1) * WIDTH), f[inside], g[inside, None], pos[inside] + j
                np.add.at(grads[1 + k][part].T, f_in, g_in * x[at_in])
                for row in line:
                    np.add.at(grads[0], row[at_in], g_in * net.filters[k][part].T[f_in])
        seen += grads[0].any(axis=1)
        for p, grad, (m, v) in zip(params, grads, state):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return seen


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """The network that the rounds over all rows start from."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.3, (ROWS, WIDTH)).astype(np.float32), [rng.normal(0, 0.3, (WIDTH * s, FILTERS)).astype(np.float32) for s in SPANS],
        [np.zeros(FILTERS, np.float32) for _ in SPANS], rng.normal(0, 0.2, FILTERS * len(SPANS)).astype(np.float32), 0.0, np.zeros(len(LANGUAGES)),
    )
    if not len(labels) or labels.min() == labels.max():
        net.bias = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
        net.weights[:] = 0
        return net
    learn = rng.permutation(len(labels))
    epochs = max(epochs, -(-400 // max(1, len(learn) // BATCH)))  # a small sample is seen more often
    net.bias = float(np.log(labels.mean() / (1 - labels.mean())))

    def batches() -> Iterator[tuple[list[np.ndarray], np.ndarray, float]]:
        for epoch in range(epochs):
            rng.shuffle(learn)
            for at in range(0, len(learn), BATCH):
                batch = learn[at : at + BATCH]
                yield [rows[i] for i in batch], labels[batch], RATE * (0.3 if epoch > 0.7 * epochs else 1)

    _descend(net, batches())
    return net


def _dense(net: Network) -> np.ndarray:
    """All parameters but the embedding, in one line padded to whole rows of WIDTH."""
    line = np.concatenate([x.ravel() for x in (*net.filters, *net.shifts, net.weights, np.array([net.bias]))]).astype(np.float64)
    return np.pad(line, (0, -len(line) % WIDTH)).reshape(-1, WIDTH)


def _moved(net: Network, embedding: np.ndarray, dense: np.ndarray) -> Network:
    """The network with a changed embedding and changed other parameters."""
    line, at, made = (_dense(net) + dense).ravel(), 0, []
    for x in (*net.filters, *net.shifts, net.weights):
        made.append(line[at : at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    n = len(SPANS)
    return Network((net.embedding + embedding).astype(np.float32), made[:n], made[n : 2 * n], made[-1], float(line[at]), net.thresholds)


def one_round(rows: DataFrame, net: Network, rate: float) -> Network:
    """The network after every row of (text, grade) has taught once, each task's rows apart."""
    net_of = share(rows.sparkSession, net)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = net_of()
        own = Network(old.embedding.copy(), [x.copy() for x in old.filters], [x.copy() for x in old.shifts], old.weights.copy(), old.bias, old.thresholds)
        n = 0

        def steps() -> Iterator[tuple[list[np.ndarray], np.ndarray, float]]:
            nonlocal n
            for batch in batches:
                buf, offs = buffer_of(batch.column(0))
                grade = batch.column(1).to_numpy()
                for i, j in cuts(offs, 1 << 20):
                    _, lines, first = hashed(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    for a in range(0, j - i, BATCH):
                        b = min(a + BATCH, j - i)
                        n += b - a
                        yield [lines[:, first[d] : first[d + 1]] for d in range(a, b)], grade[i + a : i + b], rate

        seen = _descend(own, steps())
        if n:
            slots = np.flatnonzero(seen)
            change = np.concatenate([(own.embedding - old.embedding)[slots] * seen[slots, None], (_dense(own) - _dense(old)) * n])
            weight = np.concatenate([seen[slots], np.full(len(change) - len(slots), n)])
            slot = np.concatenate([slots, ROWS + np.arange(len(change) - len(slots))])
            whole = np.rint(change * PARTS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(weight), *(pa.array(whole[:, k].copy()) for k in range(WIDTH))], ["slot", "weight", *(f"d{k}" for k in range(WIDTH))])

    columns = ["weight", *(f"d{k}" for k in range(WIDTH))]
    # at most one small row for each row of the embedding
    found = rows.select("text", "grade").mapInArrow(learn, "slot long, " + ", ".join(f"{c} long" for c in columns)).groupBy("slot").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    total = np.zeros((ROWS + len(_dense(net)), WIDTH))
    sums = np.stack([found.column(c).to_numpy() for c in columns], axis=1) if len(found) else np.zeros((0, 1 + WIDTH))
    total[found.column("slot").to_numpy()] = sums[:, 1:] / PARTS / sums[:, :1]
    return _moved(net, total[:ROWS], total[ROWS:])


def calibrated(rows: DataFrame, net: Network) -> Network:
    """The network with the thresholds that all rows of (text, grade) give."""
    net_of = share(rows.sparkSession, net)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, (table, owner) = net_of(), language_table()
        tables = [_tables(net, k) for k in range(len(SPANS))]
        for batch in batches:
            buf, offs = buffer_of(batch.column(0))
            for i, j in cuts(offs, 1 << 20):
                hashes, lines, first = hashed(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                bins = np.floor(np.clip(logits(net, lines, first, tables), -60, 60) * BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(guessed(hashes, first, table, owner)), pa.array(bins), batch.column(1).slice(i, j - i)], ["language", "bin", "grade"])

    counts = rows.select("text", "grade").mapInArrow(read, "language long, bin long, grade long").groupBy("language", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("grade").alias("toxic")).toArrow()
    language, bins, n, toxic = (counts.column(c).to_numpy() for c in ("language", "bin", "n", "toxic"))
    common = _best(bins, n, toxic, 0.0)
    for x in range(len(LANGUAGES)):
        mine = language == x
        net.thresholds[x] = _best(bins[mine], n[mine], toxic[mine], common) if toxic[mine].sum() >= LEAST_TOXIC else common
    return net


def _best(bins: np.ndarray, n: np.ndarray, toxic: np.ndarray, default: float) -> float:
    """The logit with the best F1, of counted logits; in the middle of the gap below it."""
    if not toxic.any():
        return default
    steps, at = np.unique(-bins, return_inverse=True)
    rows, hits = (np.cumsum(np.bincount(at, x)) for x in (n, toxic))
    k = int((2 * hits / (rows + hits[-1])).argmax())
    below = 1 - steps[k + 1] if k + 1 < len(steps) else -steps[k] - 2 * BINS
    return float((below - steps[k]) / 2 / BINS)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Network:
    grade, proof = F.col("toxic").cast("long"), F.pmod(F.xxhash64(F.lit("proof"), F.col(doc_id)), F.lit(PROOF)) == 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(batch.column(0))
            for i, j in cuts(offs, 1 << 20):
                _, rows, first = hashed(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                lines = pa.array([rows[:, a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([lines, batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i).cast(pa.int64())], ["rows", "doc_id", "grade"])

    rows = sample(docs, labels.filter(~proof), grade, per_class, 2, doc_id, text).mapInArrow(read, "rows binary, doc_id long, grade long").toArrow().sort_by("doc_id")
    texts = [np.frombuffer(x.as_buffer(), np.int32).reshape(2, -1) for x in rows.column("rows")]
    net = train(texts, rows.column("grade").to_numpy().astype(np.int64))
    if not net.weights.any():  # labels of one class alone
        return net
    rated = grades(labels, grade, doc_id).filter(F.col("grade").isin(0, 1)).withColumn("proof", F.pmod(F.xxhash64(F.lit("proof"), "labelled_id"), F.lit(PROOF)) == 0)
    # the join's shuffle by id mixes the rows as well, so texts move once
    every = docs.filter(~held_out(doc_id)).select(F.col(text).alias("text"), F.col(doc_id).alias("labelled_id")).join(rated.hint("shuffle_hash"), "labelled_id")
    mixed = every.withColumn("at", F.xxhash64("labelled_id", "text")).sortWithinPartitions("at", "labelled_id")
    every = cut_lineage(mixed.select("text", "grade", "proof"))
    rounds = min(ROUNDS[1], max(ROUNDS[0], -(-VISITS // max(1, every.filter("NOT proof").count()))))
    for k in range(rounds):
        net = one_round(every.filter("NOT proof"), net, RATE * (0.3 if k + 1 > 0.7 * rounds else 1))
    return calibrated(every.filter("proof"), net)


def scored(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The rows of docs with score, predicted and guessed_language, which replace columns of these names.

    A text without words, or null, gets the score of an empty one.
    """
    net_of = share(docs.sparkSession, net)
    made = ["score", "predicted", "guessed_language"]
    kept = [c for c in docs.columns if c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, (table, owner) = net_of(), language_table()
        tables = [_tables(net, k) for k in range(len(SPANS))]
        for batch in batches:
            buf, offs = buffer_of(batch.column(kept.index(text)))
            found, tongues = [], []
            for i, j in cuts(offs, 1 << 20):
                hashes, rows, first = hashed(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                tongues.append(guessed(hashes, first, table, owner))
                found.append(logits(net, rows, first, tables) - net.thresholds[tongues[-1]])
            logit = np.concatenate(found) if found else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
            tongue = np.concatenate(tongues) if tongues else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.array(LANGUAGES, object)[tongue], pa.string())], [*kept, *made])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*kept).mapInArrow(run, f"{base}, score double, predicted int, guessed_language string")
