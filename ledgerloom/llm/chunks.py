"""Chunks of texts written once, and a question-and-answer exchange of hashed keys between them.

Jobs that ask "where else does this key occur?" about every key of every text would
shuffle one row per key.  Here a chunk (a row with some MB of whole texts) asks for its
distinct keys in packed messages, one for each range of key values; the range's task
combines them and answers each chunk in the order it asked.  A key that a third of all
texts hold is sent once by each chunk, so no task grows with a hot key.  Chunks and
answers are written tables: a lost executor repeats single tasks.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.textbytes import buffer_of, ids_of
from ledgerloom.session import cut_lineage, ensure_checkpoint_dir

CHUNK_BYTES = 8 << 20
#: Keys that a task of the exchange holds at once, about.
BUCKET_KEYS = 1 << 21

CHUNK_SCHEMA = "chunk_id long, n_texts long, n_bytes long, ids binary, offsets binary, body binary"


@dataclass
class Chunk:
    """Whole texts in order of their ids. ids: int64, NO_ID for null."""

    chunk_id: int
    ids: np.ndarray
    offs: np.ndarray
    buf: np.ndarray
    answers: dict = field(default_factory=dict)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of each job that ends in here; what a job returns is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def build(texts: DataFrame, id_column: str, column: str, chunk_bytes: int = CHUNK_BYTES) -> "ChunkTable":
    """Write the texts (string or binary column) as chunks, bucketed by chunk; they never move again."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made = TaskContext.get().partitionId() << 32, 0
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, parts, held
            ids = np.concatenate([p[0] for p in parts])
            lens = np.concatenate([np.diff(p[2]) for p in parts])
            buf = np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            if (order != np.arange(len(order))).any():
                offs = np.cumsum(lens) - lens
                buf = np.concatenate([buf[offs[i] : offs[i] + lens[i]] for i in order]) if len(buf) else buf
                ids, lens = ids[order], lens[order]
            offs = np.concatenate(([0], np.cumsum(lens))).astype(np.int64)
            row = [[at + made], [len(ids)], [len(buf)], [ids.tobytes()], [offs.tobytes()], [buf.tobytes()]]
            made, parts, held = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int64()] * 3 + [pa.binary()] * 3)], ["chunk_id", "n_texts", "n_bytes", "ids", "offsets", "body"])

        for batch in batches:
            ids = ids_of(batch.column(0))
            buf, offs = buffer_of(batch.column(1))
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + chunk_bytes - held, "right")) - 1)
                j = min(j, i + 1_000_000)
                parts.append((ids[i:j].copy(), buf[offs[i] : offs[j]].copy(), offs[i : j + 1] - offs[i]))
                held += int(offs[j] - offs[i])
                i = j
                if held >= chunk_bytes or i < len(ids):
                    yield flush()
        if parts:
            yield flush()

    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    source = texts.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("body"))
    total = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_buckets = int(min(100_000, max(spark.sparkContext.defaultParallelism, 1 + 3 * total // (2 * chunk_bytes))))
    name = f"chunks_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    with tidy(spark):
        source.mapInArrow(packed, CHUNK_SCHEMA).write.option("compression", "zstd").bucketBy(n_buckets, "chunk_id").option("path", path).saveAsTable(name)
    return ChunkTable(spark, name, path, n_buckets, int(total))


@dataclass
class ChunkTable:
    spark: SparkSession
    name: str
    path: str
    n_buckets: int
    n_bytes: int

    def buckets_for(self, n_keys: float) -> int:
        """A power of two of key ranges, so that each gets about BUCKET_KEYS keys."""
        return 1 << max(3, int(np.ceil(np.log2(max(1.0, n_keys / BUCKET_KEYS)))))

    def each(self, work: Callable[[Chunk], Iterator[pa.RecordBatch]], schema: str, answers: dict[str, DataFrame] | None = None) -> DataFrame:
        """``work`` on every chunk, with the answers that it got: chunk.answers[name][bucket]."""
        names = list(answers or {})
        rows = self.spark.table(self.name)
        for x in names:
            got = answers[x].repartition(self.n_buckets, "chunk_id").groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "body")).alias(f"a_{x}"))
            rows = rows.join(got.hint("shuffle_hash"), "chunk_id", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    binary = {f: np.frombuffer(column[f][i].as_buffer(), t) for f, t in (("ids", np.int64), ("offsets", np.int64), ("body", np.uint8))}
                    chunk = Chunk(column["chunk_id"][i].as_py(), binary["ids"], binary["offsets"], binary["body"])
                    for x in names:
                        chunk.answers[x] = {a["bucket"]: a["body"] for a in column[f"a_{x}"][i].as_py() or []}
                    yield from work(chunk)

        return rows.mapInArrow(run, schema)

    def exchange(self, ask: Callable[[Chunk], Iterator[tuple[int, bytes]]], answer: Callable[[list[bytes]], list[bytes]], answers: dict[str, DataFrame] | None = None) -> DataFrame:
        """Send what each chunk asks to the tasks of the key ranges; returns their written answers."""

        def asked(chunk: Chunk) -> Iterator[pa.RecordBatch]:
            sent = list(ask(chunk))
            yield pa.RecordBatch.from_arrays([pa.array([chunk.chunk_id] * len(sent), pa.int64()), pa.array([b for b, _ in sent], pa.int64()), pa.array([x for _, x in sent], pa.binary())], ["chunk_id", "bucket", "body"])

        def answered(asking: pa.Table) -> pa.Table:
            bodies = answer([x.as_py() for x in asking.column("body")])
            return pa.table([asking.column("chunk_id"), asking.column("bucket"), pa.array(bodies, pa.binary())], ["chunk_id", "bucket", "body"])

        schema = "chunk_id long, bucket long, body binary"
        with tidy(self.spark):
            return cut_lineage(self.each(asked, schema, answers).groupBy("bucket").applyInArrow(answered, schema))

    def drop(self) -> None:
        """Delete the written chunks once nothing reads them any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value of bounded size; the function gets it inside a task."""
    held, cache = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> object:
        if not cache:
            cache.append(pickle.loads(held.value))
        return cache[0]

    return get


def ranges(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of ascending 64-bit keys, by their leading bits."""
    bits = n_buckets.bit_length() - 1
    bounds = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(n_buckets + 1, dtype=np.uint64))
    for b in range(n_buckets):
        if bounds[b] < bounds[b + 1]:
            yield b, int(bounds[b]), int(bounds[b + 1])
