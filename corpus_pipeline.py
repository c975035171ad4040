"""A corpus pipeline of five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.session import cut_lineage, ensure_checkpoint_dir

BATCH_ROWS = 500
#: Of written copies of whole texts.
CODEC = "zstd"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Send fewer whole texts to a Python worker at once: what a worker has once held stays with it in later stages."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    with small_batches(spark):
        network = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return cut_lineage(toxicity.scored(docs, network).filter("predicted = 0").select(*docs.columns), CODEC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that come earlier; one that loses all it says, or keeps only short lines of earlier documents, goes."""
    found = cut_lineage(line_dedup.dedup_lines(docs), CODEC)  # read for the stubs as well
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(line_dedup.LAST)).alias("doc"), F.xxhash64("text").alias("row")]
    kept = found.select("*", *keys).join(line_dedup.stubs(found), ["doc", "row"], "left_anti")
    return kept.withColumns({"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long"))}).select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates."""
    classes = ngram_join.similar_documents(docs.select("doc_id", "text"))
    others = classes.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark's items; those that are mostly such go."""
    cleaned = decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens, as pieces of documents."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_each_class),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack),
]

#: A trained classifier is among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
