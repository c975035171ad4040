"""The dealt operators as queries, with their SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, decontamination, dedup_passages, embedding_dedup, line_dedup, lm_matching, ngram_join, packing, prefix_trie, projected_search, quality, token_alignment, toxicity
from ledgerloom.llm.labelled import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages.repeated_passages(_table(spark, sf_dir, "documents"), with_bytes=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    network = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select("doc_id", held_out().alias("held_out"), "text"), network).drop("text")


def op3_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 well made but toxic, 2 well made."""
    docs = _table(spark, sf_dir, "documents")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2 - F.coalesce("toxic", F.lit(0)))
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), grade, 3)
    return quality.graded(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_lm_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_matching.score(_table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.format_turns(turns, path), path)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text", "spans")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return token_alignment.aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_projected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_search.nearest(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.query(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_quality_ordinal": op3_quality_ordinal,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_lm_partial_matching": op8_lm_partial_matching,
    "op9_chat_format": op9_chat_format,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_token_alignment": op11_token_alignment,
    "op12_projected_search": op12_projected_search,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {"op6_line_dedup": line_dedup.SQL, "op13_prefix_trie": prefix_trie.SQL}
