"""Stored run summaries: written as JSON, read back with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_summary(document: DataFrame, path: str) -> None:
    document.write.mode("errorifexists").json(path)


def read_summary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a stored summary; a missing artifact is an error, never an empty result."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
