"""Labelled rows for the classifiers: all of them, a bounded, repeatable sample, and the rows held out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row must teach nothing: crc32 of its id as text (null: empty) is a multiple of FOLDS."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def grades(labels: DataFrame, grade: Column, doc_id: str = "doc_id") -> DataFrame:
    """(labelled_id, grade) of all labelled ids that are not held out; an id's labels count once, by the largest grade."""
    return labels.filter(F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("labelled_id"), grade.alias("grade")).groupBy("labelled_id").agg(F.max("grade").alias("grade"))


def sample(docs: DataFrame, labels: DataFrame, grade: Column, per_grade: int, n_grades: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, doc_id, grade) of at most ``per_grade`` documents of each grade, those with the smallest hashed ids.

    Only ids of labels that are not held out take part; a document's labels count once, by the largest
    grade; null grades and null ids do not count.  ``per_grade`` bounds what is broadcast and collected.
    """
    rated = grades(labels, grade, doc_id)
    picked = [rated.filter(F.col("grade") == g).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(per_grade) for g in range(n_grades)]
    chosen = F.broadcast(reduce(DataFrame.union, picked))
    return docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id")).join(chosen, F.col("doc_id") == F.col("labelled_id")).select("text", "doc_id", "grade")
