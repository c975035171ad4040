"""Connected components of a link table: smallest labels and pointer jumping, a written table each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.chunks import tidy
from ledgerloom.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for each node in a link.

    A round takes the smallest label of a node's neighbours and then the label of its label, so
    chains shrink by halves.  Sums and minima combine before they are shuffled; no group is gathered.
    """
    spark = links.sparkSession
    with tidy(spark):
        pairs = cut_lineage(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
        both = pairs.union(pairs.select("b", "a"))
        labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
        while True:
            near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            hooked = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("next"))
            # A better label is also told to the old one, which stands for all that bear it.
            told = hooked.filter("next < label").groupBy(F.col("label").alias("node")).agg(F.min("next").alias("told"))
            better = hooked.join(told, "node", "left").select("node", "label", F.least("next", "told").alias("next"))
            better = cut_lineage(better)
            jump = better.select(F.col("node").alias("next"), F.col("next").alias("far"))
            after = cut_lineage(better.join(jump, "next", "left").select("node", "label", F.least("next", "far").alias("next")))
            moved = after.filter("next < label").limit(1).count()
            labels = after.select("node", F.col("next").alias("label"))
            if not moved:
                return labels.select("node", F.col("label").alias("component"))
