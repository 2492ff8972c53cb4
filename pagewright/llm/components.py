"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.base import cut, remove


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node that links (a, b) name; label is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so the rounds
    follow the logarithm of a component's width. Every round is written to the shared folder; the driver sees one count.
    A node with many links is one group of a pre-aggregated minimum.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("label").alias("m")), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m"))
        lower = label.select("node", "label").join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = cut(lower.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        if after.where("label <> was").isEmpty():
            remove(links.sparkSession, both, label)
            out = after.drop("was")
            out.cut_path = after.cut_path
            return out
        remove(links.sparkSession, label)
        label = after
