"""Connected components by minimum labels and pointer jumping; every round is joins and partial aggregates of narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, small, written


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b): root is the smallest node that links reach. No links: no rows.

    Labels of a bounded number of nodes are broadcast to the links; beyond that the joins shuffle.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "cc-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "cc-labels")
    while True:
        known = small(labels)
        seen = both.join(known.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = seen.join(known, "node").select("node", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        new = written(low.join(known.select(F.col("node").alias("to"), F.col("root").alias("far")), "to").select("node", F.col("far").alias("root"), (F.col("far") != F.col("was")).alias("moved")), "cc-labels")
        discard(labels)
        labels = new.select("node", "root")
        if new.filter("moved").isEmpty():
            discard(both)
            return labels
