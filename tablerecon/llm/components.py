"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns a and b; gives each linked node its smallest reachable node.

    Every round a node takes the smallest label around it and then that
    label's own label, which halves chains.  Nothing but the number of changed
    labels reaches the driver.  The hash as second key lets adaptive execution
    split a node with very many links.
    """
    both = links.where("a <> b").select("a", "b").unionAll(links.where("a <> b").select(F.col("b"), F.col("a")))
    edges = cut(both.distinct())
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        own = labels.select(F.col("node").alias("a"), F.xxhash64("node").alias("h"), "label")
        seen = edges.withColumn("h", F.xxhash64("a")).join(own, ["a", "h"]).groupBy("b").agg(F.min("label").alias("near"))
        lower = labels.join(seen, labels.node == seen.b, "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        lower = cut(lower)
        jump = lower.select(F.col("node").alias("via"), F.col("label").alias("further"))
        following = cut(
            lower.join(jump, F.col("label") == F.col("via"), "left").select("node", "old", F.least("label", "further").alias("label"))
        )
        labels = following.select("node", "label")
        if following.where("old <> label").isEmpty():
            return labels
