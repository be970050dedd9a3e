"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of the links (a, b); lone nodes have no row.

    Labels spread to neighbours by a minimum that is combined before the shuffle and then
    jump to their own label's label, so chains halve each round and a hub of any degree is
    only a skewed join. Each round is a table in the shared folder.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
               .where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(
            F.min("l").alias("m"))
        told = near.join(labels, near["a"] == labels["node"]).select(
            "node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        told = cut(told)
        root = told.select(F.col("node").alias("at"), F.col("label").alias("up"))
        jumped = cut(told.join(root, told["label"] == root["at"]).select("node", F.least("label", "up").alias("label"), "old"))
        if jumped.where("label <> old").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
