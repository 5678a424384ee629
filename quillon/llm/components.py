"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import forget, settled


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) for each node of links (a, b).

    In each round a node takes the least label among its own and its neighbours', then its label's label; the
    number of rounds grows with the logarithm of the longest chain in practice. Each round is written to the shared
    folder. A node with very many links only adds rows to a partial minimum.
    """
    edges = settled(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settled(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        took = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        took = settled(took, "took")
        up = took.select(F.col("node").alias("new"), F.col("new").alias("up"))
        after = settled(took.join(up, "new", "left").select("node", F.coalesce("up", "new").alias("component"), "old"), "labels")
        done = after.where("component <> old").isEmpty()
        forget(took, labels)
        labels = after.select("node", "component")
        if done:
            forget(edges)
            return labels
