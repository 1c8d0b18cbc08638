"""Connected components of a link table by least labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; `links`: a, b. The label is the least node.

    A round takes the least label among a node's neighbours, then the label of that label, so a
    star needs two rounds and a chain a logarithmic number. Every round is a written table.
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        joined = labels.join(near, labels.node == near.a, "left")
        least = cut_lineage(joined.select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old")))
        jump = least.select(F.col("node").alias("n"), F.col("component").alias("next"))
        fresh = cut_lineage(least.join(jump, least.component == jump.n, "left").select("node", F.coalesce("next", "component").alias("component"), "old"))
        if not fresh.filter("component <> old").limit(1).count():
            return fresh.select("node", "component")
        labels = fresh.select("node", "component")
