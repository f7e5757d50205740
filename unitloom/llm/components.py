"""Connected components of a table of links, in rounds that are each written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from unitloom.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    A round gives a node the least label among its neighbours and then that label's own label,
    so chains shorten by doubling.  Minima are combined before the shuffle and labels are joined
    from written tables, so a node with many links is split over tasks.
    """
    both = cut_lineage(
        links.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct(), "edges")
    labels = cut_lineage(
        both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("heard"))
        lower = cut_lineage(
            labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("to")),
            "lowered")
        onward = labels.select(F.col("node").alias("to"), F.col("component").alias("end"))
        jumped = cut_lineage(
            lower.join(onward, "to").select("node", F.least("to", "end").alias("component"), (F.least("to", "end") < F.col("was")).alias("moved")),
            "labels")
        labels = jumped.select("node", "component")
        if jumped.where("moved").isEmpty():
            return labels
