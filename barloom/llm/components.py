"""Connected components of a link table by repeated contraction. Links and labels stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """links(a, b) -> (id, component) for every id in a link; component is the smallest id reachable.

    Each round points every node at its smallest neighbour, follows the pointers to their roots by
    doubling, and replaces the links by those between different roots. Rounds are logarithmic in practice.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = stage.table(links.select(low.alias("lo"), high.alias("hi")).filter("lo < hi").distinct(), "links")
    labels = None
    while edges.head(1):
        roots = stage.table(edges.groupBy("hi").agg(F.min("lo").alias("to")).select(F.col("hi").alias("id"), "to"), "roots")
        while True:
            up = roots.select(F.col("id").alias("to"), F.col("to").alias("next"))
            stepped = stage.table(roots.join(up, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
            done = not stepped.filter("moved").head(1)
            roots = stepped.select("id", "to")
            if done:
                break
        ends = roots.withColumnRenamed("to", "root")
        moved = edges.join(ends.withColumnRenamed("id", "lo").withColumnRenamed("root", "rl"), "lo", "left")
        moved = moved.join(ends.withColumnRenamed("id", "hi").withColumnRenamed("root", "rh"), "hi", "left")
        a, b = F.coalesce("rl", "lo"), F.coalesce("rh", "hi")
        contracted = stage.table(moved.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct(), "links")
        if labels is None:
            labels = roots.select("id", F.col("to").alias("component"))
        else:
            labels = labels.join(roots.select(F.col("id").alias("component"), F.col("to").alias("up")), "component", "left")
            labels = labels.select("id", F.coalesce("up", "component").alias("component"))
            # roots that were no one's pointer source before
            labels = labels.unionByName(roots.join(labels.select("id"), "id", "left_anti").select("id", F.col("to").alias("component")))
        labels = stage.table(labels, "labels")
        edges = contracted
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component")).filter(F.lit(False))
    own = labels.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    return stage.table(labels.unionByName(own.join(labels.select("id"), "id", "left_anti")), "components")
