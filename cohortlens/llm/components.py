"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Every round takes the smallest label among neighbours and then follows the label's own label, which
    halves the remaining depth.  Rounds are written to the shared folder; only a count reaches the driver.
    """
    both = shared_table(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct(), "edges")
    labels = shared_table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near")))
        lower = (labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"),
                                                                        F.least("component", "near").alias("component")))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = shared_table(lower.join(jump, "component", "left").select("node", "was", F.coalesce("further", "component").alias("component")), "labels")
        if after.filter("component <> was").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
