"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of ``links`` (a, b); the component is its smallest node.

    Each round gives a node the smallest label among its neighbours and then its label's label, so
    long chains halve; every round is written to the shared folder.  Nothing but a count comes to the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "cc-links")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "cc-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = step.join(jump, F.col("label") == F.col("via"), "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        step = materialise(step, "cc-labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
