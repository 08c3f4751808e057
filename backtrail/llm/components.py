"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.session import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every end of a link (a, b), the smallest node it is joined to.

    Each round a node takes the smallest label among its neighbours, then the label of its
    label, so chains halve. Rounds end when no label changes. Links and labels stay
    distributed; each round is cut from the ones before by a checkpoint.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(
            F.min("component").alias("near"))
        joined = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        up = labels.select(F.col("node").alias("via"), F.col("component").alias("up"))
        moved = joined.join(up, F.col("new") == F.col("via"), "left").select(
            "node", "old", F.least("new", F.coalesce("up", "new")).alias("component"))
        moved = durable(moved)
        labels = moved.select("node", "component")
        if moved.filter(F.col("component") != F.col("old")).isEmpty():
            return labels
