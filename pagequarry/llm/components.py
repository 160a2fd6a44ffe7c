"""Connected components by minimum labels with pointer jumping, as joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node of its component, for every node of edges (a, b)."""
    both = stored(edges.select("a", "b").where("a <> b").unionByName(edges.selectExpr("b AS a", "a AS b").where("a <> b")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("via"))
        jump = labels.select(F.col("node").alias("at"), F.col("comp").alias("to"))
        moved = stored(lower.join(jump, F.col("via") == F.col("at")).select("node", "old", F.least("via", "to").alias("comp")), "labels")
        labels = moved.select("node", "comp")
        if not moved.where("comp <> old").limit(1).count():
            return labels
