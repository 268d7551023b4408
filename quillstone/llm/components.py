"""Connected components by least labels with pointer jumping, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import checkpointed


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(vertex, label) of all vertices with an edge; label is the least vertex of the component.

    Each round takes the least label of the neighbours (partial minima before the shuffle, so a vertex of many edges is
    no burden) and then the label's own label, so that chains halve. Rounds are checkpointed. Null ends are ignored.
    """
    edges = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = checkpointed(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("vertex")).agg(F.least(F.col("vertex"), F.min("v")).alias("label")))
    while True:
        heard = both.join(labels, F.col("v") == F.col("vertex")).groupBy("u").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, F.col("vertex") == F.col("u")).select(
            "vertex", F.col("label").alias("before"), F.least("label", "heard").alias("label")
        )
        parents = lower.select(F.col("vertex").alias("parent"), F.col("label").alias("above"))
        jumped = lower.join(parents, F.col("label") == F.col("parent"), "left").select(
            "vertex", "before", F.least("label", F.coalesce("above", "label")).alias("label")
        )
        jumped = checkpointed(jumped)
        labels = jumped.select("vertex", "label")
        if jumped.where("before <> label").isEmpty():
            return labels
