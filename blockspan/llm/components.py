"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import settle


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every end of the edges ``a, b``; the label is the least node of
    its component.

    In each round a node's parent becomes the least grandparent of its neighbours, and so
    does the parent's own; then parents give way to grandparents. Trees are so hooked to
    each other as a whole, and the rounds grow with the logarithm of a component's size.
    Minima are taken before the shuffle: a node with very many neighbours or children is no
    burden to one task.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("label"), F.col("a").alias("top")).distinct()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "top"), "b").groupBy("a").agg(F.min("top").alias("near"))
        met = settle(labels.join(near, F.col("node") == F.col("a")).select("node", "label", "top", "near"))
        own = met.select("node", F.least("label", "top", "near").alias("label"), F.col("top").alias("was"))
        hooked = met.select(F.col("label").alias("node"), F.col("near").alias("label"), F.lit(None).cast("long").alias("was"))
        lower = own.unionByName(hooked).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        parent = lower.select(F.col("node").alias("up"), F.col("label").alias("top"))
        moved = (F.col("top") < F.col("was")) | (F.col("top") < F.col("label"))
        labels = settle(lower.join(parent, F.col("label") == F.col("up")).select("node", "label", "top", moved.alias("moved")))
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
