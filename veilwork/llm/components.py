"""Connected components by rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``node, label``: the smallest node of each node's component, for edges ``a, b``.

    First each node keeps its smallest neighbour below it, to which its others
    are tied instead, so that nodes met in many places don't multiply edges.
    Then each round takes the smallest label among neighbours, then the label of
    that label, so labels travel in doubling steps.  Rounds are written tables;
    no node's neighbours are gathered.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.withColumn("least", F.min("b").over(Window.partitionBy("a")))
    thin = least.select("a", F.col("least").alias("b")).unionByName(
        least.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()
    both = work.save(thin.unionByName(thin.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = work.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"),
                       f"{name}-0")
    round_ = 0
    while True:
        round_ += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        next_ = work.save(
            hooked.alias("h").join(labels.select(F.col("node").alias("to"), F.col("label").alias("further")),
                                   F.col("label") == F.col("to"))
            .select("node", F.least("label", "further").alias("label"), "old"), f"{name}-{round_}")
        if next_.where("label <> old").isEmpty():
            return next_.select("node", "label")
        labels = next_.select("node", "label")


def smallest(pairs: int, left, right):
    """Component label (smallest member) of places ``0 .. pairs - 1`` under edges given as two arrays of places."""
    import numpy as np

    label = np.arange(pairs)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
