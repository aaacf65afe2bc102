"""Connected components of a table of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node reachable, for every node that has a link.

    Each round takes the least label of a node's neighbours, then the label of that
    label; paths shrink by half a round.  Every round is a checkpoint, and only the
    number of changed labels reaches the driver.
    """
    both = durable(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).distinct())
    labels = durable(both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("node"), F.least("u", "w").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = durable(step.join(jump, "label").select("node", F.least("label", "far").alias("label"), (F.least("label", "far") != F.col("old")).alias("changed")), spent=[labels])
        if moved.where("changed").isEmpty():
            discard([both])
            return moved.drop("changed")
        labels = moved
