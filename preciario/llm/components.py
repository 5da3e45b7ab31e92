"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preciario.llm.shared import discard, written


def connected(edges: DataFrame) -> DataFrame:
    """node and label (smallest node reachable) of every node of the edges (a, b); edges without one of their ends count for nothing.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so
    paths shrink by doubling; every round is written, which cuts the lineage and survives lost executors.
    Neighbours are only ever aggregated, never gathered, so a node may have any number of them.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where(F.col("a") != F.col("b")).distinct(), "edges")
    table = labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("far"))
        moved = stepped.join(jump, "step", "left").select("node", F.least("step", "far").alias("label"), (F.least("step", "far") < F.col("label")).alias("moved"))
        before, table = table, written(moved, "labels")
        discard(before)
        labels = table.select("node", "label")
        if table.where("moved").isEmpty():
            discard(both)
            return labels
