"""Connected components by propagating least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Table, scratch, written


def least_labels(links: DataFrame) -> Table:
    """(node, label) for every node of ``links`` (a, b): the least node of its component.

    Each round a node takes the least label of its neighbours and then the label of that label,
    so the number of rounds grows with the logarithm of a component's length in practice.
    Rounds are written to the shared folder; the loop ends when none changes.
    """
    with scratch() as keep:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        first = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.lit(None).cast("long").alias("old"), F.least("a", "m").alias("label"))
        table = written(first, "labels")
        while True:
            labels = table.frame.select("node", "label")
            near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            better = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
            before, table = table, written(better.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label")), "labels")
            before.drop()
            if table.frame.where("old <> label").isEmpty():
                keep(table)
                return table
