"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binweave.scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a`` and ``b``, whole numbers).

    The component is its least node.  Each round takes the least label among a node's
    neighbours and then the label of that label, so paths shrink by more than half and about
    log2 of the longest one are needed.  Each round is written, and the last is known by a count.
    Partial minima keep a node with many neighbours from gathering in one task.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    start = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component"))
    labels = cut(start, "labels")
    while True:
        of_other = labels.select(F.col("node").alias("b"), F.col("component").alias("other"))
        least = both.join(of_other, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        stepped = labels.join(least, "node").select("node", F.least("component", "other").alias("component"), F.col("component").alias("old"))
        of_label = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = stepped.join(of_label, "component").select("node", F.least("component", "further").alias("component"), "old")
        written = cut(jumped, "labels")
        if written.filter("component <> old").isEmpty():
            return written.select("node", "component")
        labels = written.select("node", "component")
