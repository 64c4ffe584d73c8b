"""Connected components of an edge list, by hooking to the smallest neighbouring label and pointer jumping.

Nothing of the graph reaches the driver but the count of labels that changed. Every round is written to the shared
folder; labels are written before they are joined, so Spark can split the rows of a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for the nodes of edges (a, b): label is the smallest node that is reachable."""
    both = common.settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = common.settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = common.settled(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "hooked")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = common.settled(hooked.join(jump, "label").select("node", "was", F.col("next").alias("label")), "labels")
        changed = moved.filter("was <> label").limit(1).count()
        common.dropped(hooked)
        labels = moved.select("node", "label")
        if not changed:
            common.dropped(both)
            return labels
