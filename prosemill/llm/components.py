"""Connected components by least names and pointer jumping; nothing but one counter reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.shared import cut


def components(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``edges`` (a long, b long), undirected -> (node, label): the least name that each node reaches, itself included.

    ``names`` (node, name) gives distinct nodes their names, of any type with an order; a node is its own name if None.

    Each round takes the least name among neighbours, then what the node of that name has found, so a path of n
    nodes needs about log n rounds. The names travel themselves: nothing is grouped by component in the end, where
    one component may hold a third of all nodes. Such a name is only a value on the left of a join, which adaptive
    execution splits.
    """
    plain = edges.filter("a <> b").select("a", "b")
    both = cut(plain.union(plain.select("b", "a")).distinct())
    own = both.select(F.col("a").alias("node")).distinct()
    own = own.withColumn("name", F.col("node")) if names is None else own.join(names.select("node", "name"), "node")
    labels = cut(own.select("node", F.struct("name", "node").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("over"))
        step = cut(step.join(jump, F.col("label.node") == F.col("via"), "left").select("node", "was", F.least("label", "over").alias("label")))
        labels = step.select("node", "label")
        if not step.filter("was.node <> label.node").limit(1).count():
            return labels.select("node", F.col("label.name").alias("label"))
