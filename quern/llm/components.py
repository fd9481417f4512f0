"""Connected components of an edge table, by repeated hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``: the label is the same for connected nodes.

    Each round gives every node the smallest of itself and its neighbours, follows such hooks until they
    end, and keeps the edges between different labels, which become fewer each time. Everything stays in
    tables, joined by shuffle so that none goes through the driver; a node of many edges takes part in aggregates and joins only. Loops (a = b) give a node of its own.
    """
    kind = edges.schema["a"].dataType
    edges = cut(edges.select("a", "b").distinct())
    labels = cut(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("label", F.col("node")))
    edges = edges.filter("a <> b")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("m")).select("root", F.least("root", "m").alias("to")))
        while True:  # hooks point to smaller nodes, so they have no cycles
            on = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            further = hooks.join(on.hint("merge"), "to", "left").select("root", "to", F.coalesce("next", "to").alias("next"))
            further = cut(further)
            moved = not further.filter("next <> to").isEmpty()
            hooks = further.select("root", F.col("next").alias("to"))
            if not moved:
                break
        labels = labels.join(hooks.withColumnRenamed("root", "label").hint("merge"), "label", "left").select("node", F.coalesce("to", "label").cast(kind).alias("label"))
        labels = cut(labels)
        left = hooks.select(F.col("root").alias("a"), F.col("to").alias("x"))
        right = hooks.select(F.col("root").alias("b"), F.col("to").alias("y"))
        edges = edges.join(left.hint("merge"), "a", "left").join(right.hint("merge"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels
