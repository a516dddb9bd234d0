"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b), both long: the least node that can be reached.

    Each node points to a node of its component that is no larger, first to itself. In a round it, and the node it points to, take the least that any neighbour's target points to, and
    pointers are shortened; rounds grow with the logarithm of a component's width, not with its size, and a node with many edges is summed before it moves.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    all_ = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    at = written(all_.select("node", F.col("node").alias("to")), "components")
    while True:
        far = written(at.join(at.select(F.col("node").alias("to"), F.col("to").alias("far")), "to"), "components")
        near = both.join(far.select(F.col("node").alias("b"), "far"), "b").groupBy("a").agg(F.min("far").alias("least"))
        seen = far.join(near, F.col("node") == F.col("a"))
        offers = far.select("node", F.col("far").alias("to")).unionByName(seen.select("node", F.col("least").alias("to"))).unionByName(seen.select(F.col("to").alias("node"), F.col("least").alias("to")))
        less = offers.groupBy("node").agg(F.min("to").alias("less"))
        new = written(at.join(less, "node").select("node", F.least("to", "less").alias("to"), (F.col("less") < F.col("to")).alias("moved")), "components")
        at = new.drop("moved")
        if not new.filter("moved").take(1):
            return at.withColumnRenamed("to", "component")
