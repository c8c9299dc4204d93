"""Connected components of undirected edges, as repeated joins on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node that can be reached.

    Each round every node takes the least label among its neighbours' and its own, and then the label of that label, so
    that a path of n nodes needs about log n rounds. A hub's edges are pre-aggregated and never gathered in one place.
    Loops and repeated edges do no harm; null ends have no part in it; without edges there are no nodes.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    # With a loop at each node, one aggregate gives the least label around it and its own.
    both = scratch.save(pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")])).alias("e")).select("e.*").distinct())
    labels = scratch.save(both.read().groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))
    while True:
        now = labels.read()
        around = both.read().join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
        nearest = around.agg(F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("was"), F.min("component").alias("label"))
        jumped = nearest.join(now.select(F.col("node").alias("label"), F.col("component").alias("beyond")), "label", "left")
        step = scratch.save(jumped.select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("component")))
        moved = step.read().where("was <> component").limit(1).count()
        labels.drop()
        labels = step
        if not moved:
            both.drop()
            return labels.read().select("node", "component")


def joined_components(scratch: Scratch, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels as they are after further edges (a, b): components are joined as nodes of a smaller graph.

    Ends of edges that have no label yet are components of their own.
    """
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    contracted = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(scratch, contracted).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    nodes = labels.unionByName(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").withColumn("component", F.col("node")))
    return scratch.save(nodes.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))).read()
