"""Connected components of a table of edges, as Spark joins; nothing goes to the driver but
whether edges are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component: its smallest node) for every node of ``edges`` (u, v).

    In a round each node moves to its smallest neighbour, and on to where that one moves;
    edges are then drawn between what the nodes became, without loops and repeats, so they
    shrink from round to round. Each round is written.
    """
    low, high = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    now = written(edges.where("u <> v").select(low, high).distinct(), "component-edges")
    labels = None
    while True:
        ends = now.select(F.col("v").alias("node"), F.col("u").alias("to")).union(now.select(F.col("u").alias("node"), F.col("u").alias("to")))
        step = written(ends.groupBy("node").agg(F.min("to").alias("to")), "component-steps")
        on = step.join(step.select(F.col("node").alias("to"), F.col("to").alias("on")), "to").select("node", F.col("on").alias("to"))
        moves = written(on, "component-moves")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("component"))
        else:
            of = moves.select(F.col("node").alias("component"), "to")
            labels = labels.join(of, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = written(labels, "component-labels")
        left = now.join(moves.select(F.col("node").alias("u"), F.col("to").alias("a")), "u").join(moves.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
        now = written(left.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "component-edges")
        if now.isEmpty():
            return labels
