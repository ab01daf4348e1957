"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kohort.session import stage_table


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Gives node, component (the least node reachable) for every node that has an edge.

    Each round hooks every node to its least neighbour, follows two hooks further and contracts the edges, so the edge table
    shrinks from round to round; it is written to the shared folder in between, and nothing is collected.
    """
    left = stage_table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooks = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root"))
        for _ in range(2):
            nxt = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
            hooks = hooks.join(nxt, "root").select("node", F.col("further").alias("root"))
        hooks = stage_table(hooks, "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("root").alias("component"))
        else:
            step = hooks.select(F.col("node").alias("component"), "root")
            labels = stage_table(labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        a, b = hooks.select(F.col("node").alias("a"), F.col("root").alias("x")), hooks.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = left.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = stage_table(left, "edges")
    if labels is None:
        return edges.select(F.col("a").cast("long").alias("node"), F.col("b").cast("long").alias("component")).where("false")
    return labels
