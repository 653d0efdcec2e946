"""Connected components of a graph of long node ids, by rounds of joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .stored import dropped, stored


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (the least node id reachable), for all nodes that an edge of two nodes has.

    Each round points every node at the least node its neighbours point at, and edges are
    then drawn between what their ends point at, with loops and repeats taken out: a group
    shrinks to its local minima, so a chain of n nodes needs about log n rounds. Hubs are
    summed by the least id before the shuffle. The driver sees one count a round.
    """
    live = edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).filter("a < b").distinct()
    live = stored(live, "edges")
    names: DataFrame | None = None
    while not live.isEmpty():
        least = (live.select(F.col("a").alias("node"), F.col("a").alias("to"))
                 .union(live.select(F.col("b").alias("node"), F.col("a").alias("to")))
                 .groupBy("node").agg(F.min("to").alias("to")))
        least = stored(least, "roots")
        for _ in range(2):  # what a node points at may itself point on
            onward = least.select(F.col("node").alias("to"), F.col("to").alias("next"))
            further = stored(least.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "roots")
            dropped(least)
            least = further
        onto_a = least.select(F.col("node").alias("a"), F.col("to").alias("x"))
        onto_b = least.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = live.join(onto_a, "a").join(onto_b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        after = stored(moved.filter("a < b").distinct(), "edges")
        if names is None:
            names = least
        else:
            step = least.select(F.col("node").alias("component"), F.col("to").alias("next"))
            renamed = stored(names.join(step, "component", "left")
                             .select("node", F.coalesce("next", "component").alias("component")), "names")
            dropped(names, least)
            names = renamed
        if "to" in names.columns:
            path = names._stored_path
            names = names.withColumnRenamed("to", "component")
            names._stored_path = path
        dropped(live)
        live = after
    dropped(live)
    if names is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return names
