"""Connected components in a logarithmic number of rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], on_round: Callable[[str], None] = lambda what: None) -> DataFrame:
    """(id, component) of all ids in edges (a, b): component is the smallest id reachable. Loops and repeats don't matter.

    Every node points to the least of itself and its neighbours. The pointers form trees; doubling them (each node takes
    over what its pointer points to) makes every node point to its root in as many steps as the logarithm of the greatest
    depth. Then edges are contracted to roots. A node that stays is less than all its neighbours, so at most half of them
    stay: the number of contractions is logarithmic too. keep(df, name) cuts lineage; on_round sees each step.
    """
    edges = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    total = None
    while not edges.isEmpty():
        on_round("contraction")
        both = edges.union(edges.select("b", "a"))
        to = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("to")), "pointers")
        while True:
            on_round("doubling")
            following = to.select(F.col("id").alias("to"), F.col("to").alias("then"))
            further = keep(to.join(following, "to").select("id", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")), "pointers")
            to = further.select("id", "to")
            if further.where("moved").isEmpty():
                break
        x, y = to.select(F.col("id").alias("a"), F.col("to").alias("x")), to.select(F.col("id").alias("b"), F.col("to").alias("y"))
        edges = keep(edges.join(x, "a").join(y, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if total is None:
            total = to.withColumnRenamed("to", "component")
        else:
            joined = total.join(to.withColumnRenamed("id", "component"), "component", "left")
            total = keep(joined.select("id", F.coalesce("to", "component").alias("component")), "components")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")) if total is None else total
