"""Connected components by minimum-label propagation on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaq.scratch import checkpointed


def _composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """(v, r): the map ``first`` followed by ``then``; what ``then`` does not list stays."""
    after = then.select(F.col("v").alias("r"), F.col("r").alias("__to"))
    return first.join(after, "r", "left").select("v", F.coalesce("__to", "r").alias("r"))


def min_labels(vertices: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root): the smallest id of each vertex's component.

    ``vertices`` has unique ``id`` (bigint), ``edges`` has ``a``, ``b`` (either way
    round; loops and repeats do no harm). A round hooks every vertex with a smaller
    neighbour to the least of them, follows the hooks to their ends by pointer
    jumping, and redraws the edges between those ends. Every vertex that was not the
    least among its neighbours leaves the graph, so the rounds run on ever smaller
    edge lists and their number is about the logarithm of the longest component;
    minimum labels reach every vertex in the end by composing the rounds' maps
    backwards. Every round is a checkpoint and nothing but whether edges are left
    reaches the driver. Isolated vertices are their own root; no vertices, no rows.
    """

    def drawn(e: DataFrame) -> DataFrame:
        return checkpointed(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())

    left, maps = drawn(edges), []
    while not left.isEmpty():
        if len(maps) == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        hook = checkpointed(left.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("r")))
        while True:  # hooks lead to smaller ids only, so the doubling ends
            ends = hook.select(F.col("v").alias("r"), F.col("r").alias("__up"))
            jumped = checkpointed(hook.join(ends, "r", "left").select("v", F.coalesce("__up", "r").alias("r"), F.col("__up").isNotNull().alias("moved")))
            hook = jumped.select("v", "r")
            if jumped.where("moved").isEmpty():
                break
        maps.append(hook)
        ends = hook.select(F.col("v").alias("b"), F.col("r").alias("__b"))
        # the larger end of every edge is hooked, the smaller one perhaps
        moved = left.join(hook.withColumnRenamed("v", "a"), "a").join(ends, "b", "left")
        left = drawn(moved.select(F.col("r").alias("a"), F.coalesce("__b", "b").alias("b")))
    if not maps:
        return vertices.select("id", F.col("id").alias("root"))
    whole = maps[-1]
    for m in reversed(maps[:-1]):
        whole = _composed(m, whole).unionByName(whole)
    return vertices.select("id").join(whole.select(F.col("v").alias("id"), "r"), "id", "left").select("id", F.coalesce("r", "id").alias("root"))
