"""Density clustering of points by dual-tree joins: counts, links, minimum labels, borders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaq.operators.components import min_labels
from sylvaq.operators.near import counts_within, least_near, links_within
from sylvaq.scratch import checkpointed


def dbscan(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(id, root, dense): one row per point in a cluster; ``root`` is the cluster's smallest dense id.

    ``points`` has unique ``id`` (bigint) and finite ``x``, ``y``. A point is dense if
    at least ``least`` points, itself included, lie within ``radius``. Dense points
    within ``radius`` share a cluster, also through others; a point that is not
    dense joins the lowest root among its dense neighbours; all others are in no
    cluster and do not come out. Empty input, no rows.

    No step writes pairs of dense points: they are counted wholesale, linked by a
    star per task, and a point that is not dense has fewer than ``least`` partners.
    """
    points = checkpointed(points.select("id", "x", "y"))
    flagged = points.join(counts_within(points, radius), "id").select("id", "x", "y", (F.col("n") + 1 >= least).alias("dense"))
    flagged = checkpointed(flagged)
    dense = flagged.where("dense").select("id", "x", "y")
    roots = min_labels(dense.select("id"), links_within(dense, radius))
    rooted = checkpointed(flagged.join(roots, "id", "left"))
    border = least_near(rooted.select("id", "x", "y", "root"), radius, "root")
    inside = rooted.where("dense").select("id", "root", "dense")
    return inside.unionByName(border.select("id", F.col("value").alias("root"), F.lit(False).alias("dense")))
