"""Neighbourhood metrics and planting regimes of point inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvaq.functions.species import is_general
from sylvaq.operators.dbscan import dbscan
from sylvaq.operators.near import counts_within
from sylvaq.operators.regression import row_numbers
from sylvaq.scratch import checkpointed


def mono_rate(sites: DataFrame, radius: float) -> DataFrame:
    """(id, density, mono_rate): neighbours within the radius and the share of them of the same species.

    ``sites``: unique id, x, y, name (NULL: unmapped). No neighbours: 0. Trees of a
    general category get the mean rate of all other trees that have a neighbour
    (0 if there is none), even without neighbours of their own. Unmapped trees
    equal nobody; they enter the mean and count among others' neighbours.
    """
    sites = checkpointed(sites.select("id", "x", "y", "name"))
    near = counts_within(sites.select("id", "x", "y"), radius)
    named = sites.where(F.col("name").isNotNull())
    same = counts_within(named.select("id", "x", "y", F.col("name").alias("kind")), radius).withColumnRenamed("n", "same")
    s = sites.join(near, "id", "left").join(same, "id", "left")
    n = F.coalesce("n", F.lit(0))
    s = s.select("id", "name", n.alias("density"), F.when(n > 0, F.coalesce("same", F.lit(0)) / n).otherwise(0.0).alias("rate"))
    s = checkpointed(s)
    general = is_general(F.col("name"))
    # one number; with no such tree 0
    mean = s.where(~general & (F.col("density") > 0)).agg(F.coalesce(F.avg("rate"), F.lit(0.0))).first()[0]
    return s.select("id", "density", F.when(general, F.lit(float(mean))).otherwise(F.col("rate")).alias("mono_rate"))


def cluster_labels(sites: DataFrame, radius: float, least: int) -> DataFrame:
    """(id, label): density clusters numbered from 0 in the order of their smallest dense id; -1 in none."""
    members = checkpointed(dbscan(sites, radius, least).select("id", "root"))
    roots = members.select("root", F.lit(1).alias("g")).distinct()
    label = row_numbers(roots, ["g"], "root").select("root", (F.col("rn") - 1).alias("label"))
    numbered = members.join(label, "root").select("id", "label")
    return sites.select("id").join(numbered, "id", "left").select("id", F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"))


def cluster_regimes(labelled: DataFrame, high: float = 0.70, low: float = 0.30) -> DataFrame:
    """(label, size, dominant, share, regime) per cluster of (label, name) rows; label -1 takes no part.

    Share of the most frequent name among the named members (ties: alphabetical).
    Above ``high`` 'Monoculture', or 'Unknown' for a general category; below ``low``
    'Mixed'; else 'Intermediate'. A cluster without named members is 'Unknown'.
    """
    c = labelled.where(F.col("label") >= 0).groupBy("label", "name").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("name").isNotNull(), F.col("n"))
    d = c.groupBy("label").agg(
        F.sum("n").alias("size"),
        F.min_by("name", F.when(F.col("name").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("name")))).alias("dominant"),
        (F.max(named) / F.sum(named)).alias("share"),
    )
    regime = (
        F.when(F.col("dominant").isNull(), "Unknown")
        .when(F.col("share") > high, F.when(is_general(F.col("dominant")), "Unknown").otherwise("Monoculture"))
        .when(F.col("share") < low, "Mixed")
        .otherwise("Intermediate")
    )
    return d.withColumn("regime", regime)


def site_regimes(sites: DataFrame, labels: DataFrame, regimes: DataFrame) -> DataFrame:
    """(id, label, regime) of every site; 'Sparse' outside clusters."""
    r = labels.join(regimes.select("label", "regime"), "label", "left")
    return sites.select("id").join(r, "id").select("id", "label", F.coalesce("regime", F.lit("Sparse")).alias("regime"))
