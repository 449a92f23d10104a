"""Species profiles: group-size filter, descriptive statistics, correlations."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaq.operators.ordered import exact_quantiles


def species_with(df: DataFrame, least: int, species: str = "species") -> DataFrame:
    """(species, n) of species with at least ``least`` rows, largest first; NULL species is none."""
    return df.where(F.col(species).isNotNull()).groupBy(species).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), species)


def keep_species(df: DataFrame, least: int, species: str = "species") -> DataFrame:
    """The rows of those species: a semi join with the counted groups, hot species never in one task."""
    return df.join(species_with(df, least, species).select(species), species, "left_semi")


def describe(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """(group, feature, count, mean, std, min, q25, q50, q75, max) per group and feature.

    Sample standard deviation; exact quartiles with linear interpolation from a
    range sort. NULL and NaN values are skipped; a group without values of a
    feature does not come out for it.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("c")
    long = df.select(F.col(group), cells).select(group, "c.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    plain = long.groupBy(group, "feature").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    quart = exact_quantiles(long, [group, "feature"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return plain.join(quart, [group, "feature"]).select(group, "feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature_a, feature_b, r): Pearson correlations in long form, pairwise complete, one pass.

    NULL where a feature is constant or no pair is complete.
    """
    aggs = []
    for a, b in product(features, features):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        # the built-in correlation fails on a constant column
        aggs.append(F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).alias(f"{a}|{b}"))
    one = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in product(features, features)])
    return one.select(F.explode(cells).alias("c")).select("c.*")
