"""Queries of the record operators (problems 2, 3, 5 and 6) over the test tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaq.operators.fields import split_values
from sylvaq.operators.near import counts_within, located_points, pairs_within
from sylvaq.operators.quality import Rule, findings, load_distances, malformed_texts, pooled_distances, profile_loads
from sylvaq.operators.spikes import Rules, implausible_readings, judged_readings
from sylvaq.sources.tables import table

CARBON = "tree_carbon_updated7_spatial"
RADIUS, DENSE = 25.0, 10
X_RANGE, Y_RANGE = (300_000.0, 900_000.0), (6_500_000.0, 7_200_000.0)
HEIGHTS = ["H15", "H17", "H21", "H23"]
RULES = [Rule("lightemiss", 0, 500), Rule("ra15_17", 0, 9000), Rule("LST_1516", -10, 60), Rule("Mono_Rate", 0, 1)]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_values(table(spark, sf_dir, CARBON), "soil", ["row_id"], value="soil_value", min_values=2)


def p2_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = split_values(table(spark, sf_dir, CARBON), "soil", ["row_id"], value="soil_value")
    return v.groupBy("soil_value").agg(F.count(F.lit(1)).alias("n"), F.max("pos").cast("bigint").alias("last_pos"))


def located_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y) of the trees with a location."""
    return located_points(table(spark, sf_dir, "cluster_analysis_data"), "tree_id", "X", "Y", X_RANGE, Y_RANGE)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_within(located_trees(spark, sf_dir), RADIUS).select(F.col("id_a").alias("tree_id_a"), F.col("id_b").alias("tree_id_b"))


def p3_density25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_within(located_trees(spark, sf_dir), RADIUS).select(F.col("id").alias("tree_id"), F.col("n").alias("density25"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the definition of the case the window of the Hampel filter is the whole strip."""
    flagged = implausible_readings(table(spark, sf_dir, "tree"), "tree_id", "strip_id", "seq_no", HEIGHTS)
    return flagged.select(F.col("item").alias("tree_id"), "field").distinct()


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = implausible_readings(table(spark, sf_dir, "tree"), "tree_id", "strip_id", "seq_no", HEIGHTS)
    return flagged.groupBy("field", "reason").agg(F.count(F.lit(1)).alias("n"))


def p5_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter in a window of seven readings on either side."""
    r = judged_readings(table(spark, sf_dir, "tree"), "tree_id", "strip_id", "seq_no", HEIGHTS, Rules(half=7))
    return r.where("spike").select(F.col("item").alias("tree_id"), "field", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(profile_loads(table(spark, sf_dir, CARBON), "load_id", RULES)).select(F.col("load").alias("load_id"), "column_name", "finding")


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    carbon = table(spark, sf_dir, CARBON)
    p = profile_loads(carbon, "load_id", RULES)
    texts = malformed_texts(carbon, "load_id", RULES).withColumnsRenamed({"load": "l", "column_name": "c"})
    p = p.join(texts, F.col("load").eqNullSafe(F.col("l")) & (F.col("column_name") == F.col("c")), "left")
    exact = [F.round(c, 6).alias(c) for c in ("min_value", "max_value", "q1", "median", "q3", "top_value")]
    spelt = [F.coalesce(c, F.lit(0)).alias(c) for c in ("malformed_distinct", "top_malformed_count")]
    return p.select(F.col("load").alias("load_id"), "column_name", "rows", "missing", "malformed", "numbers", "out_of_bounds", "distinct_values", *exact, "top_count", *spelt, "top_malformed")


def p6_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between each load and the next one."""
    d = load_distances(table(spark, sf_dir, CARBON), "load_id", RULES)
    return d.select("column_name", "load_a", "load_b", "n_a", "n_b", F.round("ks", 6).alias("ks"))


def p6_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between each load and all others."""
    d = pooled_distances(table(spark, sf_dir, CARBON), "load_id", RULES)
    return d.select("column_name", F.col("load").alias("load_id"), "n", "n_others", F.round("ks", 6).alias("ks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_value_counts, p3_found, p3_density25, p5_found, p5_reasons, p5_rolling, p6_found, p6_profile, p6_distance, p6_drift)}
