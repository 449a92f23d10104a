"""Long panel of a wide survey: periods, cleaning, median fill, feature gate, standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaq.functions.clean import mean_present, nonzero, number, soil_flags
from sylvaq.functions.species import GENERAL, species_name
from sylvaq.operators.ordered import exact_quantiles
from sylvaq.sources.tables import with_optional

# The periods with the columns that describe them, and how zeros are read.
PERIODS = {
    "15_17": ("H15", "svf15", "svf17", "ra15_17", "LST_1516"),
    "17_21": ("H17", "svf17", "svf21", "ra17_21", "LST_1720"),
    "21_23": ("H21", "svf21", "svf23", "ra21_23", "LST_2122"),
}
ZERO_IS_MISSING = ["noise17d", "noise22d", "lightemiss", "svf15", "svf17", "svf21", "svf23", "ra15_17", "ra17_21", "ra21_23", "LST_1516", "LST_1720", "LST_2122", "H15", "H17", "H21", "H23"]
ZERO_COUNTS = ["Density25", "Mono_Rate"]
# The features of the growth models.
FEATURES = ["Log_Initial_H", "avg_noise_day", "Density25", "Mono_Rate", "avg_svf", "avg_radiation", "avg_LST", "lightemiss", "soil_has_infill", "soil_has_moraine", "soil_has_bedrock"]
ALWAYS = ["Log_Initial_H", "avg_noise_day", "Density25", "avg_svf", "avg_radiation", "avg_LST", "lightemiss"]
OPTIONAL_SOIL = ["soil_has_infill", "soil_has_moraine", "soil_has_bedrock"]
TARGET = "Log_Annual_Carbon_Growth"
TYPES = ("Katu", "Puisto")
POOLED = "General Tree"


def cleaned(df: DataFrame) -> DataFrame:
    """Street and park rows with numeric measures: text that is no number, NaN and infinities are
    missing, zeros too except in Density25 and Mono_Rate; absent measures are all missing."""
    df = with_optional(df.where(F.col("type").isin(*TYPES)), {c: "double" for c in [*ZERO_IS_MISSING, *ZERO_COUNTS]})
    kinds = dict(df.dtypes)
    new = {c: nonzero(number(F.col(c), kinds[c])) for c in ZERO_IS_MISSING} | {c: number(F.col(c), kinds[c]) for c in ZERO_COUNTS}
    df = df.withColumns(new)
    return df.withColumns({"avg_noise_day": mean_present(F.col("noise17d"), F.col("noise22d")), "Species_Name": species_name(F.col("Species")), **soil_flags(F.col("soil"))})


def long_panel(df: DataFrame, key: str) -> DataFrame:
    """One row per tree and period with a positive growth and starting height, one scan.

    Periods whose growth column is absent are skipped; without any the panel is
    empty. Columns: key, Period, Species_Name, type, TARGET and FEATURES, unfilled.
    """
    c = cleaned(df)
    kinds = dict(c.dtypes)
    cells = []
    for name, (h, s0, s1, ra, lst) in PERIODS.items():
        if f"Ann_{name}" not in c.columns:
            continue
        growth = number(F.col(f"Ann_{name}"), kinds[f"Ann_{name}"])
        cells.append(
            F.struct(
                F.lit(name).alias("Period"), growth.alias("growth"), F.col(h).alias("Initial_H"), mean_present(F.col(s0), F.col(s1)).alias("avg_svf"),
                F.col(ra).alias("avg_radiation"), F.col(lst).alias("avg_LST"),
            )
        )
    same = [key, "Species_Name", "type", "avg_noise_day", *ZERO_COUNTS, "lightemiss", *OPTIONAL_SOIL]
    if not cells:
        cells = [F.struct(F.lit("").alias("Period"), *[F.lit(None).cast("double").alias(x) for x in ("growth", "Initial_H", "avg_svf", "avg_radiation", "avg_LST")])]
    long = c.select(*same, F.explode(F.array(*cells)).alias("p")).select(*same, "p.*")
    long = long.where((F.col("growth") > 0) & (F.col("Initial_H") > 0))
    long = long.withColumns({TARGET: F.log1p("growth"), "Log_Initial_H": F.log1p("Initial_H")})
    return long.select(key, "Period", "Species_Name", "type", TARGET, *FEATURES)


def medians(panel: DataFrame, features: list[str]) -> DataFrame:
    """(feature, median) over all rows; exact, by one range sort of the unpivoted features."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("c")
    return exact_quantiles(panel.select(cells).select("c.*"), ["feature"], "v", {"median": 0.5})


def median_filled(panel: DataFrame) -> DataFrame:
    """The panel with missing features (but Log_Initial_H) set to their median over the whole panel,
    species and periods together; 0 where a feature has no value at all."""
    todo = [f for f in FEATURES if f != "Log_Initial_H"]
    found = {r.feature: r.median for r in medians(panel, todo).collect()}  # one row per feature
    return panel.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(float(found.get(f, 0.0)))) for f in todo})


def with_pooled(panel: DataFrame) -> DataFrame:
    """Every row under its species (if it has one) and under POOLED, as ``grp``."""
    return panel.withColumn("grp", F.explode(F.array_compact(F.array(F.col("Species_Name"), F.lit(POOLED)))))


def feature_gate(grouped: DataFrame, least_obs: int = 200, least_rows: int = 500) -> DataFrame:
    """(grp, n, variable): the features each group of more than ``least_rows`` rows is analysed with.

    Always the seven basic ones; Mono_Rate unless the group is a general category;
    a soil dummy with at least ``least_obs`` ones; the type dummy; of all these only
    those that vary in the group.
    """
    every = [*ALWAYS, "Mono_Rate", *OPTIONAL_SOIL]
    g = grouped.withColumn("type_Puisto", (F.col("type") == "Puisto").cast("int"))
    stats = g.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in OPTIONAL_SOIL], *[(F.max(c) > F.min(c)).alias(f"v_{c}") for c in [*every, "type_Puisto"]]
    ).where(F.col("n") > least_rows)

    def allowed(c: str):
        ok = F.col(f"v_{c}")
        if c == "Mono_Rate":
            ok = ok & ~F.col("grp").isin(*GENERAL)
        if c in OPTIONAL_SOIL:
            ok = ok & (F.col(f"s_{c}") >= least_obs)
        return F.when(ok, F.lit(c))

    return stats.select("grp", "n", F.explode(F.array_compact(F.array(*[allowed(c) for c in [*every, "type_Puisto"]]))).alias("variable"))


def standardised(grouped: DataFrame, features: list[str]) -> DataFrame:
    """(grp, feature values scaled by the group's mean and population deviation); constants become NULL.

    The statistics are a grouped aggregate joined back, so a large group stays spread.
    """
    stats = grouped.groupBy("grp").agg(*[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in features], *[F.stddev_pop(F.col(f).cast("double")).alias(f"d_{f}") for f in features])
    return grouped.join(stats, "grp").withColumns({f: F.when(F.col(f"d_{f}") > 0, (F.col(f) - F.col(f"m_{f}")) / F.col(f"d_{f}")) for f in features}).drop(*stats.drop("grp").columns)
