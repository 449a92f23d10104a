"""Diameter imputation and carbon accounting of wide multi-year inventories.

All steps are column expressions over one row per tree: no shuffle, no window.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaq.functions.clean import number
from sylvaq.functions.species import CARBON_SHARE, biomass, species_name
from sylvaq.sources.tables import with_optional

YEARS = ("15", "17", "21", "23")


def _clean_measures(df: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    df = with_optional(df, {f"{p}{y}": "double" for p in prefixes for y in YEARS})
    kinds = dict(df.dtypes)
    return df.withColumns({f"{p}{y}": number(F.col(f"{p}{y}"), kinds[f"{p}{y}"]) for p in prefixes for y in YEARS})


def model_choice(models: DataFrame, preference: str = "best") -> DataFrame:
    """(species, features, c0, c_height, c_crown) of one linear model per species: the best
    by ``r2`` (ties: the first in ``seq``), or the preferred feature set."""
    if preference != "best":
        return models.where(F.col("features") == preference).select("species", "features", "c0", "c_height", "c_crown")
    order = F.struct((-F.coalesce("r2", F.lit(float("-inf")))).alias("r"), F.col("seq"))
    one = models.groupBy("species").agg(F.min_by(F.struct("features", "c0", "c_height", "c_crown"), order).alias("m"))
    return one.select("species", "m.*")


def forest_predictions(df: DataFrame, key: str, forests: dict[tuple[str, str], PipelineModel]) -> DataFrame:
    """(key, species, features, p15..p23): predictions of stored forests for the trees of their species.

    ``forests``: (species name, feature set) -> model, one per species. Each model
    transforms only its species' readings with a height other than 0 and, if it
    uses the crown, a crown above 0; the years come back side by side by one aggregate.
    """
    df = _clean_measures(df, ("H", "DP")).withColumn("__name", species_name(F.col("Species")))
    cells = F.array(*[F.struct(F.lit(y).alias("y"), F.col(f"H{y}").alias("tree_height_m"), F.when(F.col(f"DP{y}") > 0, F.col(f"DP{y}")).alias("crown_diameter_m")) for y in YEARS])
    long = df.select(key, "__name", F.explode(cells).alias("c")).select(key, "__name", "c.*").where(F.col("tree_height_m") != 0)
    out = None
    for (name, features), model in forests.items():
        own = long.where(F.col("__name") == name)
        if "Crown" in features:
            own = own.where(F.col("crown_diameter_m").isNotNull())
        p = model.transform(own).select(key, F.lit(name).alias("species"), F.lit(features).alias("features"), "y", "pred")
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no forests given")
    return out.groupBy(key, "species", "features").agg(*[F.max(F.when(F.col("y") == y, F.col("pred"))).alias(f"p{y}") for y in YEARS])


def impute_diameters(df: DataFrame, models: DataFrame, key: str | None = None, forest: DataFrame | None = None, with_rmse: bool = False) -> DataFrame:
    """``df`` with cleaned H and DP and, per survey year, ``TD{yy}`` and ``TD{yy}_model``.

    Per year in order: without a height (missing or 0) the last diameter is
    carried, tag 'CarryForward'; else the species' linear model predicts, and a
    prediction below the last diameter (0 at first) is raised to it, tag suffix
    '_MonotonicFix'. A species without a model, or a crown model without a crown
    above 0, carries the last diameter with an empty tag. Species ids outside the
    list leave the diameter NULL and the tag empty. ``models`` has unique
    ``species`` names, a short table whose size decides the join. With ``forest``
    (forest_predictions' result, unique in ``key``) species found there use those
    predictions, tag 'RandomForest_...', instead of a linear model. With
    ``with_rmse`` the column ``rmse`` of ``models`` comes out as ``TD{yy}_rmse`` where a
    linear model predicted.
    """
    df = _clean_measures(df, ("H", "DP")).withColumn("Species_Name", species_name(F.col("Species")))
    m = models.select(F.col("species").alias("__species"), F.struct("features", "c0", "c_height", "c_crown", *(["rmse"] if with_rmse else [])).alias("__m"))
    df = df.join(m, F.col("Species_Name") == F.col("__species"), "left")
    if forest is not None:
        f = forest.select(F.col(key).alias("__key"), F.struct("features", *[f"p{y}" for y in YEARS]).alias("__f"))
        df = df.join(f, F.col(key) == F.col("__key"), "left").drop("__key")
    state: Column = F.lit(0.0)
    new: dict[str, Column] = {}
    for y in YEARS:
        h, dp = F.col(f"H{y}"), F.col(f"DP{y}")
        crown = F.when(dp > 0, dp)
        pred = F.col("__m.c0") + F.coalesce(F.col("__m.c_height") * h, F.lit(0.0))
        uses = F.col("__m.features").contains("Crown")
        pred = F.when(uses, pred + F.col("__m.c_crown") * crown).otherwise(pred)
        label = F.concat(F.lit("Linear_"), F.col("__m.features"))
        if forest is not None:
            pred = F.when(F.col("__f").isNull(), pred).otherwise(F.col(f"__f.p{y}"))
            label = F.when(F.col("__f").isNull(), label).otherwise(F.concat(F.lit("RandomForest_"), F.col("__f.features")))
        pred = F.when(h.isNotNull() & (h != 0), pred)
        df = df.withColumn(f"__p{y}", pred)
        known = F.col("Species_Name").isNotNull()
        tag = F.concat(label, F.when(F.col(f"__p{y}") < state, "_MonotonicFix").otherwise(""))
        tag = F.when(~known, "").when(h.isNull() | (h == 0), "CarryForward").when(F.col(f"__p{y}").isNull(), "").otherwise(tag)
        state = F.greatest(state, F.coalesce(F.col(f"__p{y}"), F.lit(0.0)))
        new |= {f"TD{y}": F.when(known, state), f"TD{y}_model": tag}
        if with_rmse:
            new[f"TD{y}_rmse"] = F.when(tag.startswith("Linear_"), F.col("__m.rmse"))
    return df.withColumns(new).drop("__species", "__m", "__f", *[f"__p{y}" for y in YEARS])


def long_diameters(df: DataFrame, key: str) -> DataFrame:
    """(key, year, td, tag): the imputed diameters of all years, one scan."""
    cells = F.array(*[F.struct(F.lit(2000 + int(y)).alias("year"), F.col(f"TD{y}").alias("td"), F.col(f"TD{y}_model").alias("tag")) for y in YEARS])
    return df.select(key, F.explode(cells).alias("c")).select(key, "c.*")


def carbon_stocks(df: DataFrame) -> DataFrame:
    """``df`` with ``CS_{yy}`` in kg from ``TD{yy}`` (m) and ``H{yy}`` (m).

    0 where diameter or height is missing or the diameter not above 0; NULL for
    unmapped species. Absent year columns count as missing.
    """
    df = _clean_measures(df, ("TD", "H")).withColumn("Species_Name", species_name(F.col("Species")))
    name = F.col("Species_Name")

    def stock(y: str) -> Column:
        td, h = F.col(f"TD{y}"), F.col(f"H{y}")
        live = td.isNotNull() & h.isNotNull() & (td > 0)
        return F.when(name.isNull(), F.lit(None).cast("double")).when(live, biomass(name, td * 100, h) * CARBON_SHARE).otherwise(0.0)

    return df.withColumns({f"CS_{y}": stock(y) for y in YEARS})


def annual_growth(df: DataFrame) -> DataFrame:
    """``df`` with ``Annual_Carbon_Growth``: last less first stock above 0, by the years between; 0 with fewer than two."""

    def ends(years: list[str]) -> tuple[Column, Column]:
        live = [F.when(F.col(f"CS_{y}") > 0, F.struct(F.col(f"CS_{y}").alias("v"), F.lit(int(y)).alias("y"))) for y in years]
        s = F.coalesce(*live)
        return s["v"], s["y"]

    v0, y0 = ends(list(YEARS))
    v1, y1 = ends(list(reversed(YEARS)))
    return df.withColumn("Annual_Carbon_Growth", F.when(y1 > y0, (v1 - v0) / (y1 - y0)).otherwise(0.0))


def period_growth(df: DataFrame) -> DataFrame:
    """``df`` with ``Ann_{a}_{b}`` per pair of neighbouring years: NULL unless both stocks are above 0."""

    def growth(a: str, b: str) -> Column:
        x, z = F.col(f"CS_{a}"), F.col(f"CS_{b}")
        return F.when((x > 0) & (z > 0), (z - x) / (int(b) - int(a)))

    return df.withColumns({f"Ann_{a}_{b}": growth(a, b) for a, b in zip(YEARS, YEARS[1:])})
