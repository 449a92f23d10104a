"""Queries of the inventory workflow over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaq.functions.clean import mean_present, nonzero, number, significance_label, soil_flags
from sylvaq.functions.species import species_name
from sylvaq.operators import forest as rf
from sylvaq.operators import growth_models as gm
from sylvaq.operators import panel as pn
from sylvaq.operators import profile, stands
from sylvaq.operators import regression as reg
from sylvaq.operators.inventory import YEARS, annual_growth, carbon_stocks, forest_predictions, impute_diameters, long_diameters, model_choice, period_growth
from sylvaq.operators.near import counts_within, located_points, pairs_within
from sylvaq.plans.records import CARBON, DENSE, RADIUS, X_RANGE, Y_RANGE
from sylvaq.scratch import checkpointed, scratch_path
from sylvaq.sources.models import load_forest, load_linear, save_forest, save_linear
from sylvaq.sources.tables import copied_if_absent, nan_to_null, read_or_none, table, write_csv

LEAST_SAMPLES = 25
TARGET = "ell_eq_diameter_m"
SETS = {"Height": ["tree_height_m"], "Crown": ["crown_diameter_m"], "Height+Crown": ["tree_height_m", "crown_diameter_m"]}


def _r(*columns: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in columns]


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.keep_species(nan_to_null(table(spark, sf_dir, "all_species_summary")), LEAST_SAMPLES)


def _models(spark: SparkSession, sf_dir: str, preference: str) -> DataFrame:
    return model_choice(reg.linear_models(_samples(spark, sf_dir), "species", {preference: SETS[preference]}, TARGET), preference)


def _imputed(spark: SparkSession, sf_dir: str, preference: str = "Height") -> DataFrame:
    return impute_diameters(table(spark, sf_dir, "tree"), _models(spark, sf_dir, preference))


def impute_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_diameters(_imputed(spark, sf_dir), "rec_id").select("rec_id", "year", *_r("td"), "tag")


def impute_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _imputed(spark, sf_dir, "Crown")
    return d.select("rec_id", *_r(*[f"TD{y}" for y in YEARS]), *[f"TD{y}_model" for y in YEARS])


def impute_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputation with the best model of each species, of either kind."""
    return long_diameters(_dispatched(spark, sf_dir), "rec_id").select("rec_id", "year", *_r("td"), "tag")


def impute_with_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputation by height with the out-of-fold error of the model beside every diameter it gave."""
    s = checkpointed(_samples(spark, sf_dir))
    error = reg.cross_validate(s, "species", SETS["Height"], TARGET, "sample_id").select("species", "rmse")
    models = model_choice(reg.linear_models(s, "species", {"Height": SETS["Height"]}, TARGET), "Height").join(error, "species", "left")
    d = impute_diameters(table(spark, sf_dir, "tree"), models, with_rmse=True)
    return d.select("rec_id", *[F.round(f"TD{y}_rmse", 6).alias(f"TD{y}_rmse") for y in YEARS])


def impute_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_diameters(_imputed(spark, sf_dir), "rec_id").groupBy("year", "tag").agg(F.count(F.lit(1)).alias("n"))


def carbon_stock_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carbon_stocks(_imputed(spark, sf_dir)).select("rec_id", *[F.round(f"CS_{y}", 3).alias(f"CS_{y}") for y in YEARS])


def carbon_growth_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annual_growth(carbon_stocks(_imputed(spark, sf_dir))).select("rec_id", F.round("Annual_Carbon_Growth", 3).alias("Annual_Carbon_Growth"))


def carbon_growth_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_growth(carbon_stocks(_imputed(spark, sf_dir))).select("rec_id", *[F.round(c, 3).alias(c) for c in ("Ann_15_17", "Ann_17_21", "Ann_21_23")])


def carbon_by_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = annual_growth(carbon_stocks(_imputed(spark, sf_dir)))
    return g.groupBy("Species_Name").agg(
        F.count(F.lit(1)).alias("trees"), F.round(F.sum("CS_23"), 3).alias("stock_23"), F.round(F.avg("Annual_Carbon_Growth"), 6).alias("mean_growth")
    )


def species_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.species_with(table(spark, sf_dir, "all_species_summary"), LEAST_SAMPLES)


def species_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = profile.describe(_samples(spark, sf_dir), "species", [*SETS["Height+Crown"], TARGET])
    return d.select("species", "feature", "count", *_r("mean", "std", "min", "q25", "q50", "q75", "max"))


def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.correlations(_samples(spark, sf_dir), [*SETS["Height+Crown"], TARGET]).select("feature_a", "feature_b", *_r("r"))


def _ols(label: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reg.ols(_samples(spark, sf_dir), ["species"], SETS[label], TARGET).select("species", "n", *_r("intercept", "r2"), "variable", *_r("coef"))

    return query


def ols_tvalues_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.ols(_samples(spark, sf_dir), ["species"], SETS["Height"], TARGET).select("species", F.round("t", 4).alias("t"))


def ols_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for label, features in SETS.items():
        p = reg.ols(_samples(spark, sf_dir), ["species"], features, TARGET).select("species", F.lit(label).alias("features"), F.col("variable").alias("predictor"), F.round("p", 6).alias("p_value"))
        out = p if out is None else out.unionByName(p)
    return out


def _cv(label: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reg.cross_validate(_samples(spark, sf_dir), "species", SETS[label], TARGET, "sample_id").select("species", "n", *_r("rmse", "r2"))

    return query


def linear_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    out = None
    for label in ("Height", "Crown"):
        f = reg.formulas(s, "species", label, SETS[label], TARGET)
        out = f if out is None else out.unionByName(f)
    return out


def _cv_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of both kinds of model on every feature set, up to six rows per species."""
    s = checkpointed(_samples(spark, sf_dir))
    out = None
    for label, features in SETS.items():
        for model, cv in (("Linear", reg.cross_validate), ("RandomForest", rf.forest_cv)):
            seq = 2 * list(SETS).index(label) + (model != "Linear")
            r = cv(s, "species", features, TARGET, "sample_id").select("species", F.lit(label).alias("features"), F.lit(model).alias("model"), "rmse", "r2", F.lit(seq).alias("seq"))
            out = r if out is None else out.unionByName(r)
    return checkpointed(out)


def _dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees imputed with the best model of each species; forests are fitted on all its rows, stored and loaded again."""
    s, trees = checkpointed(_samples(spark, sf_dir)), table(spark, sf_dir, "tree")
    best = checkpointed(reg.best_rows(_cv_results(spark, sf_dir)))
    linear = reg.linear_models(s, "species", SETS, TARGET).join(best.where("model = 'Linear'"), ["species", "features"], "left_semi")
    folder = scratch_path(spark, "models")
    save_linear(linear, f"{folder}/linear")
    linear = load_linear(spark, f"{folder}/linear")
    predicted = None
    for r in best.where("model = 'RandomForest'").orderBy("species").collect():
        own = reg.complete(s.where(F.col("species") == r.species), [*SETS[r.features], TARGET])
        model = load_forest(save_forest(rf.forest(SETS[r.features], TARGET, 200, 30).fit(own), folder, f"{r.species}_{r.features}_rf"))
        p = checkpointed(forest_predictions(trees, "rec_id", {(r.species, r.features): model}))  # one large model in memory at a time
        predicted = p if predicted is None else predicted.unionByName(p)
    return impute_diameters(trees, linear, "rec_id", predicted)


def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.best_rows(_cv_results(spark, sf_dir)).select("species", "features", "model", *_r("rmse", "r2"))


def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best model per species with the linear formula of its features."""
    s = checkpointed(_samples(spark, sf_dir))
    best = reg.best_rows(_cv_results(spark, sf_dir))
    texts = None
    for label, features in SETS.items():
        f = reg.formulas(s, "species", label, features, TARGET).select("species", "features", "formula")
        texts = f if texts is None else texts.unionByName(f)
    return reg.summarise(best, texts).withColumn("best_R2", F.round("best_R2", 6))


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of linear models and forests, six rows per species."""
    return _cv_results(spark, sf_dir).select("species", "features", "model", F.col("rmse").alias("RMSE"), F.col("r2").alias("R2"))


def linear_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear rows of model_results alone."""
    s = checkpointed(_samples(spark, sf_dir))
    out = None
    for label, features in SETS.items():
        r = reg.cross_validate(s, "species", features, TARGET, "sample_id").select("species", F.lit(label).alias("features"), F.lit("Linear").alias("model"), F.round("rmse", 6).alias("RMSE"), F.round("r2", 6).alias("R2"))
        out = r if out is None else out.unionByName(r)
    return out


def impute_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputation with the stored forest of every species whose best model is a forest, and the best linear model for the rest."""
    return long_diameters(_dispatched(spark, sf_dir), "rec_id")


def rf_cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = checkpointed(_samples(spark, sf_dir))
    out = None
    for label, features in SETS.items():
        r = rf.forest_cv(s, "species", features, TARGET, "sample_id").select("species", F.lit(label).alias("features"), "n", "rmse", "r2")
        out = r if out is None else out.unionByName(r)
    return out


def rf_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = checkpointed(_samples(spark, sf_dir))
    out = None
    for label, features in SETS.items():
        i = rf.forest_importances(s, "species", features, TARGET).select("species", F.lit(label).alias("features"), F.explode("importances").alias("feature", "importance"))
        out = i if out is None else out.unionByName(i)
    return out


def samples_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples written as CSV and read again under a declared schema."""
    s = table(spark, sf_dir, "all_species_summary")
    path = scratch_path(spark, "samples_csv")
    write_csv(s, path)
    return read_or_none(spark, path, T.StructType(s.schema.fields))


def _carbon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, CARBON)


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.long_panel(_carbon(spark, sf_dir), "row_id")


def panel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select(
        "row_id", "Period", "Species_Name", "type", *_r(pn.TARGET, "Log_Initial_H", "avg_noise_day", "Density25", "Mono_Rate", "avg_svf", "avg_radiation", "avg_LST", "lightemiss"), *pn.OPTIONAL_SOIL
    )


def panel_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pn.cleaned(_carbon(spark, sf_dir))
    return c.select("row_id", *_r("avg_noise_day", "lightemiss", "svf15", "ra15_17", "LST_1516", "H15", "Density25", "Mono_Rate"))


def soil_code_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _carbon(spark, sf_dir).select("row_id", *[c.alias(n) for n, c in soil_flags(F.col("soil")).items()])


def panel_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.medians(_panel(spark, sf_dir), [f for f in pn.FEATURES if f != "Log_Initial_H"]).select("feature", *_r("median"))


def panel_median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.median_filled(_panel(spark, sf_dir)).select("row_id", "Period", *_r("avg_noise_day", "Density25", "Mono_Rate", "avg_svf", "avg_radiation", "avg_LST", "lightemiss"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.with_pooled(pn.median_filled(checkpointed(_panel(spark, sf_dir))))


def feature_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.feature_gate(_grouped(spark, sf_dir))


def standardised_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pn.standardised(_grouped(spark, sf_dir), ["Log_Initial_H", "avg_svf", "lightemiss"])
    return s.select("grp", "row_id", "Period", *[F.round(c, 5).alias(c) for c in ("Log_Initial_H", "avg_svf", "lightemiss")])


def _ordered(grouped: DataFrame) -> DataFrame:
    """A unique order that mixes rows: a multiplicative permutation of the row id, then the period."""
    place = F.when(F.col("Period") == "15_17", 0).when(F.col("Period") == "17_21", 1).otherwise(2)
    return grouped.withColumn("mix", ((F.col("row_id") * F.lit(48271)) % F.lit(2147483647)) * 4 + place)


def split_height_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = checkpointed(_ordered(_grouped(spark, sf_dir)))
    return reg.split_metrics(g, "grp", ["Log_Initial_H"], pn.TARGET, "mix").select("grp", "n", "n_test", *_r("rmse", "r2"))


def regression_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    # kept in columns, as several passes follow
    path = scratch_path(spark, "panel")
    _panel(spark, sf_dir).write.parquet(path)
    g = gm.divided(_ordered(pn.with_pooled(pn.median_filled(spark.read.parquet(path)))), "mix")
    return gm.performance(g, "mix").unionByName(gm.forest_performance(g, "mix"))


def coefficient_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.display_coefficients(gm.coefficient_table(_grouped(spark, sf_dir)))


def tile_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.tile_matrix(checkpointed(gm.coefficient_table(_grouped(spark, sf_dir))))


def tile_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.tile_legend(spark)


def tile_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.tile_wide(gm.coefficient_table(_grouped(spark, sf_dir)), gm.EVERY)


def growth_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.fit_status(_grouped(spark, sf_dir))


def coefficient_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group of the coefficient table whether its residuals, worked out row by row, are orthogonal to every
    feature, and whether they leave the share of the variance that R2 says."""
    g = checkpointed(_grouped(spark, sf_dir).withColumn("type_Puisto", (F.col("type") == "Puisto").cast("double")))
    table_ = checkpointed(gm.coefficient_table(g))
    wide = table_.groupBy(F.col("Species").alias("grp")).agg(F.map_from_entries(F.collect_list(F.struct("Variable", "Coef"))).alias("b"), F.max("R2").alias("R2"))  # some rows per group
    x = {f: F.col(f).cast("double") for f in gm.EVERY}
    stats = g.groupBy("grp").agg(*[F.avg(c).alias(f"m_{f}") for f, c in x.items()], *[F.stddev_pop(c).alias(f"d_{f}") for f, c in x.items()], F.avg(pn.TARGET).alias("m_y"), F.stddev_pop(pn.TARGET).alias("d_y"))
    j = g.join(wide.join(stats, "grp"), "grp")  # a row per group on the right
    z = {f: (c - F.col(f"m_{f}")) / (F.lit(1.0) if f == "type_Puisto" else F.nullif(F.col(f"d_{f}"), F.lit(0.0))) for f, c in x.items()}
    e = F.col(pn.TARGET) - F.col("m_y")
    for f in gm.EVERY:
        e = e - F.coalesce(F.try_element_at("b", F.lit(f)) * z[f], F.lit(0.0))
    j = j.withColumn("e", e)
    used = lambda f: F.try_element_at("b", F.lit(f)).isNotNull()
    off = F.greatest(F.lit(0.0), *[F.abs(F.avg(F.when(used(f), F.col("e") * z[f]))) for f in gm.EVERY])
    r2 = 1 - F.avg(F.col("e") * F.col("e")) / F.max("d_y") ** 2
    return j.groupBy("grp").agg((off < 1e-8).alias("orthogonal"), (F.abs(r2 - F.max("R2")) < 1e-8).alias("r2_holds"))


def significance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels over a measure taken as a p-value."""
    p = F.when(~F.isnan("Mono_Rate"), F.col("Mono_Rate") / 10)
    return _carbon(spark, sf_dir).select("row_id", significance_label(p).alias("label"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per located street or park tree: of its repeated rows the last updated one (equal times: larger species)."""
    t = table(spark, sf_dir, "cluster_analysis_data").where(F.col("tree_id").isNotNull() & F.col("X").between(*X_RANGE) & F.col("Y").between(*Y_RANGE))
    one = t.groupBy("tree_id").agg(F.max(F.struct("updated_at", "Species", "type", "X", "Y")).alias("r"))
    one = one.where(F.col("r.type").isin(*pn.TYPES))
    return one.select(F.col("tree_id").alias("id"), F.col("r.X").alias("x"), F.col("r.Y").alias("y"), species_name(F.col("r.Species")).alias("name"))


def neighbor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_within(_sites(spark, sf_dir), RADIUS)


def density25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_within(_sites(spark, sf_dir), RADIUS).select(F.col("id").alias("tree_id"), F.col("n").alias("density25"))


def mono_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stands.mono_rate(_sites(spark, sf_dir), RADIUS).select(F.col("id").alias("tree_id"), "density", *_r("mono_rate"))


def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stands.cluster_labels(checkpointed(_sites(spark, sf_dir)), RADIUS, DENSE).select(F.col("id").alias("tree_id"), "label")


def _regimes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sites = checkpointed(_sites(spark, sf_dir))
    labels = checkpointed(stands.cluster_labels(sites, RADIUS, DENSE))
    return sites, labels, stands.cluster_regimes(labels.join(sites.select("id", "name"), "id"))


def cluster_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regimes(spark, sf_dir)[2].select("label", "size", "dominant", *_r("share"), "regime")


def regime_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stands.site_regimes(*_regimes(spark, sf_dir)).groupBy("regime").agg(F.count(F.lit(1)).alias("sites"))


def _vif_frame(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    c = copied_if_absent(_carbon(spark, sf_dir), {"Initial_H": "H15"})
    kinds = dict(c.dtypes)
    n = lambda col: number(F.col(col), kinds[col])
    return c.select(
        *(keep or []), n("noise22d").alias("avg_noise_night"), n("Initial_H").alias("Initial_H"), n("lightemiss").alias("lightemiss"), mean_present(n("noise17d"), n("noise22d")).alias("avg_noise_day"), n("Density25").alias("Density25"), n("Mono_Rate").alias("Mono_Rate"),
        mean_present(nonzero(n("svf15")), nonzero(n("svf17"))).alias("avg_svf"), n("ra15_17").alias("avg_radiation"), n("LST_1516").alias("avg_LST"), *[f.alias(k) for k, f in soil_flags(F.col("soil")).items()],
    )


def _vif(features: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reg.vif(_vif_frame(spark, sf_dir), features).select("Feature", *_r("VIF"))

    return query


def vif_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 17 features, with the diameter imputed and densities at three radii counted anew."""
    carbon = _carbon(spark, sf_dir)
    frame = _vif_frame(spark, sf_dir, ["tree_id"]).drop("Density25")
    td = _imputed(spark, sf_dir).groupBy(F.col("tree_id")).agg(F.max("TD15").alias("Initial_TD"))
    sites = checkpointed(located_points(carbon, "tree_id", "X", "Y", X_RANGE, Y_RANGE))
    near = None
    for name, radius in (("Density_10", 10.0), ("Density_15", 15.0), ("Density25", RADIUS)):
        n = counts_within(sites, radius).select(F.col("id").alias("tree_id"), F.col("n").cast("double").alias(name))
        near = n if near is None else near.join(n, "tree_id")
    full = frame.join(td, "tree_id", "left").join(near, "tree_id", "left")
    return reg.vif(checkpointed(full), VIF_FEATURES)


def vif_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every VIF of vif_full is the total by the residual sum of squares of its feature on all others,
    with the residuals worked out row by row."""
    frame = checkpointed(reg.complete(_vif_frame(spark, sf_dir).select(*[F.col(f).cast("double").alias(f) for f in VIF_ALL]), VIF_ALL).withColumn("one", F.lit(1)))
    given = {r.Feature: r.VIF for r in reg.vif(frame, VIF_ALL).collect()}  # a row per feature
    aggs = []
    for f in VIF_ALL:
        fit = reg.ols(frame, ["one"], [g for g in VIF_ALL if g != f], f).collect()
        e = F.col(f) - F.lit(fit[0].intercept)
        for r in fit:
            e = e - F.lit(r.coef or 0.0) * F.col(r.variable)
        aggs.append((F.var_pop(f) / F.avg(e * e)).alias(f))
    true = frame.agg(*aggs).first()
    return spark.createDataFrame([(f, bool(abs(true[f] / given[f] - 1) < 1e-6)) for f in VIF_ALL], "Feature string, holds boolean")


# The features of the collinearity check.
VIF_FEATURES = [
    "Initial_TD", "Initial_H", "lightemiss", "avg_noise_day", "avg_noise_night", "Density_10", "Density_15", "Density25", "Mono_Rate",
    "avg_svf", "avg_radiation", "avg_LST", "soil_has_clay", "soil_has_infill", "soil_has_silt_sand", "soil_has_moraine", "soil_has_bedrock",
]
#: Those that need no imputed diameter, other radius or night noise.
VIF_ALL = [f for f in VIF_FEATURES if f not in ("Initial_TD", "Density_10", "Density_15", "avg_noise_night")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {
        f.__name__: f
        for f in (
            carbon_stock_wide, carbon_growth_annual, carbon_growth_period, carbon_by_species, impute_monotonic, impute_wide, impute_best, impute_with_rmse, impute_tag_counts, species_min_count, species_describe,
            feature_correlation, ols_tvalues_single, ols_pvalues, linear_formulas, best_model, model_summary, model_results, linear_results, impute_forest, rf_cv_metrics, rf_importance, samples_csv, panel_long, panel_clean, soil_code_flags,
            panel_medians, panel_median_fill, feature_gate, standardised_panel, split_height_metrics, regression_performance, coefficient_table, coefficient_check, growth_status, tile_matrix, tile_legend, tile_wide, significance_labels,
            neighbor_pairs, density25, mono_rate, dbscan_labels, cluster_regime, regime_counts, vif_workflow, vif_check,
        )
    }
    return named | {
        "ols_single_height": _ols("Height"), "ols_single_crown": _ols("Crown"), "ols_two_features": _ols("Height+Crown"),
        "cv_oof_height": _cv("Height"), "cv_oof_crown": _cv("Crown"), "cv_oof_both": _cv("Height+Crown"),
        "vif_two": _vif(["Initial_H", "lightemiss"]), "vif_three": _vif(["Initial_H", "Density25", "Mono_Rate"]), "vif_full": _vif(VIF_ALL),
    }
