"""Forest queries over a survey in which forests win."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaq.functions.species import species_name
from sylvaq.operators import regression
from sylvaq.operators.forest import forest, forest_cv, grown
from sylvaq.plans import trees

WINNERS = {"Acer", "Betula", "Pinus"}


@pytest.fixture(scope="module")
def survey(spark, tmp_path_factory):
    """Diameters in steps of the height for three species, linear in it for Tilia; the trees are those of the smallest tables."""
    rng, rows = np.random.default_rng(3), []
    for species in sorted(WINNERS | {"Tilia"}):
        for _ in range(60):
            h, c = rng.uniform(2, 20), rng.uniform(1, 9)
            y = 0.02 * h if species == "Tilia" else 0.1 + 0.5 * (int(h) // 6 % 2)
            rows.append((len(rows), species, float(h), float(c), float(y + rng.normal(0, 0.01))))
    folder = tmp_path_factory.mktemp("survey")
    spark.createDataFrame(rows, "sample_id bigint, species string, tree_height_m double, crown_diameter_m double, ell_eq_diameter_m double").write.parquet(str(folder / "all_species_summary.parquet"))
    os.symlink("/root/testdata/sf0.001/tree.parquet", folder / "tree.parquet")
    return str(folder)


def test_forest_cv_like_spark_ml(spark):
    rng = np.random.default_rng(3)
    x, z, e = rng.uniform(2, 20, 300), rng.uniform(1, 9, 300), rng.normal(0, 0.05, 300)
    y = 0.1 + 0.5 * (x.astype(int) // 6 % 2) + 0.02 * z + e
    d = spark.createDataFrame([(i, "a", *map(float, r)) for i, r in enumerate(zip(x, z, y))], "id bigint, g string, x double, z double, y double").cache()
    ours = forest_cv(d, "g", ["x", "z"], "y", "id", trees=40).first()
    out = None
    for f in range(5):
        p = forest(["x", "z"], "y", 40, 30).fit(d.where(F.col("id") % 5 != f)).transform(d.where(F.col("id") % 5 == f)).select("pred", "y")
        out = p if out is None else out.unionByName(p)
    assert ours.n == 300 and ours.r2 == pytest.approx(out.agg(regression.scores("pred", "y")[1]).first()[0], abs=0.02)


def test_forests_compete(spark, survey):
    best = {r.species: r for r in trees.best_model(spark, survey).collect()}
    assert {k for k, r in best.items() if r.model == "RandomForest"} == WINNERS and best["Tilia"].model == "Linear"
    summary = {r.species: r for r in trees.model_summary(spark, survey).collect()}
    assert all(summary[k].best_model == r.model and summary[k].best_features == r.features for k, r in best.items())
    tags = {r[0] for r in trees.impute_best(spark, survey).select("tag").distinct().collect()}
    assert any(t.startswith("RandomForest_") for t in tags) and any(t.startswith("Linear_") for t in tags)


def test_every_winning_forest_is_used(spark, survey):
    done = trees.impute_forest(spark, survey).join(trees.table(spark, survey, "tree").select("rec_id", species_name(F.col("Species")).alias("name")), "rec_id")
    tags = {(r.name, r.tag.split("_")[0]) for r in done.where(F.col("name").isin(*WINNERS, "Tilia") & F.col("tag").contains("_")).select("name", "tag").distinct().collect()}
    assert tags == {(k, "RandomForest") for k in WINNERS} | {("Tilia", "Linear")}


def test_scores_of_every_set_and_fold(spark, survey):
    linear = {(r.species, "Height"): r.r2 for r in trees.queries()["cv_oof_height"](spark, survey).collect()}
    rows = trees.model_results(spark, survey).collect()
    assert len(rows) == 6 * 4
    assert all(r.R2 == pytest.approx(linear[r.species, r.features], abs=1e-6) for r in rows if r.model == "Linear" and r.features == "Height")
    forests = {(r.species, r.features): r.r2 for r in trees.rf_cv_metrics(spark, survey).collect()}
    assert forests == pytest.approx({(r.species, r.features): r.R2 for r in rows if r.model == "RandomForest"})
    shares = trees.rf_importance(spark, survey).collect()
    assert len(shares) == 4 * 4 and sum(r.importance for r in shares) == pytest.approx(3 * 4)


def test_trees_do_not_hang_on_rounding():
    rng = np.random.default_rng(5)
    bins = np.unique(rng.integers(0, 32, (80, 2)), axis=0)
    n, y = rng.poisson(1.0, (50, len(bins))).astype(float), rng.normal(0.3, 0.1, len(bins))
    pred, gains = grown(n, n * y, bins, 30)
    for shift in (6e-17, -6e-17, 1e-15):
        moved, other = grown(n, n * (y + shift), bins, 30)
        assert np.allclose(moved, pred, rtol=0, atol=1e-9, equal_nan=True) and np.allclose(other, gains, rtol=0, atol=1e-9)


def test_held_out_rows_set_no_cuts(spark):
    # without the row at 1 the cut lies at 5, with it at 0.5, on whose right the row would be predicted as 1
    x = [0.0] * 11 + [1.0] + [10.0] * 12
    d = spark.createDataFrame([(i, "a", v, float(v > 5)) for i, v in enumerate(x)], "id bigint, g string, x double, y double")
    ours = forest_cv(d, "g", ["x"], "y", "id", trees=40).first()
    assert ours.n == 24 and ours.rmse < 0.05
