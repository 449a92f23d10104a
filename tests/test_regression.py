import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from sylvaq.functions.clean import display_name, significance_label, soil_flags
from sylvaq.functions.student import t_two_sided
from sylvaq.operators import growth_models, panel, profile, regression
from sylvaq.operators.forest import forest, forest_cv, forest_importances, held_out
from sylvaq.sources.models import load_forest, load_linear, save_forest, save_linear
from sylvaq.sources.tables import copied_if_absent, keep_present, read_or_none, require, with_optional


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for g, n in (("a", 80), ("b", 40), ("c", 3)):
        for _ in range(n):
            k += 1
            x, z = rng.normal(10, 3), rng.normal(5, 1)
            rows.append((k, g, float(x), float(z) if k % 17 else None, float(1 + 0.5 * x - 0.2 * z + rng.normal(0, 0.3)), 4.0))
    rows.append((k + 1, None, 1.0, 1.0, 1.0, 4.0))
    return spark.createDataFrame(rows, "id bigint, g string, x double, z double, y double, k double").cache()


def group(data, g):
    r = [r for r in data.collect() if r.g == g and r.z is not None]
    return np.array([[q.x, q.z] for q in r]), np.array([q.y for q in r]), [q.id for q in r]


def test_ols_and_p_values(spark, data):
    got = {(r.g, r.variable): r for r in regression.ols(data, ["g"], ["x", "z", "k"], "y").collect()}
    for g in ("a", "b"):
        own = regression.complete(data, ["x", "z", "y"]).where(F.col("g") == g)
        m = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(VectorAssembler(inputCols=["x", "z"], outputCol="f").transform(own))
        for i, v in enumerate(("x", "z")):
            r = got[g, v]
            assert np.allclose([r.coef, r.intercept, r.t, r.r2], [m.coefficients[i], m.intercept, m.summary.tValues[i], m.summary.r2])
            assert r.p == pytest.approx(m.summary.pValues[i], rel=1e-6, abs=1e-14)
        assert got[g, "k"].coef is None
    assert {r.status for (g, _), r in got.items() if g == "c"} <= {"degenerate", "ok"}
    assert {r.status for r in regression.ols(data.withColumn("x2", F.col("x") * 2 + 1), ["g"], ["x", "x2"], "y").where("g = 'a'").collect()} == {"singular"}
    assert regression.ols(data.limit(0), ["g"], ["x"], "y").count() == 0


def test_student():
    for t, df, p in ((0.0, 5, 1.0), (2.0, 10, 0.0733880), (12.7062, 1, 0.05), (1.96, 1e6, 0.0499960), (30.0, 50, 0.0)):
        assert t_two_sided(t, df) == pytest.approx(p, abs=1e-5)


def test_cross_validation(data):
    got = {r.g: r for r in regression.cross_validate(data, "g", ["x", "z"], "y", "id").collect()}
    for g in ("a", "b"):
        x, y, ids = group(data, g)
        order = np.argsort(ids)
        x, y = np.column_stack([np.ones(len(y)), x])[order], y[order]
        fold, pred = np.arange(len(y)) % 5, np.empty(len(y))
        for f in range(5):
            pred[fold == f] = x[fold == f] @ np.linalg.lstsq(x[fold != f], y[fold != f], rcond=None)[0]
        assert got[g].rmse == pytest.approx(np.sqrt(np.mean((y - pred) ** 2)))
        assert got[g].r2 == pytest.approx(1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_split(data):
    r = {q.g: q for q in regression.split_metrics(data, "g", ["x"], "y", "id").collect()}
    assert (r["a"].n, r["a"].n_test, r["b"].n_test) == (80, 16, 8)


def test_vif(data):
    d = data.where("g = 'a'").select("x", "z", "k", (F.col("x") + F.col("z")).alias("s"), (F.col("x") * F.col("z")).alias("m"))
    x = np.array([[r.x, r.z, r.m] for r in d.collect() if r.z is not None])
    want = dict(zip(("x", "z", "m"), np.diag(np.linalg.inv(np.corrcoef(x.T)))))
    got = {r.Feature: r.VIF for r in regression.vif(d, ["x", "z", "m", "k"]).collect()}
    assert got.pop("k") is None and got == pytest.approx(want)
    assert [r.VIF for r in regression.vif(d, ["x", "z", "s"]).collect()] == [float("inf")] * 3
    assert regression.vif(d.limit(0), ["x"]).count() == 0


def test_best_and_formula(spark):
    df = spark.createDataFrame([("a", 0, 0.5, "p"), ("a", 1, 0.5, "q"), ("b", 0, None, "p"), ("b", 1, 0.1, "q"), ("c", 0, float("nan"), "p")], "species string, seq int, r2 double, m string")
    assert sorted((r.species, r.m) for r in regression.best_rows(df).collect()) == [("a", "p"), ("b", "q")]
    assert regression.formula("Acer", 0.0625, [("h", -0.5), ("c", 1.0005)]) == "Acer trunk_diameter = 0.062 + (-0.500 * h) + (1.000 * c)"


def test_profile(spark, data):
    r = {(q.g, q.feature): q for q in profile.describe(data, "g", ["x", "z"]).collect()}
    x, _, _ = group(data, "b")
    z = x[:, 1]
    q = r["b", "z"]
    assert np.allclose([q.mean, q.std, q.q25, q.q50, q.q75], [z.mean(), z.std(ddof=1), *np.quantile(z, [0.25, 0.5, 0.75])])
    assert [tuple(s) for s in profile.species_with(data, 10, "g").collect()] == [("a", 80), ("b", 40)]
    assert profile.keep_species(data, 10, "g").count() == 120
    c = {(q.feature_a, q.feature_b): q.r for q in profile.correlations(data, ["x", "k"]).collect()}
    assert c["x", "x"] == pytest.approx(1.0) and c["x", "k"] is None


def carbon(spark, n=1500):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        h, u = rng.uniform(2, 30, 4).round(2), rng.random()
        rows.append((i, ["Katu", "Puisto", "Muu"][i % 3], int(i % 4 + 3) if i % 50 else None, [None, "Tä", "S+H", "Mr/Ka", "Sa"][i % 5], "bad" if u < 0.1 else f"{u * 50:.1f}", str(round(u * 60, 1)), *[float(x) for x in h], float(np.exp(1 + 0.3 * np.log1p(h[0]) + rng.normal(0, 0.1)) - 1)))
    return spark.createDataFrame(rows, "id bigint, type string, Species int, soil string, noise17d string, noise22d string, H15 double, H17 double, H21 double, H23 double, Ann_15_17 double")


def test_panel(spark):
    p = panel.long_panel(carbon(spark), "id").cache()
    assert {r.Period for r in p.select("Period").distinct().collect()} == {"15_17"} and p.count() == 1000
    filled = panel.median_filled(p)
    assert filled.where("avg_radiation != 0 or avg_noise_day is null").count() == 0  # absent column: median 0
    g = panel.with_pooled(filled)
    gate = {(r.grp, r.variable) for r in panel.feature_gate(g).collect()}
    assert {k for k, _ in gate} == {panel.POOLED} and (panel.POOLED, "avg_radiation") not in gate and (panel.POOLED, "type_Puisto") in gate
    s = panel.standardised(g, ["Log_Initial_H"]).groupBy("grp").agg(F.avg("Log_Initial_H").alias("m"), F.stddev_pop("Log_Initial_H").alias("d")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.d - 1) < 1e-9 for r in s)
    c = {r.Variable: r for r in growth_models.coefficient_table(g).collect()}
    x = np.array([[r.Log_Initial_H, r[panel.TARGET]] for r in p.collect()])
    assert c["Log_Initial_H"].Coef == pytest.approx(0.3 * x[:, 0].std(), rel=0.1) and c["Log_Initial_H"].Label == "* * *"
    perf = growth_models.performance(g.withColumn("o", F.col("id")), "o").collect()
    assert len(perf) == 1 and perf[0].R2 > 0.5 and perf[0].N_Samples == 1000
    tile = growth_models.tile_matrix(growth_models.coefficient_table(g)).collect()
    assert {r.row for r in tile} == {0} and any(r.variable == "Height (Log)" for r in tile)
    assert panel.long_panel(carbon(spark).drop("Ann_15_17"), "id").count() == 0


def test_split_errors_from_moments(spark):
    p = panel.with_pooled(panel.median_filled(panel.long_panel(carbon(spark), "id"))).where(F.col("grp") == panel.POOLED)
    perf = growth_models.performance(p, "id").first()
    rows = sorted(p.withColumn("type_Puisto", (F.col("type") == "Puisto").cast("int")).collect(), key=lambda r: r.id)
    gate = [r.variable for r in panel.feature_gate(p).collect()]
    x = np.array([[1.0, *[float(r[f]) for f in gate]] for r in rows])
    y = np.array([r[panel.TARGET] for r in rows])
    b = np.linalg.lstsq(x[200:], y[200:], rcond=None)[0]
    e = y[:200] - x[:200] @ b
    assert perf.RMSE == pytest.approx(np.sqrt(np.mean(e**2))) and perf.R2 == pytest.approx(1 - (e**2).sum() / ((y[:200] - y[:200].mean()) ** 2).sum())


def test_labels(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.001, 0.01, 0.05, float("nan"), None)], "p double")
    assert [r[0] for r in df.select(significance_label(F.col("p"))).collect()] == ["* * *", "* *", "*", "ns", "ns", "ns"]
    v = spark.createDataFrame([("type_Puisto",), ("soil_has_infill",), ("Log_Initial_H",), ("Density25",), ("Mono_Rate",), ("avg_svf",)], "v string")
    assert [r[0] for r in v.select(display_name(F.col("v"))).collect()] == ["Puisto", "infill", "Height (Log)", "Density (25m)", "Biotic Rate", "avg_svf"]
    s = spark.createDataFrame([("Tä/S+H",), ("Mr, KA",), (None,)], "soil string").select(*soil_flags(F.col("soil")).values()).collect()
    assert [tuple(r) for r in s] == [(1, 1, 0, 0, 0), (0, 0, 0, 1, 1), (0, 0, 0, 0, 0)]


def test_forest(spark, data, tmp_path):
    d = data.where("g != 'c'")
    cv = {r.g: r for r in forest_cv(d, "g", ["x", "z"], "y", "id", trees=5, depth=4, folds=2).collect()}
    assert cv["a"].r2 > 0.5 and cv["a"].n == len(group(data, "a")[1])
    imp = {r.g: r.importances for r in forest_importances(d, "g", ["x", "z"], "y", trees=5, depth=4).collect()}
    assert imp["a"]["x"] > imp["a"]["z"] and sum(imp["a"].values()) == pytest.approx(1)
    own = regression.complete(d, ["x", "z", "y"])
    m = forest(["x", "z"], "y", 3, 3).fit(own)
    again = load_forest(save_forest(m, str(tmp_path), "a_both_rf"))
    assert again.transform(own).agg(F.sum("pred")).first() == m.transform(own).agg(F.sum("pred")).first()


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    assert read_or_none(spark, str(tmp_path / "no"), df.schema) is None
    assert with_optional(df, {"x": "double", "y": "double"}).dtypes == [("x", "int"), ("s", "string"), ("y", "double")]
    assert keep_present(df, ["s", "q", "x"]).columns == ["s", "x"]
    with pytest.raises(ValueError, match="q"):
        require(df, ["x", "q"])


def test_linear_models_stored(spark, rows, tmp_path):
    m = spark.createDataFrame([("a", "Height", 0, 0.1, 0.5, None, 0.9), ("b", "Crown", 1, 0.2, None, 0.3, None)], "species string, features string, seq int, c0 double, c_height double, c_crown double, r2 double")
    save_linear(m, f"{tmp_path}/linear")
    assert rows(load_linear(spark, f"{tmp_path}/linear")) == rows(m.drop("seq", "r2"))


def test_copied_if_absent(spark, rows):
    df = spark.createDataFrame([(1.0, 2.0)], "H15 double, x double")
    assert rows(copied_if_absent(df, {"Initial_H": "H15", "x": "H15"})) == [(1.0, 2.0, 1.0)]


def test_status_of_every_group(spark):
    rng = np.random.default_rng(4)
    features = [f for f in growth_models.EVERY if f != "type_Puisto"]
    data = []
    for grp, n, kind in (("small", 20, ""), ("same", 60, "constant"), ("twice", 60, "copy"), ("fine", 60, "")):
        for _ in range(n):
            x = [1.0] * len(features) if kind == "constant" else [float(v) for v in rng.normal(5, 1, len(features))]
            if kind == "copy":
                x[1] = x[0]
            data.append((grp, "Katu", *x, float(rng.normal())))
    g = spark.createDataFrame(data, f"grp string, type string, {', '.join(f'{f} double' for f in features)}, {growth_models.TARGET} double")
    status = {r.Species: (r.N, r.Status) for r in growth_models.fit_status(g, 0, 40).collect()}
    assert status == {"small": (20, "too few rows"), "same": (60, "degenerate"), "twice": (60, "singular"), "fine": (60, "ok")}


def test_tile_texts(spark):
    c = spark.createDataFrame([("Acer", "Log_Initial_H", 0.125, 0.001, "* *", 0.505, 900), ("Acer", "type_Puisto", -1.75, 0.5, "ns", 0.505, 900)], "Species string, Variable string, Coef double, P_Value double, Label string, R2 double, N bigint")
    t = {r.variable: r for r in growth_models.tile_matrix(c).collect()}
    assert (t["Height (Log)"].coef_text, t["Puisto"].coef_text, t["Puisto"].shade, t["Puisto"].text_colour) == (f"{0.125:.2f}", "-1.75", -1.0, "white")
    assert t["Puisto"].species_label == f"Acer\n(N=900, R²={0.505:.2f})"
    w = growth_models.tile_wide(c, ["Log_Initial_H", "type_Puisto", "Mono_Rate"]).first()
    assert (w.Log_Initial_H_coef, w.Log_Initial_H_label, w.type_Puisto_label, w.Mono_Rate_coef) == (0.125, "* *", "ns", None)
    assert [r.label for r in growth_models.tile_legend(spark).orderBy("position").collect()] == ["* * *", "* *", "*", "ns"]


def test_held_out_forest_like_spark_ml(spark):
    rng = np.random.default_rng(12)
    n = 900
    x, z, noise = rng.uniform(0, 10, n), rng.uniform(0, 5, n), rng.uniform(0, 1, n)
    y = np.where((x > 3) ^ (z > 2), 5.0, 1.0) + 0.1 * x + rng.normal(0, 0.3, n)
    g = spark.createDataFrame([("a", i, bool(i % 5 == 0), *map(float, r)) for i, r in enumerate(zip(x, z, noise, y))] + [("b", 1, False, 1.0, 1.0, 1.0, 2.0), ("b", 2, True, 1.0, 2.0, 2.0, 3.0), ("b", 3, False, None, 2.0, 2.0, 3.0), ("c", 1, True, 1.0, 1.0, 1.0, 1.0)], "grp string, k bigint, test boolean, x double, z double, noise double, y double").cache()
    score = lambda p: p.where("grp = 'a'").agg(regression.scores("pred", "y")[1]).first()[0]
    run = lambda shares: held_out(g, "grp", "k", ["x", "z", "noise"], "y", "test", {"a": ["x", "z"], "b": [], "d": ["x"]}, 40, 30, shares)
    own = g.where("grp = 'a'")
    spark_ml = score(forest(["x", "z"], "y", 40, 30).fit(own.where("not test")).transform(own.where("test")))
    whole = run(50_000)
    assert score(whole) == pytest.approx(spark_ml, abs=0.03) and spark_ml > 0.8
    assert score(run(300)) == pytest.approx(spark_ml, abs=0.1)
    got = whole.collect()
    assert len(got) == 181 and {(r.grp, r.k): r.pred for r in got}["b", 2] == 2.0
    assert held_out(g.limit(0), "grp", "k", ["x"], "y", "test", {"a": ["x"]}).count() == 0 and held_out(g, "grp", "k", ["x"], "y", "test", {}).count() == 0
