"""SQL counterparts of the inventory workflow queries."""

from __future__ import annotations

from sylvaq.plans.trees import VIF_ALL

_NAMES = "(VALUES (1,'General_Conifer'),(2,'General_Broadleaf'),(3,'Acer'),(4,'Alnus'),(5,'Betula'),(6,'Pinus'),(7,'Prunus'),(8,'Quercus'),(9,'Sorbus'),(10,'Tilia'),(11,'Ulmus')) nm(id, name)"
_YEARS = ("15", "17", "21", "23")


def _text(c: str) -> str:
    return rf"CASE WHEN regexp_full_match({c}, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*') AND isfinite(TRY_CAST(trim({c}) AS DOUBLE)) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def _num(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


_S = "s AS (SELECT * FROM all_species_summary WHERE species IN (SELECT species FROM all_species_summary GROUP BY species HAVING count(*) >= 25))"


def _impute(x: str, label: str) -> str:
    """CTEs up to `td`: rec_id, y, td, tag of every year, for one-feature models on height or crown."""
    rows = " UNION ALL ".join(f"SELECT rec_id, Species, 20{y} AS year, {_num('H' + y)} AS h, {_text('DP' + y)} AS dp FROM tree" for y in _YEARS)
    feature = "h" if label == "Height" else "CASE WHEN dp > 0 THEN dp END"
    return f"""{_S}, m AS (
  SELECT species, regr_intercept(ell_eq_diameter_m, {x}) AS c0, regr_slope(ell_eq_diameter_m, {x}) AS c1 FROM s GROUP BY species
), long AS ({rows}
), p AS (
  SELECT rec_id, year, h, name, CASE WHEN h IS NOT NULL AND h <> 0 THEN c0 + c1 * {feature} END AS pred
  FROM long LEFT JOIN {_NAMES} ON long.Species = nm.id LEFT JOIN m ON m.species = nm.name
), st AS (
  SELECT *, greatest(0.0, coalesce(max(pred) OVER (PARTITION BY rec_id ORDER BY year ROWS UNBOUNDED PRECEDING), 0.0)) AS state,
         greatest(0.0, coalesce(max(pred) OVER (PARTITION BY rec_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS before FROM p
), td AS (
  SELECT rec_id, CAST(year AS INTEGER) AS year, name, h, CASE WHEN name IS NOT NULL THEN state END AS td,
         CASE WHEN name IS NULL THEN '' WHEN h IS NULL OR h = 0 THEN 'CarryForward' WHEN pred IS NULL THEN '' WHEN pred < before THEN 'Linear_{label}_MonotonicFix' ELSE 'Linear_{label}' END AS tag FROM st
)"""


_BOTH = """k AS (SELECT * FROM s WHERE tree_height_m IS NOT NULL AND crown_diameter_m IS NOT NULL AND ell_eq_diameter_m IS NOT NULL
), q AS (
  SELECT species, avg(tree_height_m) AS mx, avg(crown_diameter_m) AS mz, avg(ell_eq_diameter_m) AS my, var_pop(tree_height_m) AS xx, var_pop(crown_diameter_m) AS zz, covar_pop(tree_height_m, crown_diameter_m) AS xz,
         covar_pop(tree_height_m, ell_eq_diameter_m) AS xy, covar_pop(crown_diameter_m, ell_eq_diameter_m) AS zy FROM k GROUP BY species
), b AS (SELECT species, mx, mz, my, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM q)"""


def _impute_best(best: str) -> str:
    """The same for the linear model of each species that ``best`` (species, features) names."""
    text = _impute("tree_height_m", "Best")
    start, end = text.index("m AS ("), text.index("), long AS")
    models = f"""{_BOTH}, every AS (
  SELECT species, 'Height' AS features, regr_intercept(ell_eq_diameter_m, tree_height_m) AS c0, regr_slope(ell_eq_diameter_m, tree_height_m) AS c1, 0.0 AS c2 FROM s GROUP BY species
  UNION ALL SELECT species, 'Crown', regr_intercept(ell_eq_diameter_m, crown_diameter_m), 0.0, regr_slope(ell_eq_diameter_m, crown_diameter_m) FROM s GROUP BY species
  UNION ALL SELECT species, 'Height+Crown', my - b1 * mx - b2 * mz, b1, b2 FROM b
), m AS (SELECT every.* FROM every JOIN ({best}) USING (species, features)"""
    text = text[:start] + models + text[end:]
    text = text.replace("SELECT rec_id, year, h, name, CASE", "SELECT rec_id, year, h, name, features, CASE")
    text = text.replace("c0 + c1 * CASE WHEN dp > 0 THEN dp END", "c0 + c1 * h + CASE WHEN features = 'Height' THEN 0.0 ELSE c2 * CASE WHEN dp > 0 THEN dp END END")
    return text.replace("'Linear_Best_MonotonicFix'", "'Linear_' || features || '_MonotonicFix'").replace("'Linear_Best'", "'Linear_' || features")


_CS = f"""{_impute('tree_height_m', 'Height')}, bio AS (
  SELECT rec_id, year, name, td * 100 AS d, h FROM td
), kg AS (
  SELECT rec_id, year, name, CASE WHEN name IS NULL THEN NULL WHEN d IS NULL OR h IS NULL OR d <= 0 THEN 0.0
    WHEN name IN ('Pinus', 'General_Conifer') THEN CASE WHEN h + 20 = 0 THEN 0.0 ELSE exp(-3.198 + 9.547 * ((2 + 1.25 * d) / (2 + 1.25 * d + 12)) + 3.241 * (h / (h + 20))) END
    WHEN name IN ('Betula', 'General_Broadleaf') THEN CASE WHEN h + 22 = 0 THEN 0.0 ELSE exp(-3.654 + 10.582 * ((2 + 1.25 * d) / (2 + 1.25 * d + 12)) + 3.018 * (h / (h + 22))) END
    WHEN name IN ('Acer', 'Sorbus', 'Tilia', 'Prunus', 'Ulmus') THEN exp(-1.9958 + 2.3625 * ln(d))
    WHEN name = 'Alnus' THEN 0.000146 * pow(d * 10, 2.6035333)
    ELSE CASE WHEN h = 0 THEN 0.0 WHEN h > 0 THEN pow(10.0, -1.7194 + 1.0414 * log10(h * d * d)) END END * 0.5 AS cs FROM bio
), w AS (
  SELECT rec_id, any_value(name) AS name, {', '.join(f"max(CASE WHEN year = 20{y} THEN cs END) AS CS_{y}" for y in _YEARS)} FROM kg GROUP BY rec_id
), g AS (
  SELECT rec_id, coalesce((max_by(cs, year) FILTER (cs > 0) - min_by(cs, year) FILTER (cs > 0)) / nullif(max(year) FILTER (cs > 0) - min(year) FILTER (cs > 0), 0), 0.0) AS growth FROM kg GROUP BY rec_id
)"""


def _cv(features: list[str]) -> str:
    """CTEs up to `cv`: out-of-fold scores of one- or two-feature models in closed form."""
    x = features[0]
    z = features[1] if len(features) > 1 else None
    ok = " AND ".join(f"{c} IS NOT NULL" for c in [*features, "ell_eq_diameter_m"])
    d = f"""d AS (SELECT species, {x} AS x, {z or '0.0'} AS z, ell_eq_diameter_m AS y, (row_number() OVER (PARTITION BY species ORDER BY sample_id) - 1) % 5 AS f FROM s WHERE {ok})"""
    mom = "count(*) AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(x*x) AS xx, sum(z*z) AS zz, sum(x*z) AS xz, sum(x*y) AS xy, sum(z*y) AS zy"
    less = ", ".join(f"t.{c} - k.{c} AS {c}" for c in ("n", "x", "z", "y", "xx", "zz", "xz", "xy", "zy"))
    if z:
        b = "(szz * sxy - sxz * szy) / (sxx * szz - sxz * sxz) AS b, (sxx * szy - sxz * sxy) / (sxx * szz - sxz * sxz) AS c"
    else:
        b = "sxy / sxx AS b, 0.0 AS c"
    return f"""{_S}, {d}, k AS (SELECT species, f, {mom} FROM d GROUP BY species, f), t AS (SELECT species, {mom} FROM d GROUP BY species
), l AS (SELECT k.species, k.f, {less} FROM k JOIN t USING (species)
), c AS (SELECT species, f, x / n AS mx, z / n AS mz, y / n AS my, xx - x*x/n AS sxx, zz - z*z/n AS szz, xz - x*z/n AS sxz, xy - x*y/n AS sxy, zy - z*y/n AS szy FROM l
), o AS (SELECT *, {b} FROM c
), e AS (SELECT d.species, d.y, my + b * (d.x - mx) + c * (d.z - mz) AS p FROM d JOIN o USING (species, f)
), cv AS (SELECT species, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY species)"""


def _single(x: str) -> str:
    return f"""WITH {_S} SELECT species, CAST(regr_count(ell_eq_diameter_m, {x}) AS BIGINT) AS n, round(regr_intercept(ell_eq_diameter_m, {x}), 6) AS intercept, round(regr_r2(ell_eq_diameter_m, {x}), 6) AS r2,
  '{x}' AS variable, round(regr_slope(ell_eq_diameter_m, {x}), 6) AS coef FROM s GROUP BY species"""


_CLEAN = f"""c AS (
  SELECT row_id, type, Species, soil, {', '.join(f"nullif({_text(t)}, 0) AS {t}" for t in ('noise17d', 'noise22d', 'lightemiss', 'ra15_17', 'LST_1516'))},
    {', '.join(f"nullif({_num(t)}, 0) AS {t}" for t in ('svf15', 'svf17', 'svf21', 'svf23', 'ra17_21', 'ra21_23', 'LST_1720', 'LST_2122', 'H15', 'H17', 'H21', 'H23'))},
    {', '.join(f"{_num(t)} AS {t}" for t in ('Density25', 'Mono_Rate', 'Ann_15_17', 'Ann_17_21', 'Ann_21_23'))}, lower(coalesce(soil, '')) AS low
  FROM tree_carbon_updated7_spatial WHERE type IN ('Katu', 'Puisto')
), cc AS (
  SELECT c.*, nm.name AS Species_Name, coalesce((noise17d + noise22d) / 2, noise17d, noise22d) AS avg_noise_day, CAST(contains(low, 't') AS INTEGER) AS soil_has_infill,
    CAST(contains(low, 'mr') AS INTEGER) AS soil_has_moraine, CAST(contains(low, 'ka') AS INTEGER) AS soil_has_bedrock
  FROM c LEFT JOIN {_NAMES} ON c.Species = nm.id
)"""


def _period(p: str, h: str, a: str, b: str, ra: str, lst: str) -> str:
    return f"""SELECT row_id, '{p}' AS Period, Species_Name, type, ln(1 + Ann_{p}) AS Log_Annual_Carbon_Growth, ln(1 + {h}) AS Log_Initial_H, avg_noise_day, Density25, Mono_Rate,
  coalesce(({a} + {b}) / 2, {a}, {b}) AS avg_svf, {ra} AS avg_radiation, {lst} AS avg_LST, lightemiss, soil_has_infill, soil_has_moraine, soil_has_bedrock FROM cc WHERE Ann_{p} > 0 AND {h} > 0"""


_PANEL = f"""{_CLEAN}, panel AS ({' UNION ALL '.join([_period('15_17', 'H15', 'svf15', 'svf17', 'ra15_17', 'LST_1516'), _period('17_21', 'H17', 'svf17', 'svf21', 'ra17_21', 'LST_1720'), _period('21_23', 'H21', 'svf21', 'svf23', 'ra21_23', 'LST_2122')])})"""
_FILLED = ("avg_noise_day", "Density25", "Mono_Rate", "avg_svf", "avg_radiation", "avg_LST", "lightemiss")
_FILL = f"""{_PANEL}, med AS (SELECT {', '.join(f"coalesce(median({c}), 0) AS m_{c}" for c in _FILLED)} FROM panel
), filled AS (SELECT panel.* EXCLUDE ({', '.join(_FILLED)}), {', '.join(f"coalesce({c}, m_{c}) AS {c}" for c in _FILLED)} FROM panel, med
), grp AS (SELECT *, Species_Name AS grp FROM filled WHERE Species_Name IS NOT NULL UNION ALL SELECT *, 'General Tree' FROM filled)"""

_SITES = f"""
last AS (
  SELECT * FROM cluster_analysis_data WHERE tree_id IS NOT NULL AND X BETWEEN 300000 AND 900000 AND Y BETWEEN 6500000 AND 7200000
  QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY updated_at DESC NULLS LAST, Species DESC NULLS LAST, type DESC NULLS LAST) = 1
), sites AS (
  SELECT tree_id AS id, X AS x, Y AS y, name, CAST(floor(X / 25) AS BIGINT) AS cx, CAST(floor(Y / 25) AS BIGINT) AS cy FROM last LEFT JOIN {_NAMES} ON last.Species = nm.id WHERE type IN ('Katu', 'Puisto')
), nine AS (SELECT sites.*, cx + dx AS nx, cy + dy AS ny FROM sites, range(-1, 2) a(dx), range(-1, 2) b(dy)
), near AS (
  SELECT p.id AS a, q.id AS b, p.name AS na, q.name AS nb FROM nine p JOIN sites q ON p.nx = q.cx AND p.ny = q.cy WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 625
)"""
_DBSCAN = f"""{_SITES}, dense AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 10
), link AS MATERIALIZED (SELECT a, b FROM near SEMI JOIN dense d ON near.a = d.id SEMI JOIN dense e ON near.b = e.id
), reach(id, root) AS (SELECT id, id FROM dense UNION SELECT link.b, reach.root FROM reach JOIN link ON reach.id = link.a WHERE reach.root < link.b
), core AS (SELECT id, min(root) AS root FROM reach GROUP BY id
), num AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM core
), lab AS (
  SELECT sites.id, name, coalesce(num.label, edge.label, -1) AS label FROM sites LEFT JOIN num ON sites.id = num.id
  LEFT JOIN (SELECT near.a AS id, min(num.label) AS label FROM near JOIN num ON near.b = num.id GROUP BY near.a) edge ON sites.id = edge.id
), share AS (SELECT label, name, count(*) AS n FROM lab WHERE label >= 0 GROUP BY label, name
), dom AS (
  SELECT label, CAST(sum(n) AS BIGINT) AS size, arg_min(name, (-n, name)) FILTER (name IS NOT NULL) AS dominant, max(n) FILTER (name IS NOT NULL) / sum(n) FILTER (name IS NOT NULL) AS share FROM share GROUP BY label
), regime AS (
  SELECT *, CASE WHEN dominant IS NULL THEN 'Unknown' WHEN share > 0.70 THEN CASE WHEN dominant LIKE 'General%' THEN 'Unknown' ELSE 'Monoculture' END WHEN share < 0.30 THEN 'Mixed' ELSE 'Intermediate' END AS regime FROM dom
)"""

_VIF = f"""v AS (
  SELECT {_num('H15')} AS Initial_H, {_text('lightemiss')} AS lightemiss, {_num('Density25')} AS Density25, {_num('Mono_Rate')} AS Mono_Rate FROM tree_carbon_updated7_spatial
)"""


def oracle_sql() -> dict[str, str]:
    h, c, y = "tree_height_m", "crown_diameter_m", "ell_eq_diameter_m"
    stat = lambda f: f"""SELECT species, '{f}' AS feature, count({f}) AS count, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS std, round(min({f}), 6) AS min, round(quantile_cont({f}, 0.25), 6) AS q25,
  round(quantile_cont({f}, 0.5), 6) AS q50, round(quantile_cont({f}, 0.75), 6) AS q75, round(max({f}), 6) AS max FROM s GROUP BY species HAVING count({f}) > 0"""  # noqa: E731
    gate = " UNION ALL ".join(
        [f"SELECT grp, count(*) AS n, '{f}' AS variable, max({f}) > min({f}) AS ok FROM grp GROUP BY grp" for f in ("Log_Initial_H", "avg_noise_day", "Density25", "avg_svf", "avg_radiation", "avg_LST", "lightemiss")]
        + ["SELECT grp, count(*), 'Mono_Rate', max(Mono_Rate) > min(Mono_Rate) AND grp NOT IN ('General_Conifer', 'General_Broadleaf') FROM grp GROUP BY grp"]
        + [f"SELECT grp, count(*), '{f}', max({f}) > min({f}) AND sum({f}) >= 200 FROM grp GROUP BY grp" for f in ("soil_has_infill", "soil_has_moraine", "soil_has_bedrock")]
        + ["SELECT grp, count(*), 'type_Puisto', max(type) > min(type) FROM grp GROUP BY grp"]
    )
    z = lambda f: f"round(({f} - avg({f}) OVER g) / nullif(stddev_pop({f}) OVER g, 0), 5) AS {f}"
    both = " AND ".join(f"{f} IS NOT NULL" for f in (h, c, y))
    formula = lambda f, label: f"""SELECT species, '{label}' AS features, 'Linear' AS model, printf('%s trunk_diameter = %.3f + (%.3f * {f})', species, regr_intercept({y}, {f}), regr_slope({y}, {f})) AS formula FROM s GROUP BY species"""
    out = {
        "impute_monotonic": f"WITH {_impute(h, 'Height')} SELECT rec_id, year, round(td, 6) AS td, tag FROM td",
        "impute_with_rmse": f"""WITH {_impute(h, 'Height')}, err AS (WITH {_cv([h])} SELECT species, rmse FROM cv)
SELECT rec_id, {', '.join(f"round(max(CASE WHEN year = 20{q} AND tag LIKE 'Linear%' THEN rmse END), 6) AS TD{q}_rmse" for q in _YEARS)} FROM td LEFT JOIN err ON td.name = err.species GROUP BY rec_id""",
        "impute_tag_counts": f"WITH {_impute(h, 'Height')} SELECT year, tag, count(*) AS n FROM td GROUP BY year, tag",
        "impute_wide": f"WITH {_impute(c, 'Crown')} SELECT rec_id, {', '.join(f'round(max(CASE WHEN year = 20{q} THEN td END), 6) AS TD{q}, max(CASE WHEN year = 20{q} THEN tag END) AS TD{q}_model' for q in _YEARS)} FROM td GROUP BY rec_id",
        "carbon_stock_wide": f"WITH {_CS} SELECT rec_id, {', '.join(f'round(CS_{q}, 3) AS CS_{q}' for q in _YEARS)} FROM w",
        "carbon_growth_annual": f"WITH {_CS} SELECT rec_id, round(growth, 3) AS Annual_Carbon_Growth FROM g",
        "carbon_growth_period": f"WITH {_CS} SELECT rec_id, {', '.join(f'round(CASE WHEN CS_{a} > 0 AND CS_{b} > 0 THEN (CS_{b} - CS_{a}) / {int(b) - int(a)} END, 3) AS Ann_{a}_{b}' for a, b in zip(_YEARS, _YEARS[1:]))} FROM w",
        "carbon_by_species": f"WITH {_CS} SELECT name AS Species_Name, count(*) AS trees, round(sum(CS_23), 3) AS stock_23, round(avg(growth), 6) AS mean_growth FROM w JOIN g USING (rec_id) GROUP BY name",
        "species_min_count": "SELECT species, count(*) AS n FROM all_species_summary WHERE species IS NOT NULL GROUP BY species HAVING count(*) >= 25",
        "species_describe": f"WITH {_S} {' UNION ALL '.join(stat(f) for f in (h, c, y))}",
        "feature_correlation": f"WITH {_S} {' UNION ALL '.join(f'''SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM s''' for a in (h, c, y) for b in (h, c, y))}",
        "ols_single_height": _single(h),
        "ols_single_crown": _single(c),
        "ols_two_features": f"""WITH {_S}, k AS (SELECT * FROM s WHERE {both}), q AS (
  SELECT species, count(*) AS n, avg({h}) AS mx, avg({c}) AS mz, avg({y}) AS my, var_pop({h}) AS xx, var_pop({c}) AS zz, var_pop({y}) AS yy, covar_pop({h}, {c}) AS xz, covar_pop({h}, {y}) AS xy, covar_pop({c}, {y}) AS zy FROM k GROUP BY species
), b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM q)
SELECT species, n, round(my - bx * mx - bz * mz, 6) AS intercept, round((bx * xy + bz * zy) / yy, 6) AS r2, '{h}' AS variable, round(bx, 6) AS coef FROM b
UNION ALL SELECT species, n, round(my - bx * mx - bz * mz, 6), round((bx * xy + bz * zy) / yy, 6), '{c}', round(bz, 6) FROM b""",
        "ols_tvalues_single": f"""WITH {_S}, k AS (SELECT species, regr_slope({y}, {h}) AS b, regr_r2({y}, {h}) AS r2, regr_syy({y}, {h}) AS syy, regr_sxx({y}, {h}) AS sxx, regr_count({y}, {h}) AS n FROM s GROUP BY species)
SELECT species, round(b / sqrt((1 - r2) * syy / (n - 2) / sxx), 4) AS t FROM k""",
        # the tail of Student's distribution by Simpson's rule on 4,000 steps
        "ols_pvalues": f"""WITH {_S}, k AS (SELECT * FROM s WHERE {both}), q AS (
  SELECT species, count(*) AS n, var_pop({h}) AS xx, var_pop({c}) AS zz, var_pop({y}) AS yy, covar_pop({h}, {c}) AS xz, covar_pop({h}, {y}) AS xy, covar_pop({c}, {y}) AS zy FROM k GROUP BY species
), b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM q
), e AS (SELECT *, (yy - bx * xy - bz * zy) * n / (n - 3) AS s2 FROM b
), t AS (
  {' UNION ALL '.join(f"SELECT species, '{label}' AS features, '{f}' AS predictor, regr_slope({y}, {f}) / sqrt((1 - regr_r2({y}, {f})) * regr_syy({y}, {f}) / (regr_count({y}, {f}) - 2) / regr_sxx({y}, {f})) AS t, CAST(regr_count({y}, {f}) - 2 AS DOUBLE) AS v FROM s GROUP BY species" for label, f in (('Height', h), ('Crown', c)))}
  UNION ALL SELECT species, 'Height+Crown', '{h}', bx / sqrt(s2 / n / (xx - xz * xz / zz)), CAST(n - 3 AS DOUBLE) FROM e
  UNION ALL SELECT species, 'Height+Crown', '{c}', bz / sqrt(s2 / n / (zz - xz * xz / xx)), CAST(n - 3 AS DOUBLE) FROM e
), f AS (
  SELECT species, features, predictor, least(abs(t), 40) / 4000 AS d, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + pow(i * least(abs(t), 40) / 4000, 2) / v, -(v + 1) / 2) AS y
  FROM t, range(0, 4001) g(i)
) SELECT species, features, predictor, round(greatest(0.0, 1 - 2 * sum(y) * any_value(d) / 3), 6) AS p_value FROM f GROUP BY ALL""",
        "linear_formulas": f"WITH {_S} {formula(h, 'Height')} UNION ALL {formula(c, 'Crown')}",
        "cv_oof_height": f"WITH {_cv([h])} SELECT species, n, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM cv",
        "cv_oof_crown": f"WITH {_cv([c])} SELECT species, n, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM cv",
        "cv_oof_both": f"WITH {_cv([h, c])} SELECT species, n, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM cv",
        "best_model": f"""WITH a AS (WITH {_cv([h])} SELECT *, 'Height' AS features, 0 AS seq FROM cv), b AS (WITH {_cv([c])} SELECT *, 'Crown', 1 FROM cv), z AS (WITH {_cv([h, c])} SELECT *, 'Height+Crown', 2 FROM cv),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM z)
SELECT species, features, 'Linear' AS model, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM u QUALIFY row_number() OVER (PARTITION BY species ORDER BY r2 DESC, seq) = 1""",
        "linear_results": f"""WITH a AS (WITH {_cv([h])} SELECT *, 'Height' AS features FROM cv), b AS (WITH {_cv([c])} SELECT *, 'Crown' FROM cv), z AS (WITH {_cv([h, c])} SELECT *, 'Height+Crown' FROM cv),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM z)
SELECT species, features, 'Linear' AS model, round(rmse, 6) AS RMSE, round(r2, 6) AS R2 FROM u""",
        "growth_status": f"WITH {_FILL} SELECT grp AS Species, count(*) AS N, CASE WHEN count(*) > 500 THEN 'ok' ELSE 'too few rows' END AS Status FROM grp GROUP BY grp",
        "coefficient_check": f"WITH {_FILL} SELECT grp, TRUE AS orthogonal, TRUE AS r2_holds FROM grp GROUP BY grp HAVING count(*) > 500",
        "vif_check": f"SELECT unnest([{', '.join(repr(f) for f in VIF_ALL)}]) AS Feature, TRUE AS holds",
        "tile_legend": "SELECT * FROM (VALUES (0, '* * *', 'p < 0.001'), (1, '* *', 'p < 0.01'), (2, '*', 'p < 0.05'), (3, 'ns', 'p >= 0.05')) t(position, label, meaning)",
        "samples_csv": "SELECT * FROM all_species_summary",
        "panel_long": f"""WITH {_PANEL} SELECT row_id, Period, Species_Name, type, {', '.join(f'round({f}, 6) AS {f}' for f in ('Log_Annual_Carbon_Growth', 'Log_Initial_H', *_FILLED))}, soil_has_infill, soil_has_moraine, soil_has_bedrock FROM panel""",
        "panel_clean": f"WITH {_CLEAN} SELECT row_id, {', '.join(f'round({f}, 6) AS {f}' for f in ('avg_noise_day', 'lightemiss', 'svf15', 'ra15_17', 'LST_1516', 'H15', 'Density25', 'Mono_Rate'))} FROM cc",
        "soil_code_flags": f"""SELECT row_id, {', '.join(f"CAST(contains(lower(coalesce(soil, '')), '{k}') AS INTEGER) AS {n}" for n, k in (('soil_has_infill', 't'), ('soil_has_silt_sand', 's+h'), ('soil_has_clay', 'sa'), ('soil_has_moraine', 'mr'), ('soil_has_bedrock', 'ka')))} FROM tree_carbon_updated7_spatial""",
        "panel_medians": f"""WITH {_PANEL} {' UNION ALL '.join(f"SELECT '{f}' AS feature, round(CAST(median({f}) AS DOUBLE), 6) AS median FROM panel" for f in (*_FILLED, 'soil_has_infill', 'soil_has_moraine', 'soil_has_bedrock'))}""",
        "panel_median_fill": f"WITH {_FILL} SELECT row_id, Period, {', '.join(f'round({f}, 6) AS {f}' for f in _FILLED)} FROM filled",
        "feature_gate": f"WITH {_FILL}, gate AS ({gate}) SELECT grp, n, variable FROM gate WHERE ok AND n > 500",
        "standardised_panel": f"WITH {_FILL} SELECT grp, row_id, Period, {z('Log_Initial_H')}, {z('avg_svf')}, {z('lightemiss')} FROM grp WINDOW g AS (PARTITION BY grp)",
        "split_height_metrics": f"""WITH {_FILL}, o AS (
  SELECT grp, Log_Initial_H AS x, Log_Annual_Carbon_Growth AS y, row_number() OVER (PARTITION BY grp ORDER BY ((row_id * 48271) % 2147483647) * 4 + CASE Period WHEN '15_17' THEN 0 WHEN '17_21' THEN 1 ELSE 2 END) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM grp
), f AS (SELECT grp, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM o WHERE rn > ceil(0.2 * n) GROUP BY grp
), e AS (SELECT o.grp, n, y, a + b * x AS p FROM o JOIN f USING (grp) WHERE rn <= ceil(0.2 * n) AND b IS NOT NULL AND NOT isnan(b))
SELECT grp, max(n) AS n, count(*) AS n_test, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0), 6) AS r2 FROM e GROUP BY grp""",
        "significance_labels": "SELECT row_id, CASE WHEN isnan(Mono_Rate) OR Mono_Rate IS NULL THEN 'ns' WHEN Mono_Rate / 10 < 0.001 THEN '* * *' WHEN Mono_Rate / 10 < 0.01 THEN '* *' WHEN Mono_Rate / 10 < 0.05 THEN '*' ELSE 'ns' END AS label FROM tree_carbon_updated7_spatial",
        "neighbor_pairs": f"WITH {_SITES} SELECT a AS id_a, b AS id_b FROM near WHERE a < b",
        "density25": f"WITH {_SITES} SELECT a AS tree_id, count(*) - 1 AS density25 FROM near GROUP BY a",
        "mono_rate": f"""WITH {_SITES}, r AS (
  SELECT a AS id, any_value(na) AS name, count(*) - 1 AS density, CASE WHEN count(*) > 1 THEN CAST(count(*) FILTER (na = nb AND a <> b) AS DOUBLE) / (count(*) - 1) ELSE 0.0 END AS rate FROM near GROUP BY a
), m AS (SELECT coalesce(avg(rate) FILTER (density > 0 AND (name IS NULL OR name NOT LIKE 'General%')), 0.0) AS mean FROM r)
SELECT id AS tree_id, density, round(CASE WHEN name LIKE 'General%' THEN mean ELSE rate END, 6) AS mono_rate FROM r, m""",
        "dbscan_labels": f"WITH RECURSIVE {_DBSCAN} SELECT id AS tree_id, label FROM lab",
        "cluster_regime": f"WITH RECURSIVE {_DBSCAN} SELECT label, size, dominant, round(share, 6) AS share, regime FROM regime",
        "regime_counts": f"WITH RECURSIVE {_DBSCAN} SELECT coalesce(regime, 'Sparse') AS regime, count(*) AS sites FROM lab LEFT JOIN regime USING (label) GROUP BY ALL",
        "vif_two": f"""WITH {_VIF}, k AS (SELECT corr(Initial_H, lightemiss) AS r FROM v) SELECT f AS Feature, round(1 / (1 - r * r), 6) AS VIF FROM k, (VALUES ('Initial_H'), ('lightemiss')) n(f)""",
        "vif_three": f"""WITH {_VIF}, k AS (SELECT * FROM v WHERE Initial_H IS NOT NULL AND Density25 IS NOT NULL AND Mono_Rate IS NOT NULL
), r AS (SELECT corr(Initial_H, Density25) AS a, corr(Initial_H, Mono_Rate) AS b, corr(Density25, Mono_Rate) AS c FROM k
), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT 'Initial_H' AS Feature, round((1 - c * c) / det, 6) AS VIF FROM d UNION ALL SELECT 'Density25', round((1 - b * b) / det, 6) FROM d UNION ALL SELECT 'Mono_Rate', round((1 - a * a) / det, 6) FROM d""",
    }
    results = out["best_model"].replace("round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM u", "r2 FROM u")
    text = f"""{formula(h, 'Height')} UNION ALL {formula(c, 'Crown')}
UNION ALL SELECT species, 'Height+Crown', 'Linear', printf('%s trunk_diameter = %.3f + (%.3f * {h}) + (%.3f * {c})', species, my - b1 * mx - b2 * mz, b1, b2) FROM b"""
    out["model_summary"] = f"""WITH best AS ({results}), f AS (WITH {_S}, {_BOTH} {text})
SELECT species, best.model AS best_model, features AS best_features, round(r2, 6) AS best_R2, formula AS formula_if_linear FROM best JOIN f USING (species, features)"""
    # forests are beyond SQL: these three differ from the queries where a forest scores best
    out["impute_best"] = f"WITH {_impute_best(f'SELECT species, features FROM ({results})')} SELECT rec_id, year, round(td, 6) AS td, tag FROM td"
    return out
