"""Grouped least squares from moments: fits, inference, cross-validation, split metrics, VIF.

One aggregate per call gathers counts, sums and cross products per group (with
map-side partial sums, so a hot group costs no more than any other); the small
systems are solved per row of that aggregate. Columns are shifted by about their means
first to limit cancellation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaq.functions.student import t_two_sided
from sylvaq.operators.ordered import prefix_counts
from sylvaq.ship import ship

#: Share of a feature's variance below which what others leave of it counts as nothing.
SINGULAR = 1e-10
#: Rows from whose means the shifts of the moments are taken.
SHIFT_ROWS = 1000


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NULL or NaN in any of the columns."""
    ok = None
    for c in columns:
        x = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        ok = x if ok is None else ok & x
    return df.where(ok)


def moments(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group, n, shift, s, q): count, shifts, shifted sums and upper cross products of the columns.

    The shifts only limit cancellation, any number near the data would do: they are
    the means of the first SHIFT_ROWS rows, and one pass over all rows follows.
    """
    ship(df.sparkSession)
    some = df.select(*columns).limit(SHIFT_ROWS)
    means = some.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shift = [float(m) if m is not None else 0.0 for m in means]
    v = [F.col(c).cast("double") - F.lit(m) for c, m in zip(columns, shift)]
    k = len(columns)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(v[i]).alias(f"s{i}") for i in range(k)]
    aggs += [F.sum(v[i] * v[j]).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)]
    out = df.groupBy(*group).agg(*aggs)
    return out.select(
        *group, "n", F.array(*[F.lit(m) for m in shift]).alias("shift"),
        F.array(*[F.col(f"s{i}") for i in range(k)]).alias("s"), F.array(*[F.col(f"q{i}_{j}") for i in range(k) for j in range(i, k)]).alias("q"),
    )


class Fit:
    """Least squares of the last column on the others, from moments."""

    def __init__(self, n: float, shift: np.ndarray, s: np.ndarray, q: np.ndarray):
        k = len(s)
        cross = np.zeros((k, k))
        cross[np.triu_indices(k)] = q
        cross = cross + np.triu(cross, 1).T
        self.n, self.mean = n, shift + s / max(n, 1)
        cov = cross - np.outer(s, s) / max(n, 1)
        self.var = np.diag(cov)
        scale = np.abs(np.diag(cross)) + 1e-300
        self.used = [i for i in range(k - 1) if self.var[i] > 1e-12 * scale[i]]  # constant features take no part
        self.status = "ok"
        self.coef = np.full(k - 1, np.nan)
        self.t = np.full(k - 1, np.nan)
        self.p = np.full(k - 1, np.nan)
        self.intercept = self.r2 = self.p0 = np.nan
        if not self.used or n < 2:
            self.status = "degenerate"
            return
        sd = np.sqrt(self.var[self.used])
        r = cov[np.ix_(self.used, self.used)] / np.outer(sd, sd)
        eigen, axes = np.linalg.eigh(r)
        live = eigen > SINGULAR
        rank = int(live.sum())
        dof = n - rank - 1
        if dof < 0:
            self.status = "degenerate"
            return
        if rank < len(self.used):
            self.status = "singular"
        inv = (axes[:, live] / eigen[live]) @ axes[:, live].T / np.outer(sd, sd)
        xy = cov[self.used, -1]
        beta = inv @ xy
        sse = max(0.0, float(self.var[-1] - beta @ xy))
        self.coef[self.used] = beta
        centre = self.mean[self.used]
        self.intercept = float(self.mean[-1] - beta @ centre)
        self.r2 = 1 - sse / self.var[-1] if self.var[-1] > 0 else np.nan
        if dof > 0:
            s2 = sse / dof
            with np.errstate(divide="ignore", invalid="ignore"):
                self.t[self.used] = beta / np.sqrt(s2 * np.diag(inv))
                t0 = self.intercept / np.sqrt(s2 * (1 / n + centre @ inv @ centre))
            self.p[self.used] = [t_two_sided(float(x), dof) for x in self.t[self.used]]
            self.p0 = t_two_sided(float(t0), dof)


def _fit(row: dict) -> Fit:
    return Fit(row["n"], np.array(row["shift"]), np.array(row["s"], float), np.array(row["q"], float))


def ols(df: DataFrame, group: list[str], features: list[str], target: str) -> DataFrame:
    """(group, n, status, intercept, r2, variable, coef, t, p): one row per group and feature.

    Rows with a missing feature or target are left out. ``status``: 'ok',
    'degenerate' (no varying feature or too few rows), then with NULL coefficients, or
    'singular' (features that determine each other), then with the solution of least
    norm in standardised features; constant features have NULL coefficients and take
    no part.
    """
    m = moments(complete(df, [*features, target]), group, [*features, target])
    head = m.select(*group).schema
    names = [f.name for f in head.fields]
    from pyspark.sql import types as T

    schema = T.StructType([*head.fields, T.StructField("n", T.LongType()), T.StructField("status", T.StringType())])
    for c in ("intercept", "r2"):
        schema = schema.add(c, "double")
    schema = schema.add("variable", "string")
    for c in ("coef", "t", "p"):
        schema = schema.add(c, "double")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for row in pdf.to_dict("records"):
                f = _fit(row)
                own = [row[g] for g in names]
                none = lambda x: None if x is None or np.isnan(x) else float(x)
                for i, v in enumerate(features):
                    rows.append([*own, row["n"], f.status, none(f.intercept), none(f.r2), v, none(f.coef[i]), none(f.t[i]), none(f.p[i])])
            yield pd.DataFrame(rows, columns=schema.names).astype({"n": "int64"} if rows else {})

    return m.mapInPandas(run, schema)


def linear_models(df: DataFrame, species: str, feature_sets: dict[str, list[str]], target: str) -> DataFrame:
    """(species, features, seq, c0, c_height, c_crown, r2) of every species and feature set, for impute_diameters.

    ``sources.models`` stores and loads such a table.
    """
    out = None
    for seq, (label, fs) in enumerate(feature_sets.items()):
        fit = ols(df, [species], fs, target).where(F.col("status") == "ok")
        pick = lambda f: F.max(F.when(F.col("variable") == f, F.col("coef")))
        one = fit.groupBy(F.col(species).alias("species")).agg(
            F.lit(label).alias("features"), F.lit(seq).alias("seq"), F.max("intercept").alias("c0"),
            pick("tree_height_m").alias("c_height"), pick("crown_diameter_m").alias("c_crown"), F.max("r2").alias("r2"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def row_numbers(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, order, rn, size): exact row numbers per group in the order of a unique column.

    By range sort and prefix counts, so a large group is numbered by many tasks.
    """
    ranked = prefix_counts(df.select(*group, order, F.lit(1).cast("bigint").alias("one")), group, order, ["one"])
    return ranked.select(*group, order, F.col("one_upto").alias("rn"), F.col("one_all").alias("size"))


def _predict(features: list[str]) -> Column:
    p = F.col("c")[0]
    for i, f in enumerate(features):
        p = p + F.coalesce(F.col("c")[i + 1] * F.col(f).cast("double"), F.lit(0.0))
    return p


def scores(pred: str, target: str) -> tuple[Column, Column]:
    """RMSE and R2 aggregates over the evaluated rows; R2 NULL for a constant target."""
    e = F.col(target) - F.col(pred)
    sse = F.sum(e * e)
    return F.sqrt(F.avg(e * e)), 1 - F.try_divide(sse, F.var_pop(target) * F.count(target))


def cross_validate(df: DataFrame, group: str, features: list[str], target: str, key: str, folds: int = 5) -> DataFrame:
    """(group, n, rmse, r2): out-of-fold prediction of linear models, pooled over all rows.

    Folds take turns in the order of ``key`` (unique). Moments are gathered per
    group and fold once; the model that predicts a fold is solved from the total
    less that fold, so all models cost one pass. Groups without a model have no row.
    """
    d = complete(df, [*features, target]).where(F.col(group).isNotNull())
    d = d.select(group, key, *features, target).join(row_numbers(d, [group], key).drop("size"), [group, key])
    d = d.withColumn("fold", ((F.col("rn") - 1) % folds).cast("int"))
    m = moments(d, [group, "fold"], [*features, target])
    kind = df.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s, q = pdf["n"].sum(), np.sum(np.stack(pdf["s"]), 0), np.sum(np.stack(pdf["q"]), 0)
        rows = []
        for r in pdf.to_dict("records"):
            f = Fit(n - r["n"], np.array(r["shift"]), s - np.array(r["s"]), q - np.array(r["q"]))
            if f.status == "ok":
                rows.append([r[group], r["fold"], [f.intercept, *f.coef]])
        return pd.DataFrame(rows, columns=[group, "fold", "c"])

    # at most ``folds`` rows of sums per group meet here
    models = m.groupBy(group).applyInPandas(run, f"{group} {kind}, fold int, c array<double>")
    p = d.join(models, [group, "fold"]).withColumn("pred", _predict(features))
    rmse, r2 = scores("pred", target)
    return p.groupBy(group).agg(F.count(F.lit(1)).alias("n"), rmse.alias("rmse"), r2.alias("r2"))


def split_metrics(df: DataFrame, group: str, features: list[str], target: str, order: str, share: float = 0.2) -> DataFrame:
    """(group, n, n_test, rmse, r2): linear model fitted on the rest, judged on the first ceil(share * n) rows
    of each group in the order of the unique column ``order``."""
    d = complete(df, [*features, target]).where(F.col(group).isNotNull())
    d = d.select(group, order, *features, target).join(row_numbers(d, [group], order), [group, order])
    d = d.withColumn("test", F.col("rn") <= F.ceil(F.lit(share) * F.col("size")))
    m = moments(d.where(~F.col("test")), [group], [*features, target])
    kind = df.schema[group].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [[r[group], [f.intercept, *f.coef]] for r in pdf.to_dict("records") if (f := _fit(r)).status == "ok"]
            yield pd.DataFrame(rows, columns=[group, "c"])

    models = m.mapInPandas(run, f"{group} {kind}, c array<double>")
    p = d.where("test").join(models, group).withColumn("pred", _predict(features))
    rmse, r2 = scores("pred", target)
    return p.groupBy(group).agg(F.max("size").alias("n"), F.count(F.lit(1)).alias("n_test"), rmse.alias("rmse"), r2.alias("r2"))


def vif(df: DataFrame, features: list[str]) -> DataFrame:
    """(Feature, VIF), largest first: diagonal of the inverse correlation matrix over complete rows.

    One aggregate; the p x p matrix is solved on the driver. NULL for a constant
    feature, infinite where features determine each other, no rows without data.
    """
    spark = df.sparkSession
    schema = "Feature string, VIF double"
    row = moments(complete(df, features), [], features).first()
    if row is None or row["n"] < 2:
        return spark.createDataFrame([], schema)
    k, n, s = len(features), row["n"], np.array(row["s"])
    cross = np.zeros((k, k))
    cross[np.triu_indices(k)] = row["q"]
    cov = cross + np.triu(cross, 1).T - np.outer(s, s) / n
    var = np.diag(cov)
    live = [i for i in range(k) if var[i] > 1e-12 * (cross[i, i] + 1e-300)]
    sd = np.sqrt(var[live])
    r = cov[np.ix_(live, live)] / np.outer(sd, sd)
    value: dict[int, float] = {}
    if live and np.linalg.eigvalsh(r)[0] > SINGULAR:
        value = dict(zip(live, np.diag(np.linalg.inv(r)).tolist()))
    else:
        for a, i in enumerate(live):  # by definition, feature by feature
            rest = [b for b in range(len(live)) if b != a]
            fit = r[a, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)], rcond=1e-9) @ r[rest, a] if rest else 0.0
            value[i] = 1 / (1 - fit) if 1 - fit > SINGULAR else float("inf")
    rows = [(f, value.get(i)) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, schema).orderBy(F.desc_nulls_last("VIF"), "Feature")


def formula(species: str, intercept: float, terms: list[tuple[str, float]]) -> str:
    """Text of a linear model, three decimals, a plus even before a negative coefficient."""
    return f"{species} trunk_diameter = {intercept:.3f}" + "".join(f" + ({b:.3f} * {f})" for f, b in terms)


def formulas(df: DataFrame, species: str, label: str, features: list[str], target: str) -> DataFrame:
    """(species, features, model, formula) of every fitted species."""
    fit = ols(df, [species], features, target).where(F.col("status") == "ok")
    one = fit.groupBy(F.col(species).alias("species")).agg(F.max("intercept").alias("c0"), F.map_from_entries(F.collect_list(F.struct("variable", "coef"))).alias("b"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = [formula(s, c0, [(f, dict(b)[f]) for f in features]) for s, c0, b in zip(pdf["species"], pdf["c0"], pdf["b"])]
            yield pd.DataFrame({"species": pdf["species"], "features": label, "model": "Linear", "formula": texts})

    return one.mapInPandas(run, "species string, features string, model string, formula string")


def best_rows(results: DataFrame, group: str = "species", score: str = "r2", order: str = "seq") -> DataFrame:
    """The best row per group: highest score, ties by ``order``; rows without a score never win."""
    rest = [c for c in results.columns if c != group]
    live = results.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = live.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), F.col(order))).alias("b"))
    return best.select(group, "b.*")


def summarise(best: DataFrame, texts: DataFrame, strict: bool = False) -> DataFrame:
    """(species, best_model, best_features, best_R2, formula_if_linear) of the best models.

    The formula is that of the winning feature set, whatever kind of model won;
    with ``strict`` a winner that is not linear has none.
    """
    out = best.join(texts.select("species", "features", "formula"), ["species", "features"], "left")
    shown = F.when(F.col("model") == "Linear", F.col("formula")) if strict else F.col("formula")
    return out.select(
        "species", F.col("model").alias("best_model"), F.col("features").alias("best_features"), F.col("r2").alias("best_R2"), F.coalesce(shown, F.lit("N/A (RF Best)")).alias("formula_if_linear")
    )
