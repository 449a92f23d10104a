"""Column-level quality profile per load, findings against the usual state, drift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaq.operators.ordered import prefix_counts, quantile_of
from sylvaq.scratch import checkpointed

# the end of the text, not the place before a last line break
NUMBER = r"^-?[0-9]+(\.[0-9]+)?\z"
BLANK = r"^ *\z"


@dataclass(frozen=True)
class Rule:
    """One profiled column: its name and the inclusive bounds of a plausible value."""

    column: str
    low: float
    high: float


@dataclass(frozen=True)
class Limits:
    """How far a load may depart from the median over all loads."""

    missing: float = 0.15
    pattern: float = 0.05
    range: float = 0.05
    shift: float = 0.5
    constant: float = 0.4


def _cell(df: DataFrame, rule: Rule) -> Column:
    """Struct (column_name, kind, value) of one cell: kind 0 missing, 1 malformed, 2 out of bounds, 3 in bounds."""
    c = F.col(f"`{rule.column}`")
    if dict(df.dtypes)[rule.column] == "string":
        gone = c.isNull() | c.rlike(BLANK)
        number = F.when(c.rlike(NUMBER), c.try_cast("double"))
    else:
        number = c.cast("double")
        gone = number.isNull() | F.isnan(number)
    inside = number.between(rule.low, rule.high)
    kind = F.when(gone, 0).when(number.isNull(), 1).when(inside, 3).otherwise(2)
    return F.struct(
        F.lit(rule.column).alias("column_name"),
        kind.cast("int").alias("kind"),
        # -0.0 and 0.0 are one value
        F.when(~gone & number.isNotNull(), F.when(number == 0, F.lit(0.0)).otherwise(number)).alias("value"),
    )


def value_counts(df: DataFrame, load: str, rules: list[Rule]) -> DataFrame:
    """(load, column_name, kind, value, cnt): the unpivoted table, equal values counted together.

    One scan of ``load`` and the profiled columns; the partial aggregate takes
    copies and constant columns out before the shuffle.
    """
    cells = F.explode(F.array(*[_cell(df, r) for r in rules])).alias("c")
    long = df.select(F.col(f"`{load}`").alias("load"), cells)
    return long.groupBy("load", "c.column_name", "c.kind", "c.value").agg(F.count(F.lit(1)).alias("cnt"))


def profile_loads(df: DataFrame, load: str, rules: list[Rule], partitions: int | None = None) -> DataFrame:
    """One row per load and column: rows, missing, malformed, numbers, out_of_bounds,
    distinct_values, min/max of all numbers, q1, median, q3, top_value and top_count of
    the numbers in bounds.

    The quantiles and distincts are exact, from a range sort of the counted
    values and prefix counts (``ordered.prefix_counts``). NULL loads form one
    load; a column without numbers in bounds has NULL statistics; an empty table
    gives no rows. Equally frequent values: the smallest is ``top_value``.
    """
    counted = value_counts(df, load, rules)
    number = F.col("kind") >= 2
    # Missing and malformed cells have no value: each kind is one counted row of its own group.
    ranked = prefix_counts(counted, ["column_name", "load", "kind"], "value", ["cnt"], partitions)
    inside = ranked.groupBy("column_name", "load", "kind").agg(
        F.sum("cnt").alias("rows"),
        F.count("value").alias("distinct_values"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        quantile_of("value", "cnt", 0.25).alias("q1"),
        quantile_of("value", "cnt", 0.5).alias("median"),
        quantile_of("value", "cnt", 0.75).alias("q3"),
        F.max(F.when(F.col("value").isNotNull(), F.struct("cnt", (-F.col("value")).alias("neg")))).alias("top"),
    )
    r = lambda test: F.coalesce(F.sum(F.when(test, F.col("rows"))), F.lit(0))
    v = lambda name: F.max(F.when(F.col("kind") == 3, F.col(name)))
    return inside.groupBy("load", "column_name").agg(
        F.sum("rows").alias("rows"),
        r(F.col("kind") == 0).alias("missing"),
        r(F.col("kind") == 1).alias("malformed"),
        r(number).alias("numbers"),
        r(F.col("kind") == 2).alias("out_of_bounds"),
        F.coalesce(F.sum(F.when(number, F.col("distinct_values"))), F.lit(0)).alias("distinct_values"),
        F.min(F.when(number, F.col("low"))).alias("min_value"),
        F.max(F.when(number, F.col("high"))).alias("max_value"),
        v("q1").alias("q1"),
        v("median").alias("median"),
        v("q3").alias("q3"),
        (-v("top.neg")).alias("top_value"),
        F.coalesce(v("top.cnt"), F.lit(0)).alias("top_count"),
    )


def malformed_texts(df: DataFrame, load: str, rules: list[Rule]) -> DataFrame:
    """(load, column_name, malformed_distinct, top_malformed, top_malformed_count): the spellings of malformed
    values per load and text column (equally frequent ones: the first in order). Cells without any do not come out.

    Equal spellings are counted together before the shuffle; a load may have any number of them.
    """
    text = [r for r in rules if dict(df.dtypes)[r.column] == "string"]
    cells = [F.when(_cell(df, r)["kind"] == 1, F.struct(F.lit(r.column).alias("column_name"), F.col(f"`{r.column}`").alias("text"))) for r in text]
    none = F.array().cast("array<struct<column_name: string, text: string>>")
    long = df.select(F.col(f"`{load}`").alias("load"), F.explode(F.array_compact(F.array(*cells)) if cells else none).alias("c"))
    counted = long.groupBy("load", "c.column_name", "c.text").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("load", "column_name").agg(
        F.count(F.lit(1)).alias("malformed_distinct"), F.min_by("text", F.struct((-F.col("n")).alias("n"), F.col("text"))).alias("top_malformed"), F.max("n").alias("top_malformed_count")
    )


def _share(part: str, whole: Column) -> Column:
    return F.try_divide(F.col(part).cast("double"), whole.cast("double"))


def findings(profile: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(load, column_name, finding): where a load departs from the median over all loads.

    Works on the profile, one row per load and column, so the window per column
    holds one row per load. A share whose base is empty is unknown: it neither
    enters the median nor raises a finding.
    """
    present = F.col("rows") - F.col("missing")
    p = profile.select(
        "load",
        "column_name",
        _share("missing", F.col("rows")).alias("m"),
        _share("malformed", present).alias("p"),
        _share("out_of_bounds", F.col("numbers")).alias("r"),
        _share("top_count", F.col("numbers") - F.col("out_of_bounds")).alias("k"),
        "median",
        (F.col("q3") - F.col("q1")).alias("spread"),
    )
    w = Window.partitionBy("column_name")
    usual = {c: F.median(c).over(w) for c in ("m", "p", "r", "median", "spread")}
    p = p.select("*", *[x.alias(f"u_{c}") for c, x in usual.items()])
    found = F.array(
        F.when(F.col("m") - F.col("u_m") >= limits.missing, F.lit("missing")),
        F.when(F.col("p") - F.col("u_p") >= limits.pattern, F.lit("pattern")),
        F.when(F.col("r") - F.col("u_r") >= limits.range, F.lit("range")),
        F.when(F.abs(F.col("median") - F.col("u_median")) > limits.shift * F.col("u_spread"), F.lit("shift")),
        F.when(F.col("k") >= limits.constant, F.lit("constant")),
    )
    return p.select("load", "column_name", F.explode(F.array_compact(found)).alias("finding"))


def load_distances(df: DataFrame, load: str, rules: list[Rule], partitions: int | None = None) -> DataFrame:
    """(column_name, load_a, load_b, n_a, n_b, ks): exact Kolmogorov-Smirnov distance of the numbers in bounds
    between each load and the next one that has any. Empty tables and columns with one load give no rows.

    Every counted value joins the merged curve of its two pairs, once as the
    earlier and once as the later load; one range sort by (column, pair, value)
    and prefix counts of both sides give the cumulative curves at every value,
    whose largest gap is the distance. Rows: twice the counted values.
    """
    counted = value_counts(df, load, rules).where((F.col("kind") == 3) & F.col("load").isNotNull())
    loads = counted.groupBy("column_name", "load").agg(F.lit(1).alias("one"))
    w = Window.partitionBy("column_name").orderBy("load")
    loads = loads.select("column_name", "load", F.lag("load").over(w).alias("prev"), F.lead("load").over(w).alias("next"))
    both = counted.join(loads, ["column_name", "load"])
    sides = F.explode(
        F.array(
            F.struct(F.col("load").alias("load_a"), F.col("next").alias("load_b"), F.col("cnt").alias("a"), F.lit(0).cast("long").alias("b")),
            F.struct(F.col("prev").alias("load_a"), F.col("load").alias("load_b"), F.lit(0).cast("long").alias("a"), F.col("cnt").alias("b")),
        )
    ).alias("s")
    merged = both.select("column_name", "value", sides).where(F.col("s.load_a").isNotNull() & F.col("s.load_b").isNotNull())
    merged = merged.groupBy("column_name", "s.load_a", "s.load_b", "value").agg(F.sum("s.a").alias("a"), F.sum("s.b").alias("b"))
    curve = prefix_counts(merged, ["column_name", "load_a", "load_b"], "value", ["a", "b"], partitions)
    gap = F.abs(F.col("a_upto") / F.col("a_all") - F.col("b_upto") / F.col("b_all"))
    return curve.groupBy("column_name", "load_a", "load_b").agg(F.max("a_all").alias("n_a"), F.max("b_all").alias("n_b"), F.max(gap).alias("ks"))


def pooled_distances(df: DataFrame, load: str, rules: list[Rule], partitions: int | None = None) -> DataFrame:
    """(column_name, load, n, n_others, ks): the same distance between each load and all other loads together.

    Between two values of a load its own curve is flat and that of the others only
    rises, so their largest gap lies at a value of the load or just before it. The
    curve of the others is that of all loads less its own: one range sort by
    (column, value), one by (column, load, value), joined on the value, no row
    repeated. Loads without numbers in bounds, and a single load, do not come out.
    """
    counted = checkpointed(value_counts(df, load, rules).where((F.col("kind") == 3) & F.col("load").isNotNull()).select("column_name", "load", "value", "cnt"))
    every = prefix_counts(counted.groupBy("column_name", "value").agg(F.sum("cnt").alias("t")), ["column_name"], "value", ["t"], partitions)
    both = prefix_counts(counted, ["column_name", "load"], "value", ["cnt"], partitions).join(every, ["column_name", "value"])
    n, others = F.col("cnt_all"), F.col("t_all") - F.col("cnt_all")
    at = F.abs(F.col("cnt_upto") / n - F.try_divide(F.col("t_upto") - F.col("cnt_upto"), others))
    low, low_all = F.col("cnt_upto") - F.col("cnt"), F.col("t_upto") - F.col("t")
    before = F.abs(low / n - F.try_divide(low_all - low, others))
    return both.where(others > 0).groupBy("column_name", "load").agg(F.max("cnt_all").alias("n"), F.max(others).alias("n_others"), F.max(F.greatest(at, before)).alias("ks"))
