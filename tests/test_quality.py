import numpy as np
import pytest

from sylvaq.operators.ordered import exact_quantiles, prefix_counts
from sylvaq.operators.quality import Rule, findings, load_distances, malformed_texts, pooled_distances, profile_loads

RULES = [Rule("t", 0, 100), Rule("m", 0, 1)]


def frame(spark, data):
    return spark.createDataFrame(data, "ld int, t string, m double, load string, value double")


def test_prefix_counts_split_a_group(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, float(i % 50), 1) for i in range(500)], "g string, v double, c bigint")
    counted = df.groupBy("g", "v").sum("c").withColumnRenamed("sum(c)", "c")
    for n in (1, 7):
        got = prefix_counts(counted, ["g"], "v", ["c"], n).collect()
        for g in ("a", None):
            own = sorted((r for r in got if r.g == g), key=lambda r: r.v)
            assert [r.c_upto for r in own] == list(np.cumsum([r.c for r in own])) and {r.c_all for r in own} == {sum(r.c for r in own)}
    assert prefix_counts(counted.limit(0), ["g"], "v", ["c"]).count() == 0


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(0, 5, 999), 1)
    df = spark.createDataFrame([("h" if i % 3 == 0 else f"g{i % 7}", float(x)) for i, x in enumerate(v)], "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    for g in got:
        own = [x for i, x in enumerate(v) if ("h" if i % 3 == 0 else f"g{i % 7}") == g]
        assert np.allclose([got[g].a, got[g].b, got[g].c], np.quantile(own, [0.25, 0.5, 0.9]))


def test_profile(spark):
    nan = float("nan")
    data = [(1, "5", 0.5), (1, " ", nan), (1, "x", None), (1, "-5", 2.0), (1, "5", 0.25), (1, "7.5", 0.25), (None, "1e3", float("inf")), (2, "", None), (2, "5\n", nan), (2, "\n", nan)]
    p = {(r.load, r.column_name): r for r in profile_loads(frame(spark, [(*r, "x", 1.0) for r in data]), "ld", RULES).collect()}
    t = p[1, "t"]
    assert (t.rows, t.missing, t.malformed, t.numbers, t.out_of_bounds, t.distinct_values) == (6, 1, 1, 4, 1, 3)
    assert (t.min_value, t.max_value, t.median, t.top_value, t.top_count) == (-5.0, 7.5, 5.0, 5.0, 2)
    assert (p[1, "m"].missing, p[1, "m"].out_of_bounds, p[1, "m"].q1) == (2, 1, 0.25)
    assert (p[None, "t"].malformed, p[None, "m"].out_of_bounds) == (1, 1)
    assert (p[2, "t"].missing, p[2, "t"].malformed, p[2, "t"].median, p[2, "t"].top_count) == (1, 2, None, 0)
    assert profile_loads(frame(spark, []), "ld", RULES).count() == 0


def test_findings(spark):
    rng = np.random.default_rng(0)
    data = []
    for load in range(1, 8):
        for i in range(100):
            t, m = f"{rng.uniform(20, 40):.2f}", float(rng.uniform(0.2, 0.8))
            if load == 2 and i < 30:
                t = None
            if load == 3 and i < 10:
                t = "n/a"
            if load == 4 and i < 10:
                t = "900"
            if load == 5:
                t = f"{float(t) + 15:.2f}"
            if load == 6 and i < 60:
                m = 0.5
            data.append((load, t, m, "x", 0.0))
    got = {(r.load, r.column_name, r.finding) for r in findings(profile_loads(frame(spark, data), "ld", RULES)).collect()}
    assert got == {(2, "t", "missing"), (3, "t", "pattern"), (4, "t", "range"), (5, "t", "shift"), (6, "m", "constant")}


def test_distance(spark):
    rng = np.random.default_rng(3)
    a, b, c = np.round(rng.normal(50, 9, 300), 0), np.round(rng.normal(55, 9, 200), 0), np.round(rng.normal(50, 5, 100), 0)
    data = [(k, str(x), None, "x", 0.0) for k, v in ((1, a), (2, b), (5, c)) for x in v.clip(0, 100)]
    got = {(r.load_a, r.load_b): r.ks for r in load_distances(frame(spark, data), "ld", RULES, 5).collect() if r.column_name == "t"}

    def ks(x, y):
        at = np.unique(np.concatenate([x, y]))
        return np.abs(np.searchsorted(np.sort(x), at, "right") / len(x) - np.searchsorted(np.sort(y), at, "right") / len(y)).max()

    assert set(got) == {(1, 2), (2, 5)} and got[1, 2] == pytest.approx(ks(a.clip(0, 100), b.clip(0, 100))) and got[2, 5] == pytest.approx(ks(b.clip(0, 100), c.clip(0, 100)))


def test_malformed_spellings_and_drift(spark, rows):
    data = [(1, "x", 0.5), (1, "y", 0.5), (1, "x", 0.1), (1, "4", 0.9), (None, "b", None), (None, "a", float("nan")), (2, "7", 0.5), (2, None, 0.5), (2, " ", 7.0)]
    df = frame(spark, [(*r, "z", 1.0) for r in data])
    assert rows(malformed_texts(df, "ld", RULES)) == sorted([(1, "t", 2, "x", 2), (None, "t", 2, "a", 1)], key=repr)
    assert malformed_texts(df.limit(0), "ld", RULES).count() == 0 and malformed_texts(df, "ld", RULES[1:]).count() == 0
    rng = np.random.default_rng(2)
    loads = {k: np.round(np.clip(rng.normal(0.5 + 0.05 * k, 0.1, 80 + 40 * k), 0, 1), 2) for k in range(4)}
    d = spark.createDataFrame([(k, float(v)) for k, vs in loads.items() for v in vs] + [(9, None), (None, 0.5)], "ld int, m double")
    got = {r.load: r for r in pooled_distances(d, "ld", RULES[1:], 3).collect()}
    assert set(got) == set(loads)
    for k, own in loads.items():
        rest = np.concatenate([v for o, v in loads.items() if o != k])
        at = np.unique(np.concatenate([own, rest]))
        gap = np.abs(np.searchsorted(np.sort(own), at, "right") / len(own) - np.searchsorted(np.sort(rest), at, "right") / len(rest)).max()
        assert np.isclose(got[k].ks, gap) and (got[k].n, got[k].n_others) == (len(own), len(rest))
    assert pooled_distances(d.where("ld = 1"), "ld", RULES[1:]).count() == 0
