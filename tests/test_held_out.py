"""Held-out forests of large groups: rows travel once, trees are those grown by counts per bin."""

import numpy as np
import pytest

from sylvaq.operators import growth_models
from sylvaq.operators.forest import grown, held_out, predicted


@pytest.mark.parametrize("seed,rows,depth,steps", [(1, 40, 30, 10), (2, 700, 30, 3), (3, 700, 4, 1000), (4, 3000, 30, 20)])
def test_trees_row_by_row(seed, rows, depth, steps):
    rng = np.random.default_rng(seed)
    bins = np.stack([rng.integers(0, b, rows) for b in (32, 1, 2, 5, 32, 32, 3, 32, 32, 2, 32, 32, 4, 32)], 1).astype(np.uint8)
    y = np.round((bins[:, 0] / 16 + bins[:, 9] + rng.normal(0, 0.5, rows)) * steps) / steps
    away = rng.random(rows) < 0.2
    n = rng.poisson(1.0, (5, rows)) * ~away
    n[3] = 0
    whole = grown(n, n * y, bins, depth)[0][:, away]
    got = predicted(n, y, bins, bins[away], depth)
    assert got.shape == whole.shape and np.isnan(got[3]).all()
    assert np.allclose(got, whole, rtol=0, atol=1e-9, equal_nan=True)


def test_rows_travel_once(spark):
    """Before, every row was sent once per four trees."""
    g = spark.createDataFrame([("a", i, i % 5 == 0, float(i % 7), float(i % 3)) for i in range(200)] + [("b", i, True, 1.0, 1.0) for i in range(3)], "grp string, k bigint, test boolean, x double, y double")
    p = held_out(g, "grp", "k", ["x"], "y", "test", {"a": ["x"], "b": ["x"]}, 40, 30)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan
    got = {(r.grp, r.k): r.pred for r in p.collect()}
    assert len(got) == 43 and {k: v for k, v in got.items() if k[0] == "b"} == {("b", i): None for i in range(3)}


def test_first_rows_are_the_test_rows(spark):
    rows = [("a", 7 * i % 101, 1.0) for i in range(101)] + [("b", i, 1.0) for i in range(3)] + [("c", 5, 1.0), (None, 1, 1.0)]
    d = growth_models.divided(spark.createDataFrame(rows, "grp string, o bigint, v double"), "o").collect()
    assert {(r.grp, r.o) for r in d if r.test} == {("a", i) for i in range(21)} | {("b", 0), ("c", 5)}
    assert {(r.grp, r.size) for r in d} == {("a", 101), ("b", 3), ("c", 1)} and len(d) == 105
