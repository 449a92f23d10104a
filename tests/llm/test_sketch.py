import numpy as np
import pytest

from sylvaq.llm.sketch import RANK_ERROR, SPARSE, Sketch, build_sketches, decode, encode, merge_sketches, quantiles

P = np.array([0.01, 0.25, 0.5, 0.75, 0.95, 0.99])


def sketch(v):
    return Sketch().add(*np.unique(encode(np.asarray(v, float)), return_counts=True))


def rank_error(v, found):
    v = np.sort(v)
    lo, hi = np.searchsorted(v, found, "left") / len(v), np.searchsorted(v, found, "right") / len(v)
    return np.maximum(0, np.maximum(lo - P, P - hi)).max()


def test_codes_keep_order():
    rng = np.random.default_rng(1)
    v = np.sort(np.concatenate([rng.normal(0, 1e-3, 500), rng.lognormal(0, 9, 500), -rng.lognormal(0, 9, 500), [0.0, -0.0, 1e308, -1e308, 5e-324]]))
    assert (np.diff(encode(v).astype(np.int64)) >= 0).all()
    for x in (0.0, 3.599, -2.004, 27.06, 1e300, 0.1, -1000.0):
        assert decode(int(encode(np.array([x]))[0])) == x


@pytest.mark.parametrize("kind", ["normal", "skewed", "few", "heavy", "constant"])
def test_rank_error(kind):
    rng = np.random.default_rng(7)
    n = 150_000
    v = {
        "normal": rng.normal(3, 2, n),
        "skewed": rng.lognormal(1, 2, n),
        "few": rng.integers(0, 1000, n).astype(float),
        "heavy": np.where(rng.random(n) < 0.4, 0.0, rng.exponential(5, n).round(3)),
        "constant": np.full(n, -4.25),
    }[kind]
    s = sketch(v)
    assert rank_error(v, s.quantiles(P)) <= RANK_ERROR / 2
    assert s.n == n


def test_merge_and_delete():
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 3000), rng.normal(5, 1, SPARSE + 5000)
    whole, x, y = sketch(np.concatenate([a, b])), sketch(a), sketch(b)
    assert x.top is None and y.top is not None  # both forms take part
    both = Sketch.from_bytes(x.to_bytes()).merge(Sketch.from_bytes(y.to_bytes()))
    assert (both.top == whole.densify().top).all() and (both.cells == whole.cells).all()
    less = both.merge(x, -1)
    assert (less.cells == y.cells).all() and less.n == len(b)
    assert Sketch().quantiles(P) == [None] * 6


def test_frames(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    data = [(int(i % 3) if i % 11 else None, int(i % 4), float(x), "z") for i, x in enumerate(rng.normal(10, 3, 4000))]
    data += [(1, 0, x, "z") for x in (nan, inf, -inf, None, -9999.0)] + [(8, 0, nan, "z")]
    df = spark.createDataFrame(data, "sp int, ld int, v double, n string").repartition(7)
    per = merge_sketches(build_sketches(df, ["sp", "ld"], ["v"], -1000.0), ["sp", "ld"], salts=3)
    rows = merge_sketches(per, ["sp"]).collect()
    want = {}
    for sp, _, x, _ in data:
        if x is not None and np.isfinite(x) and x >= -1000:
            want.setdefault(sp, []).append(x)
    assert {r.sp: r.n for r in rows} == {k: len(v) for k, v in want.items()}
    for r in rows:
        direct = sketch(want[r.sp]).densify()
        got = Sketch.from_bytes(r.sketch).densify()
        assert (got.top == direct.top).all() and (got.cells == direct.cells).all()
    assert quantiles(per, ["sp", "ld"], [0.5]).count() == 16
    assert quantiles(merge_sketches(build_sketches(df.limit(0), ["sp"], ["v"]), ["sp"]), ["sp"], [0.5]).count() == 0
