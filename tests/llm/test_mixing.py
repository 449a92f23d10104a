import numpy as np

from sylvaq.llm.mixing import balanced_mix, flight, share_report

DOCS, TARGETS = "id bigint, source string, tokens bigint, rate string", "source string, target_share double, max_repeats int"


def test_flight_keeps_balance():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 4000):
        size, p = rng.integers(1, 900, n).astype(float), rng.random(n)
        q = flight(p, size, rng)
        assert ((q >= 0) & (q <= 1)).all() and ((q > 0) & (q < 1)).sum() <= 2
        assert np.isclose(q.sum(), p.sum()) and np.isclose((q * size).sum(), (p * size).sum())
        q = flight(p, size, rng, land=True)
        assert set(q) <= {0.0, 1.0} and abs((q * size).sum() - (p * size).sum()) <= size.max()


def test_flight_keeps_inclusion():
    rng = np.random.default_rng(2)
    size, p = np.array([5.0, 9.0, 2.0, 7.0, 7.0]), np.array([0.1, 0.9, 0.5, 0.3, 0.2])
    mean = np.mean([flight(p, size, rng, land=True) for _ in range(20_000)], axis=0)
    assert np.abs(mean - p).max() < 0.02


def test_mix(spark):
    rng = np.random.default_rng(3)
    data, i = [], 0
    for name, n in (("a", 4000), ("b", 900), (" B ", 30), ("c-x", 60), ("zz", 500), (None, 40)):
        for _ in range(n):
            i += 1
            data.append((i, name, int(rng.lognormal(5, 0.8)), "z"))
    data.append((i + 1, "a", 0, "z"))
    docs = spark.createDataFrame(data, DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c_x", 0.1, 4), ("gone", 0.1, 3)], TARGETS)
    mix = balanced_mix(docs, targets, block=500)
    got = mix.collect()
    assert len({r.id for r in got}) == len(got) and all(r.copies >= 1 for r in got)
    report = {r.source: r for r in share_report(mix, docs, targets).collect()}
    for name, share in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c_x", 0.1 / 0.9)):
        assert abs(report[name].share - share) < 0.01
    assert report["c_x"].most_copies == 4 and report["a"].most_copies == 1 and report["gone"].tokens == 0
    assert sorted(map(tuple, balanced_mix(docs, targets, block=500).collect())) == sorted(map(tuple, got))
    fixed = {r.source: r for r in share_report(balanced_mix(docs, targets, total=100_000.0, block=500), docs, targets).collect()}
    assert abs(sum(r.tokens for r in fixed.values()) - 100_000) < 3 * max(t for *_, t, _ in data)


def test_many_sources_and_small_blocks(spark):
    """Each source lands by itself, however many others are still open."""
    rng = np.random.default_rng(6)
    data = [(i, f"s{i % 40}", int(rng.lognormal(4, 0.7)) + 1, "z") for i in range(4000)]
    docs = spark.createDataFrame(data, DOCS)
    weights = rng.uniform(1, 3, 40)
    targets = spark.createDataFrame([(f"s{k}", float(w / weights.sum()), 2) for k, w in enumerate(weights)], TARGETS)
    report = share_report(balanced_mix(docs, targets, block=8), docs, targets).collect()
    total, largest = sum(r.tokens for r in report), max(t for *_, t, _ in data)
    assert all(abs(r.tokens - r.target_share * total) <= 2.5 * largest and r.most_copies <= 2 for r in report)
    assert balanced_mix(spark.createDataFrame([(i, f"s{i}", 10, "z") for i in range(300)], DOCS), spark.createDataFrame([(f"s{i}", 1 / 300, 1) for i in range(300)], TARGETS), total=1500.0, block=8).count() > 0


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert balanced_mix(docs, targets).count() == 0
    assert share_report(balanced_mix(docs, targets), docs, targets).first().share == 0.0
    one = spark.createDataFrame([(1, "a", 10, "z")], DOCS)
    assert balanced_mix(one, targets.limit(0)).count() == 0
    assert [tuple(r) for r in balanced_mix(one, targets).collect()] == [(1, "a", 10, 1)]
