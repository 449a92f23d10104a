import math
import random
import statistics

import pytest

from sylvaq.operators.spikes import Rules, implausible_readings, judged_readings, numbered, stuck_runs

SCHEMA = "tree bigint, strip string, seq int, H float, item int, source string"


def make(spark, data):
    return spark.createDataFrame([(*r, 1, "z") for r in data], "tree bigint, strip string, seq int, H double, item int, source string")


def brute(data):
    out, by = set(), {}
    for tree, strip, seq, v in set(data):
        if tree is not None and v is not None and not math.isnan(v) and v != 0:
            by.setdefault(strip, []).append((seq, tree, v))
    for items in by.values():
        med = statistics.median(v for _, _, v in items)
        dist = lambda v: 0.0 if v == med else abs(v - med)
        mad = statistics.median(dist(v) for _, _, v in items)
        items.sort(key=lambda r: r[:2])
        run = []
        for seq, tree, v in items:
            if v < 0 or v > 60:
                out.add((tree, "bounds"))
            if dist(v) > 9 * mad:
                out.add((tree, "spike"))
            run = [*run, tree] if run and v == last else [tree]
            last = v
            if len(run) >= 8:
                out |= {(t, "stuck") for t in run}
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_against_brute_force(spark, partitions):
    rng = random.Random(2)
    data, tree = [], 0
    for strip in ("a", "b", None):
        level = rng.uniform(5, 20)
        for seq in range(120):
            tree += 1
            v = round(rng.gauss(level, 0.4), 1)
            if rng.random() < 0.1:
                v = rng.choice([None, float("nan"), 0.0, -3.0, 75.0, float("inf"), level + 9])
            if 40 <= seq < 52 and strip != "b":
                v = level if seq != 45 else None
            data.append((tree, strip, seq, v))
            if rng.random() < 0.05:
                data.append(data[-1])
    got = implausible_readings(make(spark, data), "tree", "strip", "seq", ["H"], partitions=partitions).collect()
    assert {(r.item, r.reason) for r in got} == brute(data) and len(got) == len(brute(data))
    assert {r for _, r in brute(data)} == {"bounds", "spike", "stuck"}


def test_runs_across_blocks(spark):
    values = [1.0] * 7 + [2.0] * 20 + [3.0] * 3 + [2.0] * 8 + [4.0] * 7
    data = [(i, "s", "H", i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "item bigint, source string, field string, ord int, v double")
    for block in (3, 4, 8, 1000):
        got = sorted(r.item for r in stuck_runs(numbered(df), 8, block).collect())
        assert got == [*range(7, 27), *range(30, 38)], block


def test_empty_and_tiny(spark):
    assert implausible_readings(make(spark, []), "tree", "strip", "seq", ["H"]).count() == 0
    assert implausible_readings(make(spark, [(1, "a", 1, None), (2, "a", None, 5.0), (None, "a", 3, 99.0)]), "tree", "strip", "seq", ["H"]).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_rolling(spark, partitions):
    rng = random.Random(5)
    data = [(i, "s", i, round(10 + i / 30 + rng.gauss(0, 0.2), 2) + (5 if i % 41 == 7 else 0)) for i in range(300)]
    data += [(1000 + i, f"t{i % 3}", i, float(i + 1)) for i in range(60)]
    got = {r.item: r for r in judged_readings(make(spark, data), "tree", "strip", "seq", ["H"], Rules(half=5), partitions=partitions).collect()}
    assert len(got) == len(data)
    for i in range(300):
        near = [v for *_, v in data[max(0, i - 5) : min(300, i + 6)]]
        med = statistics.median(near)
        mad = statistics.median(abs(v - med) for v in near)
        assert math.isclose(got[i].med, med) and math.isclose(got[i].mad, mad, abs_tol=1e-12)
        assert got[i].spike == (abs(data[i][3] - med) > 9 * mad)
    assert any(r.spike for r in got.values())


def test_one_large_source_without_order(spark):
    """A source of two thirds of the rows whose order numbers are missing or all the same, over many ranges."""
    rng = random.Random(8)
    data = [(i, "big", None if i % 2 else 7, rng.choice([8.0, 8.5, 9.0, 30.0]) if not 500 <= i < 540 else 8.5) for i in range(1200)]
    data += [(5000 + i, f"s{i % 6}", i, rng.choice([8.0, 8.5, 9.0, 30.0])) for i in range(600)]
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[3])  # noqa: E731  NULL order comes first
    want = brute([key(r) for r in data])
    for partitions in (2, 12):
        got = implausible_readings(make(spark, data), "tree", "strip", "seq", ["H"], partitions=partitions).collect()
        assert {(r.item, r.reason) for r in got} == want and {reason for _, reason in want} >= {"stuck", "spike"}
