import numpy as np
import pytest

from sylvaq.functions.dualtree import Tree, near_counts, near_pairs
from sylvaq.functions.graph import components
from sylvaq.operators.near import _Join, counts_within, least_near, links_within, located_points, pairs_within, shared_places
from sylvaq.operators.regions import containing_regions


def points(n, seed, span=600.0):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(0, span, (n, 2)) * 2) / 2
    p[: n // 4] = [100.0, 100.0]  # coincident
    p[n // 4] = [125.0, 100.0]  # exactly on the radius
    return p


def brute(p, r=25.0):
    d = ((p[:, None] - p[None]) ** 2).sum(-1) <= r * r
    return {(i, j) for i, j in zip(*np.nonzero(d)) if i < j}


@pytest.mark.parametrize("n", [1, 2, 40, 900])
def test_kernel(n):
    p = points(n, n)
    t = Tree(p[:, 0], p[:, 1], np.arange(n))
    got = [tuple(sorted(x)) for i, j in near_pairs(t, t, 25.0, True) for x in zip(t.tag[i].tolist(), t.tag[j].tolist())]
    want = brute(p)
    assert len(got) == len(set(got)) and set(got) == want
    c = np.zeros(n, int)
    for i, j in want:
        c[i] += 1
        c[j] += 1
    out = np.zeros(n, int)
    out[t.tag] = near_counts(t, t, 25.0, True)[0]
    assert (out == c).all()


@pytest.mark.parametrize("node_points", [4096, 16])
def test_join_with_crowded_nodes(spark, node_points):
    p = points(400, 5, 3000.0)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id bigint, x double, y double")
    want = brute(p)
    got = [tuple(r) for r in pairs_within(df, 25.0, node_points).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    n = {r.id: r.n for r in counts_within(df, 25.0, node_points).collect()}
    assert sum(n.values()) == 2 * len(want) and len(n) == 400


def test_counts_by_kind(spark):
    p = points(200, 8)
    kinds = [f"k{i % 3}" for i in range(200)]
    df = spark.createDataFrame([(i, float(x), float(y), k) for i, ((x, y), k) in enumerate(zip(p, kinds))], "id bigint, x double, y double, kind string")
    want = sum(1 for i, j in brute(p) if kinds[i] == kinds[j])
    assert sum(r.n for r in counts_within(df, 25.0).collect()) == 2 * want


def test_located(spark, rows):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, 5.0, 5.0, 9), (1, 5.0, 5.0, 8), (2, nan, 5.0, 7), (3, None, 5.0, 7), (4, 11.0, 5.0, 7), (None, 5.0, 5.0, 7), (5, 10.0, 0.0, 7), (6, 5.0, 5.0, 7), (6, 4.0, 9.0, 7)],
        "tree bigint, X double, Y double, id int",
    )
    assert rows(located_points(df, "tree", "X", "Y", (0, 10), (0, 10))) == [(1, 5.0, 5.0), (5, 10.0, 0.0), (6, 4.0, 9.0)]
    none = located_points(df.limit(0), "tree", "X", "Y", (0, 10), (0, 10))
    assert pairs_within(none, 25.0).count() == 0 and counts_within(none, 25.0).count() == 0


def frame(spark, p):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id bigint, x double, y double")


@pytest.mark.parametrize("node_points", [4096, 8])
def test_crowded_plot(spark, node_points):
    """A third of the points on a plot the size of the radius, all on places of their own, and a heap of copies."""
    rng = np.random.default_rng(9)
    p = rng.uniform(0, 1500, (450, 2))
    p[:150] = 500 + rng.uniform(0, 25, (150, 2))
    p[150:180] = p[0]
    df, want = frame(spark, p), brute(p)
    got = [tuple(r) for r in pairs_within(df, 25.0, node_points).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    n = np.zeros(450, int)
    for i, j in want:
        n[i] += 1
        n[j] += 1
    assert {r.id: r.n for r in counts_within(df, 25.0, node_points).collect()} == dict(enumerate(n.tolist()))
    i, j = np.array(sorted(want)).T
    root = components(450, i, j)
    edges = [tuple(r) for r in links_within(df, 25.0, node_points).collect()]
    linked = components(450, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert (linked == root).all() and len(edges) < 6 * 450
    values = [int(v) if v % 3 else None for v in rng.integers(1, 1000, 450)]
    d = spark.createDataFrame([(k, float(x), float(y), v) for k, ((x, y), v) in enumerate(zip(p, values))], "id bigint, x double, y double, v bigint")
    best = {}
    for a, b in want:
        for k, o in ((a, b), (b, a)):
            if values[k] is None and values[o] is not None:
                best[k] = min(best.get(k, 10**9), values[o])
    assert {r.id: r["value"] for r in least_near(d, 25.0, "v", node_points).collect()} == best


def test_box_pairs_grow_with_the_nodes(spark):
    rng = np.random.default_rng(1)
    sizes = []
    for n in (1000, 4000):
        j = _Join(frame(spark, rng.uniform(0, 60, (n, 2))), 2.0, 16, True)
        nodes = sum(box.count() for box in j.levels)
        sizes.append((nodes, j.tasks.count() + j.sure.count()))
    assert sizes[1][0] > 2 * sizes[0][0] and sizes[1][1] / sizes[1][0] < 2.5 * sizes[0][1] / sizes[0][0]


def test_shared_places(spark, rows):
    df = frame(spark, [(1, 1), (2, 2), (1, 1), (1, 1)])
    assert rows(shared_places(df)) == [(0, 0, 3), (1, 1, 1), (2, 0, 3), (3, 0, 3)]


def test_regions(spark, rows):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    shapes = [("square", ring((0, 0), (4, 0), (4, 4), (0, 4))), ("next", ring((4, 0), (8, 0), (8, 4), (4, 4))), ("far", ring((-1000, -1000), (3, -1000), (3, 3), (-1000, 3))),
              ("notch", ring((0, 0), (100, 0), (50, 50), (100, 100), (0, 100))), ("line", ring((0, 0), (1, 1))), ("flat", ring((1, 1), (1, 1), (1, 1))), ("none", None)]
    regions = spark.createDataFrame(shapes, "region string, ring array<struct<x: double, y: double>>")
    nan = float("nan")
    data = [(1, 2.0, 2.0), (2, 4.0, 2.0), (3, 90.0, 50.0), (4, 20.0, 50.0), (5, -500.0, 0.5), (6, nan, 1.0), (7, None, 1.0), (8, float("inf"), 1.0), (9, 2.0, 2.0)]
    pts = spark.createDataFrame(data, "id bigint, x double, y double")
    got = rows(containing_regions(pts, regions))
    assert got == sorted([(1, "far"), (1, "notch"), (1, "square"), (2, "next"), (2, "notch"), (4, "notch"), (5, "far"), (9, "far"), (9, "notch"), (9, "square")])
    assert containing_regions(pts, regions.limit(0)).count() == 0 and containing_regions(pts.limit(0), regions).count() == 0
