import numpy as np

from sylvaq.operators.components import min_labels
from sylvaq.operators.dbscan import dbscan


def textbook(p, r, least):
    """Root of every clustered point: dense points by flood fill, the others by the lowest root near them."""
    near = ((p[:, None] - p[None]) ** 2).sum(-1) <= r * r
    dense = near.sum(1) >= least
    root = {}
    for i in np.flatnonzero(dense):
        todo = [] if i in root else [i]
        root.setdefault(int(i), int(i))
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & dense):
                if j not in root:
                    root[int(j)] = root[int(i)]
                    todo.append(j)
    edge = {int(i): min(o) for i in np.flatnonzero(~dense) if (o := [root[j] for j in np.flatnonzero(near[i] & dense)])}
    return {(i, r, True) for i, r in root.items()} | {(i, r, False) for i, r in edge.items()}


def test_against_textbook(spark):
    for seed, n, least in ((1, 700, 10), (2, 500, 4)):
        rng = np.random.default_rng(seed)
        p = np.round(rng.uniform(0, 600, (n, 2)) * 4) / 4
        p[:30] = p[0] + rng.uniform(0, 2, (30, 2)).round()
        want = textbook(p, 25.0, least)
        df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id bigint, x double, y double")
        got = [tuple(r) for r in dbscan(df, 25.0, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and {d for *_, d in want} == {True, False} and len(want) < n


def test_chain_and_empty(spark):
    df = spark.createDataFrame([(i, 20.0 * i, 0.0) for i in range(200)], "id bigint, x double, y double")
    assert {(r.root, r.id) for r in dbscan(df, 25.0, 3).collect()} == {(1, i) for i in range(200)}
    assert dbscan(df.limit(0), 25.0, 3).count() == 0 and dbscan(df, 25.0, 10).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    n = 300
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    root = list(range(500))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = min_labels(spark.range(500), spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {(r.id, r.root) for r in got.collect()} == {(i, find(i)) for i in range(500)}
