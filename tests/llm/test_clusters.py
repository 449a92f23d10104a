import numpy as np

from pyspark.sql import functions as F

from sylvaq.llm.clusters import _CELL, _boxes, density_clusters, describe_clusters, touching_cells
from sylvaq.operators.dbscan import dbscan


def procedural(p, r, least):
    """Textbook clustering: dense points, flood fill, borders to the cluster with the lowest dense id."""
    near = ((p[:, None] - p[None]) ** 2).sum(-1) <= r * r
    dense = near.sum(1) >= least
    root = {}
    for i in range(len(p)):
        if dense[i] and i not in root:
            todo = [i]
            root[i] = i
            while todo:
                k = todo.pop()
                for j in np.flatnonzero(near[k] & dense):
                    if j not in root:
                        root[j] = i
                        todo.append(j)
    for i in range(len(p)):
        if not dense[i] and (options := [root[j] for j in np.flatnonzero(near[i] & dense)]):
            root[i] = min(options)
    low = {}
    for i, k in root.items():
        low[k] = min(low.get(k, i), i)
    touching = sum(1 for i in range(len(p)) if not dense[i] and len({root[j] for j in np.flatnonzero(near[i] & dense)}) > 1)
    return {(low[k], i) for i, k in root.items()}, dense, touching


def test_against_procedural(spark):
    seen = 0
    for seed, n, least in ((1, 700, 10), (2, 500, 4)):
        rng = np.random.default_rng(seed)
        p = np.round(rng.uniform(0, 600, (n, 2)) * 4) / 4
        p[:30] = p[0] + rng.uniform(0, 2, (30, 2)).round()  # a crowded cell with copies
        want, dense, touching = procedural(p, 25.0, least)
        seen += touching
        df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id bigint, x double, y double")
        got = [(r.cluster_key, r.id) for r in density_clusters(df, 25.0, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert 0 < dense.sum() < n and len(want) < n
    assert seen  # borders with a choice were among the cases


def test_chain_and_empty(spark):
    df = spark.createDataFrame([(i, 20.0 * i, 0.0) for i in range(200)], "id bigint, x double, y double")
    out = density_clusters(df, 25.0, 3)
    assert {(r.cluster_key, r.id) for r in out.collect()} == {(0, i) for i in range(200)}
    assert density_clusters(df.limit(0), 25.0, 3).count() == 0
    assert density_clusters(df, 25.0, 10).count() == 0
    kind = spark.createDataFrame([(i, i % 2 if i else None) for i in range(200)], "id bigint, kind int")
    r = describe_clusters(out, kind).first()
    assert (r["size"], r.dense_members, r.dominant) == (200, 198, 1) and r.typical == "0"


def test_heavy_cells_and_clusters(spark):
    """A third of the points in two cells, with the crowd limit far below; the same rows as without it and as by other means."""
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.uniform(0, 8, (150, 2)), rng.uniform(400, 406, (60, 2)), rng.uniform(0, 500, (420, 2))])
    p[:40] = p[0]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id bigint, x double, y double")
    plain, heavy = ({(r.root, r.id, r.dense) for r in density_clusters(df, 25.0, 10, limit).collect()} for limit in (100_000, 20))
    assert plain == heavy == {(r.root, r.id, r.dense) for r in dbscan(df, 25.0, 10).collect()}


def test_crowds_just_out_of_reach(spark):
    """Cells whose outermost points are apart although others are near: only finer cells tell."""
    side, rng = 25.0 / 2**0.5 * (1 - 1e-9), np.random.default_rng(2)
    for gap, linked in ((24.9, True), (25.1, False)):
        fill = [(float(x), float(y)) for x, y in rng.uniform((1, 1), (3, 17), (60, 2))]
        left = [(6.0, 0.3), (4.0, 17.5), (5.5, 9.0), *fill]
        right = [(30.0, 17.5), (32.0, 0.2), (5.5 + gap, 9.0), *[(32 + x / 2, y) for x, y in fill]]
        d = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([*left, *right])], "id bigint, x double, y double")
        d = d.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
        boxes = _boxes(d, _CELL, [F.min("id").alias("label")])
        assert not any((2 if r.label == 0 else len(left) + 2) in {k for k, q in enumerate([*left, *right]) for p in r.rim if (p.x, p.y) == q} for r in boxes.collect())
        found = {tuple(sorted((r.a, r.b))) for r in touching_cells(boxes, d, 25.0, side).collect()}
        assert found == ({(0, len(left))} if linked else set())
