import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaq.llm.packing import fill_report, pack, pack_block, pack_check

KINDS = "kind_id int, kind_name string, capacity_tokens int"


def test_block_keeps_all_limits():
    rng = np.random.default_rng(1)
    size = np.column_stack([rng.integers(1, 512, 3000), np.ones(3000), rng.integers(0, 400, 3000)]).astype(float)
    limits = np.array([512.0, 8.0, 420.0])
    bins = pack_block(size, limits)
    assert (bins >= 0).all() and sorted(set(bins)) == list(range(bins.max() + 1))
    for d in range(3):
        assert np.bincount(bins, weights=size[:, d]).max() <= limits[d]
    lower = np.ceil((size.sum(0) / limits).max())
    assert bins.max() + 1 <= 1.03 * lower


def test_block_corner_cases():
    assert list(pack_block(np.zeros((0, 2)), np.ones(2))) == []
    assert len(set(pack_block(np.full((10, 1), 6.0), np.array([10.0])))) == 10
    assert len(set(pack_block(np.full((10, 1), 5.0), np.array([10.0])))) == 5
    assert len(set(pack_block(np.array([[5.0, 9.0], [5.0, 1.0]]), np.array([10.0, 8.0])))) == 2  # one breaks a limit alone


def test_pack(spark):
    rng = np.random.default_rng(4)
    tokens = [int(t) for t in rng.lognormal(4, 1.5, 1500)] + [0, 100, 100, 5000]
    items = spark.createDataFrame([(i, t, min(t, 20), "x") for i, t in enumerate(tokens)], "id bigint, tokens bigint, loss_from bigint, k string")
    kinds = spark.createDataFrame([(1, "s", 100), (2, "l", 2000), (3, "none", 0)], KINDS)
    packed = pack(items, kinds, segment_tokens=10, loss_share=1.0, block=300)
    out = packed.collect()
    for kind, cap in ((1, 100), (2, 2000)):
        own = [r for r in out if r.kind_id == kind]
        total, pieces, loss = {}, {}, {}
        for r in own:
            total.setdefault(r.id, {})[r.piece] = r.tokens
            pieces.setdefault(r.container, []).append(r.tokens)
            loss[r.id] = loss.get(r.id, 0) + r.loss
        assert {i: sum(p.values()) for i, p in total.items()} == {i: t for i, t in enumerate(tokens) if t}
        assert loss == {i: t - min(t, 20) for i, t in enumerate(tokens) if t}
        assert len(own) == sum(len(p) for p in total.values())  # every piece once
        for p in total.values():  # cut only where longer, all pieces but the last whole
            assert sorted(p) == list(range(len(p))) and all(p[i] == cap for i in range(len(p) - 1))
        assert max(map(sum, pieces.values())) <= cap and max(map(len, pieces.values())) <= cap // 10
    report = {r.kind_id: r for r in fill_report(packed, kinds).collect()}
    assert report[1].fill > 0.98 and report[3].containers == 0


@pytest.mark.parametrize("rows", [[], [(1, 0, 0)]])
def test_nothing_to_pack(spark, rows):
    items = spark.createDataFrame(rows, "id bigint, tokens bigint, loss_from bigint")
    kinds = spark.createDataFrame([(1, "s", 100)], KINDS)
    assert pack(items, kinds).count() == 0
    assert pack(items, kinds.limit(0)).count() == 0
    assert fill_report(pack(items, kinds), kinds).first().containers == 0


def test_binding_limits_and_check(spark):
    """Segments bind for one kind, loss for another; the check sees every kind of damage."""
    rng = np.random.default_rng(7)
    items = spark.createDataFrame([(i, int(t), int(t * rng.uniform(0, 0.6))) for i, t in enumerate(rng.integers(5, 90, 3000))], "id bigint, tokens bigint, loss_from bigint")
    kinds = spark.createDataFrame([(1, "s", 400), (2, "l", 3000)], KINDS)
    packed = pack(items, kinds, segment_tokens=60, loss_share=0.65, block=1500).cache()
    limits = {1: (400, 6, 260), 2: (3000, 50, 1950)}
    by = {}
    for r in packed.collect():
        by.setdefault((r.kind_id, r.container), []).append((r.tokens, 1, r.loss))
    peak = {k: np.max([np.sum(v, axis=0) / limits[k] for (kind, _), v in by.items() if kind == k], axis=0) for k in limits}
    assert all((p <= 1).all() and p[1] == 1 and p[2] > 0.97 for p in peak.values())
    check = lambda d: {r.kind_id: (r["items"], r.whole, r.within, r.full) for r in pack_check(d, items, kinds, 60, 0.65, 0.85).collect()}
    assert check(packed) == {1: (3000, True, True, True), 2: (3000, True, True, True)}
    assert not check(packed.unionByName(packed.limit(1)))[packed.first().kind_id][1]
    assert not check(packed.withColumn("container", F.lit("one")))[1][2]
    assert not check(packed.withColumn("container", F.concat_ws("-", "container", "id")))[2][3]
