"""Grouping points into similarity clusters: grid density clustering in SQL operations.

Locations are quantised to cells whose points all lie within the radius of each
other, so a cell with enough points is dense as a whole and the dense points of
one cell always share a cluster. Only points of poor cells are counted against
the points around; adjacent cells with dense points are joined when a dense
pair lies within the radius; the minimum label is propagated over these cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaq.operators.components import min_labels
from sylvaq.operators.skew import HEAVY, heavy_keys, spread_join
from sylvaq.scratch import checkpointed

#: Cells ahead whose nearest points may lie within the radius: half of 5 x 5 without the corners.
AHEAD = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if abs(dx) + abs(dy) < 4 and (dy, dx) > (0, 0)]
#: Side, in cells, of the blocks by which points meet those around them; the 5 x 5 cells around a point touch just 4 blocks.
BLOCK = 4
#: Points of a cell up to which all of them are kept beside its box instead of its outermost ones.
FEW = 24
#: Divisions of an undecided cell's side, per level, and levels; a division of 8 ** 12 is beyond the precision of a coordinate.
PARTS, LEVELS = 8, 12

_CELL = ["cx", "cy"]
_NODE = ["cx", "cy", "sx", "sy"]


def _squared(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def _boxes(dense: DataFrame, keys: list[str], extra: list[Column], all_points: bool = False) -> DataFrame:
    """Box and eight outermost points (or ``all_points``) of every cell; ``whole`` where these are all its places."""
    x, y = F.col("x"), F.col("y")
    outer = [F.min_by(F.struct("x", "y"), F.struct(k, x, y)) for k in (x, -x, y, -y, x + y, -x - y, x - y, y - x)]
    rim = F.collect_list(F.struct("x", "y")) if all_points else F.array_distinct(F.array(*outer))
    c = dense.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), rim.alias("rim"), F.count(F.lit(1)).alias("n"), *extra)
    flat = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    return c.withColumn("whole", flat | (F.size("rim") == F.col("n")))


def _judged(pairs: DataFrame, radius: float) -> DataFrame:
    """Pairs of boxes that may hold a near pair: ``sure`` if outermost points are near, ``settled`` if nothing else can be."""
    r2 = F.lit(radius * radius)
    gx = F.greatest(F.lit(0.0), F.col("b_x0") - F.col("a_x1"), F.col("a_x0") - F.col("b_x1"))
    gy = F.greatest(F.lit(0.0), F.col("b_y0") - F.col("a_y1"), F.col("a_y0") - F.col("b_y1"))
    pairs = pairs.where(_squared(gx, gy) <= r2)
    sure = F.exists("a_rim", lambda p: F.exists("b_rim", lambda q: _squared(p.x - q.x, p.y - q.y) <= r2))
    return pairs.withColumn("sure", sure).withColumn("settled", F.col("sure") | (F.col("a_whole") & F.col("b_whole")))


def _sides(cells: DataFrame, s: str, keep: list[str]) -> DataFrame:
    return cells.select(*[F.col(c).alias(f"{s}_{c}") for c in [*keep, "x0", "x1", "y0", "y1", "rim", "whole"]])


def touching_cells(cells: DataFrame, dense: DataFrame, radius: float, side: float) -> DataFrame:
    """(a, b): labels of adjacent cells with a dense pair within the radius.

    ``cells`` is _boxes' result with ``label``. Cell pairs are settled by their boxes
    (too far apart), by their outermost points (near enough), or because they have
    no others. What stays undecided is divided into finer cells and judged again;
    only finer cells near each other meet, so no two crowds are compared point by point.
    """
    ahead = F.explode(F.array(*[F.struct(F.lit(dx).cast("bigint").alias("dx"), F.lit(dy).cast("bigint").alias("dy")) for dx, dy in AHEAD])).alias("o")
    left = _sides(cells, "a", [*_CELL, "label"]).select("*", ahead)
    left = left.withColumns({"b_cx": F.col("a_cx") + F.col("o.dx"), "b_cy": F.col("a_cy") + F.col("o.dy")}).drop("o")
    pairs = checkpointed(_judged(left.join(_sides(cells, "b", [*_CELL, "label"]), ["b_cx", "b_cy"]), radius))
    link = lambda p: p.where("sure").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    found = link(pairs)
    names = ["a_label", "b_label", *[f"{s}_{c}" for s in "ab" for c in _CELL]]
    zero = F.lit(0).cast("bigint")
    open_ = pairs.where("not settled").select(*names, *[zero.alias(f"{s}_s{c}") for s in "ab" for c in "xy"])
    for level in range(1, LEVELS + 1):
        if open_.isEmpty():
            break
        # the finer cells of those cells alone that still are in doubt
        doubt = open_.select(*[F.col(f"a_{c}").alias(c) for c in _CELL]).unionByName(open_.select(*[F.col(f"b_{c}").alias(c) for c in _CELL])).distinct()
        fine = side / PARTS**level
        parts = dense.join(doubt, _CELL, "left_semi").withColumns({"sx": F.floor((F.col("x") - F.col("cx") * side) / fine), "sy": F.floor((F.col("y") - F.col("cy") * side) / fine)})
        parts = checkpointed(_boxes(parts, _NODE, []))
        up = parts.withColumns({c: F.floor(F.col(c) / PARTS) for c in ("sx", "sy")} | {f"f{c}": F.col(c) for c in ("sx", "sy")})
        for s in "ab":
            kin = _sides(up, s, [*_NODE, "fsx", "fsy"])
            open_ = open_.join(kin, [f"{s}_{c}" for c in _NODE]).drop(f"{s}_sx", f"{s}_sy").withColumnsRenamed({f"{s}_fsx": f"{s}_sx", f"{s}_fsy": f"{s}_sy"})
        pairs = checkpointed(_judged(open_, radius))
        found = found.unionByName(link(pairs).distinct())
        # a pair of cells linked by any of its parts is done
        open_ = pairs.where("not settled").join(pairs.where("sure").select("a_label", "b_label").distinct(), ["a_label", "b_label"], "left_anti")
        open_ = checkpointed(open_.select(*names, *[f"{s}_s{c}" for s in "ab" for c in "xy"]))
    return found


def _around(p: DataFrame) -> DataFrame:
    """Every point once for each of the 4 blocks that hold the cells around it."""
    low, high = ([F.floor((F.col(c) + d) / BLOCK) for c in _CELL] for d in (-2, 2))
    four = F.explode(F.array(*[F.struct(i.alias("bx"), j.alias("by")) for i in (low[0], high[0]) for j in (low[1], high[1])]))
    return p.select(F.col("id").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"), four.alias("o")).select("p", "px", "py", "o.bx", "o.by")


def _meet(some: DataFrame, others: DataFrame, radius: float, heavy: DataFrame | None) -> DataFrame:
    """Pairs (p, columns of others) within the radius. The points of a heavy block are dealt out over salts."""
    left, right = _around(some), others.withColumns({"bx": F.floor(F.col("cx") / BLOCK), "by": F.floor(F.col("cy") / BLOCK)}).drop(*_CELL)
    keys = ["bx", "by"]
    if heavy is not None:
        salts = F.broadcast(heavy.select(*keys, F.ceil(F.col("heavy_n") / HEAVY).alias("salts")))
        many = F.coalesce("salts", F.lit(1))
        left = left.join(salts, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1))).drop("salts")
        right = right.join(salts, keys, "left").withColumn("salt", F.pmod(F.xxhash64("id"), many)).drop("salts")
        keys = [*keys, "salt"]
    near = _squared(F.col("px") - F.col("x"), F.col("py") - F.col("y")) <= F.lit(radius * radius)
    return left.join(right, keys).where(near)


def density_clusters(points: DataFrame, radius: float, least: int, heavy: int = HEAVY) -> DataFrame:
    """(cluster_key, root, id, dense, cell): one row per point in a cluster.

    ``points`` has unique ``id`` (bigint) and finite ``x``, ``y``. A point is dense if
    at least ``least`` points, itself included, lie within ``radius``. Dense points
    within ``radius`` share a cluster, also through others; a point that is not
    dense but near a dense one joins the cluster with the smallest dense id among
    those it may choose from; all others are in none. ``cluster_key`` is the
    smallest id of the cluster, ``root`` its smallest dense id. Empty input, no rows.

    Cells, blocks and clusters of more than ``heavy`` points are found by counting
    first; their rows are joined by broadcast of the few heavy keys or dealt out
    over salts, so that no task holds a crowd.
    """
    side = radius / math.sqrt(2.0) * (1 - 1e-9)
    p = points.select("id", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    p = checkpointed(p)
    cells = checkpointed(p.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n")))
    crowds = heavy_keys(cells, _CELL, "n", heavy)
    by_block = cells.groupBy(F.floor(F.col("cx") / BLOCK).alias("bx"), F.floor(F.col("cy") / BLOCK).alias("by")).agg(F.sum("n").alias("n"))
    blocks = None if crowds is None else heavy_keys(by_block, ["bx", "by"], "n", heavy)

    p = checkpointed(spread_join(p, cells.select(*_CELL, (F.col("n") < least).alias("poor"), (F.col("n") <= FEW).alias("few")), _CELL, crowds))
    poor = p.where("poor").select("id", "x", "y", *_CELL, "few")
    counts = _meet(poor, p.select("id", "x", "y", *_CELL), radius, blocks).groupBy(F.col("p").alias("id")).agg(F.count(F.lit(1)).alias("near"))
    poor = checkpointed(poor.join(counts, "id").withColumn("dense", F.col("near") >= least).drop("near"))
    dense = p.where("not poor").drop("poor").unionByName(poor.where("dense").drop("dense"))

    label = [F.min("id").alias("label")]
    boxes = checkpointed(_boxes(dense.where("few"), _CELL, label, True).unionByName(_boxes(dense.where("not few"), _CELL, label)))
    dense = dense.drop("few")
    roots = min_labels(boxes.select(F.col("label").alias("id")), touching_cells(boxes, dense, radius, side))
    owner = boxes.join(roots.withColumnRenamed("id", "label"), "label").select(*_CELL, "root")
    inside = checkpointed(spread_join(dense, owner, _CELL, crowds))

    border = _meet(poor.where("not dense"), inside, radius, blocks).groupBy(F.col("p").alias("id")).agg(F.min("root").alias("root"))
    border = poor.where("not dense").join(border, "id").select("id", "root", F.lit(False).alias("dense"), F.struct(*_CELL).alias("cell"))
    out = checkpointed(inside.select("id", "root", F.lit(True).alias("dense"), F.struct(*_CELL).alias("cell")).unionByName(border))
    keys = checkpointed(out.groupBy("root").agg(F.min("id").alias("cluster_key"), F.count(F.lit(1)).alias("n")))
    whole = spread_join(out, keys.drop("n"), ["root"], heavy_keys(keys, ["root"], "n", heavy))
    return whole.select("cluster_key", "root", "id", "dense", "cell")


def describe_clusters(members: DataFrame, kind: DataFrame, top: int = 3) -> DataFrame:
    """One row per cluster: size, dense members, cells, the dominant ``kind`` with its share
    (of the members that have one) and the ``top`` most typical members, the smallest ids
    of the cluster's fullest cell (ties: lowest cell).

    ``members`` is density_clusters' result; ``kind`` has unique ``id`` and ``kind``. All
    steps are aggregates with partial sums; the only window ranks the cells and
    kinds of a cluster after they are counted.
    """
    m = members.join(kind.select("id", "kind"), "id", "left")
    cells = m.groupBy("cluster_key", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dense").cast("int")).alias("d"))
    size = cells.groupBy("cluster_key").agg(
        F.sum("n").alias("size"), F.sum("d").alias("dense_members"), F.count(F.lit(1)).alias("cells"),
        F.min_by("cell", F.struct((-F.col("n")).alias("n"), F.col("cell"))).alias("cell"),
    )
    inside = members.join(size.select("cluster_key", "cell"), ["cluster_key", "cell"])
    rank = F.row_number().over(Window.partitionBy("cluster_key", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))
    inside = inside.withColumn("r", rank).where(F.col("r") <= top)  # at most 64 * top rows a cluster from here
    rank = F.row_number().over(Window.partitionBy("cluster_key").orderBy("id"))
    typical = inside.withColumn("r", rank).where(F.col("r") <= top).groupBy("cluster_key").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("typical"))
    kinds = m.where(F.col("kind").isNotNull()).groupBy("cluster_key", "kind").agg(F.count(F.lit(1)).alias("n"))
    dominant = kinds.groupBy("cluster_key").agg(
        F.min_by("kind", F.struct((-F.col("n")).alias("n"), F.col("kind"))).alias("dominant"), (F.max("n") / F.sum("n")).alias("dominant_share")
    )
    return size.drop("cell").join(typical, "cluster_key", "left").join(dominant, "cluster_key", "left")
