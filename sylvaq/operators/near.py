"""Points near other points or in regions: a distributed dual-tree join within a radius."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaq.scratch import checkpointed

#: Side of the coarsest node in radii, and how often a crowded node may be halved.
TOP_RADII, HALVINGS = 32.0, 12
#: Points of a node beyond which it is divided.
NODE_POINTS = 4096

_NODE = ["kind", "level", "ix", "iy"]
_BOX = ["x0", "x1", "y0", "y1"]


def located_points(df: DataFrame, item: str, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """(id, x, y): one row per item with a usable location.

    Coordinates outside the inclusive ranges, NULL and NaN are no location. An
    item with several different locations keeps the smallest (x, y); NULL items
    are left out. Equal locations of different items stay.
    """
    p = df.select(F.col(f"`{item}`").alias("id"), F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
    p = p.where(F.col("id").isNotNull() & F.col("x").between(*x_range) & F.col("y").between(*y_range))
    return p.groupBy("id").agg(F.min(F.struct("x", "y")).alias("p")).select("id", "p.x", "p.y")


def _tree(points: DataFrame, radius: float, node_points: int, extra: list[Column]) -> tuple[DataFrame, list[DataFrame]]:
    """Points with their leaf node, and the nodes of every level with count, box, ``extra`` aggregates and whether they are divided.

    A node with more than ``node_points`` points is divided into four, level by
    level, each step a count over the points of divided nodes alone. Nodes of
    coincident points and those of the last level stay whole.
    """
    rest, side, level = points, radius * TOP_RADII, 0
    leaves: DataFrame | None = None
    levels: list[DataFrame] = []
    while True:
        cell = rest.withColumns({"level": F.lit(level), "ix": F.floor(F.col("x") / side), "iy": F.floor(F.col("y") / side)})
        box = cell.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), *extra)
        apart = (F.col("x1") > F.col("x0")) | (F.col("y1") > F.col("y0"))
        box = checkpointed(box.withColumn("open", (F.col("n") > node_points) & apart & F.lit(level < HALVINGS)))
        levels.append(box)
        divided = box.where("open").select(*_NODE)
        last = divided.isEmpty()
        if not last:
            # divided nodes are few (points / node_points at most); their size decides the join
            cell = cell.join(divided.withColumn("open", F.lit(True)), _NODE, "left")
        done = cell if last else cell.where(F.col("open").isNull()).drop("open")
        leaves = done if leaves is None else leaves.unionByName(done)
        if last:
            return leaves, levels
        rest = checkpointed(_gathered(cell.where("open").drop("open", "level", "ix", "iy")))
        side, level = side / 2, level + 1


def _gathered(df: DataFrame) -> DataFrame:
    """The same rows on no more partitions than a shuffle has; the unions of a loop would double them every round."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _side(nodes: DataFrame, s: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{s}_{c}") for c in nodes.columns])


def _gap(sign: str) -> Column:
    """Squared distance of the nearest ('near') or farthest ('far') points two boxes may hold."""
    d = []
    for lo, hi in (("x0", "x1"), ("y0", "y1")):
        one, two = F.col(f"b_{lo}") - F.col(f"a_{hi}"), F.col(f"a_{lo}") - F.col(f"b_{hi}")
        d.append(F.greatest(F.lit(0.0), one, two) if sign == "near" else F.greatest(-one, -two))
    return d[0] * d[0] + d[1] * d[1]


def _descend(levels: list[DataFrame], radius: float, wholesale: bool, wanted: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of leaf nodes that may hold near points, each once; and pairs of nodes all of whose points are near.

    Starts with every coarsest node and its neighbours ahead, and descends both
    sides of a pair together, a level a step: pairs further apart than the radius
    are discarded (also those not ``wanted``), with ``wholesale`` certain ones are
    settled where they stand, and of the rest every divided side is replaced by its
    children. A node is compared with those around it only, so pairs grow with the nodes.
    """
    r2 = F.lit(radius * radius)
    top = levels[0]
    ahead = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])).alias("o")
    left = _side(top, "a").select("*", ahead)
    left = left.withColumns({"b_kind": F.col("a_kind"), "b_ix": F.col("a_ix") + F.col("o.dx"), "b_iy": F.col("a_iy") + F.col("o.dy")}).drop("o")
    front = left.join(_side(top, "b"), ["b_kind", "b_ix", "b_iy"])
    own = (F.col("a_level") == F.col("b_level")) & (F.col("a_ix") == F.col("b_ix")) & (F.col("a_iy") == F.col("b_iy"))
    found: DataFrame | None = None
    sure: DataFrame | None = None
    for level in range(len(levels)):
        front = front.where(_gap("near") <= r2)
        if wanted is not None:
            front = front.where(wanted)
        front = checkpointed(_gathered(front.withColumns({"sure": _gap("far") <= r2, "own": own})))
        last = level == len(levels) - 1
        if wholesale:
            s = front.where("sure")
            sure = s if sure is None else sure.unionByName(s)
            front = front.where(~F.col("sure"))
        split = F.col("a_open") | F.col("b_open")
        done = front.where(~split)
        found = done if found is None else found.unionByName(done)
        if last:
            break
        front = front.where(split).drop("sure")
        for s in "ab":
            kept = [c for c in front.columns if not c.startswith(f"{s}_")]
            up = front.where(f"{s}_open").select(*kept, F.col(f"{s}_kind"), F.col(f"{s}_ix").alias(f"{s}_ix_"), F.col(f"{s}_iy").alias(f"{s}_iy_"))
            kin = _side(levels[level + 1].withColumns({"ix_": F.floor(F.col("ix") / 2), "iy_": F.floor(F.col("iy") / 2)}), s)
            down = up.join(kin, [f"{s}_kind", f"{s}_ix_", f"{s}_iy_"]).drop(f"{s}_ix_", f"{s}_iy_")
            front = front.where(~F.col(f"{s}_open")).unionByName(down)
        # of a node with itself every unordered pair of children once
        order = F.struct("a_ix", "a_iy") <= F.struct("b_ix", "b_iy")
        front = front.where(~F.col("own") | order).drop("own")
    return found, sure


def _name(s: str = "") -> Column:
    return F.concat_ws(":", *[F.col(f"{s}{c}") for c in _NODE], F.col(f"{s}block"))


def _blocks(n: str, node_points: int) -> Column:
    return F.ceil(F.col(n) / F.lit(node_points)).cast("bigint")


def _tasks(found: DataFrame, node_points: int) -> DataFrame:
    """(a_node, b_node, own, task, a box, b box): leaf pairs grouped into tasks of one left node and right
    nodes of about ``node_points`` points in all. A leaf that could not be divided comes as hashed blocks."""
    f = found
    for s in "ab":
        f = f.withColumn(f"{s}_block", F.explode(F.sequence(F.lit(0).cast("bigint"), _blocks(f"{s}_n", node_points) - 1)))
    f = f.where(~F.col("own") | (F.col("a_block") <= F.col("b_block")))
    f = f.withColumns({"a_node": _name("a_"), "b_node": _name("b_"), "own": F.col("own") & (F.col("a_block") == F.col("b_block"))})
    w = Window.partitionBy("a_node").orderBy("b_node").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.least(F.col("b_n"), F.lit(node_points))).over(w), F.lit(0))
    f = f.withColumn("task", F.concat_ws("/", "a_node", F.floor(before / F.lit(4 * node_points))))
    return f.select("a_node", "b_node", "own", "task", *[f"a_{b}" for b in _BOX])


def _near(side_box: str, radius: float) -> Column:
    """Whether the point lies within the radius of the other node's box."""
    gx = F.greatest(F.lit(0.0), F.col(f"{side_box}_x0") - F.col("x"), F.col("x") - F.col(f"{side_box}_x1"))
    gy = F.greatest(F.lit(0.0), F.col(f"{side_box}_y0") - F.col("y"), F.col("y") - F.col(f"{side_box}_y1"))
    return gx * gx + gy * gy <= F.lit(radius * radius)


class _Join:
    """The relational upper part of a dual-tree join of a point set with itself."""

    def __init__(self, points: DataFrame, radius: float, node_points: int, wholesale: bool, payload: str | None = None, extra: list[Column] | None = None, wanted: Column | None = None):
        if "kind" not in points.columns:
            points = points.withColumn("kind", F.lit(0))
        points = points.where(F.col("kind").isNotNull())
        self.radius, self.columns = radius, ["id", "x", "y", *([payload] if payload else [])]
        self.leaves, self.levels = _tree(checkpointed(points.select(*self.columns, "kind")), radius, node_points, extra or [])
        found, self.sure = _descend(self.levels, radius, wholesale, wanted)
        heavy = None
        for box in self.levels:  # leaves over the limit: heaps of coincident points, at most points / node_points of them
            h = box.where(~F.col("open") & (F.col("n") > node_points)).select(*_NODE, _blocks("n", node_points).alias("blocks"))
            heavy = h if heavy is None else heavy.unionByName(h)
        block = F.lit(0).cast("bigint")
        nodes = self.leaves
        if not heavy.isEmpty():
            nodes = nodes.join(heavy, _NODE, "left")
            block = F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("bigint")
        nodes = nodes.withColumn("block", block).select(*self.columns, _name().alias("node"))
        self.nodes = checkpointed(nodes) if len(self.levels) > 1 else nodes
        self.tasks = checkpointed(_tasks(found, node_points))

    def assembled(self) -> DataFrame:
        """(task, right, own, id, x, y, payload) sorted by task: the points each task needs, and no others."""
        lefts = self.tasks.groupBy(F.col("a_node").alias("node"), "task").agg(F.max("own").alias("own"))
        left = self.nodes.join(lefts, "node").select("task", F.lit(False).alias("right"), "own", *self.columns)
        others = self.tasks.where(F.col("a_node") != F.col("b_node")).select(F.col("b_node").alias("node"), "task", *[f"a_{b}" for b in _BOX])
        right = self.nodes.join(others, "node").where(_near("a", self.radius)).select("task", F.lit(True).alias("right"), F.lit(None).cast("boolean").alias("own"), *self.columns)
        return left.unionByName(right).repartition("task").sortWithinPartitions("task", "right")

    def run(self, work: Callable, schema: str) -> DataFrame:
        return self.assembled().mapInArrow(_by_task(work, self.columns), schema)

    def sure_pairs(self) -> DataFrame | None:
        """The certain node pairs, or None where there are none."""
        return None if self.sure is None or self.sure.isEmpty() else self.sure

    def per_leaf(self, given: DataFrame, value: str, joined: Callable[[Column, Column], Column]) -> DataFrame:
        """(node columns, value): ``value`` of nodes handed down to the leaves, where ``joined(from above, own)`` combines it."""
        above: DataFrame | None = None
        out: DataFrame | None = None
        for level, box in enumerate(self.levels):
            own = box.join(given.where(F.col("level") == level).drop("level"), ["kind", "ix", "iy"], "left")
            up = F.lit(None)
            if above is not None:
                own = own.withColumns({"__px": F.floor(F.col("ix") / 2), "__py": F.floor(F.col("iy") / 2)}).join(above, ["kind", "__px", "__py"], "left")
                up = F.col("__above")
            own = own.select(*_NODE, "open", joined(up, F.col(value)).alias(value))
            own = checkpointed(_gathered(own.where(F.col(value).isNotNull())))
            leaf = own.where(~F.col("open")).drop("open")
            out = leaf if out is None else out.unionByName(leaf)
            above = own.where("open").select("kind", F.col("ix").alias("__px"), F.col("iy").alias("__py"), F.col(value).alias("__above"))
        return out


def _by_task(work: Callable, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over partitions sorted by task: ``work(own, right, *columns)`` per task, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []
        name = None

        def finish() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            right = t["right"].to_numpy().astype(bool)
            yield from work(bool(t["own"][0].as_py()), right, *(t[c].to_numpy() for c in columns))

        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("task").dictionary_encode()
            idx = code.indices.to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(idx)) + 1, [len(idx)]])
            for s, e in zip(cut[:-1], cut[1:]):
                task = code.dictionary[idx[s]].as_py()
                if held and task != name:
                    yield from finish()
                    held = []
                name = task
                held.append(batch.slice(s, e - s))
        if held:
            yield from finish()

    return run


def pairs_within(points: DataFrame, radius: float, node_points: int = NODE_POINTS) -> DataFrame:
    """(id_a, id_b): every unordered pair of different ids at most ``radius`` apart, once, id_a < id_b.

    ``points`` has unique ``id`` (bigint) and finite ``x``, ``y``; with a column ``kind`` only
    pairs of one kind come out (NULL is no kind). The upper part of the dual-tree join is
    relational: nodes of bounded size with their boxes, descended together from the
    coarsest level (_descend); each remaining pair of leaves is one task, which gets of
    the right node only the points near the left node's box. Within a task the two
    trees are traversed together (``functions.dualtree``). A crowded place becomes
    many nodes and many tasks, and a task streams its pairs out in bounded batches.
    The pairs themselves are as many as there are: where n points share a place,
    about n * n / 2; ``shared_places`` first takes the copies out. Empty input, no result.
    """

    def work(own, right, ids, x, y):
        import numpy as np

        from sylvaq.functions.dualtree import Tree, near_pairs

        a = Tree(x[~right], y[~right], ids[~right])
        todo = [(a, True)] if own else []
        if right.any():
            todo.append((Tree(x[right], y[right], ids[right]), False))
        for b, same in todo:
            for i, j in near_pairs(a, b, radius, same):
                p, q = a.tag[i], b.tag[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["id_a", "id_b"])

    return _Join(points, radius, node_points, False).run(work, "id_a bigint, id_b bigint")


def shared_places(points: DataFrame) -> DataFrame:
    """(id, place, size): every id with the smallest id at exactly its location and the number of ids there.

    The ids with ``id = place`` stand for the others in pairs_within: two different
    places are near if their representatives are, and ids of one place always are.
    """
    place = points.groupBy("x", "y").agg(F.min("id").alias("place"), F.count(F.lit(1)).alias("size"))
    return points.join(place, ["x", "y"]).select("id", "place", "size")


def counts_within(points: DataFrame, radius: float, node_points: int = NODE_POINTS) -> DataFrame:
    """(id, n): how many other ids lie within ``radius`` of each id, 0 included.

    With a column ``kind`` in ``points`` only ids of the same kind count (NULL is no kind
    and comes out in no row). As pairs_within, but certain node pairs are counted
    wholesale on every level, between tasks and within, so no pair is written.
    """

    def work(own, right, ids, x, y):
        from sylvaq.functions.dualtree import Tree, near_counts

        a = Tree(x[~right], y[~right], ids[~right])
        out = []
        if own:
            out.append((a.tag, near_counts(a, a, radius, True)[0]))
        if right.any():
            b = Tree(x[right], y[right], ids[right])
            ca, cb = near_counts(a, b, radius, False)
            out += [(a.tag, ca), (b.tag, cb)]
        for tag, n in out:
            yield pa.RecordBatch.from_arrays([pa.array(tag), pa.array(n)], names=["id", "n"])

    j = _Join(points, radius, node_points, True)
    parts = j.run(work, "id bigint, n bigint")
    sure = j.sure_pairs()
    if sure is not None:
        node = lambda s: [F.col(f"{s}_{c}").alias(c) for c in _NODE]
        add = sure.select(*node("a"), F.when(F.col("own"), F.col("a_n") - 1).otherwise(F.col("b_n")).alias("add")).unionByName(sure.where(~F.col("own")).select(*node("b"), F.col("a_n").alias("add")))
        add = checkpointed(add.groupBy(*_NODE).agg(F.sum("add").alias("add")))
        down = j.per_leaf(add, "add", lambda up, own: F.when(up.isNotNull() | own.isNotNull(), F.coalesce(up, F.lit(0)) + F.coalesce(own, F.lit(0))))
        parts = parts.unionByName(j.leaves.join(down, _NODE).select("id", F.col("add").alias("n")))
    return parts.groupBy("id").agg(F.sum("n").alias("n"))


def links_within(points: DataFrame, radius: float, node_points: int = NODE_POINTS) -> DataFrame:
    """(a, b): edges between ids whose components are those of the graph of all pairs within ``radius``.

    Every task reduces its part of the graph to one star per component, at most an
    edge per point; the points of certain node pairs hang on one of them. So the
    edges grow with the points, however many pairs there are.
    """

    def work(own, right, ids, x, y):
        import numpy as np

        from sylvaq.functions.dualtree import Tree, near_links
        from sylvaq.functions.graph import components

        a = Tree(x[~right], y[~right], ids[~right])
        tag, root = a.tag, near_links(a, a, radius, True) if own else np.arange(len(a.tag))
        if right.any():
            b = Tree(x[right], y[right], ids[right])
            tag, every = np.concatenate([a.tag, b.tag]), np.arange(len(a.tag) + len(b.tag))
            links = near_links(a, b, radius, False)
            root = components(len(tag), np.concatenate([every[: len(a.tag)], every]), np.concatenate([root, links]))
        low = np.full(len(tag), np.iinfo(np.int64).max)
        np.minimum.at(low, root, tag)
        low = low[root]
        keep = low != tag
        yield pa.RecordBatch.from_arrays([pa.array(tag[keep]), pa.array(low[keep])], names=["a", "b"])

    j = _Join(points, radius, node_points, True, extra=[F.min("id").alias("rep")])
    edges = j.run(work, "a bigint, b bigint")
    sure = j.sure_pairs()
    if sure is not None:
        reps = [sure.select(*[F.col(f"{s}_{c}").alias(c) for c in _NODE], F.col(f"{s}_rep").alias("rep_")) for s in "ab"]
        marked = checkpointed(reps[0].unionByName(reps[1]).groupBy(*_NODE).agg(F.min("rep_").alias("rep_")))
        down = j.per_leaf(marked, "rep_", lambda up, own: F.coalesce(up, own))
        edges = edges.unionByName(sure.where(~F.col("own")).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
        edges = edges.unionByName(j.leaves.join(down, _NODE).where(F.col("id") != F.col("rep_")).select(F.col("id").alias("a"), F.col("rep_").alias("b")))
    return edges


def least_near(points: DataFrame, radius: float, value: str, node_points: int = NODE_POINTS) -> DataFrame:
    """(id, value): for every id whose ``value`` (bigint) is NULL the least ``value`` of an id within ``radius``; ids without one do not come out.

    Meant for ids with few near partners that have a value: their pairs are looked at one by one.
    """
    none = -(1 << 63)

    def work(own, right, ids, x, y, v):
        import numpy as np

        from sylvaq.functions.dualtree import Tree, near_pairs

        side = {}
        for name, of in (("a", ~right), ("b", right)):
            for kind, has in (("with", v != none), ("without", v == none)):
                m = of & has
                side[name, kind] = Tree(x[m], y[m], np.flatnonzero(m)) if m.any() else None
        best = np.full(len(ids), np.iinfo(np.int64).max)
        for p, q in ([("a", "a")] if own else []) + [("a", "b"), ("b", "a")]:
            t, u = side[p, "without"], side[q, "with"]
            if t is not None and u is not None:
                for i, k in near_pairs(t, u, radius, False):
                    np.minimum.at(best, t.tag[i], v[u.tag[k]])
        hit = best != np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(best[hit])], names=["id", "value"])

    p = points.withColumn("value", F.coalesce(F.col(value), F.lit(none)))
    # a pair of nodes matters only if one has ids to serve and the other values
    open_, has = F.count_if(F.col("value") == none).alias("todo"), F.count_if(F.col("value") != none).alias("has")
    wanted = ((F.col("a_todo") > 0) & (F.col("b_has") > 0)) | ((F.col("b_todo") > 0) & (F.col("a_has") > 0))
    j = _Join(p, radius, node_points, False, payload="value", extra=[open_, has], wanted=wanted)
    return j.run(work, "id bigint, value bigint").groupBy("id").agg(F.min("value").alias("value"))
