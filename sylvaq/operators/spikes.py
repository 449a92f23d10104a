"""Implausible readings per source: bounds, Hampel filter, stuck values.

The rows are range-sorted by (source, order, item) once. A source that lies wholly
in one range is judged in one ordered pass there; a source that reaches over a
border of the ranges, of which there is at most one per border however large it
is, is spread over tasks instead. Where a source falls depends on the ranges
alone, so both ways run at every size, and both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaq.operators.ordered import exact_quantiles, prefix_counts
from sylvaq.scratch import checkpointed

SOURCE = ["source", "field"]
#: Readings of a block when a source is spread; windows computed at a time in a task.
BLOCK, CHUNK = 8192, 1 << 16


def _wide(df: DataFrame, item: str, source: str, order: str, fields: list[str]) -> DataFrame:
    """(item, source, ord, v0, v1, ...): one row per item and place, repeated rows counted once."""
    v = {f: F.col(f"`{f}`").cast("double") for f in fields}
    kept = [F.when(~F.isnan(c) & (c != 0), c).alias(f"v{i}") for i, c in enumerate(v.values())]
    wide = df.where(F.col(f"`{item}`").isNotNull()).select(F.col(f"`{item}`").alias("item"), F.col(f"`{source}`").alias("source"), F.col(f"`{order}`").alias("ord"), *kept)
    return wide.groupBy("item", "source", "ord").agg(*[F.min(f"v{i}").alias(f"v{i}") for i in range(len(fields))])


def _unpivot(wide: DataFrame, fields: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v{i}").alias("v")) for i, f in enumerate(fields)])).alias("c")
    return wide.select("source", "item", "ord", cells).where(F.col("c.v").isNotNull()).select("source", "c.field", "item", "ord", "c.v")


def readings(df: DataFrame, item: str, source: str, order: str, fields: list[str]) -> DataFrame:
    """(source, field, item, ord, v): the readings, one row per item, field and place in its source.

    NULL, NaN and 0 are no readings. Repeated rows of an item count once, before
    the fields are unpivoted; if they disagree, the smallest reading counts, so the
    result does not depend on file order. Rows with NULL item have no identity and
    are left out; a NULL source is a source of its own.
    """
    return _unpivot(_wide(df, item, source, order, fields), fields)


def _join_stats(rows: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    s = stats.select(F.col("source").alias("__s"), F.col("field").alias("__f"), *names)
    on = F.col("source").eqNullSafe(F.col("__s")) & (F.col("field") == F.col("__f"))
    return rows.join(s, on, "left").drop("__s", "__f")


def source_spread(rows: DataFrame) -> DataFrame:
    """Readings with ``med`` and ``mad``, the exact median of their source and field and the
    median distance from it. Both come from range sorts with prefix counts, so a
    source of any size is spread over many tasks."""
    med = exact_quantiles(rows, SOURCE, "v", {"med": 0.5})
    off = _join_stats(rows, med, ["med"])
    off = checkpointed(off.withColumn("dist", _gap(F.col("v"), F.col("med"))))
    mad = exact_quantiles(off, SOURCE, "dist", {"mad": 0.5})
    return _join_stats(off, mad, ["mad"])


def numbered(rows: DataFrame) -> DataFrame:
    """Readings with ``at``, their exact place from 0 in the order of their source and field (ties by item), and ``size``.

    By a range sort with prefix counts, so places are exact whatever the order
    numbers are: missing, repeated or far apart.
    """
    r = rows.select(*SOURCE, F.struct("ord", "item", "v").alias("o"), F.lit(1).cast("bigint").alias("one"))
    r = prefix_counts(r, SOURCE, "o", ["one"])
    return checkpointed(r.select(*SOURCE, "o.*", (F.col("one_upto") - 1).alias("at"), F.col("one_all").alias("size")))


def stuck_runs(places: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """Items (source, field, item) inside runs of at least ``least`` equal readings in a row; ``places``: numbered().

    Runs are first found inside blocks of ``block`` consecutive readings, a window of
    bounded size; then only each block's first and last run, two rows a block, are
    stitched along the source.
    """
    b = places.withColumn("blk", F.floor(F.col("at") / F.lit(block)))
    part = [*SOURCE, "blk"]
    w = Window.partitionBy(*part).orderBy("at")
    b = b.withColumn("new", F.when(F.col("v") == F.lag("v").over(w), 0).otherwise(1))
    b = b.withColumn("run", F.sum("new").over(w))
    b = b.withColumn("len", F.count(F.lit(1)).over(Window.partitionBy(*part, "run")))
    b = b.withColumn("runs", F.max("run").over(Window.partitionBy(*part)))
    b = checkpointed(b.select(*part, "item", "v", "run", "len", "runs"))
    inside = b.where(F.col("len") >= least)
    edges = b.where((F.col("run") == 1) | (F.col("run") == F.col("runs"))).groupBy(*part, "run", "runs").agg(F.max("v").alias("v"), F.max("len").alias("len"))
    along = Window.partitionBy(*SOURCE).orderBy("blk", "run")
    joined = (F.col("run") == 1) & (F.col("v") == F.lag("v").over(along))
    edges = edges.withColumn("isle", F.sum(F.when(joined, 0).otherwise(1)).over(along))
    edges = edges.withColumn("total", F.sum("len").over(Window.partitionBy(*SOURCE, "isle")))
    grown = edges.where((F.col("total") >= least) & (F.col("len") < least)).select(
        F.col("source").alias("__s"), F.col("field").alias("__f"), F.col("blk").alias("__b"), F.col("run").alias("__r")
    )
    on = F.col("source").eqNullSafe(F.col("__s")) & (F.col("field") == F.col("__f")) & (F.col("blk") == F.col("__b")) & (F.col("run") == F.col("__r"))
    stitched = b.where(F.col("len") < least).join(grown, on, "left_semi")
    return inside.select(*SOURCE, "item").unionByName(stitched.select(*SOURCE, "item"))


def _middle(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the first ``n`` values of each row; blanks are NaN, which sorts behind every reading."""
    a, row = np.sort(a, axis=1), np.arange(len(a))
    lo, hi = a[row, (n - 1) // 2], a[row, n // 2]
    with np.errstate(invalid="ignore"):
        return np.where(lo == hi, lo, lo + (hi - lo) * 0.5)


def _window_level(a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of each row and median distance from it."""
    med = _middle(a, n)
    with np.errstate(invalid="ignore"):
        off = np.where(a == med[:, None], 0.0, np.abs(a - med[:, None]))
    return med, _middle(off, n)


def _levels(v: np.ndarray, half: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Median and median distance in the window of every reading: the whole of ``v``, or ``half`` on either side."""
    n = len(v)
    if half is None:
        at = [(n - 1) // 2, n // 2]

        def middle(x: np.ndarray) -> float:
            lo, hi = np.partition(x, at)[at]
            return lo if lo == hi else lo + (hi - lo) * 0.5

        med = middle(v)
        mad = middle(np.where(v == med, 0.0, np.abs(v - med)))
        return np.full(n, med), np.full(n, mad)
    padded = np.concatenate([np.full(half, np.nan), v, np.full(half, np.nan)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    place = np.arange(n)
    size = np.minimum(place, half) + np.minimum(n - 1 - place, half) + 1
    med, mad = np.empty(n), np.empty(n)
    for s in range(0, n, CHUNK):
        part = slice(s, s + CHUNK)
        med[part], mad[part] = _window_level(wide[part], size[part])
    return med, mad


def _gap(v: Column, med: Column) -> Column:
    """Distance from a median; inf - inf has no value, an infinite median leaves finite readings infinitely far."""
    return F.when(v == med, F.lit(0.0)).otherwise(F.abs(v - med))


@dataclass(frozen=True)
class Rules:
    """What is judged: physical bounds, the Hampel rule in a window, stuck values."""

    low: float = 0.0
    high: float = 60.0
    k: float = 9.0
    half: int | None = None
    floor: float = 0.0
    run: int = 8


def _whole_sources(rows: DataFrame, fields: list[str], rules: Rules, flagged_only: bool) -> DataFrame:
    """Readings judged source by source in one pass over rows sorted by (source, ord, item)."""
    kinds = {f.name: f.dataType for f in rows.schema}
    flags = ["bounds", "spike", "stuck"]
    schema = T.StructType(
        [T.StructField("source", kinds["source"]), T.StructField("field", T.StringType()), T.StructField("item", kinds["item"]), T.StructField("ord", kinds["ord"])]
        + [T.StructField(c, T.DoubleType()) for c in ("v", "med", "mad")] + [T.StructField(c, T.BooleanType()) for c in flags]
    )

    def judged(t: pa.Table, i: int) -> pa.RecordBatch | None:
        col = t.column(f"v{i}")
        v = col.drop_null().to_numpy()
        if not len(v):
            return None
        with np.errstate(invalid="ignore"):
            med, mad = _levels(v, rules.half)
            dist = np.where(v == med, 0.0, np.abs(v - med))
            edge = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1, [len(v)]])
            size = np.diff(edge)
            found = [(v < rules.low) | (v > rules.high) | np.isinf(v), dist > rules.k * np.maximum(mad, rules.floor), np.repeat(size, size) >= rules.run]
        keep = np.flatnonzero(found[0] | found[1] | found[2]) if flagged_only else np.arange(len(v))
        if not len(keep):
            return None
        where = pa.array(np.flatnonzero(col.is_valid().to_numpy())[keep])
        own = [t.column(c).take(where).combine_chunks() for c in ("source", "item", "ord")]
        return pa.RecordBatch.from_arrays([own[0], pa.array([fields[i]] * len(keep)), *own[1:], *[pa.array(x[keep]) for x in (v, med, mad, *found)]], names=schema.names)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ready: list[pa.RecordBatch] = []
        name: object = ()

        def finish() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            ready.extend(b for i in range(len(fields)) if (b := judged(t, i)) is not None)

        for batch in parts:
            if not batch.num_rows:
                continue
            code = batch.column("source").dictionary_encode()
            idx = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(idx)) + 1, [len(idx)]])
            for s, e in zip(cut[:-1], cut[1:]):
                own = None if idx[s] < 0 else code.dictionary[int(idx[s])].as_py()
                if held and own != name:
                    finish()
                    held = []
                name = own
                held.append(batch.slice(s, e - s))
            if len(ready) >= 512:  # small findings are gathered to batches of a useful size
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if held:
            finish()
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return rows.mapInArrow(work, schema)


def _windows(places: DataFrame, half: int, block: int = BLOCK) -> DataFrame:
    """numbered() readings with ``med`` and ``mad`` of the ``half`` readings on either side.

    Windows run inside blocks of ``block`` places, which also receive the ``half``
    readings before and after them, so they are whole and no task holds a source.
    """
    at = F.col("at")
    own = F.floor(at / F.lit(block))
    first, last = F.greatest(F.lit(0), F.floor((at - half) / F.lit(block))), F.floor(F.least(F.col("size") - 1, at + half) / F.lit(block))
    b = places.select(*SOURCE, "item", "ord", "v", "at", own.alias("own"), F.explode(F.sequence(first, last)).alias("blk"))
    w = Window.partitionBy(*SOURCE, "blk").orderBy("at").rowsBetween(-half, half)
    b = b.withColumn("near", F.collect_list("v").over(w)).where(F.col("own") == F.col("blk")).drop("own", "blk", "at")
    schema = T.StructType([*b.drop("near").schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("med", "mad")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            n = np.diff(near.offsets.to_numpy())
            a = np.full((len(n), 2 * half + 1), np.nan)
            a[np.arange(2 * half + 1) < n[:, None]] = near.flatten().to_numpy()
            cols = [c for name, c in zip(batch.schema.names, batch.columns) if name != "near"]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x) for x in _window_level(a, n)]], names=schema.names)

    return b.mapInArrow(run, schema)


def _spread_sources(wide: DataFrame, fields: list[str], rules: Rules, flagged_only: bool) -> DataFrame:
    """The same for sources of any size: medians by range sort and prefix counts or windows in
    blocks, runs stitched across blocks."""
    r = checkpointed(_unpivot(wide, fields))
    places = numbered(r)
    level = source_spread(r).drop("dist") if rules.half is None else _windows(places, rules.half)
    stuck = stuck_runs(places, rules.run).select(F.col("source").alias("__s"), F.col("field").alias("__f"), F.col("item").alias("__i"), F.lit(True).alias("stuck"))
    on = F.col("source").eqNullSafe(F.col("__s")) & (F.col("field") == F.col("__f")) & (F.col("item") == F.col("__i"))
    out = level.join(stuck.distinct(), on, "left")
    v = F.col("v")
    out = out.select(
        *SOURCE, "item", "ord", "v", "med", "mad", ((v < rules.low) | (v > rules.high) | (F.abs(v) == float("inf"))).alias("bounds"),
        (_gap(v, F.col("med")) > F.lit(float(rules.k)) * F.greatest("mad", F.lit(float(rules.floor)))).alias("spike"), F.coalesce("stuck", F.lit(False)).alias("stuck"),
    )
    return out.where(F.col("bounds") | F.col("spike") | F.col("stuck")) if flagged_only else out


def judged_readings(df: DataFrame, item: str, source: str, order: str, fields: list[str], rules: Rules = Rules(), flagged_only: bool = False, partitions: int | None = None) -> DataFrame:
    """(source, field, item, ord, v, med, mad, bounds, spike, stuck): every reading (or those with a flag) and what speaks against it.

    ``bounds``: below ``low``, above ``high`` or infinite. ``spike``: further from the
    median of its window than ``k`` times the window's median distance from it (the
    Hampel filter); the window is the whole source, or with ``half`` that many
    readings on either side, clipped at the ends of the source; ``floor`` is the
    least distance used, so by default a window whose spread is 0 has every other
    value flagged. ``stuck``: part of ``run`` or more equal readings in a row.
    Readings and repeated rows: see readings(). Ties in the order are broken by
    item; NULL order numbers come first. An item that stands at several places of a
    source is judged at each, and stuck at all if at one. Empty tables, all-missing
    fields and single readings raise no flag; a single reading only out of bounds.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = _wide(df, item, source, order, fields)
    rows = checkpointed(wide.repartitionByRange(n, "source", "ord", "item").sortWithinPartitions("source", "ord", "item").withColumn("__p", F.spark_partition_id()))
    spans = rows.groupBy(F.col("source").alias("__large")).agg((F.min("__p") < F.max("__p")).alias("over"))
    over = checkpointed(spans.where("over").select("__large"))  # at most a source per border of the ranges
    rows = rows.drop("__p")
    if over.isEmpty():
        return _whole_sources(rows, fields, rules, flagged_only)
    same = F.col("source").eqNullSafe(F.col("__large"))
    whole = _whole_sources(rows.join(F.broadcast(over), same, "left_anti"), fields, rules, flagged_only)
    return whole.unionByName(_spread_sources(rows.join(F.broadcast(over), same, "left_semi"), fields, rules, flagged_only))


def implausible_readings(df: DataFrame, item: str, source: str, order: str, fields: list[str], rules: Rules = Rules(), partitions: int | None = None) -> DataFrame:
    """(item, field, reason): the flags of judged_readings, a row per reading and reason."""
    flagged = judged_readings(df, item, source, order, fields, rules, True, partitions)
    reasons = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in ("bounds", "spike", "stuck")]))
    return flagged.select("item", "field", F.explode(reasons).alias("reason"))
