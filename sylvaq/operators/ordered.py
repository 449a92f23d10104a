"""Exact order statistics of any size of group: range sort and prefix counts.

The rows are range-partitioned and sorted by (group, value). Sums per partition
and group form a small table whose running totals are each partition's offset,
so that every row gets its exact cumulative count without one task ever holding
a whole group: a group of any size is just a run of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaq.scratch import checkpointed

PARTITION = "__pid"


def prefix_counts(df: DataFrame, group: list[str], value: str, counts: list[str], partitions: int | None = None) -> DataFrame:
    """``group``, ``value``, ``counts`` and, per count ``c``, the columns ``c_upto`` and ``c_all``.

    ``c_upto`` is the sum of ``c`` over the rows of the group up to and including
    this one in (value) order, ``c_all`` the sum over the group. Rows should be
    unique in (group, value); callers pre-aggregate, which also takes the weight
    out of hot values before the shuffle. NULL group members form groups of their
    own; an empty input gives an empty result.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [*group, value, *counts]
    ordered = df.select(*cols).repartitionByRange(n, *group, value).sortWithinPartitions(*group, value)
    ordered = checkpointed(ordered.withColumn(PARTITION, F.spark_partition_id()))
    upto = [f"{c}_upto" for c in counts]
    types = {f.name: f.dataType for f in ordered.schema}
    schema = T.StructType([*ordered.schema.fields, *[T.StructField(u, types[c]) for c, u in zip(counts, upto)]])
    k, first = len(group), len(group) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        last, carry = None, None
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            change = np.zeros(m, bool)
            for i in range(k):
                code = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            head = [batch.column(i)[0].as_py() for i in range(k)]
            same = last is not None and head == last
            if not same:
                carry = [0] * len(counts)
            change[0] = True
            at = np.flatnonzero(change)
            sums = []
            for j in range(len(counts)):
                c = batch.column(first + j).to_numpy(zero_copy_only=False)
                run_sum = np.cumsum(c)
                base = run_sum[at] - c[at]
                base[0] -= carry[j]
                s = run_sum - np.repeat(base, np.diff(np.append(at, m)))
                sums.append(s)
                carry[j] = s[-1]
            last = [batch.column(i)[m - 1].as_py() for i in range(k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(s) for s in sums]], names=schema.names)

    local = ordered.mapInArrow(run, schema)
    # One row per (partition, group): at most partitions + groups rows.
    parts = ordered.groupBy(PARTITION, *group).agg(*[F.sum(c).cast(types[c]).alias(f"{c}_part") for c in counts])
    w = Window.partitionBy(*group)
    before = w.orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col(PARTITION).alias("__p"),
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        *[F.coalesce(F.sum(f"{c}_part").over(before), F.lit(0)).cast(types[c]).alias(f"{c}_off") for c in counts],
        *[F.sum(f"{c}_part").over(w).cast(types[c]).alias(f"{c}_all") for c in counts],
    )
    on = F.col(PARTITION) == F.col("__p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return local.join(parts, on).select(
        *cols,
        *[(F.col(u) + F.col(f"{c}_off")).alias(u) for c, u in zip(counts, upto)],
        *[F.col(f"{c}_all") for c in counts],
    )


def at_rank(value: str, upto: str, count: str, rank: Column) -> Column:
    """Aggregate: the value that holds the 0-based ``rank`` among rows of prefix_counts."""
    hit = (F.col(upto) > rank) & (F.col(upto) - F.col(count) <= rank)
    return F.max(F.when(hit, F.col(value)))


def quantile_of(value: str, count: str, p: float) -> Column:
    """Aggregate over rows of prefix_counts: exact quantile with linear interpolation."""
    place = F.lit(float(p)) * (F.col(f"{count}_all") - F.lit(1)).cast("double")
    low, up = F.floor(place), F.ceil(place)
    a = at_rank(value, f"{count}_upto", count, low)
    b = at_rank(value, f"{count}_upto", count, up)
    share = F.max(place - low)
    return F.when(a == b, a).otherwise(a + (b - a) * share)


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float], partitions: int | None = None) -> DataFrame:
    """``group`` and one column per entry of ``probs`` (name -> probability), exact.

    NULL values are skipped; groups without a value do not come out. Repeated
    values are counted together before the sort.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("cnt"))
    ranked = prefix_counts(counted, group, value, ["cnt"], partitions)
    return ranked.groupBy(*group).agg(*[quantile_of(value, "cnt", p).alias(name) for name, p in probs.items()])
