"""Dyadic Count-sketches: percentiles of very large numeric columns with bounded rank error.

A value is encoded to an order-preserving 32-bit code, the leading bits of its
double. For every binary resolution of the codes the sketch keeps signed
counters: exact ones for the upper resolutions, which have few prefixes, and a
Count-sketch of ``ROWS`` x ``WIDTH`` counters for each finer one. Everything is a
sum over values, so sketches merge by addition, and a deletion is an update
with a negative count. A rank is inverted by descending the resolutions: the
left child's estimated count tells on which side the rank lies.

While a sketch has seen few distinct codes it holds their counts instead of the
counters (the sparse form, from which the counters follow); partial results of
small partitions thus never outgrow their rows. Queries always descend the
counters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaq.ship import ship

BITS, EXACT, ROWS, WIDTH = 32, 11, 5, 1024
#: Stated bound of the rank error as a share of the count, beyond the values that share a cell
#: with the answer (a code's cell is 2**-20 of its value wide; values closer than that are one). The standard deviation of a
#: descent is at most about sqrt(sketched levels) / WIDTH * 0.56 = 0.0025 in the worst
#: case (as many equally heavy values as counters at every level), a quarter of it.
RANK_ERROR = 0.01
#: Distinct codes beyond which the sparse form gives way to counters.
SPARSE = 40_000
DEPTHS = BITS - EXACT


def encode(v: np.ndarray) -> np.ndarray:
    """Order-preserving 32-bit codes of finite doubles; relative resolution 2**-20."""
    bits = (np.asarray(v, np.float64) + 0.0).view(np.uint64)
    neg = bits >> np.uint64(63) == 1
    return (np.where(neg, ~bits, bits | np.uint64(1 << 63)) >> np.uint64(32)).astype(np.uint32)


def _edge(code: int, high: bool) -> float:
    bits = (int(code) << 32) | (0xFFFFFFFF if high else 0)
    bits = bits & 0x7FFFFFFFFFFFFFFF if bits >> 63 else ~bits & 0xFFFFFFFFFFFFFFFF
    return float(np.uint64(bits).view(np.float64))


def decode(code: int) -> float:
    """The shortest decimal number inside the code's cell."""
    lo, hi = sorted((_edge(code, False), _edge(code, True)))
    if lo <= 0 <= hi:
        return 0.0
    mid = lo + (hi - lo) / 2
    for digits in range(1, 18):
        x = float(f"{mid:.{digits}g}")
        if lo <= x <= hi:
            return x
    return mid


@lru_cache(maxsize=1)
def _seeds() -> np.ndarray:
    """Fixed hash seeds, one per depth and row, from a counter-based generator."""
    return _mix(np.arange(1, DEPTHS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(DEPTHS, ROWS)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _slots(prefix: np.ndarray, depth: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each prefix at a sketched depth (0 is the coarsest)."""
    h = _mix(prefix.astype(np.uint64) ^ _seeds()[depth, row])
    return (h & np.uint64(WIDTH - 1)).astype(np.int64), 1 - 2 * (h >> np.uint64(63)).astype(np.int64)


def _together(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with their summed counts."""
    if not len(codes):
        return codes, counts
    if (codes[1:] < codes[:-1]).any():
        o = np.argsort(codes, kind="stable")
        codes, counts = codes[o], counts[o]
    at = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
    return codes[at], np.add.reduceat(counts, at)


class Sketch:
    """A dyadic Count-sketch of one group of values."""

    def __init__(self, sparse: int = SPARSE) -> None:
        self.sparse = sparse
        self.codes, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.top: np.ndarray | None = None
        self.cells: np.ndarray | None = None

    @property
    def n(self) -> int:
        return int(self.counts.sum() if self.top is None else self.top.sum())

    def add(self, codes: np.ndarray, counts: np.ndarray) -> "Sketch":
        """Adds ``counts`` (negative: deletions) of ``codes``."""
        if self.top is None:
            c, k = _together(np.concatenate([self.codes, codes]), np.concatenate([self.counts, counts]))
            self.codes, self.counts = c[k != 0], k[k != 0]
            if len(self.codes) > self.sparse:
                self.densify()
        else:
            self._update(*_together(codes, counts))
        return self

    def densify(self) -> "Sketch":
        if self.top is None:
            self.top, self.cells = np.zeros(1 << EXACT, np.int64), np.zeros((DEPTHS, ROWS, WIDTH), np.int64)
            self._update(self.codes, self.counts)
            self.codes, self.counts = self.codes[:0], self.counts[:0]
        return self

    def _update(self, codes: np.ndarray, counts: np.ndarray) -> None:
        for depth in range(DEPTHS - 1, -1, -1):
            for row in range(ROWS):
                slot, sign = _slots(codes, depth, row)
                self.cells[depth, row] += np.rint(np.bincount(slot, weights=sign * counts, minlength=WIDTH)).astype(np.int64)
            codes, counts = _together(codes >> np.uint32(1), counts)
        self.top += np.rint(np.bincount(codes, weights=counts, minlength=1 << EXACT)).astype(np.int64)

    def merge(self, other: "Sketch", sign: int = 1) -> "Sketch":
        """Adds (or with ``sign`` -1 takes away) another sketch."""
        if other.top is None:
            return self.add(other.codes, sign * other.counts)
        self.densify()
        self.top += sign * other.top
        self.cells += sign * other.cells
        return self

    def _estimate(self, prefix: np.ndarray, depth: int) -> np.ndarray:
        est = []
        for row in range(ROWS):
            slot, sign = _slots(prefix, depth, row)
            est.append(sign * self.cells[depth, row][slot])
        return np.median(np.stack(est), axis=0)

    def quantiles(self, probs: np.ndarray) -> list[float | None]:
        """Values at the given probabilities; None for an empty sketch."""
        n = self.n
        if n <= 0:
            return [None] * len(probs)
        self.densify()
        rank = np.clip(np.ceil(np.asarray(probs) * n), 1, n)
        upto = np.cumsum(self.top)
        prefix = np.minimum(np.searchsorted(upto, rank), (1 << EXACT) - 1)
        rank = rank - (upto[prefix] - self.top[prefix])
        whole = self.top[prefix].astype(float)
        prefix = prefix.astype(np.uint32)
        for depth in range(DEPTHS):
            left = prefix << np.uint32(1)
            a, b = self._estimate(left, depth), self._estimate(left + np.uint32(1), depth)
            # both children together are the parent: spread the disagreement evenly
            a = np.clip((a + whole - b) / 2, 0, whole)
            right = rank > a
            rank = np.where(right, rank - a, rank)
            whole = np.where(right, whole - a, a)
            prefix = left + right.astype(np.uint32)
        return [decode(c) for c in prefix]

    def to_bytes(self) -> bytes:
        def pack(a: np.ndarray) -> bytes:
            small = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not len(a) or (a.min() >= np.iinfo(t).min and a.max() <= np.iinfo(t).max))
            return bytes([np.dtype(small).itemsize]) + a.astype(small).tobytes()

        if self.top is None:
            gaps = np.diff(self.codes, prepend=np.uint32(0))
            return b"S" + zlib.compress(len(self.codes).to_bytes(8, "little") + gaps.tobytes() + pack(self.counts), 1)
        return b"D" + zlib.compress(pack(np.concatenate([self.top, self.cells.ravel()])), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> "Sketch":
        def unpack(raw: bytes) -> np.ndarray:
            return np.frombuffer(raw, f"i{raw[0]}", offset=1).astype(np.int64)

        s, raw = cls(), zlib.decompress(data[1:])
        if data[:1] == b"S":
            k = int.from_bytes(raw[:8], "little")
            s.codes = np.cumsum(np.frombuffer(raw, np.uint32, k, 8), dtype=np.uint32)
            s.counts = unpack(raw[8 + 4 * k :])
        else:
            a = unpack(raw)
            s.top, s.cells = a[: 1 << EXACT].copy(), a[1 << EXACT :].reshape(DEPTHS, ROWS, WIDTH).copy()
        return s


def _sketch_schema(df: DataFrame, group: list[str]) -> T.StructType:
    return T.StructType([*[df.schema[g] for g in group], T.StructField("field", T.StringType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])


#: Held codes after which a task writes what it has and starts afresh.
HELD = 8_000_000


def build_sketches(df: DataFrame, group: list[str], values: list[str], low: float = float("-inf"), sparse: int = SPARSE) -> DataFrame:
    """(group, field, n, sketch): partial sketches, one or more per group and field.

    One narrow pass: each task sketches its own rows, so what leaves it is at most
    the smaller of its distinct values and its counters. Counted are finite values
    of at least ``low``; NULL, NaN and infinities are not. NULL group members form
    a group of their own. Groups without a counted value do not come out. A part of
    more than ``sparse`` distinct codes is shipped as counters.
    """
    ship(df.sparkSession)
    schema = _sketch_schema(df, group)
    narrow = df.select(*[F.col(f"`{g}`") for g in group], *[F.col(f"`{v}`").cast("double").alias(f"__v{i}") for i, v in enumerate(values)])
    k = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}

        def flush() -> pa.RecordBatch:
            keys = list(held)
            cols = [pa.array([key[i] for key in keys], t) for i, t in enumerate(types)]
            cols += [pa.array([values[key[k]] for key in keys]), pa.array([s.n for s in held.values()], pa.int64()), pa.array([s.to_bytes() for s in held.values()], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        types: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(i).type for i in range(k)]
            gid, members = np.zeros(batch.num_rows, np.int64), 1
            parts = []
            for i in range(k):
                enc = batch.column(i).dictionary_encode()
                size = len(enc.dictionary) + 1
                gid = gid * size + enc.indices.fill_null(size - 1).to_numpy(zero_copy_only=False)
                parts.append((size, [*enc.dictionary.to_pylist(), None]))
            for j in range(len(values)):
                v = batch.column(k + j).to_numpy(zero_copy_only=False).astype(float)
                use = np.isfinite(v) & (v >= low)
                code = encode(v[use])
                both = (gid[use].astype(np.uint64) << np.uint64(32)) | code
                both, counts = np.unique(both, return_counts=True)
                own = (both >> np.uint64(32)).astype(np.int64)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) if len(own) else np.zeros(1, np.int64)
                for s, e in zip(cut[:-1], cut[1:]):
                    key, g = [], int(own[s])
                    for size, names in reversed(parts):
                        key.append(names[g % size])
                        g //= size
                    key = (*reversed(key), j)
                    held.setdefault(key, Sketch(sparse)).add((both[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts[s:e])
            if sum(len(x.codes) if x.top is None else DEPTHS * ROWS * WIDTH for x in held.values()) > HELD:
                yield flush()
        if held:
            yield flush()

    return narrow.mapInArrow(run, schema)


def merge_sketches(sketches: DataFrame, group: list[str], salts: int = 32) -> DataFrame:
    """(group, field, n, sketch): one sketch per group and field, the sum of its parts.

    Two steps: parts are first merged within ``salts`` random shares of each group,
    then the shares are; a task streams over its parts and holds one sum per group.
    """
    ship(sketches.sparkSession)
    keys = [*group, "field"]
    schema = _sketch_schema(sketches, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, types = None, Sketch(), None

        def row() -> pa.RecordBatch:
            cols = [pa.array([x], t) for x, t in zip(now, types)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([total.n], pa.int64()), pa.array([total.to_bytes()], pa.binary())], names=schema.names)

        for batch in batches:
            at = batch.schema.get_field_index("sketch")
            cols = [batch.column(i).to_pylist() for i in range(len(keys))]
            for *key, data in zip(*cols, batch.column(at).to_pylist()):
                if now is not None and key != now:
                    yield row()
                    total = Sketch()
                now, types = key, [batch.schema.field(i).type for i in range(len(keys))]
                total.merge(Sketch.from_bytes(data))
        if now is not None:
            yield row()

    parts = sketches.select(*keys, "sketch")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("sketch"), F.lit(salts))).repartition(*keys, "salt").sortWithinPartitions(*keys, "salt")
    some = salted.select(*keys, "sketch").mapInArrow(run, schema)
    return some.select(*keys, "sketch").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def quantiles(sketches: DataFrame, group: list[str], probs: list[float]) -> DataFrame:
    """(group, field, n, prob, value): the percentiles of every sketch, within RANK_ERROR of the rank, up to the width of a code's cell."""
    fields = [f for f in _sketch_schema(sketches, group).fields if f.name != "sketch"]
    schema = T.StructType([*fields, T.StructField("prob", T.DoubleType()), T.StructField("value", T.DoubleType())])
    p = np.array(probs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(batch.num_columns - 1).to_pylist()
            found = [Sketch.from_bytes(d).quantiles(p) for d in data]
            take = pa.array(np.repeat(np.arange(len(data)), len(p)))
            cols = [batch.column(i).take(take) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.tile(p, len(data))), pa.array([x for f in found for x in f], pa.float64())], names=schema.names)

    return sketches.select(*group, "field", "n", "sketch").mapInArrow(run, schema)
