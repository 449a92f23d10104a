"""Random forests per group on Spark ML: out-of-fold scores, importances, storing and loading."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaq.operators.regression import complete, row_numbers, scores
from sylvaq.scratch import checkpointed
from sylvaq.ship import ship

#: Bins of a feature (the default of Spark ML forests); trees grown in one task.
BINS, BLOCK = 32, 25
#: Trees whose weights are drawn together, the rows of a share of a large group, and the rows of trees worked on at once.
TREES, SHARE, AT_ONCE = 4, 50_000, 150_000
#: Nodes of fewer rows have their cuts found in sorted order, others by counts per bin; features of few bins always by counts.
SORTED, NARROW = 24, 4
#: Places of 5 bits in a bigint.
PACK = 12


def forest(features: list[str], target: str, trees: int, depth: int, seed: int = 42) -> Pipeline:
    """Assembler and forest; every split may use all features. Depth is at most 30."""
    rf = RandomForestRegressor(featuresCol="__features", labelCol=target, predictionCol="pred", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__features"), rf])


def grown(n: np.ndarray, s: np.ndarray, bins: np.ndarray, depth: int, width: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Predictions (trees, cells) and variance reductions (trees, features) of trees grown level by level, all at once.

    ``n``, ``s``: weight and weighted sum of the target of each tree in each cell;
    ``bins``: (cells, features). Cells without weight follow the splits of the others.
    A tree without any weight predicts NaN. Of splits that are as good but for
    rounding the first one is taken, so sums added up in another order give the
    same trees.
    """
    trees, cells = n.shape
    k = bins.shape[1]
    pred, gains = np.full(trees * cells, np.nan), np.zeros((trees, k))
    node, at = np.repeat(np.arange(trees), cells), np.arange(trees * cells)
    tree = np.arange(trees)
    n, s, low = n.ravel().astype(float), s.ravel().astype(float), 1e-12 * max(float(np.abs(s).max(initial=0.0)), 1e-300)
    tiny = 1e-12 * float(np.divide(s**2, n, out=np.zeros_like(s), where=n > 0).max(initial=0.0))
    for level in range(depth + 1):
        m = len(tree)
        total, sums = np.bincount(node, n[at], m), np.bincount(node, s[at], m)
        with np.errstate(divide="ignore", invalid="ignore"):
            value, base = sums / total, np.where(total > 0, sums**2 / total, 0.0)
        best, which, cut = np.full(m, -np.inf), np.zeros(m, int), np.zeros(m, int)
        for j in range(k if level < depth else 0):
            place = node * width + bins[at % cells, j]
            nl = np.bincount(place, n[at], m * width).reshape(m, width).cumsum(1)[:, :-1]
            sl = np.bincount(place, s[at], m * width).reshape(m, width).cumsum(1)[:, :-1]
            nr, sr = total[:, None] - nl, sums[:, None] - sl
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where((nl > 0) & (nr > 0), sl**2 / nl + sr**2 / nr, -np.inf)
            top = score.max(1)
            near = np.where(top > -np.inf, np.maximum(1e-10 * top, tiny), 0.0)
            c = (score >= (top - near)[:, None]).argmax(1)
            better = top > best + near
            best, which, cut = np.where(better, top, best), np.where(better, j, which), np.where(better, c, cut)
        split = best - base > np.maximum(1e-10 * base, low)
        done = ~split[node]
        pred[at[done]] = value[node[done]]
        if not split.any():
            break
        np.add.at(gains, (tree[split], which[split]), (best - base)[split])
        at, node = at[~done], node[~done]
        right = bins[at % cells, which[node]] > cut[node]
        node = 2 * (np.cumsum(split) - 1)[node] + right
        tree = np.repeat(tree[split], 2)
    return pred.reshape(trees, cells), gains


def _gains(place, w, e, n, width):
    """(cuts, nodes): by how much each cut lowers the squared errors; 0 for cuts with an empty side. ``e``: weighted distance to the node's mean."""
    m = len(n)
    nl, d = np.bincount(place, w, m * width).reshape(width, m), np.bincount(place, e, m * width).reshape(width, m)
    if m < 64:
        nl, d = nl.cumsum(0), d.cumsum(0)
    else:
        for c in range(1, width - 1):
            nl[c] += nl[c - 1]
            d[c] += d[c - 1]
    nl, d = nl[:-1], d[:-1]
    d *= d
    d *= n
    both = n - nl
    both *= nl
    off = both <= 0
    both += off
    d /= both
    d *= ~off
    return d


def predicted(weights: np.ndarray, y: np.ndarray, bins: np.ndarray, asked: np.ndarray, depth: int) -> np.ndarray:
    """Predictions (trees, asked rows) of the same trees as ``grown``, for rows that are mostly in cells of their own.

    ``weights``: (trees, rows); ``y``: target; ``bins``, ``asked``: places (rows, features)
    of the rows and of those to predict, below BINS. Only rows of weight are worked on, in
    the order of their nodes. Cuts of a node of few rows are looked for among its sorted rows,
    so the work of a level grows with the rows left, not with nodes times bins.
    """
    trees, k = len(weights), bins.shape[1]
    out = np.full(trees * len(asked), np.nan)
    tree, row = np.nonzero(weights)
    if not len(row) or not len(asked):
        return out.reshape(trees, -1)
    flat, places = np.ascontiguousarray(bins).ravel(), np.ascontiguousarray(asked).ravel()
    packed = np.stack(_packed(bins)) if k else np.zeros((0, len(bins)), np.int64)
    width = bins.max(0).astype(int) + 1
    narrow, wide = [j for j in range(k) if 1 < width[j] <= NARROW], [j for j in range(k) if width[j] > NARROW]
    w, node, m = weights[tree, row].astype(float), tree, trees
    v = y[row]
    goal, at, ask = np.arange(len(out)), np.repeat(np.arange(trees), len(asked)), np.tile(np.arange(len(asked)), trees) * k
    low, tiny = 1e-12 * max(float(np.abs(w * v).max()), 1e-300), 1e-12 * float((w * v**2).max())
    for level in range(depth + 1):
        size, n, s = np.bincount(node, minlength=m), np.bincount(node, w, m), np.bincount(node, w * v, m)
        value = np.divide(s, n, out=np.full(m, np.nan), where=n > 0)
        base = np.where(n > 0, s * value, 0.0)
        best, which, cut = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        many = size >= SORTED
        for counted in (True, False) if level < depth else ():
            ids = np.flatnonzero(many if counted else ~many & (size > 1))
            if not len(ids):
                continue
            if len(ids) == m:
                own, r, we, mean = node, row, w, v - value[node]
            else:
                at_ = np.full(m, -1)
                at_[ids] = np.arange(len(ids))
                own = at_[node]
                pick = np.flatnonzero(own >= 0)
                own, r, we = own[pick], row[pick], w[pick]
                mean = v[pick] - value[ids][own]
            e, x, total = we * mean, packed[:, r], n[ids]
            bin_of = lambda j: (x[j // PACK] >> 5 * (j % PACK)) & 31
            count = lambda j: _gains(bin_of(j) * len(ids) + own, we, e, total, width[j])
            if counted:
                top_ = np.zeros(len(ids))
                for j in sorted(narrow + wide):
                    gain = count(j)
                    top = gain.max(0)
                    near = np.maximum(1e-10 * (top + base[ids]), tiny)
                    i = np.flatnonzero(top > (top_ + near if j else 0))
                    top_[i], which[ids[i]] = top[i], j
                    cut[ids[i]] = (gain[:, i] >= np.maximum(top - near, 1e-300)[i]).argmax(0)
                best[ids] = top_
                continue
            few = {j: count(j) for j in narrow}
            z = we + 1j * e
            begin = np.append(0, np.cumsum(size[ids]))[:-1]
            before, whole = (np.cumsum(total) - total)[own], total[own]
            head = (own << 25) | np.arange(len(own))
            gains, seen = np.empty((len(wide), len(own))), np.empty((len(wide), len(own)), np.uint8)
            for i, j in enumerate(wide):
                key = bin_of(j)
                key <<= 20
                key |= head
                key.sort()
                c = z[key & 0xFFFFF].cumsum()
                key >>= 20
                nl = c.real - before
                both = whole - nl
                both *= nl
                both += both <= 0
                d = np.square(c.imag)
                d *= whole
                d /= both
                ok = np.append(key[1:] != key[:-1], False)
                ok[begin[1:] - 1] = False
                np.multiply(d, ok, out=gains[i])
                seen[i] = key & 31
            top = np.maximum.reduceat(gains.max(0), begin) if wide else np.zeros(len(ids))
            for gain in few.values():
                top = np.maximum(top, gain.max(0))
            least = np.maximum(top - np.maximum(1e-10 * (top + base[ids]), tiny), 1e-300)
            best[ids], each = top, least[own]
            for j in sorted(narrow + wide, reverse=True):
                if j in few:
                    good = few[j] >= least
                    hit = np.flatnonzero(good.any(0))
                    which[ids[hit]], cut[ids[hit]] = j, good[:, hit].argmax(0)
                else:
                    i = wide.index(j)
                    hit = np.flatnonzero(gains[i] >= each)[::-1]
                    which[ids[own[hit]]], cut[ids[own[hit]]] = j, seen[i, hit]
        split = best > np.maximum(1e-10 * base, low)
        go = split[at]
        out[goal[~go]] = value[at[~go]]
        if not split.any():
            break
        new = 2 * (np.cumsum(split) - 1)
        goal, at, ask = goal[go], at[go], ask[go]
        at = new[at] + (places[ask + which[at]] > cut[at])
        keep = np.flatnonzero(split[node])
        node, row = node[keep], row[keep]
        node = new[node] + (flat[row * k + which[node]] > cut[node])
        order = (node << 24) | np.arange(len(node))
        order.sort()
        node, order = order >> 24, order & 0xFFFFFF
        row, keep = row[order], keep[order]
        w, v, m = w[keep], v[keep], 2 * int(split.sum())
    return out.reshape(trees, -1)


def _packed(bins: np.ndarray) -> list[np.ndarray]:
    """Places (rows, features) below BINS as bigints of PACK features each."""
    words = [np.zeros(len(bins), np.int64) for _ in range(-(-bins.shape[1] // PACK))]
    for j in range(bins.shape[1]):
        words[j // PACK] |= bins[:, j].astype(np.int64) << 5 * (j % PACK)
    return words


def _binned(d: DataFrame, by: list[str], features: list[str], seen: Column | None = None) -> DataFrame:
    """``d`` with ``bins``: each feature's place among up to 31 cuts, as many as a Spark ML forest makes.

    Cuts lie halfway between a quantile of the group (of its rows with ``seen``) and the next larger value.
    """
    x = [F.col(f).cast("double") for f in features]
    names = [f"__c{i}" for i in range(len(x))]
    rows = d if seen is None else d.where(seen)
    cuts = rows.groupBy(*by).agg(*[F.percentile_approx(v, [i / BINS for i in range(1, BINS)], 10_000).alias(c) for v, c in zip(x, names)])
    cuts = rows.join(F.broadcast(cuts), by).groupBy(*by).agg(*[F.array(*[(F.max(F.get(c, i)) + F.min(F.when(v > F.get(c, i), v))) / 2 for i in range(BINS - 1)]).alias(c) for v, c in zip(x, names)])
    cuts = cuts.select(*by, *[F.array_distinct(c).alias(c) for c in names])
    d = d.join(F.broadcast(cuts), by)
    place = lambda c, v: F.size(F.filter(c, lambda t: t < v))
    return d.withColumn("bins", F.array(*[place(c, v) for c, v in zip(names, x)])).drop(*names)


def _blocks(d: DataFrame, group: str, target: str, trees: int, seed: int = 42) -> DataFrame:
    """(group, held, block, bins, n, s): bootstrap weights and weighted target sums of a block of trees per held fold and cell.

    A row has a Poisson weight in every tree, as in a Spark ML forest, and none where
    its own fold is held out. Rows are weighed in parts of 100,000 of a group, so no
    task holds a whole large group.
    """
    kind = d.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        cells, cell = np.unique(np.stack(pdf["bins"]), axis=0, return_inverse=True)
        y, first, held = pdf["y"].to_numpy(float), int(pdf["rn"].iloc[0]), int(pdf["held"].iloc[0])
        away = pdf["fold"].to_numpy() == held
        out = []
        for block, begin in enumerate(range(0, trees, BLOCK)):
            rng = np.random.default_rng([seed, zlib.crc32(str(pdf[group].iloc[0]).encode()), first, block])
            w = rng.poisson(1.0, (min(BLOCK, trees - begin), len(y))) * np.where(away, 0.0, 1.0)
            n = np.stack([np.bincount(cell.ravel(), t, len(cells)) for t in w], 1)
            s = np.stack([np.bincount(cell.ravel(), t * y, len(cells)) for t in w], 1)
            out.append(pd.DataFrame({group: pdf[group].iloc[0], "held": held, "block": block, "bins": list(cells), "n": list(n), "s": list(s)}))
        return pd.concat(out)

    parts = d.withColumn("part", F.floor((F.col("rn") - 1) / 100_000)).select(group, "held", "part", "rn", "fold", "bins", F.col(target).cast("double").alias("y"))
    return parts.groupBy(group, "held", "part").applyInPandas(run, f"{group} {kind}, held int, block int, bins array<int>, n array<double>, s array<double>")


def _table(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a block, and the weights and sums (trees, cells)."""
    cells, cell = np.unique(np.stack(pdf["bins"]), axis=0, return_inverse=True)
    both = []
    for c in ("n", "s"):
        v = np.stack(pdf[c])
        t = np.zeros((len(cells), v.shape[1]))
        np.add.at(t, cell.ravel(), v)
        both.append(t.T)
    return cells, both[0], both[1]


def forest_cv(df: DataFrame, group: str, features: list[str], target: str, key: str, trees: int = 200, depth: int = 30, folds: int = 5) -> DataFrame:
    """(group, n, rmse, r2): out-of-fold forest predictions pooled per group, folds as in cross_validate.

    The forests are those of ``forest``: Poisson bootstrap, all features at every
    split, splits at 31 quantiles a feature. The forest that predicts a fold knows
    nothing of that fold's rows, its quantiles neither. As trees see rows only through
    their cells, sums per held fold and cell are gathered, and a block of trees of a
    held fold is grown per task. Rows with missing values take no part, nor do groups
    of no more than ``folds`` rows.
    """
    d = complete(df, [*features, target]).where(F.col(group).isNotNull()).select(group, key, *features, target)
    d = d.join(row_numbers(d, [group], key), [group, key]).where(F.col("size") > folds).withColumn("fold", ((F.col("rn") - 1) % folds).cast("int"))
    d = d.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    d = checkpointed(_binned(d, [group, "held"], features, F.col("fold") != F.col("held")))
    kind = df.schema[group].dataType.simpleString()
    mean = F.broadcast(d.groupBy(group).agg(F.avg(target).alias("__mean")))
    centred = d.join(mean, group).withColumn("__y", F.col(target) - F.col("__mean"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, n, s = _table(pdf)
        p, _ = grown(n, s, cells, depth)
        return pd.DataFrame({group: pdf[group].iloc[0], "held": int(pdf["held"].iloc[0]), "bins": list(cells), "total": np.nansum(p, 0), "grown": (~np.isnan(p)).sum(0)})

    p = _blocks(centred, group, "__y", trees).groupBy(group, "held", "block").applyInPandas(run, f"{group} {kind}, held int, bins array<int>, total double, grown bigint")
    p = p.groupBy(group, "held", "bins").agg(F.try_divide(F.sum("total"), F.sum("grown")).alias("__pred"))
    p = centred.where(F.col("fold") == F.col("held")).join(p, [group, "held", "bins"]).select(group, "__y", "__pred")
    rmse, r2 = scores("__pred", "__y")
    return p.groupBy(group).agg(F.count(F.lit(1)).alias("n"), rmse.alias("rmse"), r2.alias("r2"))


def forest_importances(df: DataFrame, group: str, features: list[str], target: str, trees: int = 200, depth: int = 30) -> DataFrame:
    """(group, importances): a map of feature to importance of the forest over all rows of each group.

    The share of a feature in a tree's reduction of variance, averaged over the trees, as Spark ML has it.
    """
    d = complete(df, [*features, target]).where(F.col(group).isNotNull()).select(group, *features, target)
    d = checkpointed(_binned(d, [group], features).withColumns({"held": F.lit(0), "fold": F.lit(-1)}).withColumn("rn", F.monotonically_increasing_id() + 1))
    kind = df.schema[group].dataType.simpleString()
    mean = F.broadcast(d.groupBy(group).agg(F.avg(target).alias("__mean")))
    centred = d.join(mean, group).withColumn("__y", F.col(target) - F.col("__mean"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, n, s = _table(pdf)
        gains = grown(n, s, cells, depth)[1]
        shares = gains / np.where(gains.sum(1, keepdims=True) > 0, gains.sum(1, keepdims=True), 1.0)
        return pd.DataFrame({group: pdf[group].iloc[0], "feature": features, "share": shares.sum(0)})

    p = _blocks(centred, group, "__y", trees).groupBy(group, "block").applyInPandas(run, f"{group} {kind}, feature string, share double")
    p = p.groupBy(group, "feature").agg(F.sum("share").alias("share"))
    every = p.groupBy(group).agg(F.sum("share").alias("every"))
    p = p.join(every, group).select(group, "feature", F.coalesce(F.try_divide("share", "every"), F.lit(0.0)).alias("share"))
    return p.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("feature", "share"))).alias("importances"))


def held_out(df: DataFrame, group: str, key: str, features: list[str], target: str, test: str, allowed: dict[str, list[str]], trees: int = 100, depth: int = 30, share_rows: int = SHARE) -> DataFrame:
    """(group, key, y, pred): predictions of the rows with ``test`` by a forest of the group's other rows.

    ``allowed`` names the features of each group, a short list; groups not in it take
    no part. All groups are worked on side by side, grown as in forest_cv but row by row.
    A group of more than ``share_rows`` rows is dealt at random into shares of about
    that many, each with a whole forest of its own that predicts the share's test rows,
    so every row counts and no task holds a large group; up to that size a forest sees
    all rows of its group. A row travels once, its places (see _binned) packed into
    bigints, and a share's trees are grown in one task. ``key`` is a unique bigint per group.
    """
    ship(df.sparkSession)
    names = F.array(*[F.lit(g) for g in allowed]) if allowed else F.array().cast("array<string>")
    x = [F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)]
    d = complete(df, [*features, target]).where(F.array_contains(names, F.col(group)))
    d = d.select(group, key, F.col(test).cast("boolean").alias("__test"), F.col(target).cast("double").alias("y"), F.xxhash64(key).alias("__h"), *x)
    probs = [i / BINS for i in range(1, BINS)]
    quantiles = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f"__x{i}", probs, 10_000).alias(f"q{i}") for i in range(len(x))])
    shares, cuts = {}, {}
    for r in quantiles.collect():  # a row per group of the list
        # no value lies between a quantile and the next larger value, so halfway to the next double the cut parts the rows as halfway to that value
        q = [np.unique(np.array(r[f"q{i}"], float)) for i in range(len(x))]
        shares[r[group]], cuts[r[group]] = -(-r.n // share_rows), [np.unique((v + np.nextafter(v, np.inf)) / 2) for v in q]
    kind, k, words = df.schema[group].dataType.simpleString(), len(x), [f"b{i}" for i in range(-(-len(x) // PACK))]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [batch.column(5 + i).to_numpy(zero_copy_only=False) for i in range(k)]
            h = batch.column(4).to_numpy(zero_copy_only=False)
            group_ = batch.column(0).dictionary_encode()
            order = np.argsort(group_.indices.to_numpy(zero_copy_only=False), kind="stable")
            at = np.split(order, np.cumsum(np.bincount(group_.indices.to_numpy(zero_copy_only=False), minlength=len(group_.dictionary)))[:-1])
            share, bins = np.zeros(len(h), np.int32), np.zeros((len(h), k), np.uint8)
            for g, i in zip(group_.dictionary.to_pylist(), at):
                share[i] = h[i] % shares[g]
                for j, c in enumerate(cuts[g]):
                    bins[i, j] = np.searchsorted(c, v[j][i])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(share), *map(pa.array, _packed(bins))], names=[group, key, "__test", "y", "share", *words])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        name, share = pdf[group].iloc[0], int(pdf["share"].iloc[0])
        own = [i for i, f in enumerate(features) if f in allowed[name]]
        bins = np.stack([(pdf[words[i // PACK]].to_numpy() >> 5 * (i % PACK)) & 31 for i in own], 1).astype(np.uint8) if own else np.zeros((len(pdf), 0), np.uint8)
        y, away = pdf["y"].to_numpy(float), pdf["__test"].to_numpy(bool)
        mean = y[~away].mean() if (~away).any() else np.nan
        total, ripe, waiting = np.zeros(away.sum()), np.zeros(away.sum(), int), []
        for block in range(-(-trees // TREES)):
            rng = np.random.default_rng([zlib.crc32(str(name).encode()), share, block])
            waiting += list(rng.poisson(1.0, (min(TREES, trees - block * TREES), len(y))).astype(np.uint8) * ~away)
            while waiting and (len(waiting) * len(y) >= AT_ONCE or block == -(-trees // TREES) - 1):
                some = max(1, AT_ONCE // len(y))
                p = predicted(np.stack(waiting[:some]), y - mean, bins, bins[away], depth)
                waiting, total, ripe = waiting[some:], total + np.nansum(p + mean, 0), ripe + (~np.isnan(p)).sum(0)
        pred = np.divide(total, ripe, out=np.full(len(total), np.nan), where=ripe > 0)
        return pd.DataFrame({group: name, key: pdf[key].to_numpy()[away], "y": y[away], "pred": pred})

    packed = d.mapInArrow(places, f"{group} {kind}, {key} bigint, __test boolean, y double, share int, {', '.join(f'{w} bigint' for w in words)}")
    packed = packed.repartition(max(1, min(2 * sum(shares.values()), 10_000)), group, "share")  # about a share a task
    return packed.groupBy(group, "share").applyInPandas(run, f"{group} {kind}, {key} bigint, y double, pred double")
