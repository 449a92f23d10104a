"""Mixing sources to target shares by balanced sampling (the cube method)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaq.scratch import checkpointed

#: Documents whose probabilities are moved together in one task.
BLOCK = 20_000
EPS = 1e-9


def tidy_source(source: Column) -> Column:
    """One spelling of a source name: trimmed, lower case, separators as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")


def _moved(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities (rows of one to three documents) after one move of every row along its null space.

    Three documents have a direction that keeps both their sum and sum(p * size), two one
    that keeps sum(p * size), a single one just moves. Each row goes to one of the
    two ends where a probability becomes whole, at random such that its expectation stays.
    """
    rows, k = p.shape
    if k == 3:
        u, plain = size[:, [1, 2, 0]] - size[:, [2, 0, 1]], [1.0, -1.0, 0.0]
    elif k == 2:
        u, plain = size[:, [1, 0]] * [1.0, -1.0], [1.0, -1.0]
    else:
        u, plain = np.ones((rows, 1)), [1.0]
    u = np.where((u == 0).all(axis=1, keepdims=True), plain, u)
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf))
        down = np.where(u > 0, p / u, np.where(u < 0, (1 - p) / -u, np.inf))
    high, low = up.min(axis=1), down.min(axis=1)
    rise = rng.random(rows) * (high + low) < low
    at = np.where(rise, up.argmin(axis=1), down.argmin(axis=1))
    p = p + np.where(rise, high, -low)[:, None] * u
    row = np.arange(rows)
    p[row, at] = np.where((u[row, at] > 0) == rise, 1.0, 0.0)  # the one that became whole, exactly
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    return p


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Moves fractional inclusion probabilities to 0 or 1, keeping their sum and sum(prob * size).

    Undecided documents are moved in groups of three, all groups of a round at once,
    along the null space of the balancing equations; every move decides at least one
    of a group, so the rounds are about the logarithm of the documents. With
    ``land`` the count is given up in the end, then the tokens, until all are
    decided. Otherwise at most two stay fractional.
    """
    p = prob.astype(float).copy()
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    pending = np.flatnonzero((p > 0) & (p < 1))
    for k in (3, 2, 1) if land else (3,):
        while len(pending) >= k:
            groups = len(pending) // k
            now = pending[: groups * k].reshape(groups, k)
            p[now] = _moved(p[now], size[now], rng)
            pending = pending[(p[pending] > 0) & (p[pending] < 1)]
    return p


_OUT = "source string, id bigint, tokens bigint, base bigint, prob double"


def _mover(seed: int, number: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, number, int(pdf.block.iloc[0]), *pdf.source.iloc[0].encode()])
        order = rng.permutation(len(pdf))
        p = np.empty(len(pdf))
        p[order] = flight(pdf.prob.to_numpy()[order], pdf.tokens.to_numpy(float)[order], rng, bool(pdf.land.iloc[0]))
        return pdf.assign(prob=p)[["source", "id", "tokens", "base", "prob"]]

    return run


def plan_shares(stats: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, available, goal, rate): tokens to take of each source.

    ``stats``: source, documents, available (tokens). The shares of listed sources
    that hold tokens are scaled to 1. Without ``total`` the largest total is taken
    at which no source needs more than ``max_repeats`` copies, so the scaled shares
    can be reached exactly; with it a source that cannot deliver its part gives
    all it may. ``rate`` is the mean number of copies of a document.
    """
    t = targets.select("source", "target_share", "max_repeats").join(stats, "source", "left")
    t = t.withColumns({"documents": F.coalesce("documents", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    live = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    w = Window.partitionBy()  # the targets are a fixed short list
    share = F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(w)).otherwise(0.0)
    most = F.col("available") * F.col("max_repeats")
    t = t.withColumn("share", share)
    size = F.lit(float(total)) if total is not None else F.min(F.when(live, most / F.col("share"))).over(w)
    t = t.withColumn("goal", F.when(live, F.least(F.col("share") * size, most.cast("double"))).otherwise(0.0))
    return t.withColumn("rate", F.coalesce(F.try_divide(F.col("goal"), F.col("available").cast("double")), F.lit(0.0)))


def balanced_mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(id, source, tokens, copies): the selected documents with their number of copies.

    ``docs`` has unique ids, a source and tokens; ``targets`` source, target_share,
    max_repeats. Each document of a source has the same expected number of copies
    (plan_shares); its whole part is given, and the fraction is drawn by the cube
    method, balanced on tokens and on documents. Blocks of about ``block`` documents
    of a source move in parallel and leave at most two undecided documents each;
    these meet again in the next round, until a source fits one block and lands,
    each source by itself. So no task holds a large source, the rounds are the
    logarithm of the largest source to the base of half a block, and the tokens
    reached differ from the goal by at most about one document. ``block`` is at
    least 8. Sources are compared in one spelling (tidy_source); documents of
    unlisted or NULL source and those without tokens are not selected. Empty tables
    give no rows.
    """
    if block < 8:
        raise ValueError("a block needs at least 8 documents")
    d = docs.select("id", tidy_source(F.col("source")).alias("source"), "tokens").where(F.col("source").isNotNull() & (F.col("tokens") > 0))
    t = targets.select(tidy_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    stats = d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    rates = checkpointed(plan_shares(stats, t, total).where(F.col("rate") > 0).select("source", "documents", "rate"))
    d = d.join(rates, "source").withColumn("base", F.floor(F.col("rate") + F.lit(EPS)))
    d = d.withColumn("prob", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    d = d.select("source", "id", "tokens", "base", "prob", "documents")
    still = (F.col("prob") > EPS) & (F.col("prob") < 1 - EPS)
    decided = [d.where(~still).drop("documents")]
    open_docs, number = d.where(still), 0
    while True:
        # the block of a document by its source's open documents; a source of one block lands
        blocks = F.greatest(F.lit(1), F.ceil(F.col("documents") / F.lit(block)))
        keyed = open_docs.withColumns({"block": F.pmod(F.xxhash64("id", F.lit(number)), blocks), "land": blocks == 1}).drop("documents")
        moved = checkpointed(keyed.groupBy("source", "block").applyInPandas(_mover(seed, number), _OUT))
        decided.append(moved.where(~still))
        open_docs = moved.where(still)
        left = checkpointed(open_docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents")))
        if left.isEmpty():
            break
        open_docs = open_docs.join(left, "source")  # a row per listed source
        number += 1
    out = decided[0]
    for x in decided[1:]:
        out = out.unionByName(x)
    out = out.withColumn("copies", (F.col("base") + F.round("prob")).cast("bigint"))
    return out.where(F.col("copies") > 0).select("id", "source", "tokens", "copies")


def share_report(selected: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target share, share reached, documents and tokens available and
    selected, most copies of one document. Sources without documents have share 0."""
    t = targets.select(tidy_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    have = docs.select(tidy_source(F.col("source")).alias("source"), "tokens").where(F.col("tokens") > 0)
    have = have.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    got = selected.groupBy("source").agg(
        F.count(F.lit(1)).alias("selected"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    out = t.join(have, "source", "left").join(got, "source", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("documents", "available", "selected", "copies", "tokens", "most_copies")})
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy()).cast("double")), F.lit(0.0))
    return out.withColumn("share", share)
