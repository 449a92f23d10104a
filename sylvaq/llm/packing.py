"""Filling fixed-capacity containers: vector bin packing with a dot-product heuristic."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaq.scratch import checkpointed

#: Items packed together; a block leaves about one container partly empty.
BLOCK = 4096
#: Containers filled less than this are opened again in the next round.
FULL = 0.97
ROUNDS = 2
#: Kinds of container, a list given with the query.
MOST_KINDS = 1000
#: Bits of a container's number inside its block, and of the block inside its round.
_BIN, _BLOCK = 20, 36


def pack_block(size: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item, for sizes (items x dimensions) under simultaneous limits.

    Containers are filled one after another: of the items that still fit in every
    dimension, the one whose normalised size has the largest dot product with what
    the container has left goes in, until none fits. An item over a limit by
    itself gets a container of its own.
    """
    rel = size / limits
    n, out = len(rel), np.full(len(rel), -1, np.int64)
    order = np.lexsort((np.arange(n), -rel[:, 0]))  # ties: the earlier item
    rel = rel[order]
    alone = (rel > 1).any(axis=1)
    bins = int(alone.sum())
    out[order[alone]] = np.arange(bins)
    left, where = rel[~alone], order[~alone]
    while len(left):
        room = np.ones(rel.shape[1])
        free = np.ones(len(left), bool)
        cols = [np.ascontiguousarray(left[:, d]) for d in range(left.shape[1])]
        begin = 0
        while True:
            # the order is by the first dimension, so what fits there is a suffix
            begin = max(begin, int(np.searchsorted(-cols[0], -(room[0] + 1e-12), side="left")))
            fit = free[begin:].copy()
            score = cols[0][begin:] * room[0]
            for d in range(1, len(cols)):
                c = cols[d][begin:]
                fit &= c <= room[d] + 1e-12
                score += c * room[d]
            if not fit.any():
                break
            i = begin + int(np.argmax(np.where(fit, score, -1.0)))
            free[i] = False
            out[where[i]] = bins
            room -= [c[i] for c in cols]
        bins += 1
        left, where = left[free], where[free]
    return out


def pieces(items: DataFrame, kinds: DataFrame, segment_tokens: int, loss_share: float) -> DataFrame:
    """(kind_id, capacity, max_segments, max_loss, id, piece, tokens, loss): items cut only where longer than the capacity.

    ``items``: id, tokens, loss_from (tokens before the first loss-bearing one).
    Items without tokens have no pieces. All pieces but the last are whole
    capacities; a piece's loss-bearing tokens are those behind ``loss_from``.
    """
    rows = kinds.where(F.col("capacity_tokens") > 0).select("kind_id", "capacity_tokens").limit(MOST_KINDS + 1).collect()
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    each = F.array(*[F.struct(F.lit(r.kind_id).cast("bigint").alias("kind_id"), F.lit(r.capacity_tokens).cast("bigint").alias("capacity")) for r in rows])
    if not rows:
        each = each.cast("array<struct<kind_id:bigint,capacity:bigint>>")
    cut = items.where(F.col("tokens") > 0).select("id", "tokens", "loss_from", F.explode(each).alias("k")).select("id", "tokens", "loss_from", "k.*")
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / F.col("capacity")))))
    start = F.col("piece") * F.col("capacity")
    end = F.least("tokens", start + F.col("capacity"))
    return cut.select(
        "kind_id", "capacity",
        F.greatest(F.lit(1), F.floor(F.col("capacity") / segment_tokens)).cast("bigint").alias("max_segments"),
        F.greatest(F.lit(1), F.floor(F.col("capacity") * loss_share)).cast("bigint").alias("max_loss"),
        "id", "piece", (end - start).alias("tokens"),
        F.greatest(F.lit(0), end - F.greatest(start, F.col("loss_from"))).alias("loss"),
    )


#: A segment per so many tokens of capacity, and the share of it that may bear loss.
SEGMENT_TOKENS, LOSS_SHARE = 128, 0.9

_OUT = "kind_id bigint, capacity bigint, max_segments bigint, max_loss bigint, id bigint, piece bigint, tokens bigint, loss bigint, container_id bigint, fill double"


def _packer(number: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece"], kind="stable").reset_index(drop=True)
        first = pdf.iloc[0]
        limits = np.array([first.capacity, first.max_segments, first.max_loss], float)
        size = np.column_stack([pdf.tokens, np.ones(len(pdf)), pdf.loss]).astype(float)
        bins = pack_block(size, limits)
        # a container is as full as its fullest dimension
        fill = np.max([np.bincount(bins, weights=size[:, d]) / limits[d] for d in range(len(limits))], axis=0)
        pdf["container_id"] = (number << (_BIN + _BLOCK)) | (int(first.block) << _BIN) | bins
        pdf["fill"] = fill[bins]
        return pdf[[c.split()[0] for c in _OUT.split(", ")]]

    return run


def pack(items: DataFrame, kinds: DataFrame, segment_tokens: int = SEGMENT_TOKENS, loss_share: float = LOSS_SHARE, block: int = BLOCK) -> DataFrame:
    """(kind_id, container, id, piece, tokens, loss): every item of each kind in a container.

    A container holds at most ``capacity_tokens`` tokens, ``capacity / segment_tokens``
    pieces and ``loss_share * capacity`` loss-bearing tokens. Whole pieces of long
    items fill containers alone and need no packing. The rest of each kind is spread
    by a hash of the item over blocks of about ``block`` pieces, each packed in one
    task by the dot-product heuristic (pack_block); what lies in containers whose
    fullest dimension is less than FULL is taken out and packed again, in fewer
    blocks, ROUNDS times in all. ``items`` needs unique ids; items of 0 tokens come
    out in no container; a piece that alone breaks the loss limit has a container of
    its own; no items, no rows. A container is named by kind_id and container.
    """
    todo = pieces(items, kinds, segment_tokens, loss_share)
    whole = todo.where(F.col("tokens") == F.col("capacity"))
    # a full piece's container is named by its item and piece, counted within the item's hash
    full = whole.select("kind_id", F.concat_ws("-", "id", "piece").alias("container"), "id", "piece", "tokens", "loss")
    todo = checkpointed(todo.where(F.col("tokens") < F.col("capacity")))
    done = []
    for number in range(1, ROUNDS + 1):
        n = checkpointed(todo.groupBy("kind_id").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) / block)).cast("bigint").alias("blocks")))
        if n.isEmpty():
            break
        # a row per kind, of which there are MOST_KINDS at most
        keyed = todo.join(F.broadcast(n), "kind_id").withColumn("block", F.pmod(F.xxhash64("id", "piece", F.lit(number)), F.col("blocks"))).drop("blocks")
        packed = checkpointed(keyed.groupBy("kind_id", "block").applyInPandas(_packer(number), _OUT))
        keep = packed if number == ROUNDS else packed.where(F.col("fill") >= FULL)
        done.append(keep.select("kind_id", F.col("container_id").cast("string").alias("container"), "id", "piece", "tokens", "loss"))
        todo = packed.where(F.col("fill") < FULL).drop("container_id", "fill")
    out = full
    for d in done:
        out = out.unionByName(d)
    return out


def pack_check(packed: DataFrame, items: DataFrame, kinds: DataFrame, segment_tokens: int = SEGMENT_TOKENS, loss_share: float = LOSS_SHARE, fill: float = 0.97) -> DataFrame:
    """(kind_id, items, whole, within, full): what must hold of a packing, per kind.

    ``whole``: of every item each token lies in exactly one piece, and only items longer
    than the capacity have several. ``within``: no container of more than one piece
    breaks a limit, none of one piece the capacity. ``full``: the containers hold at
    least ``fill`` of the tokens that fit under the limit that binds most: the sum of
    all sizes in that dimension by its limit is the least number of containers.
    """
    k = kinds.where(F.col("capacity_tokens") > 0).select("kind_id", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    limits = {"tokens": F.col("capacity"), "pieces": F.greatest(F.lit(1), F.floor(F.col("capacity") / segment_tokens)), "loss": F.greatest(F.lit(1), F.floor(F.col("capacity") * loss_share))}
    per = packed.groupBy("kind_id", "id").agg(F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("different"), F.max("piece").alias("last"))
    per = per.join(k, "kind_id").join(items.select("id", "tokens"), "id", "left")
    once = (F.col("got") == F.col("tokens")) & (F.col("pieces") == F.col("different")) & (F.col("last") == F.col("pieces") - 1) & (F.col("pieces") == F.ceil(F.col("tokens") / F.col("capacity")))
    whole = per.groupBy("kind_id").agg(F.count(F.lit(1)).alias("items"), F.every(F.coalesce(once, F.lit(False))).alias("whole"))
    c = packed.groupBy("kind_id", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.sum("loss").alias("loss")).join(k, "kind_id")
    kept = (F.col("tokens") <= F.col("capacity")) & ((F.col("pieces") == 1) | ((F.col("pieces") <= limits["pieces"]) & (F.col("loss") <= limits["loss"])))
    least = F.greatest(*[F.sum(F.col(d) / x) for d, x in limits.items()])
    within = c.groupBy("kind_id").agg(F.every(kept).alias("within"), (least >= fill * F.count(F.lit(1))).alias("full"))
    return whole.join(within, "kind_id")


def fill_report(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind_id, containers, tokens, pieces, fill): how full the containers of each kind are."""
    per = packed.groupBy("kind_id", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    per = per.groupBy("kind_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"))
    k = kinds.select("kind_id", "kind_name", "capacity_tokens")
    return k.join(per, "kind_id", "left").select(
        "kind_id", "kind_name", "capacity_tokens", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("containers", "tokens", "pieces")],
        F.try_divide(F.col("tokens").cast("double"), F.col("containers") * F.col("capacity_tokens")).alias("fill"),
    )
