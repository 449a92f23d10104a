"""The region that contains a point, by cells as large as the region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(c: str, level: Column) -> Column:
    return F.floor(F.col(c) / F.pow(F.lit(2.0), level))


def containing_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, region): every region that contains each point, found by an equi-join and one exact test.

    ``points``: id, x, y; ``regions``: region and ``ring``, an array of struct (x, y), its corners in
    order. A region is filed under a cell size between one and two of its extents, so it
    touches at most four cells however large it is; a point looks into its cell of
    every size in use, which are few (a size is a power of two). Inside is decided by
    the even-odd rule; of two regions with a common edge one contains a point on it.
    Points with NULL or non-finite coordinates, rings of fewer than three corners,
    with a missing corner or without extent contain or lie in nothing.
    """
    ends = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    r = regions.where((F.size("ring") >= 3) & ~F.exists("ring", lambda p: p.x.isNull() | p.y.isNull() | F.isnan(p.x) | F.isnan(p.y)))
    r = r.select("region", "ring", *[ends(f, c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.array_min, F.array_max))])
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    r = r.where((extent > 0) & (extent < float("inf"))).withColumn("level", F.ceil(F.log2(extent)))
    sizes = [row.level for row in r.select("level").distinct().orderBy("level").collect()]  # at most the exponents of a double
    r = r.withColumn("ix", F.explode(F.sequence(_cell("x0", F.col("level")), _cell("x1", F.col("level")))))
    r = r.withColumn("iy", F.explode(F.sequence(_cell("y0", F.col("level")), _cell("y1", F.col("level")))))
    levels = F.array(*[F.lit(s).cast("bigint") for s in sizes]) if sizes else F.array().cast("array<bigint>")
    p = points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).select("id", "x", "y", F.explode(levels).alias("level"))
    p = p.withColumns({"ix": _cell("x", F.col("level")), "iy": _cell("y", F.col("level"))})
    near = p.join(r, ["level", "ix", "iy"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    edges = F.arrays_zip(F.col("ring").alias("p"), F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)).alias("q"))
    x, y = F.col("x"), F.col("y")

    def crossed(e: Column) -> Column:
        p, q = e["p"], e["q"]
        at = F.try_divide((q.x - p.x) * (y - p.y), q.y - p.y) + p.x
        return ((p.y > y) != (q.y > y)) & (x < at)

    return near.where(F.size(F.filter(edges, crossed)) % 2 == 1).select("id", "region")
