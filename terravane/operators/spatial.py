"""Spatial joins: points within a radius, and nearest neighbours.

Both use grids of cells.  A radius join sends each left point to the 27 cells
around it and meets the right points by equality of cells.

A neighbour join follows the local density.  Grids of cells that halve in size are
counted on the right side; a left point takes the finest grid in which its own cell
holds ``k`` right points, so that its neighbours lie within that cell's diagonal,
and meets the right points of the cells of that grid.  Points on surfaces and in
clusters thus have small cells, and pairs stay in proportion to points.  Left points
in cells with fewer right points search radii that double until they have ``k``
neighbours.  Both are exact.  Small relations (counted) are compared directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators import shapes
from terravane.storage import materialise

#: below this many pairs, comparing all with one broadcast side is the cheapest plan
DIRECT_PAIRS, DIRECT_ROWS = 30_000_000, 50_000
#: grids of a neighbour join, from coarse to fine; level 0 has the cells of the mean density
LEVELS = range(-2, 11)


def squared(a: str, b: str) -> Column:
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _named(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.select(F.col(key).alias(f"{prefix}id"), *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in "xyz"])


def _cells(df: DataFrame, prefix: str, size: float, around: bool) -> DataFrame:
    base = [F.floor(F.col(f"{prefix}{c}") / F.lit(size)).cast("long") for c in "xyz"]
    if not around:
        return df.select("*", *[b.alias(f"c{c}") for b, c in zip(base, "xyz", strict=True)])
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    out = df.select("*", F.explode(shifts).alias("s"))
    return out.select(*df.columns, *[(b + F.col(f"s.{n}")).alias(f"c{c}") for b, n, c in zip(base, "ijk", "xyz", strict=True)])


def radius_join(left: DataFrame, right: DataFrame, radius2: float, left_key: str = "id", right_key: str = "id") -> DataFrame:
    """(aid, bid, d2) of all pairs with squared distance <= ``radius2``."""
    size = float(radius2) ** 0.5 * (1 + 1e-9)
    a = _cells(_named(left, left_key, "a"), "a", size, True)
    b = _cells(_named(right, right_key, "b"), "b", size, False)
    pairs = a.join(b, ["cx", "cy", "cz"]).select("aid", "bid", squared("a", "b").alias("d2"))
    return pairs.filter(F.col("d2") <= F.lit(float(radius2)))


def radius_pairs(left: DataFrame, right: DataFrame, radius2: float, left_key: str = "id", right_key: str = "id") -> DataFrame:
    """(aid, bid) of :func:`radius_join`; places are compared, and points of one place travel as arrays that meet last."""
    size = float(radius2) ** 0.5 * (1 + 1e-9)

    def places(df: DataFrame, key: str, prefix: str) -> DataFrame:
        xyz = [f"{prefix}{c}" for c in "xyz"]
        found = _named(df, key, prefix).dropna(subset=xyz)
        for c in xyz:
            found = found.filter(~F.isnan(c))
        return shapes.chunked(found, xyz, f"{prefix}id", f"{prefix}ids")

    a = _cells(places(left, left_key, "a"), "a", size, True)
    b = _cells(places(right, right_key, "b"), "b", size, False)
    near = shapes.meet(a, b, ["cx", "cy", "cz"], F.size("aids"), F.size("bids")).filter(squared("a", "b") <= F.lit(float(radius2)))
    return near.select(F.explode("aids").alias("aid"), "bids").select("aid", F.explode("bids").alias("bid"))


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("aid").orderBy("d2", "bid"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def _leveled(df: DataFrame, prefix: str, size: float, levels: list[int], double: bool = False) -> DataFrame:
    """Each row once for each level, with its cell; ``double``: cells of twice the size."""
    out = df.select("*", F.explode(F.array(*[F.lit(v) for v in levels])).alias("level"))
    side = F.lit(size * (2 if double else 1)) / F.pow(F.lit(2.0), F.col("level"))
    return out.select("*", *[F.floor(F.col(f"{prefix}{c}") / side).alias(f"c{c}") for c in "xyz"])


def _doubling(left: DataFrame, right: DataFrame, k: int, radius: float, widest: float) -> DataFrame:
    """Neighbours by radii that double; what lies within a radius is known in full."""
    b = right.select(F.col("bid").alias("id"), *[F.col(f"b{c}").alias(c) for c in "xyz"])
    out = None
    while True:
        last = radius >= widest
        a = left.select(F.col("aid").alias("id"), *[F.col(f"a{c}").alias(c) for c in "xyz"])
        near = _nearest(radius_join(a, b, radius * radius), k)
        if not last:
            near = near.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("aid"))).filter(F.col("n") >= k).drop("n")
        done = materialise(near)
        out = done if out is None else out.union(done)
        if not last:
            left = materialise(left.join(done.select("aid").distinct(), "aid", "left_anti"))
        if last or left.limit(1).count() == 0:
            return out
        radius *= 2


def knn_join(left: DataFrame, right: DataFrame, k: int, left_key: str = "id", right_key: str = "id", direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """(aid, bid, d2, rank): the ``k`` nearest right points of each left point; ties by id.

    With fewer than ``k`` right points all of them are neighbours.
    """
    a, b = _named(left, left_key, "a"), _named(right, right_key, "b")
    n_a, n_b = a.count(), b.count()
    k = min(k, n_b)
    if n_a * n_b <= direct_pairs and n_b <= DIRECT_ROWS:
        return _nearest(a.crossJoin(F.broadcast(b)).select("aid", "bid", squared("a", "b").alias("d2")), k)
    box = b.agg(*[F.min(f"b{c}").alias(f"lo{c}") for c in "xyz"], *[F.max(f"b{c}").alias(f"hi{c}") for c in "xyz"]).first()
    reach = a.agg(*[F.min(f"a{c}").alias(f"lo{c}") for c in "xyz"], *[F.max(f"a{c}").alias(f"hi{c}") for c in "xyz"]).first()
    sides = [max(box[f"hi{c}"] - box[f"lo{c}"], 1e-9) for c in "xyz"]
    widest = sum((max(box[f"hi{c}"], reach[f"hi{c}"]) - min(box[f"lo{c}"], reach[f"lo{c}"])) ** 2 for c in "xyz") ** 0.5
    size = max((2.0 * k * sides[0] * sides[1] * sides[2] / n_b) ** (1 / 3), max(sides) * 1e-3)
    cell, levels = ["level", "cx", "cy", "cz"], list(LEVELS)
    full = _leveled(b, "b", size, levels).groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(*cell)
    own = _leveled(a, "a", size, levels).join(full, cell, "left_semi").groupBy("aid").agg(F.max("level").alias("level"))
    a = materialise(a.join(own, "aid", "left"))
    used = sorted(r["level"] for r in a.select("level").distinct().collect() if r["level"] is not None)  # a few numbers
    out = None
    if used:
        # a cell's diagonal is shorter than two sides: 27 cells of twice the size hold the ball
        found = a.filter("level is not null")
        side = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
        shifts = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(m).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)])
        around = found.select("*", F.explode(shifts).alias("s")).select(*found.columns, *[(F.floor(F.col(f"a{c}") / (2 * side)) + F.col(f"s.{c}")).alias(f"c{c}") for c in "xyz"])
        pairs = around.join(_leveled(b, "b", size, used, True), cell).select("aid", "bid", squared("a", "b").alias("d2"), (3.001 * side * side).alias("most"))
        out = _nearest(pairs.filter("d2 <= most").drop("most"), k)
    rest = a.filter("level is null").drop("level")
    if rest.limit(1).count():
        more = _doubling(rest, b, k, size / 2.0 ** levels[0], widest)
        out = more if out is None else out.unionByName(more)
    return out if out is not None else _nearest(a.crossJoin(b).select("aid", "bid", squared("a", "b").alias("d2")).limit(0), k)


def nn_join(left: DataFrame, right: DataFrame, left_key: str = "id", right_key: str = "id", direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """(aid, distance) to the nearest right point."""
    near = knn_join(left, right, 1, left_key, right_key, direct_pairs)
    return near.select("aid", F.sqrt("d2").alias("distance"))


def neighbour_counts(df: DataFrame, radius2: float, key: str = "id") -> DataFrame:
    """(id, n): points within the radius, the point itself included."""
    return radius_join(df, df, radius2, key, key).groupBy(F.col("aid").alias(key)).agg(F.count(F.lit(1)).alias("n"))
