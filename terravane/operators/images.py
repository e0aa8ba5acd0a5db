"""Stencils and resampling on pixel relations (view, y, x, value)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import geometry as g


#: pixels along a side that a key can tell apart
SIDE = 100_000


def pixel_key(view: Column, y: Column, x: Column) -> Column:
    """One number for a pixel of a view; larger images are refused."""
    fits = (y >= 0) & (y < SIDE) & (x >= 0) & (x < SIDE)
    return F.when(fits, (view * SIDE + y) * SIDE + x).otherwise(F.raise_error(F.lit("a pixel lies outside of what a key can tell apart")).cast("long")).cast("long")


def neighbour(value: str, dy: int, dx: int) -> Column:
    """Value one step along a column or row; null where there is no such pixel.

    The frame is a range, not a row count, so holes in the image stay holes.
    """
    if dy:
        w = Window.partitionBy("view", "x").orderBy("y").rangeBetween(dy, dy)
    else:
        w = Window.partitionBy("view", "y").orderBy("x").rangeBetween(dx, dx)
    return F.max(value).over(w)


def laplacian(px: DataFrame, depth: str = "depth") -> DataFrame:
    """Four neighbours minus four times the pixel, on the inverse depth; 0 outside."""
    inv = px.withColumn("__i", 1.0 / (F.col(depth) + 1e-6))
    around = [F.coalesce(neighbour("__i", dy, dx), F.lit(0.0)) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    return inv.withColumn("laplacian", around[0] + around[1] + around[2] + around[3] - 4 * F.col("__i")).drop("__i")


def depth_edges(px: DataFrame, threshold: float = 0.01, iterations: int = 1, depth: str = "depth") -> DataFrame:
    """``edge``: whether a pixel above the threshold lies within ``iterations`` steps (box)."""
    lap = laplacian(px, depth)
    steps = [i for i in range(-iterations, iterations + 1)]
    box = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps])
    wide = lap.filter(F.col("laplacian") > F.lit(float(threshold))).select("view", "y", "x", F.explode(box).alias("s"))
    wide = wide.select("view", (F.col("y") + F.col("s.i")).alias("y"), (F.col("x") + F.col("s.j")).alias("x")).distinct()
    return lap.join(wide.withColumn("__e", F.lit(True)), ["view", "y", "x"], "left").withColumn("edge", F.coalesce("__e", F.lit(False))).drop("__e")


def depth_normals(px: DataFrame) -> DataFrame:
    """(view, y, x, nx, ny, nz) from central differences of camera-space points.

    ``px`` has the camera's columns.  The first difference runs along rows (y), the
    second along columns (x); a pixel without all four neighbours has zeros.
    """
    p = g.pixel_to_camera(F.col("x") + 0.5, F.col("y") + 0.5, F.col("depth"))
    pts = px.select("view", "y", "x", *[v.alias(n) for v, n in zip(p, ("px", "py", "pz"), strict=True)])
    near = {(n, d): neighbour(n, *d) for n in ("px", "py", "pz") for d in ((-1, 0), (1, 0), (0, -1), (0, 1))}
    pts = pts.withColumns({f"{n}_{k}": near[n, d] for n in ("px", "py", "pz") for k, d in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1)))})
    a = tuple(F.col(f"{n}_1") - F.col(f"{n}_0") for n in ("px", "py", "pz"))
    b = tuple(F.col(f"{n}_3") - F.col(f"{n}_2") for n in ("px", "py", "pz"))
    pts = pts.select("view", "y", "x", *[v.alias(n) for v, n in zip(g.cross(a, b), ("cx", "cy", "cz"), strict=True)])
    n = g.normalise((F.col("cx"), F.col("cy"), F.col("cz")))
    return pts.select("view", "y", "x", *[F.coalesce(v, F.lit(0.0)).alias(c) for v, c in zip(n, ("nx", "ny", "nz"), strict=True)])


def _targets(source: Column, n: int, m: int, taps: Callable[[Column], tuple[Column, ...]]) -> Column:
    """Target places along one axis, of ``m``, that have ``source``, of ``n``, among their taps."""
    lo = F.greatest(F.floor((source - 1.5) * m / n) - 1, F.lit(0))
    hi = F.when(source == n - 1, F.lit(m - 1)).otherwise(F.least(F.ceil((source + 1.5) * m / n), F.lit(m - 1)))
    return F.filter(F.sequence(lo.cast("int"), hi.cast("int")), lambda o: reduce(Column.__or__, [t == source for t in taps(o)]))


def bilinear(px: DataFrame, height: int, width: int, new_height: int, new_width: int, value: str = "value") -> DataFrame:
    """Bilinear samples at pixel centres (corners not aligned), from source to target.

    Each source pixel is sent to the target pixels that it weighs in, which follow
    from its place; the factor of the sizes bounds how many those are.
    """

    def axis(o: Column, n: int, m: int) -> tuple[Column, Column, Column]:
        s = F.greatest((o + 0.5) * n / m - 0.5, F.lit(0.0))
        lo = F.floor(s)
        return lo, F.least(lo + 1, F.lit(n - 1)), s - lo

    def weight(o: str, source: str, n: int, m: int) -> Column:
        lo, hi, share = axis(F.col(o), n, m)
        return F.when(lo == F.col(source), 1 - share).otherwise(F.lit(0.0)) + F.when(hi == F.col(source), share).otherwise(F.lit(0.0))

    sent = px.select("view", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value).alias("__v"))
    sent = sent.select("*", F.explode(_targets(F.col("sy"), height, new_height, lambda o: axis(o, height, new_height)[:2])).alias("y"))
    sent = sent.select("*", F.explode(_targets(F.col("sx"), width, new_width, lambda o: axis(o, width, new_width)[:2])).alias("x"))
    k = weight("y", "sy", height, new_height) * weight("x", "sx", width, new_width)
    return sent.groupBy("view", "y", "x").agg(F.sum(k * F.col("__v")).alias(value))


def nearest(px: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Nearest samples, as for masks; each pixel is sent to the targets that it is nearest to."""
    sent = px.withColumnsRenamed({"y": "__sy", "x": "__sx"})
    for c, n, m in (("y", height, new_height), ("x", width, new_width)):
        places = _targets(F.col(f"__s{c}"), n, m, lambda o, n=n, m=m: (F.floor(o * n / m),))
        sent = sent.withColumn(c, F.explode(places)).drop(f"__s{c}")
    return sent


def composite_front_to_back(samples: DataFrame, value: str = "value", alpha: str = "alpha") -> DataFrame:
    """(view, pix, value, transmittance): front-to-back blending in the order of depth, ties by id."""
    w = Window.partitionBy("view", "pix").orderBy("depth", "gid")
    log = F.log(F.greatest(1.0 - F.col(alpha), F.lit(1e-12)))
    before = F.coalesce(F.sum("__l").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = samples.withColumn("__l", log).withColumn("__t", F.exp(before))
    return rows.groupBy("view", "pix").agg(F.sum(F.col("__t") * F.col(alpha) * F.col(value)).alias("value"), F.exp(F.sum("__l")).alias("transmittance"))
