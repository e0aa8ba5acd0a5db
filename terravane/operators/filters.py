"""Filters and predicates on scene relations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import geometry as g

Triple = Sequence[float]
#: a relation this small may be given to every task
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def cropbox(pos: Triple | None, rpy: Triple | None, scale: Triple | None) -> tuple[Triple, Triple, Triple] | None:
    """No box if nothing is given; else defaults for what is missing."""
    if pos is None and rpy is None and scale is None:
        return None
    return pos or (0.0, 0.0, 0.0), rpy or (0.0, 0.0, 0.0), scale or (1.0, 1.0, 1.0)


def euler_rotation(rpy: Triple) -> list[list[float]]:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    (a, b, c) = rpy
    ca, sa, cb, sb, cc, sc = math.cos(a), math.sin(a), math.cos(b), math.sin(b), math.cos(c), math.sin(c)
    return [[cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa], [sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa], [-sb, cb * sa, cb * ca]]


def crop(df: DataFrame, pos: Triple | None = None, rpy: Triple | None = None, scale: Triple | None = None) -> DataFrame:
    """Points in an oriented box, its faces included."""
    box = cropbox(pos, rpy, scale)
    if box is None:
        return df
    (pos, rpy, scale), m = box, euler_rotation(box[1])
    d = [F.col(c) - F.lit(float(p)) for c, p in zip("xyz", pos, strict=True)]
    inside = F.lit(True)
    for i in range(3):
        local = sum((F.lit(m[k][i]) * d[k] for k in (1, 2)), F.lit(m[0][i]) * d[0])
        inside = inside & (F.abs(local) <= F.lit(scale[i] / 2.0))
    return df.filter(inside)


def opacity(df: DataFrame, min_opacity: float, column: str = "opacity") -> DataFrame:
    """Strictly above a threshold in logits, as stored."""
    return df.filter(F.col(column) > F.lit(float(min_opacity)))


def mask_color(df: DataFrame, colour: Sequence[float], columns: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Rows of which every channel differs from the colour's."""
    keep = F.lit(True)
    for c, v in zip(columns, colour, strict=True):
        keep = keep & (F.col(c) != F.lit(v))
    return df.filter(keep)


#: cells along the longest side of the points' box that are tested against each camera
CELLS = 32


def in_view(points: DataFrame, cameras: DataFrame, behind: bool = False) -> DataFrame:
    """Points with the columns of each camera that may see them.

    The points' box is cut into cells; a pair of cell and camera is left out only
    if a plane of the camera's frustum (of the mirrored one too, with ``behind``)
    has the whole cell on its outer side.  Points meet cameras by their cell.
    """
    box = points.agg(*[F.min(c).alias(f"lo{c}") for c in "xyz"], *[F.max(c).alias(f"hi{c}") for c in "xyz"]).first()
    if box["lox"] is None:
        return points.crossJoin(small(cameras))
    side = max(max(box[f"hi{c}"] - box[f"lo{c}"] for c in "xyz"), 1e-9) / CELLS
    cell = [F.floor((F.col(c) - F.lit(box[f"lo{c}"])) / F.lit(side)).alias(f"__c{c}") for c in "xyz"]
    placed = points.select("*", *cell)
    cells = placed.select("__cx", "__cy", "__cz").distinct()
    middle = [F.lit(box[f"lo{c}"]) + (F.col(f"__c{c}") + 0.5) * F.lit(side) for c in "xyz"]
    reach = side * 3**0.5 / 2 * (1 + 1e-6) + 1e-9
    pairs = cells.crossJoin(small(cameras))  # CELLS ** 3 cells at most
    d = [m - F.col(t) for m, t in zip(middle, ("tx", "ty", "tz"), strict=True)]
    p = [F.col(f"r0{i}") * d[0] + F.col(f"r1{i}") * d[1] + F.col(f"r2{i}") * d[2] for i in range(3)]

    def inner(sign: int) -> Column:
        """Whether a cell's ball reaches the inner side of all planes; the frame has a margin of one pixel."""
        out = sign * p[2] > -reach
        for at, f, c, size in ((p[0], "fx", "cx", "w"), (p[1], "fy", "cy", "h")):
            for slope, k in ((1, F.col(c) + 1), (-1, F.col(size) + 1 - F.col(c))):
                out = out & (sign * (slope * F.col(f) * at + k * p[2]) >= -reach * (F.abs(F.col(f)) + F.abs(k)))
        return out

    pairs = pairs.filter(inner(1) | inner(-1) if behind else inner(1))
    return placed.join(pairs, ["__cx", "__cy", "__cz"]).drop("__cx", "__cy", "__cz")


def mask_reject(points: DataFrame, cameras: DataFrame, mask: DataFrame, key: str = "id") -> DataFrame:
    """Points that no camera sees on a pixel outside of its mask.

    ``mask``: (view, y, x) of the pixels inside.  A point on pixel row or column
    0, off the frame or at depth 0 is not rejected; points behind count.
    """
    u, v, _ = g.project(g.vector("x", "y", "z"))
    seen = in_view(points, cameras, behind=True).select(key, F.col("cam").alias("view"), F.floor(u - 0.5).alias("x"), F.floor(v - 0.5).alias("y"), "w", "h")
    seen = seen.filter((F.col("x") > 0) & (F.col("x") < F.col("w")) & (F.col("y") > 0) & (F.col("y") < F.col("h")))
    rejected = seen.join(mask.select("view", "y", "x"), ["view", "y", "x"], "left_anti").select(key).distinct()
    return points.join(rejected, key, "left_anti")


def visible(rx: Column, ry: Column) -> Column:
    return (rx > 1.0) | (ry > 1.0)


def prefilter_visible(df: DataFrame) -> DataFrame:
    return df.filter(F.col("rx") + F.col("ry") > 0)


def iou_range(df: DataFrame, low: float = 0.85, high: float = 1.0) -> DataFrame:
    return df.filter(F.col("predicted_iou").between(F.lit(float(low)), F.lit(float(high))))


def mask_records(mask_px: DataFrame) -> DataFrame:
    """Area and box (corner and extent, without + 1) of each mask that has a pixel."""
    box = mask_px.groupBy("view", "mask_id").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("bx"), F.min("y").alias("by"), (F.max("x") - F.min("x")).alias("bw"), (F.max("y") - F.min("y")).alias("bh"))
    return box.filter("area > 0")


def depth_mask(df: DataFrame, inside: Column) -> DataFrame:
    return df.withColumn("depth", F.when(inside, F.col("depth")).otherwise(F.lit(0.0)))


def depth_trunc(df: DataFrame, far: float) -> DataFrame:
    return df.filter(F.col("depth") <= F.lit(float(far)))


def nan_to_num(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))
