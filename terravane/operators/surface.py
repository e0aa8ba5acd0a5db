"""Iso-surfaces of sampled volumes: marching cubes, cell by cell.

A volume is a relation (ix, iy, iz, value) of samples.  Every sample is sent to the
eight cells around it; one aggregate by cell gathers the corners, and a cell that
the surface cuts gives its triangles from a table of 254 cases.  A vertex is named
by the grid edge it lies on, so that cells agree on it without meeting.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: grid places along an axis; three numbers below it and an axis make one 64-bit name
SPAN = 1 << 20
CORNERS = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
#: (lower corner, upper corner, axis) of the twelve edges
EDGES = [(p, q, axis) for p in range(8) for axis in range(3) if (q := p | 4 >> axis) != p]


def _face_cycles() -> list[list[int]]:
    """Corners of each face, counter-clockwise as seen from outside."""
    faces = []
    for axis in range(3):
        u, v = (axis + 1) % 3, (axis + 2) % 3
        for side in (0, 1):
            cycle = []
            for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)):
                place = [0, 0, 0]
                place[axis], place[u], place[v] = side, a, b
                cycle.append(CORNERS.index(tuple(place)))
            faces.append(cycle if side else cycle[::-1])
    return faces


@cache
def cases() -> dict[int, list[tuple[int, int, int]]]:
    """Triangles (three edges each) by case; bit k of a case tells that corner k is above.

    On each face, every run of corners above is cut off by a segment, from the edge
    where the cycle enters the run to the edge where it leaves it.  Two cells see the
    same corners of their common face, so they cut it alike.  An edge is entered on
    one of its faces and left on the other: the segments form loops, and a loop
    gives a fan of triangles, with the front towards the corners below.
    """
    number = {frozenset(e[:2]): n for n, e in enumerate(EDGES)}
    out: dict[int, list[tuple[int, int, int]]] = {}
    for case in range(1, 255):
        above = [bool(case >> k & 1) for k in range(8)]
        follow: dict[int, int] = {}
        for cycle in _face_cycles():
            steps = list(zip(cycle, cycle[1:] + cycle[:1], strict=True))
            for at, (p, q) in enumerate(steps):
                if not above[p] and above[q]:
                    turn = next(s for s in steps[at + 1 :] + steps[: at + 1] if above[s[0]] and not above[s[1]])
                    follow[number[frozenset((p, q))]] = number[frozenset(turn)]
        triangles = []
        while follow:
            loop = [min(follow)]
            while (step := follow.pop(loop[-1])) != loop[0]:
                loop.append(step)
            triangles += [(loop[0], a, b) for a, b in zip(loop[1:], loop[2:], strict=False)]
        out[case] = triangles
    return out


def _looked_up(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _place(edge: Column) -> list[Column]:
    """Grid place of an edge's lower corner, and its axis."""
    lower = [_looked_up([CORNERS[p][n] for p, _, _ in EDGES], edge) for n in range(3)]
    return [F.col(c) + low for c, low in zip(("cx", "cy", "cz"), lower, strict=True)] + [_looked_up([a for _, _, a in EDGES], edge)]


def _name(place: list[Column]) -> Column:
    x, y, z, axis = (c.cast("long") for c in place)
    return ((x * SPAN + y) * SPAN + z) * 3 + axis


def cut_cells(samples: DataFrame, iso: float, fill: float | None = None, resolution: int | None = None) -> DataFrame:
    """(cx, cy, cz, v0 to v7, case) of the cells that the surface cuts, by their lowest corner.

    A sample lies above where its value is larger than ``iso``.  Without ``fill`` a
    cell needs all eight samples; else missing ones have that value, and cells lie
    inside of the grid of ``resolution`` samples along each axis.
    """
    outside = F.greatest("ix", "iy", "iz") >= F.lit(SPAN)
    given = samples.filter(F.when(outside | (F.least("ix", "iy", "iz") < 0), F.raise_error(F.lit("a grid place lies outside of the span"))).otherwise(F.col("value").isNotNull()))
    corner = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for n, (i, j, k) in enumerate(CORNERS)]))
    sent = given.select("ix", "iy", "iz", "value", corner.alias("c")).select((F.col("ix") - F.col("c.i")).alias("cx"), (F.col("iy") - F.col("c.j")).alias("cy"), (F.col("iz") - F.col("c.k")).alias("cz"), F.col("c.n").alias("n"), "value")
    sent = sent.filter(F.least("cx", "cy", "cz") >= 0)
    if resolution is not None:
        sent = sent.filter(F.greatest("cx", "cy", "cz") <= resolution - 2)
    cells = sent.groupBy("cx", "cy", "cz").agg(*[F.max(F.when(F.col("n") == n, F.col("value"))).alias(f"v{n}") for n in range(8)], F.count(F.lit(1)).alias("known"))
    if fill is None:
        cells = cells.filter("known = 8")
    else:
        cells = cells.withColumns({f"v{n}": F.coalesce(f"v{n}", F.lit(float(fill))) for n in range(8)})
    case = sum(((F.col(f"v{n}") > F.lit(float(iso))).cast("int") * (1 << n) for n in range(1, 8)), (F.col("v0") > F.lit(float(iso))).cast("int"))
    return cells.drop("known").withColumn("case", case).filter((F.col("case") > 0) & (F.col("case") < 255))


def marching_cubes(samples: DataFrame, iso: float, origin: tuple[float, float, float], step: float, fill: float | None = None, resolution: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z, gx, gy, gz, axis, share) and triangles (a, b, c) of the surface.

    A vertex lies on the grid edge that leaves (gx, gy, gz) along ``axis``, at
    ``share`` of its length, where the values cross ``iso``.  Fronts look to values
    below.  Every pair of cells that both exist shares its edges.
    """
    cells = cut_cells(samples, iso, fill, resolution)
    table = samples.sparkSession.createDataFrame([(c, t) for c, t in cases().items()], "case int, t array<struct<a:int,b:int,c:int>>")
    cells = cells.join(F.broadcast(table), "case")  # 254 rows
    each = cells.select("cx", "cy", "cz", F.explode("t").alias("t"))
    triangles = each.select(*[_name(_place(F.col(f"t.{n}"))).alias(n) for n in "abc"])
    values = F.array(*[F.col(f"v{n}") for n in range(8)])
    used = F.array_distinct(F.flatten(F.transform("t", lambda t: F.array(t["a"], t["b"], t["c"]))))
    edge = cells.select("cx", "cy", "cz", values.alias("v"), F.explode(used).alias("e"))
    low, high = (F.element_at("v", _looked_up([e[n] for e in EDGES], F.col("e")) + 1) for n in (0, 1))
    place = _place(F.col("e"))
    rows = edge.select(_name(place).alias("vid"), *[c.alias(n) for c, n in zip(place, ("gx", "gy", "gz", "axis"), strict=True)], ((F.lit(float(iso)) - low) / (high - low)).alias("share"))
    rows = rows.groupBy("vid").agg(*[F.min(c).alias(c) for c in ("gx", "gy", "gz", "axis", "share")])  # the cells of an edge agree
    world = [(F.lit(float(o)) + F.lit(float(step)) * (F.col(f"g{c}") + F.when(F.col("axis") == n, F.col("share")).otherwise(F.lit(0.0)))).alias(c) for n, (c, o) in enumerate(zip("xyz", origin, strict=True))]
    return rows.select("vid", *world, "gx", "gy", "gz", "axis", "share"), triangles


def interpolated(vertices: DataFrame, samples: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Vertices with attributes of the samples at both ends of their edges, by their share."""
    ends = []
    for end in (0, 1):
        place = [(F.col(f"g{c}") + F.when(F.col("axis") == n, F.lit(end)).otherwise(F.lit(0))).alias(f"i{c}") for n, c in enumerate("xyz")]
        own = vertices.select("vid", *place).join(samples.select("ix", "iy", "iz", *names), ["ix", "iy", "iz"], "left")
        ends.append(own.select("vid", *[F.col(n).alias(f"__{n}{end}") for n in names]))
    both = vertices.join(ends[0], "vid").join(ends[1], "vid")
    mixed = {n: F.col(f"__{n}0") * (1 - F.col("share")) + F.col(f"__{n}1") * F.col("share") for n in names}
    return both.withColumns(mixed).drop(*[f"__{n}{end}" for n in names for end in (0, 1)])
