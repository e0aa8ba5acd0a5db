"""Scene-shaped relations derived from the stored tables.

Each relation is one SQL text that both engines read; ``{name}`` stands for a
table or another relation.  The few differences of dialect are functions here.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def at(self, array: str, i: int) -> str:
        """Element ``i``, counted from 0."""
        return f"{array}[{i if self.spark else i + 1}]"

    def div(self, a: str, b: str) -> str:
        return f"({a} {'div' if self.spark else '//'} {b})"

    def doubles(self, array: str, start: int, stop: int) -> str:
        """Elements ``start`` to ``stop`` - 1 as an array of doubles."""
        if self.spark:
            return f"transform(slice({array}, {start + 1}, {stop - start}), e -> CAST(e AS DOUBLE))"
        return f"CAST({array}[{start + 1}:{stop}] AS DOUBLE[])"

    def series(self, n: int) -> str:
        """The numbers 0 to ``n`` - 1, one a row."""
        return f"explode(sequence(0, {n - 1}))" if self.spark else f"unnest(range(0, {n}))::INTEGER"


def _pts(d: Dialect) -> str:
    xyz = ", ".join(f"CAST({d.at('embedding', i)} AS DOUBLE) AS {c}" for i, c in enumerate("xyz"))
    return f"SELECT vec_id AS id, {xyz}, {d.doubles('embedding', 3, 16)} AS f, label FROM {{embeddings}}"


#: rotations about one axis with exact cosines and sines (from whole-number right triangles), and places
CAMERAS = [(1, "z", 3, 4, 5), (2, "y", 5, 12, 13), (3, "x", 8, 15, 17), (4, "z", 4, 3, 5), (5, "y", 12, 5, 13), (6, "x", 15, 8, 17), (7, "z", 0, 1, 1)]


def camera_rows() -> list[tuple]:
    rows = []
    for cam, axis, c, s, h in CAMERAS:
        c, s = c / h, s / h
        r = {"z": [c, -s, 0, s, c, 0, 0, 0, 1], "y": [c, 0, s, 0, 1, 0, -s, 0, c], "x": [1, 0, 0, 0, c, -s, 0, s, c]}[axis]
        rows.append((cam, *map(float, r), cam * 0.25, cam * 0.5 - 2, -cam * 0.125, 32.0, 32.0, 16.0, 12.0, 32, 24))
    return rows


CAMERA_COLUMNS = ["cam", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz", "fx", "fy", "cx", "cy", "w", "h"]


def _cameras(d: Dialect) -> str:
    rows = ", ".join("(" + ", ".join(f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) for v in row) + ")" for row in camera_rows())
    return f"SELECT * FROM (VALUES {rows}) AS t({', '.join(CAMERA_COLUMNS)})"


RELATIONS: dict[str, Callable[[Dialect], str]] = {
    "pts": _pts,
    "vertices": lambda d: "SELECT * FROM {pts} WHERE id % 5 = 0",
    "points": lambda d: "SELECT * FROM {pts} WHERE id % 5 <> 0",
    "vfeat": lambda d: f"SELECT vec_id AS vid, {d.doubles('embedding', 0, 64)} AS f, label FROM {{embeddings}}",
    "cloud": lambda d: "SELECT p_partkey AS id, p_size * CAST(0.02 AS DOUBLE) AS x, (CAST(p_retailprice AS DOUBLE) % 100) * CAST(0.01 AS DOUBLE) AS y, (p_partkey % 100) * CAST(0.01 AS DOUBLE) AS z FROM {part}",
    "depth_px": lambda d: "SELECT CAST(l_linenumber AS BIGINT) AS view, CAST(l_suppkey % 24 AS INT) AS y, CAST(l_partkey % 32 AS INT) AS x, sum(l_quantity) / count(*) AS depth, count(*) AS n FROM {lineitem} GROUP BY 1, 2, 3",
    "cameras": _cameras,
    "projected": lambda d: "SELECT event_id AS gid, user_id % 8 AS view, ((event_id * 7919) % 640) / CAST(20 AS DOUBLE) AS u, ((event_id * 104729) % 480) / CAST(20 AS DOUBLE) AS v, value AS depth, (event_id % 11) / CAST(4 AS DOUBLE) AS rx, (event_id % 7) / CAST(4 AS DOUBLE) AS ry FROM {events}",
    "masks": lambda d: f"SELECT p_partkey % 8 AS view, {d.div('p_partkey', '8')} AS mask_id, CAST(0.8 AS DOUBLE) + ((p_partkey * 37) % 25) / CAST(100 AS DOUBLE) AS predicted_iou, CAST((p_partkey * 13) % 20 AS INT) AS x0, CAST((p_partkey * 7) % 14 AS INT) AS y0, CAST(4 + p_size % 9 AS INT) AS mw, CAST(4 + p_size % 7 AS INT) AS mh FROM {{part}}",
    "grid": lambda d: f"SELECT CAST({d.div('i', '32')} AS INT) AS y, CAST(i % 32 AS INT) AS x FROM (SELECT {d.series(768)} AS i) g",
    "mask_px": lambda d: "SELECT m.view, m.mask_id, m.predicted_iou, g.y, g.x FROM {masks} m JOIN {grid} g ON g.x >= m.x0 AND g.x < m.x0 + m.mw AND g.y >= m.y0 AND g.y < m.y0 + m.mh",
    "torus_grid": lambda d: f"SELECT {d.div('k', '20')} AS i, k % 20 AS j FROM (SELECT CAST(n AS BIGINT) AS k FROM (SELECT {d.series(400)} AS n) s) g",
    "torus_vertices": lambda d: "SELECT i * 20 + j AS vid, round((2 + cos(2 * pi() * j / 20)) * cos(2 * pi() * i / 20), 9) + CAST(0 AS DOUBLE) AS x, round((2 + cos(2 * pi() * j / 20)) * sin(2 * pi() * i / 20), 9) + CAST(0 AS DOUBLE) AS y, round(sin(2 * pi() * j / 20), 9) + CAST(0 AS DOUBLE) AS z FROM {torus_grid}",
    "torus_faces": lambda d: "SELECT * FROM (SELECT 2 * (20 * i + j) AS fid, 20 * i + j AS a, 20 * ((i + 1) % 20) + j AS b, 20 * ((i + 1) % 20) + (j + 1) % 20 AS c FROM {torus_grid} UNION ALL SELECT 2 * (20 * i + j) + 1, 20 * i + j, 20 * ((i + 1) % 20) + (j + 1) % 20, 20 * i + (j + 1) % 20 FROM {torus_grid}) t WHERE fid >= 5",
    # primitives of a scene: log scales, quaternion, logit of opacity, colour coefficients
    "splats": lambda d: "SELECT vec_id AS gid, " + ", ".join(f"CAST({d.at('embedding', i)} AS DOUBLE) AS {c}" for i, c in enumerate(["x", "y", "z", "sx", "sy", "sz", "qw", "qx", "qy", "qz", "opacity", "cr", "cg", "cb"])) + ", label FROM {embeddings}",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table or a derived relation as a DataFrame."""
    if name not in RELATIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = RELATIONS[name](Dialect(True))
    return spark.sql(sql, **{n: relation(spark, sf_dir, n) for n in _needs(sql)})


def with_relations(sql: str, recursive: bool = False) -> str:
    """DuckDB text in which every ``{relation}`` is defined and named."""
    done: dict[str, str] = {}

    def visit(text: str) -> str:
        for n in _needs(text):
            if n in RELATIONS and n not in done:
                inner = visit(RELATIONS[n](Dialect(False)))
                done[n] = inner
        return re.sub(r"\{(\w+)\}", r"\1", text)

    body = visit(sql)
    if not done:
        return body
    head = ", ".join(f"{n} AS ({s})" for n, s in done.items())
    start = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if start:
        return f"WITH {'RECURSIVE ' if start[1] or recursive else ''}{head}, {body[start.end():]}"
    return f"WITH {head} {body}"
