"""Surfaces, culling and neighbours of uneven clouds against plain versions."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators import filters, fusion, graph, pointcloud, spatial, surface


def ball(spark, n=12, radius=0.7):
    step = 2.0 / (n - 1)
    rows = [(i, j, k, radius - math.dist((-1 + i * step, -1 + j * step, -1 + k * step), (0.05, 0.02, -0.03))) for i in range(n) for j in range(n) for k in range(n)]
    return spark.createDataFrame(rows, "ix int, iy int, iz int, value double"), step


def signed_volume(v, faces):
    return sum(np.dot(v[a], np.cross(v[b], v[c])) / 6 for a, b, c in faces)


def test_a_ball_gives_a_closed_surface_that_looks_outwards(spark):
    samples, step = ball(spark)
    vertices, faces = surface.marching_cubes(samples, 0.0, (-1.0, -1.0, -1.0), step)
    v = {r["vid"]: np.array([r["x"], r["y"], r["z"]]) for r in vertices.collect()}
    f = [tuple(r) for r in faces.collect()]
    directed = collections.Counter(e for a, b, c in f for e in ((a, b), (b, c), (c, a)))
    assert set(v) == {x for t in f for x in t} and all(n == 1 and directed[q, p] == 1 for (p, q), n in directed.items())
    assert len(v) - len(directed) // 2 + len(f) == 2
    assert abs(signed_volume(v, f) - 4 / 3 * math.pi * 0.7**3) < 0.1
    assert all(abs(math.dist(p, (0.05, 0.02, -0.03)) - 0.7) < 0.03 for p in v.values())


def test_every_case_of_a_cell_is_closed_by_its_neighbours(spark):
    """Random signs hold all cases, also the doubtful ones: inner edges have two faces."""
    rng = random.Random(4)
    n = 9
    inner = range(1, n - 1)
    rows = [(i, j, k, rng.choice([-1.0, 1.0]) * rng.uniform(0.5, 1) if {i, j, k} <= set(inner) else -1.0) for i in range(n) for j in range(n) for k in range(n)]
    samples = spark.createDataFrame(rows, "ix int, iy int, iz int, value double")
    vertices, faces = surface.marching_cubes(samples, 0.0, (0.0,) * 3, 1.0)
    directed = collections.Counter(e for a, b, c in map(tuple, faces.collect()) for e in ((a, b), (b, c), (c, a)))
    assert all(n == directed[q, p] for (p, q), n in directed.items()) and vertices.count() > 300
    sparse = samples.filter("value > 0")
    assert {r["vid"] for r in surface.marching_cubes(sparse, 0.0, (0.0,) * 3, 1.0, -1.0, n)[0].collect()} == {r["vid"] for r in vertices.collect()}


def test_places_out_of_the_span_are_refused(spark):
    far = spark.createDataFrame([(surface.SPAN, 0, 0, 1.0)], "ix int, iy int, iz int, value double")
    with pytest.raises(Exception, match="outside of the span"):
        surface.cut_cells(far, 0.0).collect()


def test_attributes_are_interpolated(spark):
    samples, step = ball(spark)
    vertices, _ = surface.marching_cubes(samples, 0.0, (0.0,) * 3, 1.0)
    given = samples.withColumn("red", F.col("ix") * 2.0)
    assert all(abs(r["red"] - 2 * r["x"]) < 1e-9 for r in surface.interpolated(vertices, given, ("red",)).collect())


def camera(spark):
    rows = [(1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.5, -0.2, -3.0, 20.0, 20.0, 8.0, 6.0, 16, 12), (2, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 10.0, 30.0, 8.0, 6.0, 16, 12)]
    return spark.createDataFrame(rows, "cam int, r00 double, r01 double, r02 double, r10 double, r11 double, r12 double, r20 double, r21 double, r22 double, tx double, ty double, tz double, fx double, fy double, cx double, cy double, w int, h int")


@pytest.mark.parametrize("behind", [False, True])
def test_culling_loses_no_point_in_view(spark, behind):
    from terravane.functions import geometry as g

    rng = random.Random(9)
    points = spark.createDataFrame([(i, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(4000)], "id long, x double, y double, z double")
    u, v, z = g.project(g.vector("x", "y", "z"))

    def seen(df):
        df = df.select("id", "cam", u.alias("u"), v.alias("v"), z.alias("d"), "w", "h").filter("u >= 0 and u < w and v >= 0 and v < h")
        return {(r["id"], r["cam"]) for r in (df if behind else df.filter("d > 0")).collect()}

    near = filters.in_view(points, camera(spark), behind)
    assert seen(near) == seen(points.crossJoin(camera(spark))) and near.count() < 8000 * 0.6
    assert filters.in_view(points.limit(0), camera(spark)).count() == 0


def uneven(rng, n):
    """A surface, a dense cluster, equal points and some far ones."""
    out = [(rng.uniform(0, 10), rng.uniform(0, 10), 0.01 * rng.random()) for _ in range(n)]
    out += [(5 + rng.gauss(0, 0.01), 5 + rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for _ in range(n)]
    out += [(1.0, 1.0, 1.0)] * 40 + [(rng.uniform(-300, 300),) * 3 for _ in range(10)]
    return [(i, *p) for i, p in enumerate(out)]


@pytest.mark.parametrize("k", [1, 6])
def test_neighbours_follow_the_local_density(spark, k):
    rng = random.Random(k)
    a = spark.createDataFrame(uneven(rng, 150), "id long, x double, y double, z double")
    b = spark.createDataFrame(uneven(rng, 400), "id long, x double, y double, z double")
    want = {(r["aid"], r["rank"]): (r["bid"], round(r["d2"], 12)) for r in spatial.knn_join(a, b, k).collect()}
    got = {(r["aid"], r["rank"]): (r["bid"], round(r["d2"], 12)) for r in spatial.knn_join(a, b, k, direct_pairs=0).collect()}
    assert got == want and len(got) == 350 * k


def test_pairs_of_a_clustered_cloud_stay_in_proportion(spark, monkeypatch):
    """Pairs that meet by cells, for each point, at four times the points."""
    rng = random.Random(2)
    per_point = []
    for n in (500, 2000):
        df = spark.createDataFrame(uneven(rng, n), "id long, x double, y double, z double").filter("id < %d" % (2 * n))
        met = []
        nearest = spatial._nearest
        monkeypatch.setattr(spatial, "_nearest", lambda pairs, k, met=met, nearest=nearest: met.append(pairs.count()) or nearest(pairs, k))
        spatial.knn_join(df, df, 5, direct_pairs=0).count()
        monkeypatch.setattr(spatial, "_nearest", nearest)
        per_point.append(sum(met) / (2 * n))
    assert per_point[1] < 1.5 * per_point[0] + 20


def test_quantile_by_narrow_bands(spark):
    rng = random.Random(5)
    for values in ([rng.random() for _ in range(3000)], [rng.choice([1.0, 2.0]) if k % 3 else rng.random() * 5 for k in range(3000)], [float(k // 7) for k in range(3000)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for q in (0.0, 0.01, 0.5, 0.9, 1.0):
            assert abs(pointcloud.quantile(df, "v", q, 50).first()["q"] - np.quantile(values, q)) < 1e-9


def grid_with_a_hole(spark, n=8):
    faces, places = [], [(i * n + j, float(i), float(j), 0.0) for i in range(n) for j in range(n)]
    for i in range(n - 1):
        for j in range(n - 1):
            if not (2 <= i <= 4 and 2 <= j <= 4):
                p = i * n + j
                faces += [(p, p + n, p + n + 1), (p, p + n + 1, p + 1)]
    return spark.createDataFrame(faces, "a long, b long, c long"), spark.createDataFrame(places, "vid long, x double, y double, z double")


@pytest.mark.parametrize("max_edge, splits, smooth", [(None, 0, 0), (1.0, 1000, 0), (0.5, 1000, 4), (0.5, 12, 0)])
def test_holes_are_filled_split_and_smoothed(spark, max_edge, splits, smooth):
    faces, vertices = grid_with_a_hole(spark)
    f, v = graph.fill_holes(faces, vertices, 13.0, max_edge, splits, smooth)
    places = {r["vid"]: (r["x"], r["y"], r["z"]) for r in v.collect()}
    f = [tuple(r) for r in f.collect()]
    edges = collections.Counter(frozenset(e) for a, b, c in f for e in ((a, b), (b, c), (c, a)))
    # only the outer rim is left open
    assert {p for e, n in edges.items() if n == 1 for p in e} == {i * 8 + j for i in range(8) for j in range(8) if i in (0, 7) or j in (0, 7)} and max(edges.values()) == 2
    new = [p for p in places if p >= 64]
    rings = 1 if max_edge is None else min(math.ceil(math.dist((2, 2), (3.5, 3.5)) / max_edge), splits // 12 + 1)
    assert len(new) == 12 * (rings - 1) + 1 and {x for t in f for x in t} <= set(places)
    area = sum(np.linalg.norm(np.cross(np.subtract(places[b], places[a]), np.subtract(places[c], places[a]))) / 2 for a, b, c in f)
    assert abs(area - 49) < 1e-9
    assert all(places[r["vid"]] == (r["x"], r["y"], r["z"]) for r in vertices.collect())


def test_the_default_mesher_ends_in_an_aligned_mesh(spark):
    """Depth maps of a floor and a box above it, seen from above."""
    cams = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 4.0, 32.0, 32.0, 16.0, 16.0, 32, 32), (2, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0, 0.3, 0.0, 4.0, 32.0, 32.0, 16.0, 16.0, 32, 32)], camera(spark).schema)
    px = spark.createDataFrame([(c, y, x, 3.0 if 12 <= x < 20 and 12 <= y < 20 else 4.0, x / 31, y / 31, 0.5) for c in (1, 2) for y in range(32) for x in range(32)], "view long, y int, x int, depth double, red double, green double, blue double")
    splats = spark.createDataFrame([(i, (i % 10) / 4 - 1.2, (i // 10) / 4 - 1.2, 0.02, [0.0, 0.0, 1.0], [float(i % 10), 1.0]) for i in range(100)], "gid long, x double, y double, z double, n array<double>, f array<double>")
    mesh = fusion.fused_mesh(cams, px, splats, 25, -1.5, 1.5, 0.3, max_hole=2.0, transfer=0.5)
    rows = mesh.vertices.collect()
    faces = mesh.faces.collect()
    assert len(rows) > 100 and {x for t in faces for x in t} == {r["vid"] for r in rows}
    assert sum(abs(r["z"]) < 0.1 for r in rows) > len(rows) / 2 and len(mesh.transform) == 3
    assert all(len(r["rgb"]) == 3 and -1e-9 <= min(r["rgb"]) and max(r["rgb"]) <= 1 + 1e-9 for r in rows)
    assert all(abs(r["n"][2] - 1) < 1e-6 or not any(r["n"]) for r in rows) and any(any(r["n"]) for r in rows)
    assert mesh.features.count() == len(rows) and all(len(r["f"]) == 2 for r in mesh.features.collect())
    plain = fusion.fused_mesh(cams, px, splats, 25, -1.5, 1.5, 0.3, repair=False, align=False, transfer=0.5)
    assert plain.transform is None and plain.vertices.count() >= len(rows)


def test_strategies_end_in_meshes(spark):
    assert sorted(fusion.STRATEGIES) == ["dn", "gaussians", "marching", "o3dtsdf", "sugar-coarse", "tsdf"]
    splats = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 3.0, 0.1, 0.2, 0.3), (1, 0.1, 0.0, 0.0, 3.0, 0.4, 0.5, 0.6)], "gid long, x double, y double, z double, opacity double, cr double, cg double, cb double")
    mesh = fusion.strategy("marching")(splats, 16, -0.5, 0.5, 0.2)
    rows = mesh.vertices.collect()
    assert len(rows) > 20 and all((r["cr"] == 0.1) == (r["x"] <= 0.05) for r in rows if abs(r["x"] - 0.05) > 1e-6)
    half = fusion.strategy("marching")(splats, 16, -0.5, 0.5, 0.2, crop=((0.5, 0.0, 0.0), None, (1.0, 2.0, 2.0)))
    assert 0 < half.vertices.count() < len(rows)
