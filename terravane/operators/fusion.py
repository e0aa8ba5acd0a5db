"""Volumes, planes and the meshing strategies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions import geometry as g
from terravane.operators import filters, graph, images, pointcloud, ranks, spatial, surface
from terravane.storage import materialise


def voxel_grid(spark: SparkSession, resolution: int, first: float, last: float) -> DataFrame:
    """(ix, iy, iz, x, y, z) of a cube of sample points, from one range."""
    n = resolution
    grid = spark.range(n * n * n)
    index = {"ix": F.floor(F.col("id") / (n * n)), "iy": F.floor(F.col("id") / n) % n, "iz": F.col("id") % n}
    places = {c: g.voxel_to_world(i, n, first, last) for c, i in zip("xyz", index.values(), strict=True)}
    return grid.select(*[v.cast("int").alias(k) for k, v in index.items()], *[v.alias(k) for k, v in places.items()])


def tsdf_integrate(voxels: DataFrame, cameras: DataFrame, depth_px: DataFrame, trunc: float, far: float = 20.0, min_weight: int = 1, colours: tuple[str, ...] = ()) -> DataFrame:
    """(ix, iy, iz, tsdf, weight): mean truncated distance over the views that see a voxel.

    A voxel projects to the pixel that holds it; its distance is the pixel's depth
    minus its own; what lies more than ``trunc`` behind the surface doesn't count.
    ``colours`` of the pixels are averaged over the same views.
    """
    u, v, z = g.project(g.vector("x", "y", "z"))
    seen = filters.in_view(voxels, cameras).select("ix", "iy", "iz", F.col("cam").alias("view"), F.floor(u).cast("int").alias("px"), F.floor(v).cast("int").alias("py"), z.alias("z"), "w", "h")
    seen = seen.filter((F.col("z") > 0) & (F.col("px") >= 0) & (F.col("px") < F.col("w")) & (F.col("py") >= 0) & (F.col("py") < F.col("h")))
    depth = filters.depth_trunc(depth_px, far).select("view", F.col("y").alias("py"), F.col("x").alias("px"), "depth", *colours)
    sdf = seen.join(depth, ["view", "py", "px"]).withColumn("sdf", F.col("depth") - F.col("z")).filter(F.col("sdf") > -F.lit(float(trunc)))
    mean = sdf.groupBy("ix", "iy", "iz").agg(F.avg(F.least(F.lit(1.0), F.col("sdf") / F.lit(float(trunc)))).alias("tsdf"), F.count(F.lit(1)).alias("weight"), *[F.avg(c).alias(c) for c in colours])
    return mean.filter(F.col("weight") >= min_weight)


def density_grid(voxels: DataFrame, splats: DataFrame, radius2: float) -> DataFrame:
    """(ix, iy, iz, density): sum of opacity * exp(-d2 / 2 sigma2) over the primitives within the radius."""
    span = surface.SPAN
    points = voxels.select(((F.col("ix").cast("long") * span + F.col("iy")) * span + F.col("iz")).alias("id"), "x", "y", "z")
    near = spatial.radius_join(points, splats, radius2, "id", "gid")
    weight = splats.select(F.col("gid").alias("bid"), g.sigmoid(F.col("opacity")).alias("alpha"))
    value = F.col("alpha") * F.exp(-F.col("d2") * F.lit(2.0 / radius2))
    sums = near.join(weight, "bid").groupBy("aid").agg(F.sum(value).alias("density"))
    return sums.select(F.floor(F.col("aid") / (span * span)).cast("int").alias("ix"), (F.floor(F.col("aid") / span) % span).cast("int").alias("iy"), (F.col("aid") % span).cast("int").alias("iz"), "density")


def plane_hypotheses(points: DataFrame, triples: int, seed: int = 7, key: str = "id") -> DataFrame:
    """(hid, a, b, c, d): unit planes through three points each; c >= 0.

    Points are drawn in a seeded order, three for each hypothesis; where they are
    fewer, the points of the first draw are drawn again with the next seed, round
    by round.  Degenerate triples are left out.
    """
    picked = ranks.sample(points, 3 * triples, key, seed).select(F.col(key).cast("string").alias("k"), "x", "y", "z")
    rows = [tuple(r) for r in picked.collect()]  # three points a hypothesis
    out, once = [], len(rows) // 3
    for turn in range(-(-triples // once) if once else 0):
        order = sorted(rows, key=lambda r: (hashlib.md5(f"{seed + turn}:{r[0]}".encode()).hexdigest(), r[0]))
        for j in range(min(once, triples - turn * once)):
            p, q, s = (r[1:] for r in order[3 * j : 3 * j + 3])
            u, v = [b - a for a, b in zip(p, q, strict=True)], [b - a for a, b in zip(p, s, strict=True)]
            normal = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
            length = (normal[0] * normal[0] + normal[1] * normal[1] + normal[2] * normal[2]) ** 0.5
            if length < 1e-12:
                continue
            sign = -1.0 if normal[2] < 0 else 1.0
            a, b, c = (sign * x / length for x in normal)
            out.append((turn * once + j, a, b, c, -(a * p[0] + b * p[1] + c * p[2])))
    return points.sparkSession.createDataFrame(out, "hid int, a double, b double, c double, d double")


def floor_plane(points: DataFrame, hypotheses: DataFrame, threshold: float = 0.02) -> DataFrame:
    """The hypothesis with the most points within the threshold; the first of equals.

    All counts come from one pass over the points.
    """
    rows = hypotheses.orderBy("hid").collect()  # a parameter of the search, not data
    if not rows:
        return hypotheses.select("*", F.lit(0).cast("long").alias("inliers")).limit(0)
    spark = points.sparkSession
    hid, *plane = (np.array([r[k] for r in rows]) for k in ("hid", "a", "b", "c", "d"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b, c, d), n = plane, np.zeros(len(hid), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x, y, z = (v.to_numpy(zero_copy_only=False)[:, None] for v in batch.slice(at, 1024).columns)
                n += (np.abs(a * x + b * y + c * z + d) <= threshold).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(hid, pa.int64()), pa.array(n)], ["hid", "n"])

    places = points.select(*[F.col(k).cast("double") for k in "xyz"])
    counts = [(r["hid"], r["n"]) for r in places.mapInArrow(near, "hid long, n long").groupBy("hid").agg(F.sum("n").alias("n")).collect()] or [(int(hid[0]), 0)]  # one row a hypothesis
    best = max(counts, key=lambda x: (x[1], -x[0]))
    return hypotheses.filter(F.col("hid") == F.lit(best[0])).crossJoin(spark.createDataFrame([(best[1],)], "inliers long"))


def rotation_to_z(a: float, b: float, c: float) -> list[list[float]]:
    """The rotation that turns a unit normal with c >= 0 onto the z axis."""
    k = 1.0 / (1.0 + c)
    return [[1 - a * a * k, -a * b * k, -a], [-a * b * k, 1 - b * b * k, -b], [a, b, c]]


def align_floor(points: DataFrame, triples: int = 1000, threshold: float = 0.02, key: str = "id") -> tuple[DataFrame, list[list[float]]]:
    """Points with the floor at z = 0, and the 3x4 transform.

    The plane is canonical (c >= 0), so moving by + d puts it at 0.
    """
    best = floor_plane(points, plane_hypotheses(points, triples, key=key), threshold).first()
    if best is None:
        return points, [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]]
    m = [[*row, 0.0] for row in rotation_to_z(best["a"], best["b"], best["c"])]
    m[2][3] = best["d"]
    p = g.affine(m, g.vector("x", "y", "z"))
    return points.withColumns(dict(zip("xyz", p, strict=True))), m


def samples_per_frame(total: int, frames: int) -> int:
    return (total + frames) // frames


# --- strategies: each a pipeline of operators


def gaussians_points(splats: DataFrame, min_opacity: float, colour: tuple[float, ...] | None = None, crop: tuple | None = None, voxel: float | None = None, neighbours: int = 20, densify: DataFrame | None = None, cameras: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Primitives ready for surface reconstruction: masks, opacity, colour, samples, box, voxels, outliers."""
    df = splats if cameras is None else filters.mask_reject(splats, cameras, mask, "gid")
    df = filters.opacity(df, min_opacity)
    if colour is not None:
        df = filters.mask_color(df, colour, ("cr", "cg", "cb"))
    df = df.select(F.col("gid").alias("id"), "x", "y", "z")
    if densify is not None:
        df = df.unionByName(densify)
    if crop is not None:
        df = filters.crop(df, *crop)
    if voxel is not None:
        df = pointcloud.voxel_downsample(df, voxel)
    return pointcloud.statistical_outlier(df, neighbours)


def depth_normal_points(px: DataFrame, per_frame: int, edge_threshold: float, crop: tuple | None = None, neighbours: int = 20) -> DataFrame:
    """(id, x, y, z, nx, ny, nz): sampled pixels off the edges of depth, in the world, without outliers.

    ``px``: depth pixels with their camera's columns; ``per_frame`` 0 takes all of them.
    """
    smooth = images.laplacian(px).filter(F.col("laplacian") < F.lit(float(edge_threshold))).drop("laplacian")
    key = images.pixel_key(F.col("view"), F.col("y"), F.col("x"))
    keyed = smooth.filter("depth > 0").withColumn("id", key)
    chosen = _per_frame(keyed, per_frame) if per_frame > 0 else keyed
    p = g.backproject(F.col("x") + 0.5, F.col("y") + 0.5, F.col("depth"))
    world = chosen.select("id", "view", F.col("y").alias("py"), F.col("x").alias("px"), *[v.alias(f"w{c}") for v, c in zip(p, "xyz", strict=True)])
    normals = images.depth_normals(px).withColumnsRenamed({"y": "py", "x": "px"})
    out = world.join(normals, ["view", "py", "px"]).select("id", *[F.col(f"w{c}").alias(c) for c in "xyz"], "nx", "ny", "nz")
    if crop is not None:
        out = filters.crop(out, *crop)
    return pointcloud.statistical_outlier(out, neighbours)


def _per_frame(df: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("view").orderBy(ranks.drawn("id"), "id"))
    return df.withColumn("__r", rank).filter(F.col("__r") <= k).drop("__r")


def level_points(frames: DataFrame, crop: tuple | None = None, neighbours: int = 20, ratio: float = 20.0) -> DataFrame:
    """Surface points of each level, cropped, without outliers of their level.

    ``frames``: (level, id, x, y, z), the union over all frames.
    """
    if crop is not None:
        frames = filters.crop(frames, *crop)
    levels = [r["level"] for r in frames.select("level").distinct().orderBy("level").collect()]  # a few densities
    out = None
    for level in levels:
        own = pointcloud.statistical_outlier(frames.filter(F.col("level") == F.lit(level)), neighbours, ratio)
        out = own if out is None else out.unionByName(own)
    return frames.limit(0) if out is None else out


@dataclass
class Mesh:
    """Vertices (vid, x, y, z and attributes), faces (a, b, c), and the 3x4 transform that was applied."""

    vertices: DataFrame
    faces: DataFrame
    features: DataFrame | None = None
    transform: list[list[float]] | None = None


def _used(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return vertices.join(faces.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct(), "vid", "left_semi")


def nearest_attributes(vertices: DataFrame, points: DataFrame, names: tuple[str, ...], key: str = "id") -> DataFrame:
    """Vertices with attributes of the nearest point."""
    near = spatial.knn_join(vertices, points, 1, "vid", key).select(F.col("aid").alias("vid"), "bid")
    return vertices.join(near, "vid").join(points.select(F.col(key).alias("bid"), *names), "bid").drop("bid")


def marching_mesh(splats: DataFrame, resolution: int, first: float, last: float, radius2: float, iso: float = 0.5, crop: tuple | None = None, colours: tuple[str, ...] = ("cr", "cg", "cb")) -> Mesh:
    """Surface of the primitives' density on a cube of samples, with the nearest primitive's colours."""
    voxels = voxel_grid(splats.sparkSession, resolution, first, last)
    if crop is not None:
        voxels = filters.crop(voxels, *crop)
    density = materialise(density_grid(voxels, splats, radius2).withColumnRenamed("density", "value"))
    vertices, faces = surface.marching_cubes(density, iso, (first,) * 3, (last - first) / (resolution - 1), 0.0, resolution)
    return Mesh(nearest_attributes(materialise(vertices.select("vid", "x", "y", "z")), splats, colours, "gid"), faces)


def volume_surface(volume: DataFrame, resolution: int, first: float, last: float) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces where the distance crosses 0, between voxels that are known; fronts look outwards."""
    samples = volume.select("ix", "iy", "iz", (-F.col("tsdf")).alias("value"))
    return surface.marching_cubes(samples, 0.0, (first,) * 3, (last - first) / (resolution - 1))


def tsdf_mesh(cameras: DataFrame, px: DataFrame, points: DataFrame, resolution: int, first: float, last: float, trunc: float, far: float = 20.0, min_weight: int = 5, colours: tuple[str, ...] = ("red", "green", "blue")) -> Mesh:
    """Surface of the volume where at least ``min_weight`` views agree, with the nearest point's colours.

    ``px``: depth pixels; ``points``: all of them in the world (id, x, y, z, colours).
    """
    voxels = voxel_grid(px.sparkSession, resolution, first, last)
    volume = materialise(tsdf_integrate(voxels, cameras, px, trunc, far, min_weight))
    vertices, faces = volume_surface(volume, resolution, first, last)
    return Mesh(nearest_attributes(materialise(vertices.select("vid", "x", "y", "z")), points, colours), faces)


def fused_mesh(cameras: DataFrame, px: DataFrame, splats: DataFrame, resolution: int, first: float, last: float, trunc: float, far: float = 20.0, repair: bool = True, max_hole: float = 3.0, max_splits: int = 1000, use_largest: bool = False, k: int = 5, transfer: float = 0.03, align: bool = True, colours: tuple[str, ...] = ("red", "green", "blue")) -> Mesh:
    """The default mesher: integrate, extract, clean and repair, transfer colours, normals and features, align.

    ``px``: depth pixels with colours; ``splats``: (gid, x, y, z, n, f) with normals
    and features as arrays.  Vertices get ``rgb`` and ``n``; features are (vid, f).
    ``transfer`` is the largest distance over which attributes go to a vertex.
    """
    voxels = voxel_grid(px.sparkSession, resolution, first, last)
    volume = materialise(tsdf_integrate(voxels, cameras, px, trunc, far, 1, colours))
    vertices, faces = volume_surface(volume, resolution, first, last)
    vertices, faces = materialise(vertices), materialise(faces)
    raw = materialise(surface.interpolated(vertices, volume, colours).select("vid", "x", "y", "z", F.array(*colours).alias("rgb")))
    if repair:
        faces, places = graph.clean_repair(faces, raw.select("vid", "x", "y", "z"), max_hole, use_largest, max_splits)
        faces = materialise(faces)
        places = materialise(_used(places, faces).withColumnRenamed("vid", "id"))
        rgb = pointcloud.features_to_vertices(raw.withColumnRenamed("vid", "id"), places, k, transfer, len(colours), "rgb")
    else:
        places = raw.select(F.col("vid").alias("id"), "x", "y", "z")
        rgb = raw.select(F.col("vid").alias("id"), "rgb")
    points = splats.withColumnRenamed("gid", "id")
    normals = pointcloud.normals_to_vertices(points, places, k, transfer, "n")
    features = pointcloud.features_to_vertices(points, places, k, transfer, None, "f")
    out = places.join(rgb, "id").join(normals, "id")
    transform = None
    if align:
        out, transform = align_floor(materialise(out))
    return Mesh(out.withColumnRenamed("id", "vid"), faces, features.withColumnRenamed("id", "vid"), transform)


STRATEGIES: dict[str, Callable] = {
    "tsdf": tsdf_mesh,
    "o3dtsdf": fused_mesh,
    "dn": depth_normal_points,
    "sugar-coarse": level_points,
    "gaussians": gaussians_points,
    "marching": marching_mesh,
}


def strategy(name: str) -> Callable:
    if name not in STRATEGIES:
        raise ValueError(f"unknown meshing method {name!r}; one of {sorted(STRATEGIES)}")
    return STRATEGIES[name]
