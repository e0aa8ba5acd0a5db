"""Queries of semantic scoring, decoding, volumes and meshing strategies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions import geometry
from terravane.operators import fusion, images, score, spatial, surface
from terravane.plans.geometry import _BACK, depth_with_camera
from terravane.plans.registry import Relations, query, rounded
from terravane.plans.scene import _INV, _LAP, _NORMALS
from terravane.storage import materialise

# --- scoring: label means as queries; label 0 positive, 1 to 3 negative

_TEXT = """SELECT qid, list(v / n ORDER BY i) AS emb FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY qid)) AS n FROM (
SELECT label AS qid, i, avg(f[i]) AS v FROM {vfeat}, (SELECT unnest(range(1, 65)) AS i) WHERE label < 4 GROUP BY label, i)) GROUP BY qid"""
_DOT = "list_sum(list_transform(range(1, 65), lambda i: f[i] * emb[i]))"
_RAW = f"SELECT vid, qid, {_DOT} AS s FROM {{vfeat}}, ({_TEXT})"


def text_queries(r: Relations) -> DataFrame:
    """Mean embedding of each of four labels as a unit vector."""
    means = r("vfeat").filter("label < 4").groupBy(F.col("label").alias("qid")).agg(F.array(*[F.avg(F.col("f")[i]) for i in range(64)]).alias("emb"))
    return means.select("qid", F.when(F.col("qid") == 0, "positive").otherwise("negative").alias("polarity"), score.normalised(F.col("emb")).alias("emb"))


@query(f"SELECT qid, round(emb[1], 6) + 0.0::DOUBLE AS e0, round(emb[64], 6) + 0.0::DOUBLE AS e63, round(list_sum(list_transform(emb, lambda x: x * x)), 6) AS norm2 FROM ({_TEXT})")
def text_encode(r: Relations) -> DataFrame:
    q = text_queries(r)
    return q.select("qid", (F.round(F.col("emb")[0], 6) + 0.0).alias("e0"), (F.round(F.col("emb")[63], 6) + 0.0).alias("e63"), F.round(score.dot(F.col("emb"), F.col("emb")), 6).alias("norm2"))


@query(f"SELECT vid, qid, round(s, 6) + 0.0::DOUBLE AS similarity FROM ({_RAW})")
def raw_similarity(r: Relations) -> DataFrame:
    out = score.raw_similarity(r("vfeat").select("vid", "f"), text_queries(r))
    return out.select("vid", "qid", (F.round("similarity", 6) + 0.0).alias("similarity"))


def _pairwise() -> str:
    return f"""SELECT vid, exp(p / 0.05::DOUBLE) / (3 * exp(p / 0.05::DOUBLE) + e) AS s FROM (SELECT vid, avg(s) FILTER (qid = 0) AS p, sum(exp(s / 0.05::DOUBLE)) FILTER (qid <> 0) AS e FROM ({_RAW}) GROUP BY vid)"""


@query(f"SELECT vid, round(sum(exp(s / 0.05::DOUBLE)) FILTER (qid = 0) / sum(exp(s / 0.05::DOUBLE)), 6) AS similarity FROM ({_RAW}) GROUP BY vid")
def sim_standard(r: Relations) -> DataFrame:
    out = score.similarity(r("vfeat").select("vid", "f"), text_queries(r), "standard")
    return out.select("vid", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vid, round(s, 6) AS similarity FROM ({_pairwise()})")
def sim_pairwise(r: Relations) -> DataFrame:
    out = score.similarity(r("vfeat").select("vid", "f"), text_queries(r), "pairwise")
    return out.select("vid", F.round("similarity", 6).alias("similarity"))


@query("SELECT * FROM (VALUES ('standard', true), ('pairwise', true), ('cosine', false)) AS t(method, accepted)")
def sim_dispatch(r: Relations) -> DataFrame:
    rows = []
    for method in ("standard", "pairwise", "cosine"):
        try:
            score.similarity(r("vfeat").select("vid", "f").limit(1), text_queries(r), method)
            rows.append((method, True))
        except ValueError:
            rows.append((method, False))
    return r.spark.createDataFrame(rows, "method string, accepted boolean")


@query("SELECT * FROM (VALUES ('clip-vit', true), ('SamCLIP', true), ('dinov2', false)) AS t(feature_type, enabled)")
def text_encoder_gate(r: Relations) -> DataFrame:
    return r.spark.createDataFrame([(t, score.scoring_enabled(t)) for t in ("clip-vit", "SamCLIP", "dinov2")], "feature_type string, enabled boolean")


@query("SELECT * FROM (VALUES ('none', 'object'), ('empty', ''), ('two', 'ground,leaves')) AS t(given, negatives)")
def set_text_queries(r: Relations) -> DataFrame:
    rows = [("none", ",".join(score.with_negatives(None))), ("empty", ",".join(score.with_negatives([]))), ("two", ",".join(score.with_negatives(["ground", "leaves"])))]
    return r.spark.createDataFrame(rows, "given string, negatives string")


def decoder_weights() -> tuple[tuple[np.ndarray, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Small fixed weights: 13 inputs, 8 hidden, branches of 4 and 2."""
    i, h = np.arange(13)[:, None], np.arange(8)[None, :]
    w1, b1 = ((i * 7 + h * 3) % 11 - 5) / 10.0, (np.arange(8) - 4) / 20.0
    hh = np.arange(8)[:, None]
    return (w1, b1), {"main": (((hh * 5 + np.arange(4)) % 7 - 3) / 10.0, np.arange(4) / 10.0), "side": (((hh * 2 + np.arange(2)) % 5 - 2) / 10.0, np.zeros(2))}


_HIDDEN = "list_transform(range(0, 8), lambda h: greatest(0, (h - 4) / 20::DOUBLE + list_sum(list_transform(range(0, 13), lambda i: f[i + 1] * (((i * 7 + h * 3) % 11 - 5) / 10::DOUBLE)))))"


@query(f"""SELECT id, round(0.1::DOUBLE + list_sum(list_transform(range(0, 8), lambda h: hid[h + 1] * (((h * 5 + 1) % 7 - 3) / 10::DOUBLE))), 6) + 0.0::DOUBLE AS main1,
round(list_sum(list_transform(range(0, 8), lambda h: hid[h + 1] * (((h * 2) % 5 - 2) / 10::DOUBLE))), 6) + 0.0::DOUBLE AS side0 FROM (SELECT id, {_HIDDEN} AS hid FROM {{pts}})""")
def mlp_decode(r: Relations) -> DataFrame:
    out = score.mlp_decode(r("pts").select("id", "f"), *decoder_weights())
    return out.select("id", (F.round(F.col("main")[1], 6) + 0.0).alias("main1"), (F.round(F.col("side")[0], 6) + 0.0).alias("side0"))


@query("""WITH t AS (SELECT oy, ox, greatest((oy + 0.5) * 3 / 24::DOUBLE - 0.5, 0) AS sy, greatest((ox + 0.5) * 4 / 32::DOUBLE - 0.5, 0) AS sx FROM (SELECT unnest(range(0, 24))::INTEGER AS oy), (SELECT unnest(range(0, 32))::INTEGER AS ox)),
k AS (SELECT oy, ox, least(2, floor(sy)::INTEGER + dy) AS y0, least(3, floor(sx)::INTEGER + dx) AS x0, (CASE WHEN dy = 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE WHEN dx = 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS w FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dy, dx))
SELECT id // 12 AS view, oy AS y, ox AS x, round(sum(w * f[1]), 6) + 0.0::DOUBLE AS value FROM k JOIN {pts} p ON p.id % 12 = y0 * 4 + x0 GROUP BY ALL""")
def decode_resize(r: Relations) -> DataFrame:
    small = r("pts").select(F.floor(F.col("id") / 12).alias("view"), F.floor(F.col("id") % 12 / 4).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("x"), F.col("f")[0].alias("value"))
    out = images.bilinear(small, 3, 4, 24, 32)
    return out.select("view", "y", "x", (F.round("value", 6) + 0.0).alias("value"))


@query(f"SELECT vid, round(s, 6) AS similarity, round(s / max(s) OVER (), 6) AS red, 0.0::DOUBLE AS green, 0.0::DOUBLE AS blue FROM ({_pairwise()})")
def query_mesh(r: Relations) -> DataFrame:
    scored = score.similarity_colors(score.similarity(r("vfeat").select("vid", "f"), text_queries(r), "pairwise"))
    return scored.select("vid", F.round("similarity", 6).alias("similarity"), F.round("red", 6).alias("red"), "green", "blue")


@query(f"""WITH s AS (SELECT vid // 12 AS view, (vid % 12) // 4 AS y, vid % 4 AS x, s FROM ({_pairwise()}) ),
t AS (SELECT oy, ox, greatest((oy + 0.5) * 3 / 6::DOUBLE - 0.5, 0) AS sy, greatest((ox + 0.5) * 4 / 8::DOUBLE - 0.5, 0) AS sx FROM (SELECT unnest(range(0, 6))::INTEGER AS oy), (SELECT unnest(range(0, 8))::INTEGER AS ox)),
k AS (SELECT oy, ox, least(2, floor(sy)::INTEGER + dy) AS y0, least(3, floor(sx)::INTEGER + dx) AS x0, (CASE WHEN dy = 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE WHEN dx = 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS w FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dy, dx))
SELECT view, oy AS y, ox AS x, round(sum(w * s), 6) AS similarity FROM k JOIN s ON s.y = y0 AND s.x = x0 GROUP BY view, oy, ox""")
def similarity_map(r: Relations) -> DataFrame:
    scored = score.similarity(r("vfeat").select("vid", "f"), text_queries(r), "pairwise")
    px = scored.select(F.floor(F.col("vid") / 12).alias("view"), F.floor(F.col("vid") % 12 / 4).cast("int").alias("y"), (F.col("vid") % 4).cast("int").alias("x"), F.col("similarity").alias("value"))
    return images.bilinear(px, 3, 4, 6, 8).select("view", "y", "x", F.round("value", 6).alias("similarity"))


@query()
def pca_rgb(r: Relations) -> DataFrame:
    return rounded(score.pca_rgb(r("pts").select("id", "f")), "red", "green", "blue")


# --- volumes and planes

_VOXELS = "SELECT i // 256 AS ix, (i // 16) % 16 AS iy, i % 16 AS iz, (i // 256) / 15::DOUBLE * 40 - 20 AS x, ((i // 16) % 16) / 15::DOUBLE * 40 - 20 AS y, (i % 16) / 15::DOUBLE * 40 - 20 AS z FROM (SELECT unnest(range(0, 4096)) AS i)"
_TSDF = f"""SELECT ix, iy, iz, avg(least(1, (depth - pz) / 5)) AS tsdf, count(*) AS weight FROM (
SELECT v.ix, v.iy, v.iz, c.cam, c.w, c.h, r02*(v.x-tx) + r12*(v.y-ty) + r22*(v.z-tz) AS pz,
(r00*(v.x-tx) + r10*(v.y-ty) + r20*(v.z-tz)) * fx / nullif(r02*(v.x-tx) + r12*(v.y-ty) + r22*(v.z-tz), 0) + cx AS u,
(r01*(v.x-tx) + r11*(v.y-ty) + r21*(v.z-tz)) * fy / nullif(r02*(v.x-tx) + r12*(v.y-ty) + r22*(v.z-tz), 0) + cy AS v FROM ({_VOXELS}) v, {{cameras}} c) p
JOIN {{depth_px}} d ON d.view = cam AND d.x = floor(u) AND d.y = floor(v) WHERE pz > 0 AND u >= 0 AND u < w AND v >= 0 AND v < h AND depth <= 30 AND depth - pz > -5 GROUP BY ix, iy, iz"""


def _volume(r: Relations, min_weight: int) -> DataFrame:
    voxels = fusion.voxel_grid(r.spark, 16, -20.0, 20.0)
    return fusion.tsdf_integrate(voxels, r("cameras"), r("depth_px"), 5.0, 30.0, min_weight)


@query(f"SELECT ix::INTEGER AS ix, iy::INTEGER AS iy, iz::INTEGER AS iz, round(tsdf, 9) + 0.0::DOUBLE AS tsdf, weight FROM ({_TSDF})")
def tsdf_integrate(r: Relations) -> DataFrame:
    return rounded(_volume(r, 1), "tsdf")


def _cubes(samples: str, iso: str, first: str, step: str, fill: str | None = None, resolution: int | None = None) -> str:
    """CTEs ``mv`` (vid, x, y, z) and ``mf`` (a, b, c): marching cubes over samples (ix, iy, iz, value)."""
    corners = ", ".join(f"({n}, {i}, {j}, {k})" for n, (i, j, k) in enumerate(surface.CORNERS))
    edges = ", ".join(f"({n}, {p}, {q}, {axis}, {', '.join(map(str, surface.CORNERS[p]))})" for n, (p, q, axis) in enumerate(surface.EDGES))
    table = ", ".join(f"({c}, {t[0]}, {t[1]}, {t[2]})" for c, ts in surface.cases().items() for t in ts)
    value = "coalesce(max(value) FILTER (n = {n}), %s)" % fill if fill else "max(value) FILTER (n = {n})"
    inside = f" AND greatest(ix - i, iy - j, iz - k) <= {resolution - 2}" if resolution else ""
    known = "" if fill else "HAVING count(*) = 8"
    case = " + ".join(f"(v[{n + 1}] > {iso})::INT * {1 << n}" for n in range(8))
    name = "(((cx + e{0}.i) * 1048576 + cy + e{0}.j) * 1048576 + cz + e{0}.k) * 3 + e{0}.axis"
    place = [f"{first} + {step} * (c{x} + e0.{i} + CASE WHEN e0.axis = {n} THEN ({iso} - v[e0.p + 1]) / (v[e0.q + 1] - v[e0.p + 1]) ELSE 0 END) AS {x}" for n, (x, i) in enumerate(zip("xyz", "ijk", strict=True))]
    return f"""ms AS ({samples}), mc AS (SELECT ix - i AS cx, iy - j AS cy, iz - k AS cz, [{", ".join(value.format(n=n) for n in range(8))}] AS v FROM ms, (VALUES {corners}) AS o(n, i, j, k) WHERE least(ix - i, iy - j, iz - k) >= 0{inside} GROUP BY ALL {known}),
mt(kase, ea, eb, ec) AS (VALUES {table}), me(e, p, q, axis, i, j, k) AS (VALUES {edges}), mk AS (SELECT *, {case} AS kase FROM mc),
mf AS (SELECT {name.format(1)} AS a, {name.format(2)} AS b, {name.format(3)} AS c FROM mk JOIN mt USING (kase) JOIN me e1 ON e1.e = ea JOIN me e2 ON e2.e = eb JOIN me e3 ON e3.e = ec),
mv AS (SELECT vid, min(x) AS x, min(y) AS y, min(z) AS z FROM (SELECT {name.format(0)} AS vid, {", ".join(place)} FROM mk JOIN (SELECT DISTINCT kase, unnest([ea, eb, ec]) AS e FROM mt) USING (kase) JOIN me e0 USING (e)) GROUP BY vid)"""


_RGB = "x / 31::DOUBLE AS red, y / 23::DOUBLE AS green, depth / 60::DOUBLE AS blue"
_TSDF5 = _TSDF.replace(_VOXELS, "SELECT i // 1024 AS ix, (i // 32) % 32 AS iy, i % 32 AS iz, (i // 1024) / 31::DOUBLE * 60 - 30 AS x, ((i // 32) % 32) / 31::DOUBLE * 60 - 30 AS y, (i % 32) / 31::DOUBLE * 60 - 30 AS z FROM (SELECT unnest(range(0, 32768)) AS i)").replace("/ 5))", "/ 20))").replace("<= 30", "<= 60").replace("> -5 GROUP", "> -20 GROUP")
_CUBES5 = _cubes(f"SELECT ix, iy, iz, -tsdf AS value FROM ({_TSDF5}) WHERE weight >= 5", "0.0::DOUBLE", "-30.0::DOUBLE", "(60 / 31::DOUBLE)")


def coloured_pixels(r: Relations) -> DataFrame:
    """Depth pixels with colours that follow from their place and depth."""
    return r("depth_px").withColumns({"red": F.col("x") / 31.0, "green": F.col("y") / 23.0, "blue": F.col("depth") / 60.0})


def pixel_points(r: Relations) -> DataFrame:
    """All depth pixels in the world, with their colours."""
    px = depth_with_camera(r)
    p = geometry.backproject(F.col("x") + 0.5, F.col("y") + 0.5, F.col("depth"))
    rgb = {"red": F.col("x") / 31.0, "green": F.col("y") / 23.0, "blue": F.col("depth") / 60.0}
    return px.select(images.pixel_key(F.col("view"), F.col("y"), F.col("x")).alias("id"), *[v.alias(f"w{c}") for v, c in zip(p, "xyz", strict=True)], *[v.alias(k) for k, v in rgb.items()]).withColumnsRenamed({f"w{c}": c for c in "xyz"})


def _vdb(r: Relations) -> fusion.Mesh:
    return fusion.tsdf_mesh(r("cameras"), r("depth_px"), pixel_points(r), 32, -30.0, 30.0, 20.0, 60.0, 5)


@query(f"""WITH w AS ({_BACK}), p AS (SELECT (w.view * 100000 + w.y) * 100000 + w.x AS id, wx, wy, wz, {_RGB.replace("x /", "w.x /").replace("y /", "w.y /").replace("depth /", "w.depth /")} FROM w), {_CUBES5}
SELECT vid, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y, round(z, 6) + 0.0::DOUBLE AS z, round(n.red, 6) AS red, round(n.green, 6) AS green, round(n.blue, 6) AS blue FROM
(SELECT v.vid, v.x, v.y, v.z, arg_min({{'red': red, 'green': green, 'blue': blue}}, {{'d': (v.x-wx)**2 + (v.y-wy)**2 + (v.z-wz)**2, 'id': id}}) AS n FROM mv v, p GROUP BY ALL)""")
def tsdf_vdb(r: Relations) -> DataFrame:
    return _vdb(r).vertices.select("vid", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"], *[F.round(c, 6).alias(c) for c in ("red", "green", "blue")])


@query(f"WITH {_CUBES5} SELECT a, b, c FROM mf")
def tsdf_vdb_faces(r: Relations) -> DataFrame:
    return _vdb(r).faces


_TSDF_RGB = _TSDF.replace("count(*) AS weight", "count(*) AS weight, avg(red) AS red, avg(green) AS green, avg(blue) AS blue").replace("{depth_px}", f"(SELECT *, {_RGB} FROM {{depth_px}})")
_CUBES1 = _cubes(f"SELECT ix, iy, iz, -tsdf AS value FROM ({_TSDF_RGB})", "0.0::DOUBLE", "-20.0::DOUBLE", "(40 / 15::DOUBLE)")


@query(f"""WITH t AS ({_TSDF_RGB}), {_CUBES1}, p AS (SELECT *, vid % 3 AS axis, (vid // 3) % 1048576 AS gz, (vid // 3 // 1048576) % 1048576 AS gy, vid // 3 // 1048576 // 1048576 AS gx FROM mv),
s AS (SELECT p.*, CASE axis WHEN 0 THEN (x + 20) / (40 / 15::DOUBLE) - gx WHEN 1 THEN (y + 20) / (40 / 15::DOUBLE) - gy ELSE (z + 20) / (40 / 15::DOUBLE) - gz END AS share FROM p)
SELECT vid, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y, round(z, 6) + 0.0::DOUBLE AS z, round(l.red * (1 - share) + h.red * share, 6) AS red, round(l.green * (1 - share) + h.green * share, 6) AS green, round(l.blue * (1 - share) + h.blue * share, 6) AS blue
FROM s JOIN t l ON l.ix = gx AND l.iy = gy AND l.iz = gz JOIN t h ON h.ix = gx + (axis = 0)::INT AND h.iy = gy + (axis = 1)::INT AND h.iz = gz + (axis = 2)::INT""")
def tsdf_o3d(r: Relations) -> DataFrame:
    """Vertices of the default mesher's surface, before it is repaired, with fused colours."""
    rgb = ("red", "green", "blue")
    volume = fusion.tsdf_integrate(fusion.voxel_grid(r.spark, 16, -20.0, 20.0), r("cameras"), coloured_pixels(r), 5.0, 30.0, 1, rgb)
    volume = materialise(volume)
    vertices, _ = fusion.volume_surface(volume, 16, -20.0, 20.0)
    out = surface.interpolated(vertices, volume, rgb)
    return out.select("vid", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"], *[F.round(c, 6).alias(c) for c in rgb])


@query(f"WITH {_CUBES1} SELECT a, b, c FROM mf")
def tsdf_o3d_faces(r: Relations) -> DataFrame:
    return fusion.volume_surface(_volume(r, 1), 16, -20.0, 20.0)[1]


@query()
def tsdf_o3d_mesh(r: Relations) -> DataFrame:
    """The default mesher from depth pixels to aligned vertices with colours, normals and features."""
    splats = r("splats").select("gid", *[(F.col(c) * 40).alias(c) for c in "xyz"], F.array("qx", "qy", "qz").alias("n"), F.array("cr", "cg", "cb").alias("f"))
    mesh = fusion.fused_mesh(r("cameras"), coloured_pixels(r), splats, 16, -20.0, 20.0, 5.0, 30.0, max_hole=60.0, transfer=10.0)
    out = mesh.vertices.join(mesh.features, "vid")
    return out.select("vid", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"], *[F.transform(c, lambda v: F.round(v, 6) + 0.0).alias(c) for c in ("rgb", "n", "f")])


_DENS = """SELECT v.i // 1024 AS ix, (v.i // 32) % 32 AS iy, v.i % 32 AS iz, sum(1 / (1 + exp(-g.opacity)) * exp(-((v.x-g.x)**2 + (v.y-g.y)**2 + (v.z-g.z)**2) * 2 / 0.0051::DOUBLE)) AS density FROM (
SELECT i, (i // 1024) / 31::DOUBLE * 0.8::DOUBLE - 0.4::DOUBLE AS x, ((i // 32) % 32) / 31::DOUBLE * 0.8::DOUBLE - 0.4::DOUBLE AS y, (i % 32) / 31::DOUBLE * 0.8::DOUBLE - 0.4::DOUBLE AS z FROM (SELECT unnest(range(0, 32768)) AS i)) v
JOIN {splats} g ON (v.x-g.x)**2 + (v.y-g.y)**2 + (v.z-g.z)**2 <= 0.0051::DOUBLE GROUP BY v.i"""
_CUBES = _cubes(f"SELECT ix, iy, iz, density AS value FROM ({_DENS})", "0.5001::DOUBLE", "-0.4::DOUBLE", "(0.8::DOUBLE / 31)", "0", 32)


@query(f"SELECT ix::INTEGER AS ix, iy::INTEGER AS iy, iz::INTEGER AS iz, round(density, 6) AS density FROM ({_DENS})")
def marching_cubes_density(r: Relations) -> DataFrame:
    d = fusion.density_grid(fusion.voxel_grid(r.spark, 32, -0.4, 0.4), r("splats"), 0.0051)
    return d.select("ix", "iy", "iz", F.round("density", 6).alias("density"))


def _marching(r: Relations) -> fusion.Mesh:
    return fusion.marching_mesh(r("splats"), 32, -0.4, 0.4, 0.0051, 0.5001)


@query(f"""WITH {_CUBES} SELECT vid, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y, round(z, 6) + 0.0::DOUBLE AS z, n.cr, n.cg, n.cb FROM
(SELECT v.vid, v.x, v.y, v.z, arg_min({{'cr': cr, 'cg': cg, 'cb': cb}}, {{'d': (v.x-g.x)**2 + (v.y-g.y)**2 + (v.z-g.z)**2, 'gid': gid}}) AS n FROM mv v, {{splats}} g GROUP BY ALL)""")
def marching_cubes(r: Relations) -> DataFrame:
    return _marching(r).vertices.select("vid", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"], "cr", "cg", "cb")


@query(f"WITH {_CUBES} SELECT a, b, c FROM mf")
def marching_cubes_faces(r: Relations) -> DataFrame:
    return _marching(r).faces


def _fixed_planes(r: Relations) -> DataFrame:
    rows = [(h, *n, d) for h, (n, d) in enumerate([((0.0, 0.0, 1.0), -0.05), ((0.0, 0.6, 0.8), 0.01), ((0.6, 0.0, 0.8), -0.02), ((0.28, 0.0, 0.96), 0.03)])]
    return r.spark.createDataFrame(rows, "hid int, a double, b double, c double, d double")


@query("""SELECT h.hid, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d, count(*) AS inliers FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, -0.05::DOUBLE), (1, 0.0, 0.6, 0.8, 0.01), (2, 0.6, 0.0, 0.8, -0.02), (3, 0.28, 0.0, 0.96, 0.03)) AS h(hid, a, b, c, d), {pts} p
WHERE abs(a*x + b*y + c*z + d) <= 0.02::DOUBLE GROUP BY ALL ORDER BY inliers DESC, hid LIMIT 1""")
def floor_plane(r: Relations) -> DataFrame:
    return fusion.floor_plane(r("pts"), _fixed_planes(r), 0.02)


_PLANES = """SELECT turn * once + j AS hid, sgn * nx / len AS a, sgn * ny / len AS b, sgn * nz / len AS c, p, len FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len, CASE WHEN nz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sgn FROM (
SELECT turn, j, once, p, (q.y-p.y) * (s.z-p.z) - (q.z-p.z) * (s.y-p.y) AS nx, (q.z-p.z) * (s.x-p.x) - (q.x-p.x) * (s.z-p.z) AS ny, (q.x-p.x) * (s.y-p.y) - (q.y-p.y) * (s.x-p.x) AS nz FROM (
SELECT turn, once, i // 3 AS j, max({'x': x, 'y': y, 'z': z}) FILTER (i % 3 = 0) AS p, max({'x': x, 'y': y, 'z': z}) FILTER (i % 3 = 1) AS q, max({'x': x, 'y': y, 'z': z}) FILTER (i % 3 = 2) AS s FROM (
SELECT turn, n // 3 AS once, x, y, z, row_number() OVER (PARTITION BY turn ORDER BY md5((7 + turn) || ':' || id), id::VARCHAR) - 1 AS i FROM (SELECT *, count(*) OVER () AS n FROM (SELECT id, x, y, z FROM {pts} ORDER BY md5('7:' || id), id LIMIT 3000)), (SELECT unnest(range(0, 1000)) AS turn) WHERE turn * (n // 3) < 1000)
WHERE i < 3 * once AND turn * once + i // 3 < 1000 GROUP BY ALL))) WHERE len >= 1e-12"""
_FLOOR = f"SELECT a, b, c, d FROM (SELECT h.hid, a, b, c, d, count(*) AS n FROM (SELECT hid, a, b, c, -(a * p.x + b * p.y + c * p.z) AS d FROM ({_PLANES})) h, {{pts}} t WHERE abs(a * t.x + b * t.y + c * t.z + d) <= 0.02::DOUBLE GROUP BY ALL) ORDER BY n DESC, hid LIMIT 1"


@query(f"""SELECT id, round((1 - a * a / (1 + c)) * x - a * b / (1 + c) * y - a * z, 6) + 0.0::DOUBLE AS x, round(-a * b / (1 + c) * x + (1 - b * b / (1 + c)) * y - b * z, 6) + 0.0::DOUBLE AS y, round(a * x + b * y + c * z + d, 6) + 0.0::DOUBLE AS z FROM {{pts}}, ({_FLOOR})""")
def align_floor(r: Relations) -> DataFrame:
    out = fusion.align_floor(r("pts").select("id", "x", "y", "z"))[0]
    return out.select("id", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


# --- strategies

_OUTLIER = "SELECT a.id, list_avg(min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), 20)) AS mean FROM c a, c b GROUP BY a.id"


@query(f"""WITH s AS (SELECT gid AS id, x, y, z FROM {{splats}} WHERE opacity > -0.1::DOUBLE AND abs(x) <= 0.2 AND abs(y) <= 0.2 AND abs(z) <= 0.2), l AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM s),
c AS (SELECT min(id) AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM s, l GROUP BY floor((x - lx) / 0.04::DOUBLE), floor((y - ly) / 0.04::DOUBLE), floor((z - lz) / 0.04::DOUBLE)), o AS ({_OUTLIER})
SELECT id FROM o, (SELECT avg(mean) + 2 * stddev_samp(mean) AS lim FROM o) WHERE mean > 0 AND mean < lim""")
def gaussians_poisson(r: Relations) -> DataFrame:
    return fusion.gaussians_points(r("splats"), -0.1, crop=((0.0, 0.0, 0.0), None, (0.4, 0.4, 0.4)), voxel=0.04).select("id")


_DN = f"""{_INV}, l AS ({_LAP}), w AS ({_BACK}), c AS (SELECT (w.view * 100000 + w.y) * 100000 + w.x AS id, wx AS x, wy AS y, wz AS z FROM w JOIN l USING (view, y, x) WHERE lap < 0.0201::DOUBLE AND depth > 0), o AS ({_OUTLIER})
SELECT id FROM o, (SELECT avg(mean) + 2 * stddev_samp(mean) AS lim FROM o) WHERE mean > 0 AND mean < lim"""


@query(_DN)
def depth_normal_poisson(r: Relations) -> DataFrame:
    px = depth_with_camera(r).drop("u", "v", "n")
    return fusion.depth_normal_points(px, 0, 0.0201).select("id")


@query(f"""{_INV}, l AS ({_LAP}), w AS ({_BACK}), k AS (SELECT w.view, w.y AS py, w.x AS px, (w.view * 100000 + w.y) * 100000 + w.x AS id, wx AS x, wy AS y, wz AS z FROM w JOIN l USING (view, y, x) WHERE lap < 0.0201::DOUBLE AND depth > 0),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY view ORDER BY md5('7:' || id), id) AS place FROM k) WHERE place <= 201), o AS ({_OUTLIER})
SELECT c.id, round(c.x, 9) + 0.0::DOUBLE AS x, round(c.y, 9) + 0.0::DOUBLE AS y, round(c.z, 9) + 0.0::DOUBLE AS z, nx, ny, nz FROM o JOIN c USING (id) JOIN ({_NORMALS}) n ON n.view = c.view AND n.y = c.py AND n.x = c.px, (SELECT avg(mean) + 2 * stddev_samp(mean) AS lim FROM o) WHERE mean > 0 AND mean < lim""")
def depth_normal_samples(r: Relations) -> DataFrame:
    px = depth_with_camera(r).drop("u", "v", "n")
    out = fusion.depth_normal_points(px, fusion.samples_per_frame(1400, 7), 0.0201)
    return rounded(out, "x", "y", "z", "nx", "ny", "nz")


@query(f"""WITH a AS (SELECT label % 2 AS level, id, x, y, z FROM {{pts}} WHERE abs(x) <= 0.25), {', '.join(f"o{k} AS ({_OUTLIER.replace('FROM c a, c b', f'FROM (SELECT * FROM a WHERE level = {k}) a, (SELECT * FROM a WHERE level = {k}) b')})" for k in (0, 1))}
SELECT {' UNION ALL SELECT '.join(f"{k} AS level, id FROM o{k}, (SELECT avg(mean) + 2 * stddev_samp(mean) AS lim FROM o{k}) WHERE mean > 0 AND mean < lim" for k in (0, 1))}""")
def level_set(r: Relations) -> DataFrame:
    p = r("pts").select((F.col("label") % 2).cast("int").alias("level"), "id", "x", "y", "z")
    return fusion.level_points(p, crop=(None, None, (0.5, 100.0, 100.0)), ratio=2.0).select("level", "id")


@query("SELECT unnest(['dn', 'gaussians', 'marching', 'o3dtsdf', 'sugar-coarse', 'tsdf']) AS command")
def commands(r: Relations) -> DataFrame:
    return r.spark.createDataFrame([(c,) for c in sorted(fusion.STRATEGIES)], "command string")


@query("SELECT p.id, v.bid FROM {points} p JOIN (SELECT aid, bid FROM (SELECT p.id AS aid, v.id AS bid, row_number() OVER (PARTITION BY p.id ORDER BY (p.x-v.x)**2 + (p.y-v.y)**2 + (p.z-v.z)**2, v.id) AS k FROM {points} p, {vertices} v) WHERE k = 1) v ON v.aid = p.id")
def knn_join_grid(r: Relations) -> DataFrame:
    """The neighbour join by cells, forced on small relations."""
    near = spatial.knn_join(r("points"), r("vertices"), 1, direct_pairs=0)
    return near.select(F.col("aid").alias("id"), "bid")
