"""Queries of projections and scalar geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions import geometry as g
from terravane.plans.registry import Relations, query, r9, rounded

_PX = "SELECT d.view, d.y, d.x, d.depth, c.*, d.x + 0.5::DOUBLE AS u, d.y + 0.5::DOUBLE AS v FROM {depth_px} d JOIN {cameras} c ON c.cam = d.view"
#: world point of each depth pixel
_BACK = f"""SELECT view, y, x, depth, r00*a + r01*b + r02*depth + tx AS wx, r10*a + r11*b + r12*depth + ty AS wy, r20*a + r21*b + r22*depth + tz AS wz
FROM (SELECT *, (u - cx) * depth / fx AS a, (v - cy) * depth / fy AS b FROM ({_PX}))"""
_R6 = "round({}, 6) + 0.0::DOUBLE"


def depth_with_camera(r: Relations) -> DataFrame:
    d = r("depth_px")
    c = r("cameras")
    return d.join(c, d["view"] == c["cam"]).withColumns({"u": F.col("x") + F.lit(0.5), "v": F.col("y") + F.lit(0.5)})


def _sel(**columns: str) -> str:
    return ", ".join(f"round({e}, 9) + 0.0::DOUBLE AS {n}" for n, e in columns.items())


@query("SELECT CAST(y * 32 + x AS BIGINT) AS pix, y, x, x + 0.5::DOUBLE AS u, y + 0.5::DOUBLE AS v FROM {grid}")
def pixel_grid(r: Relations) -> DataFrame:
    return g.pixel_grid(r.spark, 32, 24)


@query(f"SELECT view, y, x, {_sel(wx='wx', wy='wy', wz='wz')} FROM ({_BACK})")
def backproject(r: Relations) -> DataFrame:
    p = g.backproject(F.col("u"), F.col("v"), F.col("depth"))
    return depth_with_camera(r).select("view", "y", "x", r9(p[0]).alias("wx"), r9(p[1]).alias("wy"), r9(p[2]).alias("wz"))


_PROJECT = """SELECT id, cam, w, h, px*fx/nullif(pz,0) + cx AS u, py*fy/nullif(pz,0) + cy AS v, pz AS z FROM (
  SELECT p.id, c.*, r00*(p.x-tx) + r10*(p.y-ty) + r20*(p.z-tz) AS px, r01*(p.x-tx) + r11*(p.y-ty) + r21*(p.z-tz) AS py, r02*(p.x-tx) + r12*(p.y-ty) + r22*(p.z-tz) AS pz
  FROM {pts} p JOIN {cameras} c ON c.cam = 1 + p.id % 7)"""


@query(f"SELECT id, cam, {_sel(u='u', v='v', z='z')} FROM ({_PROJECT})")
def project_points(r: Relations) -> DataFrame:
    p, c = r("pts").select("id", "x", "y", "z"), r("cameras")
    joined = p.join(c, c["cam"] == 1 + p["id"] % 7)
    u, v, z = g.project(g.vector("x", "y", "z"))
    return joined.select("id", "cam", r9(u).alias("u"), r9(v).alias("v"), r9(z).alias("z"))


@query(f"SELECT view, y, x, {_sel(wx='wx', wy='wy', wz='wz', red='x / 32::DOUBLE', green='y / 24::DOUBLE')} FROM ({_BACK}) WHERE (y * 32 + x) % 3 = 0")
def colored_points_from_depth(r: Relations) -> DataFrame:
    d = depth_with_camera(r).withColumn("pix", F.col("y") * 32 + F.col("x"))
    colours = g.pixel_grid(r.spark, 32, 24).select("pix", (F.col("x") / 32.0).alias("red"), (F.col("y") / 24.0).alias("green")).filter("pix % 3 = 0")
    p = g.backproject(F.col("u"), F.col("v"), F.col("depth"))
    joined = d.join(colours, "pix")
    return joined.select("view", "y", "x", r9(p[0]).alias("wx"), r9(p[1]).alias("wy"), r9(p[2]).alias("wz"), r9("red").alias("red"), r9("green").alias("green"))


@query(f"SELECT view, y, x, {_sel(zdepth='depth / sqrt(((u-cx)/fx)*((u-cx)/fx) + ((v-cy)/fy)*((v-cy)/fy) + 1)')} FROM ({_PX})")
def euclid_to_zdepth(r: Relations) -> DataFrame:
    return depth_with_camera(r).select("view", "y", "x", r9(g.euclid_to_zdepth(F.col("depth"), F.col("u"), F.col("v"))).alias("zdepth"))


@query(f"SELECT gid, {_sel(nx='2*u/32 - 1', ny='1 - 2*v/24', u='u', v='v')} FROM {{projected}}")
def pix_ndc(r: Relations) -> DataFrame:
    w, h = F.lit(32.0), F.lit(24.0)
    nx, ny = g.pix2ndc(F.col("u"), F.col("v"), w, h)
    u, v = g.ndc2pix(nx, ny, w, h)
    return r("projected").select("gid", r9(nx).alias("nx"), r9(ny).alias("ny"), r9(u).alias("u"), r9(v).alias("v"))


@query(f"""SELECT cam, y, x, {_sel(dx='a*r00 + b*r10 - r20', dy='a*r01 + b*r11 - r21', dz='a*r02 + b*r12 - r22', ox='tx', oy='ty', oz='tz')}
FROM (SELECT c.*, g.y, g.x, (2*(g.x+0.5)/w - 1)/(2*fx/w) AS a, (1 - 2*(g.y+0.5)/h)/(2*fy/h) AS b FROM {{cameras}} c JOIN {{grid}} g ON (g.y * 32 + g.x) % 7 + 1 = c.cam)""")
def rays_xy1(r: Relations) -> DataFrame:
    grid = g.pixel_grid(r.spark, 32, 24)
    c = r("cameras")
    joined = grid.join(c, grid["pix"] % 7 + 1 == c["cam"])
    nx, ny = g.pix2ndc(F.col("u"), F.col("v"), F.col("w"), F.col("h"))
    d = g.ray(nx, ny, 2.0 * F.col("fx") / F.col("w"), 2.0 * F.col("fy") / F.col("h"))
    return joined.select("cam", "y", "x", *[r9(e).alias(n) for n, e in zip(("dx", "dy", "dz", "ox", "oy", "oz"), (*d, F.col("tx"), F.col("ty"), F.col("tz")), strict=True)])


@query(f"SELECT cam, {_sel(fov_x='2*atan(w/(2*fx))', fov_y='2*atan(h/(2*fy))', fx='w/(2*tan(atan(w/(2*fx))))', fy='h/(2*tan(atan(h/(2*fy))))', cx='w/2::DOUBLE', cy='h/2::DOUBLE')} FROM {{cameras}}")
def focal_to_fov(r: Relations) -> DataFrame:
    fov = r("cameras").withColumns({"fov_x": g.focal_to_fov(F.col("fx"), F.col("w")), "fov_y": g.focal_to_fov(F.col("fy"), F.col("h"))})
    return fov.select("cam", r9("fov_x").alias("fov_x"), r9("fov_y").alias("fov_y"), r9(g.fov_to_focal(F.col("fov_x"), F.col("w"))).alias("fx"), r9(g.fov_to_focal(F.col("fov_y"), F.col("h"))).alias("fy"), r9(F.col("w") / 2.0).alias("cx"), r9(F.col("h") / 2.0).alias("cy"))


@query(f"SELECT cam, {_sel(r00='r00', r01='-r01', r02='-r02', r10='r10', r11='-r11', r12='-r12', r20='r20', r21='-r21', r22='-r22')} FROM {{cameras}}")
def opengl_to_opencv(r: Relations) -> DataFrame:
    names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    return rounded(g.flip_yz(r("cameras")).select("cam", *names), *names)


_VIEW = {"vx": "-(r00*tx + r10*ty + r20*tz)", "vy": "-(r01*tx + r11*ty + r21*tz)", "vz": "-(r02*tx + r12*ty + r22*tz)"}


@query(f"SELECT cam, {_sel(v00='r00', v01='r10', v02='r20', v10='r01', v11='r11', v12='r21', v20='r02', v21='r12', v22='r22', **_VIEW)} FROM (SELECT * REPLACE ((tx + 0.5) * 2 AS tx, (ty - 0.25) * 2 AS ty, (tz + 1) * 2 AS tz) FROM {{cameras}})")
def world_to_view(r: Relations) -> DataFrame:
    m, t = g.world_to_view(g.vector(0.5, -0.25, 1.0), 2.0)
    return r("cameras").select("cam", *[r9(m[i][j]).alias(f"v{i}{j}") for i in range(3) for j in range(3)], *[r9(t[i]).alias(n) for i, n in enumerate(("vx", "vy", "vz"))])


@query(f"SELECT cam, {_sel(p00='2*fx/w', p11='2*fy/h', p22='1000/(1000-0.01)::DOUBLE', p23='-(1000*0.01)/(1000-0.01)::DOUBLE', p32='1::DOUBLE')} FROM {{cameras}}")
def projection_matrix(r: Relations) -> DataFrame:
    e = g.projection_entries(g.focal_to_fov(F.col("fx"), F.col("w")), g.focal_to_fov(F.col("fy"), F.col("h")))
    return r("cameras").select("cam", *[r9(x).alias(n) for n, x in e.items()])


@query(f"""SELECT cam, {_sel(fov_x='2*atan(w/(2*fx))', fov_y='2*atan(h/(2*fy))', near='0.01::DOUBLE', far='1000::DOUBLE', f00='2*fx/w*r00', f10='2*fx/w*r10', f20='2*fx/w*r20', f30='2*fx/w*(-(r00*tx + r10*ty + r20*tz))', f33='-(r02*tx + r12*ty + r22*tz)', centre_x='tx', centre_y='ty', centre_z='tz')} FROM {{cameras}}""")
def camera_record(r: Relations) -> DataFrame:
    m, t = g.world_to_view()
    c = r("cameras").withColumns({"fov_x": g.focal_to_fov(F.col("fx"), F.col("w")), "fov_y": g.focal_to_fov(F.col("fy"), F.col("h"))})
    e = g.projection_entries(F.col("fov_x"), F.col("fov_y"))
    # full projection in row-vector form: world to view, times the frustum's matrix
    centre = tuple(-x for x in g.mat_vec(g.transpose(m), t))
    out = {"fov_x": F.col("fov_x"), "fov_y": F.col("fov_y"), "near": F.lit(0.01), "far": F.lit(1000.0), "f00": m[0][0] * e["p00"], "f10": m[0][1] * e["p00"], "f20": m[0][2] * e["p00"], "f30": t[0] * e["p00"], "f33": t[2] * e["p32"], "centre_x": centre[0], "centre_y": centre[1], "centre_z": centre[2]}
    return c.select("cam", *[r9(x).alias(n) for n, x in out.items()])


@query("""SELECT gid, view, (greatest(0, least(31, round_even(u, 0))) + 32 * greatest(0, least(23, round_even(v, 0))))::BIGINT AS pix, depth, rx > 1 OR ry > 1 AS valid FROM {projected}""")
def project_gaussians(r: Relations) -> DataFrame:
    px = g.clamp(F.bround("u", 0), 0.0, 31.0) + 32.0 * g.clamp(F.bround("v", 0), 0.0, 23.0)
    return r("projected").select("gid", "view", px.cast("long").alias("pix"), "depth", ((F.col("rx") > 1) | (F.col("ry") > 1)).alias("valid"))


_Q = "SELECT gid, sx, sy, sz, opacity, cr, cg, cb, qw/n AS w, qx/n AS x, qy/n AS y, qz/n AS z FROM (SELECT *, sqrt(qw*qw+qx*qx+qy*qy+qz*qz) AS n FROM {splats})"


@query(f"SELECT gid, {_sel(m00='1-2*(y*y+z*z)', m01='2*(x*y-w*z)', m02='2*(x*z+w*y)', m10='2*(x*y+w*z)', m11='1-2*(x*x+z*z)', m12='2*(y*z-w*x)', m20='2*(x*z-w*y)', m21='2*(y*z+w*x)', m22='1-2*(x*x+y*y)')} FROM ({_Q})")
def quat_to_rotation(r: Relations) -> DataFrame:
    m = g.quat_to_rotation(*[F.col(f"q{c}") for c in "wxyz"])
    return r("splats").select("gid", *[r9(m[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)])


_AXIS = "CASE WHEN sx <= sy AND sx <= sz THEN {0} WHEN sy <= sz THEN {1} ELSE {2} END"


@query(f"SELECT gid, {_sel(nx=_AXIS.format('1-2*(y*y+z*z)', '2*(x*y-w*z)', '2*(x*z+w*y)'), ny=_AXIS.format('2*(x*y+w*z)', '1-2*(x*x+z*z)', '2*(y*z-w*x)'), nz=_AXIS.format('2*(x*z-w*y)', '2*(y*z+w*x)', '1-2*(x*x+y*y)'))} FROM ({_Q})")
def gaussian_normals(r: Relations) -> DataFrame:
    m = g.quat_to_rotation(*[F.col(f"q{c}") for c in "wxyz"])
    n = g.shortest_axis_normal([F.exp(f"s{c}") for c in "xyz"], m)
    return r("splats").select("gid", *[r9(x).alias(a) for x, a in zip(n, ("nx", "ny", "nz"), strict=True)])


@query(f"SELECT gid, {_sel(scale_x='exp(sx)', scale_y='exp(sy)', scale_z='exp(sz)', alpha='1/(1+exp(-opacity))', red='greatest(cr+0.5, 0)', green='greatest(cg+0.5, 0)', blue='greatest(cb+0.5, 0)')}, least(gid // 100, 3)::INTEGER AS sh_degree FROM {{splats}}")
def activations(r: Relations) -> DataFrame:
    return r("splats").select("gid", *[r9(F.exp(f"s{c}")).alias(f"scale_{c}") for c in "xyz"], r9(g.sigmoid(F.col("opacity"))).alias("alpha"), *[r9(F.greatest(F.col(c) + 0.5, F.lit(0.0))).alias(n) for c, n in (("cr", "red"), ("cg", "green"), ("cb", "blue"))], g.sh_degree(F.col("gid"), 100, 3).alias("sh_degree"))


@query(f"SELECT gid, {_sel(red='greatest(0, least(1, cr + (1 - a) * 0.5))', green='greatest(0, least(1, cg + (1 - a) * 0.25))', blue='greatest(0, least(1, cb + (1 - a) * 1.0))')} FROM (SELECT *, 1/(1+exp(-opacity)) AS a FROM {{splats}})")
def composite_background(r: Relations) -> DataFrame:
    a = g.sigmoid(F.col("opacity"))
    return r("splats").select("gid", *[r9(g.composite(F.col(c), a, F.lit(b))).alias(n) for c, n, b in (("cr", "red", 0.5), ("cg", "green", 0.25), ("cb", "blue", 1.0))])


@query("SELECT view, y, x, round(CASE WHEN (x + y) % 4 > 0 THEN depth ELSE max(depth) OVER (PARTITION BY view) END, 9) + 0.0::DOUBLE AS depth FROM {depth_px}")
def alpha_fill_max(r: Relations) -> DataFrame:
    d = r("depth_px")
    # one number for each view: an aggregate and a join, so that a view's pixels need not meet in one task
    most = d.groupBy("view").agg(F.max("depth").alias("most"))
    filled = F.when((F.col("x") + F.col("y")) % 4 > 0, F.col("depth")).otherwise(F.col("most"))
    return d.join(most, "view").select("view", "y", "x", r9(filled).alias("depth"))


_N = "SELECT id, x/n AS x, y/n AS y, z/n AS z FROM (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM {pts})"


@query(f"SELECT id, {_sel(ex='(x+1)/2', ey='(-y+1)/2', ez='(-z+1)/2', wx='r00*x - r01*y - r02*z', wy='r10*x - r11*y - r12*z', wz='r20*x - r21*y - r22*z')} FROM ({_N}) JOIN {{cameras}} c ON c.cam = 1 + id % 7")
def normals_encode(r: Relations) -> DataFrame:
    p, c = r("pts").select("id", "x", "y", "z"), r("cameras")
    n = g.normalise(g.vector("x", "y", "z"))
    e = [g.encode_normal(v) for v in (n[0], -n[1], -n[2])]
    w = g.mat_vec(g.rotation(), tuple(g.decode_normal(v) for v in e))
    return p.join(c, c["cam"] == 1 + p["id"] % 7).select("id", *[r9(v).alias(a) for a, v in zip(("ex", "ey", "ez", "wx", "wy", "wz"), (*e, *w), strict=True)])


@query(f"SELECT id, {_sel(x='0.5*y - 2*z + 1', y='x + 3*y', z='-x + 0.25*z - 4')} FROM {{pts}}")
def affine_apply(r: Relations) -> DataFrame:
    p = g.affine([[0, 0.5, -2, 1], [1, 3, 0, 0], [-1, 0, 0.25, -4], [0, 0, 0, 1]], g.vector("x", "y", "z"))
    return r("pts").select("id", *[r9(v).alias(n) for v, n in zip(p, "xyz", strict=True)])


@query(f"SELECT cam, {_sel(tx='-ty * 0.5 + 1', ty='tx * 0.5', tz='tz * 0.5', r00='-r10', r10='r00', r20='r20')} FROM {{cameras}}")
def camera_align(r: Relations) -> DataFrame:
    from terravane.operators import cameras

    out = cameras.align(r("cameras"), scale=0.5, mesh_transform=[[0, -1, 0, 1], [1, 0, 0, 0], [0, 0, 1, 0]])
    return out.select("cam", *[r9(c).alias(c) for c in ("tx", "ty", "tz", "r00", "r10", "r20")])


@query(f"""WITH k AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 0.0), (1, -0.1, -0.1, 0.1), (2, 0.1, -0.1, 0.1), (3, 0.1, 0.1, 0.1), (4, -0.1, 0.1, 0.1), (5, -5.0, -5.0, 5.0), (6, 5.0, -5.0, 5.0), (7, 5.0, 5.0, 5.0), (8, -5.0, 5.0, 5.0)) AS t(corner, a, b, d)),
p AS (SELECT c.*, corner, a::DOUBLE * w/(2*fx) AS px, b::DOUBLE * h/(2*fy) AS py, d::DOUBLE AS pz FROM {{cameras}} c, k)
SELECT cam, corner, {_sel(x='r00*px + r01*py + r02*pz + tx', y='r10*px + r11*py + r12*pz + ty', z='r20*px + r21*py + r22*pz + tz')} FROM p""")
def frustum_geometry(r: Relations) -> DataFrame:
    return rounded(g.frustum(r("cameras")), "x", "y", "z")


@query(f"SELECT vid, {_sel(x='x/511*3 - 1', y='y/511*3 - 1', z='z/511*3 - 1')} FROM {{torus_vertices}}")
def voxel_to_world(r: Relations) -> DataFrame:
    return r("torus_vertices").select("vid", *[r9(g.voxel_to_world(F.col(c), 512, -1.0, 2.0)).alias(c) for c in "xyz"])


@query("SELECT id, floor(least(1, abs(x)) * 255)::INTEGER AS r, floor(least(1, abs(y)) * 255)::INTEGER AS g, floor(least(1, abs(z)) * 255)::INTEGER AS b FROM {pts}")
def rgb_u8(r: Relations) -> DataFrame:
    return r("pts").select("id", *[g.rgb_u8(F.least(F.lit(1.0), F.abs(c))).alias(n) for c, n in zip("xyz", "rgb", strict=True)])


@query("""SELECT p_partkey AS id, (floor(floor(w * s) / 14) * 14)::INTEGER AS w, (floor(floor(h * s) / 14) * 14)::INTEGER AS h, (h // w * 0 + h * 64 // w)::INTEGER AS object_h
FROM (SELECT p_partkey, 100 + p_size * 10 AS w, (60 + p_partkey % 400)::INTEGER AS h, 800.0::DOUBLE / greatest(100 + p_size * 10, 60 + p_partkey % 400) AS s FROM {part})""")
def resize_dims(r: Relations) -> DataFrame:
    p = r("part").select(F.col("p_partkey").alias("id"), (100 + F.col("p_size") * 10).alias("w0"), (60 + F.col("p_partkey") % 400).cast("int").alias("h0"))
    w, h = g.resize_dims(F.col("w0"), F.col("h0"), 800, 14)
    return p.select("id", w.alias("w"), h.alias("h"), F.floor(F.col("h0") * 64 / F.col("w0")).cast("int").alias("object_h"))


@query(f"SELECT id, {_sel(clip_r='(x-0.485)/0.229', clip_g='(y-0.456)/0.224', clip_b='(z-0.406)/0.225', dino_r='(x-0.5)/0.5', dino_g='(y-0.5)/0.5', dino_b='(z-0.5)/0.5')} FROM {{pts}}")
def normalise_image(r: Relations) -> DataFrame:
    rgb = [F.col(c) for c in "xyz"]
    return r("pts").select("id", *[r9(v).alias(f"{kind}_{n}") for kind in ("clip", "dino") for v, n in zip(g.normalise_image(rgb, kind), "rgb", strict=True)])


@query("SELECT id, round(CASE WHEN max(x) OVER () > 0 THEN x / max(x) OVER () ELSE x END, 9) + 0.0::DOUBLE AS red, 0.0::DOUBLE AS green, 0.0::DOUBLE AS blue FROM {pts}")
def similarity_colors(r: Relations) -> DataFrame:
    from terravane.operators import score

    return rounded(score.similarity_colors(r("pts").select("id", F.col("x").alias("similarity"))).drop("similarity"), "red")


@query(f"SELECT cam, {_sel(fx='fx', fy='fy', cx='w/2::DOUBLE', cy='h/2::DOUBLE')} FROM {{cameras}}")
def intrinsics(r: Relations) -> DataFrame:
    fx = g.fov_to_focal(g.focal_to_fov(F.col("fx"), F.col("w")), F.col("w"))
    fy = g.fov_to_focal(g.focal_to_fov(F.col("fy"), F.col("h")), F.col("h"))
    return r("cameras").select("cam", r9(fx).alias("fx"), r9(fy).alias("fy"), r9(F.col("w") / 2.0).alias("cx"), r9(F.col("h") / 2.0).alias("cy"))
