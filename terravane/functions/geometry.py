"""Geometry as column expressions: no joins, no shuffles, all inside codegen.

A camera is a set of columns: rotation ``r00``..``r22`` (camera to world, by
rows), place ``tx, ty, tz``, and ``fx, fy, cx, cy, w, h``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Matrix = Sequence[Sequence[Column]]


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def vector(x: Column | str | float, y: Column | str | float, z: Column | str | float) -> Vector:
    return col(x), col(y), col(z)


def rotation(prefix: str = "r") -> Matrix:
    return [[F.col(f"{prefix}{i}{j}") for j in range(3)] for i in range(3)]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Vector) -> Vector:
    """Unit vector; null where the length is 0."""
    n = F.nullif(norm(a), F.lit(0.0))
    return a[0] / n, a[1] / n, a[2] / n


def mat_vec(m: Matrix, v: Vector) -> Vector:
    return dot(m[0], v), dot(m[1], v), dot(m[2], v)


def transpose(m: Matrix) -> Matrix:
    return [[m[j][i] for j in range(3)] for i in range(3)]


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(col(low), F.least(col(high), x))


def pixel_grid(spark: SparkSession, width: int, height: int, offset: float = 0.5) -> DataFrame:
    """Pixel centres in row-major order, from one range: (pix, y, x, u, v)."""
    grid = spark.range(width * height).withColumnRenamed("id", "pix")
    x, y = F.col("pix") % width, F.floor(F.col("pix") / width)
    return grid.select("pix", y.cast("int").alias("y"), x.cast("int").alias("x"), (x + F.lit(offset)).cast("double").alias("u"), (y + F.lit(offset)).cast("double").alias("v"))


def pixel_to_camera(u: Column, v: Column, depth: Column) -> Vector:
    return (u - F.col("cx")) * depth / F.col("fx"), (v - F.col("cy")) * depth / F.col("fy"), depth


def backproject(u: Column, v: Column, depth: Column) -> Vector:
    """World point of a pixel with a depth along the camera's axis."""
    p = mat_vec(rotation(), pixel_to_camera(u, v, depth))
    return p[0] + F.col("tx"), p[1] + F.col("ty"), p[2] + F.col("tz")


def world_to_camera(p: Vector) -> Vector:
    moved = (p[0] - F.col("tx"), p[1] - F.col("ty"), p[2] - F.col("tz"))
    return mat_vec(transpose(rotation()), moved)


def project(p: Vector) -> Vector:
    """(u, v, depth) of a world point; u and v are null at depth 0, and points behind count."""
    x, y, z = world_to_camera(p)
    safe = F.nullif(z, F.lit(0.0))
    return x * F.col("fx") / safe + F.col("cx"), y * F.col("fy") / safe + F.col("cy"), z


def euclid_to_zdepth(distance: Column, u: Column, v: Column) -> Column:
    """Depth along the axis from the distance along the ray."""
    return distance / norm(((u - F.col("cx")) / F.col("fx"), (v - F.col("cy")) / F.col("fy"), F.lit(1.0)))


def pix2ndc(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return 2.0 * x / w - 1.0, 1.0 - 2.0 * y / h


def ndc2pix(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return (x + 1.0) * w / 2.0, (1.0 - y) * h / 2.0


def ray(ndc_x: Column, ndc_y: Column, focal_x: Column, focal_y: Column) -> Vector:
    """Direction through a device coordinate as a row vector times the rotation."""
    d = (ndc_x / focal_x, ndc_y / focal_y, F.lit(-1.0))
    return mat_vec(transpose(rotation()), d)


def focal_to_fov(focal: Column, pixels: Column) -> Column:
    return 2.0 * F.atan(pixels / (2.0 * focal))


def fov_to_focal(fov: Column, pixels: Column) -> Column:
    return pixels / (2.0 * F.tan(fov / 2.0))


def flip_yz(df: DataFrame) -> DataFrame:
    """Camera axes from y up, z back to y down, z forward: two columns change sign."""
    return df.withColumns({f"r{i}{j}": -F.col(f"r{i}{j}") for i in range(3) for j in (1, 2)})


def world_to_view(translate: Vector | None = None, scale: float = 1.0) -> tuple[Matrix, Vector]:
    """Rotation and translation of the inverse camera; its centre may be moved and scaled."""
    r = transpose(rotation())
    c = (F.col("tx"), F.col("ty"), F.col("tz"))
    if translate is not None:
        c = tuple((a + b) * F.lit(scale) for a, b in zip(c, translate, strict=True))  # type: ignore[assignment]
    t = mat_vec(r, c)  # type: ignore[arg-type]
    return r, (-t[0], -t[1], -t[2])


def projection_entries(fov_x: Column, fov_y: Column, near: float = 0.01, far: float = 1000.0) -> dict[str, Column]:
    """Entries of the frustum's matrix that are not 0."""
    return {
        "p00": 1.0 / F.tan(fov_x / 2.0),
        "p11": 1.0 / F.tan(fov_y / 2.0),
        "p22": F.lit(far / (far - near)),
        "p23": F.lit(-(far * near) / (far - near)),
        "p32": F.lit(1.0),
    }


def quat_to_rotation(w: Column, x: Column, y: Column, z: Column) -> Matrix:
    n = F.nullif(norm((w, x, y, z)), F.lit(0.0))
    w, x, y, z = w / n, x / n, y / n, z / n
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def shortest_axis_normal(scales: Sequence[Column], m: Matrix) -> Vector:
    """The rotation's column of the smallest scale; the first of equals."""
    sx, sy, sz = scales
    first, second = (sx <= sy) & (sx <= sz), sy <= sz
    return tuple(F.when(first, m[i][0]).when(second, m[i][1]).otherwise(m[i][2]) for i in range(3))  # type: ignore[return-value]


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def sh_degree(step: Column, interval: int, most: int) -> Column:
    return F.least(F.floor(step / interval), F.lit(most)).cast("int")


def composite(render: Column, alpha: Column, background: Column) -> Column:
    return clamp(render + (1.0 - alpha) * background, 0.0, 1.0)


def encode_normal(n: Column) -> Column:
    return (n + 1.0) / 2.0


def decode_normal(n: Column) -> Column:
    return 2.0 * n - 1.0


def affine(m: Sequence[Sequence[float]], p: Vector) -> Vector:
    """A 3x4 or 4x4 matrix of numbers applied to a point."""
    return tuple(F.lit(float(r[0])) * p[0] + F.lit(float(r[1])) * p[1] + F.lit(float(r[2])) * p[2] + F.lit(float(r[3])) for r in m[:3])  # type: ignore[return-value]


def voxel_to_world(v: Column, resolution: int, first: float, last: float) -> Column:
    return v / F.lit(float(resolution - 1)) * F.lit(last - first) + F.lit(first)


def rgb_u8(x: Column) -> Column:
    return F.floor(x * 255).cast("int")


def resize_dims(w: Column, h: Column, longest: int, patch: int) -> tuple[Column, Column]:
    """Size with the longest edge at ``longest``, each side cut to whole patches."""
    scale = F.lit(float(longest)) / F.greatest(w, h)
    new_w, new_h = F.floor(w * scale), F.floor(h * scale)
    return (F.floor(new_w / patch) * patch).cast("int"), (F.floor(new_h / patch) * patch).cast("int")


#: channel means and deviations of two image encoders (fixed values)
IMAGE_STATS = {"clip": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)), "dino": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5))}


def normalise_image(channels: Sequence[Column], kind: str) -> list[Column]:
    if kind not in IMAGE_STATS:
        raise ValueError(f"unknown image statistics {kind!r}")
    mean, dev = IMAGE_STATS[kind]
    return [(c - F.lit(m)) / F.lit(s) for c, m, s in zip(channels, mean, dev, strict=True)]


def frustum(df: DataFrame, scale: float = 1.0, near: float = 0.1, far: float = 5.0) -> DataFrame:
    """Nine corners of each camera's frustum: (cam, corner, x, y, z).

    Corner 0 is the apex, 1 to 4 stand at ``near`` and 5 to 8 at ``far`` times the scale.
    """
    half_x, half_y = F.col("w") / (2.0 * F.col("fx")), F.col("h") / (2.0 * F.col("fy"))
    corners = [(0.0, 0.0, 0.0)] + [(sx * d, sy * d, d) for d in (near * scale, far * scale) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    local = F.array(*[F.struct(F.lit(k).alias("corner"), (F.lit(x) * half_x).alias("px"), (F.lit(y) * half_y).alias("py"), F.lit(z).alias("pz")) for k, (x, y, z) in enumerate(corners)])
    rows = df.select("*", F.explode(local).alias("c")).select("*", "c.*")
    p = mat_vec(rotation(), vector("px", "py", "pz"))
    return rows.select("cam", "corner", (p[0] + F.col("tx")).alias("x"), (p[1] + F.col("ty")).alias("y"), (p[2] + F.col("tz")).alias("z"))


#: polylines of a frustum by corner: apex rays, two open rectangles, connectors
FRUSTUM_LINES = [[0, 1], [0, 2], [0, 3], [0, 4], [0, 5], [0, 6], [0, 7], [0, 8], [1, 2, 3, 4], [5, 6, 7, 8], [1, 5], [2, 6], [3, 7], [4, 8]]
