"""Operators on camera relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import geometry as g


def _left_multiply(df: DataFrame, m: Sequence[Sequence[float]]) -> DataFrame:
    """``m`` (3x4) times each camera's rotation and place."""
    t = g.affine(m, g.vector("tx", "ty", "tz"))
    out: dict[str, Column] = dict(zip(("tx", "ty", "tz"), t, strict=True))
    for i in range(3):
        for j in range(3):
            out[f"r{i}{j}"] = sum((F.lit(float(m[i][k])) * F.col(f"r{k}{j}") for k in range(1, 3)), F.lit(float(m[i][0])) * F.col(f"r0{j}"))
    return df.withColumns(out)


def align(df: DataFrame, scale: float = 1.0, mesh_transform: Sequence[Sequence[float]] | None = None, transform: Sequence[Sequence[float]] | None = None, apply_transform: bool = False) -> DataFrame:
    """Places times ``scale``; the transform of the parser only if ``apply_transform``; then that of the mesh."""
    if apply_transform and transform is not None:
        df = _left_multiply(df, transform)
    df = df.withColumns({c: F.col(c) * F.lit(float(scale)) for c in ("tx", "ty", "tz")})
    return df if mesh_transform is None else _left_multiply(df, mesh_transform)


def scene_radius(df: DataFrame, factor: float = 2.0) -> DataFrame:
    """One row: ``factor`` times the largest distance of a camera from the mean place."""
    centre = df.agg(*[F.avg(c).alias(f"m{c}") for c in ("tx", "ty", "tz")])
    far = g.norm([F.col(c) - F.col(f"m{c}") for c in ("tx", "ty", "tz")])
    return df.crossJoin(F.broadcast(centre)).agg((F.lit(factor) * F.max(far)).alias("radius"))  # one row
