"""Readers and writers.  Canonical storage is Parquet; the rest is for exchange."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEO, IMAGE = (".mp4", ".mov", ".avi"), (".jpg", ".jpeg", ".png")


def source_kind(path: Column) -> Column:
    """video, images or equirectangular by the path; anything else is an error."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    wide = F.when(F.contains(path, F.lit("360")), "equirectangular").otherwise("images")
    bad = F.raise_error(F.concat(F.lit("unsupported source: "), path))
    return F.when(ext.isin(*VIDEO), "video").when(ext.isin(*IMAGE), wide).otherwise(bad)


def frames_to_sample(n_frames: Column, share: float, min_frames: int) -> Column:
    """``int(n * share)``, or all frames where that is below the least number."""
    n = F.floor(n_frames * F.lit(float(share)))
    return F.when(n < min_frames, n_frames).otherwise(n)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text through Spark's own file systems."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _get(spark: SparkSession, path: str) -> str:
    """Read a small sidecar as one text."""
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Sidecar of transforms or parameters (JSON, never pickle)."""
    _put(spark, path, json.dumps(value, sort_keys=True))


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(_get(spark, path))


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, r00..r22, tx, ty, tz) of the frames in a transforms file."""
    schema = "frames array<struct<file_path: string, transform_matrix: array<array<double>>>>"
    frames = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("frames").alias("f"))
    m = F.col("f.transform_matrix")
    return frames.select(F.col("f.file_path").alias("file_path"), *[m[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[m[i][3].alias(n) for i, n in enumerate(("tx", "ty", "tz"))])


def ply_lines(vertices: DataFrame, faces: DataFrame | None = None, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(part, place, value): the lines of an ASCII PLY file; part 0 is the header.

    Vertices are written in the order of ``vid``, and faces name vertices by ``vid``,
    which has to run from 0 without gaps.
    """
    n_v = vertices.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n_v}", *[f"property double {c}" for c in columns]]
    if faces is not None:
        head += [f"element face {faces.count()}", "property list uchar int vertex_indices"]
    spark = vertices.sparkSession
    lines = spark.createDataFrame([(0, k, h) for k, h in enumerate([*head, "end_header"])], "part int, place long, value string")
    lines = lines.unionByName(vertices.select(F.lit(1).alias("part"), F.col("vid").cast("long").alias("place"), F.format_string(" ".join(["%.6f"] * len(columns)), *columns).alias("value")))
    if faces is not None:
        lines = lines.unionByName(faces.select(F.lit(2).alias("part"), F.col("fid").cast("long").alias("place"), F.format_string("3 %d %d %d", "a", "b", "c").alias("value")))
    return lines


def write_ply(lines: DataFrame, path: str) -> None:
    """One file, in order: an export for other programs, not a way to store data."""
    lines.repartitionByRange(1, "part", "place").sortWithinPartitions("part", "place").select("value").write.mode("overwrite").text(path)


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and faces (fid, a, b, c) of an ASCII PLY file."""

    def rows(texts: Sequence[str]) -> tuple[list[tuple], list[tuple]]:
        lines = "\n".join(texts).split("\n")
        end = lines.index("end_header")
        count = {line.split()[1]: int(line.split()[2]) for line in lines[:end] if line.startswith("element ")}
        body = lines[end + 1 :]
        n = count["vertex"]
        v = [(k, *map(float, line.split()[:3])) for k, line in enumerate(body[:n])]
        f = [(k, *map(int, line.split()[1:4])) for k, line in enumerate(body[n : n + count.get("face", 0)])]
        return v, f

    # parsed where it is read; one file is one row
    files = spark.read.text(path, wholetext=True)

    def vertices(batches):
        import pyarrow as pa

        for batch in batches:
            v, _ = rows(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pylist([dict(zip(("vid", "x", "y", "z"), x, strict=True)) for x in v], pa.schema([("vid", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())]))

    def faces(batches):
        import pyarrow as pa

        for batch in batches:
            _, f = rows(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pylist([dict(zip(("fid", "a", "b", "c"), x, strict=True)) for x in f], pa.schema([(n, pa.int64()) for n in ("fid", "a", "b", "c")]))

    return files.mapInArrow(vertices, "vid long, x double, y double, z double"), files.mapInArrow(faces, "fid long, a long, b long, c long")


def write_masks(mask_px: DataFrame, path: str) -> None:
    """Mask pixels, one folder for each view."""
    mask_px.write.mode("overwrite").partitionBy("view").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def skip_stage(output_exists: bool, overwrite: bool) -> bool:
    """A stage is skipped if its output is there and isn't to be overwritten."""
    return output_exists and not overwrite


def cache_key(names: Sequence[str], params: dict) -> str:
    """Name of a cached result: every parameter takes part."""
    import hashlib

    return hashlib.sha256(json.dumps([[str(n) for n in names], params], sort_keys=True).encode()).hexdigest()


def cached(spark: SparkSession, path: str, names: Sequence[str], params: dict, make) -> tuple[DataFrame, bool]:
    """A stored result if it is of the same inputs and parameters; else a new one.

    Returns the relation and whether it came from the store.
    """
    key = cache_key(names, params)
    manifest = f"{path}/manifest-{key}"
    if exists(spark, manifest):
        return spark.read.parquet(f"{path}/data-{key}"), True
    make().write.mode("overwrite").parquet(f"{path}/data-{key}")
    write_json(spark, manifest, {"names": [str(n) for n in names], "params": params})
    return spark.read.parquet(f"{path}/data-{key}"), False
