"""Cleaning of point clouds, and reconstruction metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators import spatial

#: up to this many values the exact percentile is one aggregate
EXACT_ROWS = 5_000_000


def quantile(df: DataFrame, value: str, q: float, exact_rows: int | None = None) -> DataFrame:
    """One row: the exact linear quantile of ``value``.

    Many distinct values are narrowed to a band around the rank by approximate
    quantiles, again and again until the band has few; ranks below the band are
    counted, so the result stays exact.  One task sees ``exact_rows`` distinct
    values at most.
    """
    most = exact_rows or EXACT_ROWS
    values = df.select(F.col(value).alias("v")).filter("v is not null")
    n = values.count()
    if n <= most:
        return values.agg(F.percentile("v", F.lit(q)).alias("q"))
    rank = q * (n - 1)
    k = min(int(rank), n - 2)
    band, below, size, margin = values, 0, n, 0.001
    while band.select("v").distinct().limit(most + 1).count() > most:
        near = [max(0.0, (k - below) / size - margin), min(1.0, (k + 2 - below) / size + margin)]
        lo, hi = band.agg(F.percentile_approx("v", near, 10_000)).first()[0]
        inner = (F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi))
        less, held = band.agg(F.count_if(F.col("v") < F.lit(lo)), F.count_if(inner)).first()
        if below + less > k or below + less + held < k + 2 or held == size:
            margin *= 2  # both ranks must lie in the band; a band of everything is narrowed less carefully next
            if margin > 0.5:
                break
            continue
        band, below, size, margin = values.filter(inner), below + less, held, 0.001
    counted = band.groupBy("v").count()
    # the two values around the rank, from the running counts of the distinct values of the band
    pair = counted.agg(F.percentile("v", F.array(F.lit((k - below) / (size - 1)), F.lit((k + 1 - below) / (size - 1))), F.col("count")).alias("p"))
    return pair.select((F.col("p")[0] + (F.col("p")[1] - F.col("p")[0]) * F.lit(rank - k)).alias("q"))


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a relation that has one row, on every row."""
    return df.crossJoin(F.broadcast(one_row))


def remove_far(df: DataFrame, max_distance: float | None = None, n_points: int | None = None, reference: str = "centroid", key: str = "id") -> DataFrame:
    """Points at most ``max_distance`` from the reference, or else the ``n_points`` closest."""
    if max_distance is None and n_points is None:
        raise ValueError("max_distance or n_points is needed")
    if reference not in ("centroid", "origin"):
        raise ValueError(f"unknown reference {reference!r}")
    if reference == "centroid":
        moved = with_scalar(df, df.agg(*[F.avg(c).alias(f"__m{c}") for c in "xyz"]))
    else:
        moved = df.withColumns({f"__m{c}": F.lit(0.0) for c in "xyz"})
    d = [F.col(c) - F.col(f"__m{c}") for c in "xyz"]
    moved = moved.withColumn("__d", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).drop(*[f"__m{c}" for c in "xyz"])
    if max_distance is not None:
        return moved.filter(F.col("__d") <= F.lit(float(max_distance))).drop("__d")
    if n_points > df.count():
        raise ValueError("more points are asked for than there are")
    return moved.orderBy("__d", key).limit(n_points).drop("__d")


def density_filter(df: DataFrame, radius2: float, percent: float = 10.0, key: str = "id") -> DataFrame:
    """Points whose neighbour count reaches a percentile of the counts."""
    counts = spatial.neighbour_counts(df, radius2, key)
    keep = with_scalar(counts, quantile(counts, "n", percent / 100.0)).filter("n >= q").select(key)
    return df.join(keep, key, "left_semi")


def density_stats(df: DataFrame, radius2: float, key: str = "id") -> DataFrame:
    return spatial.neighbour_counts(df, radius2, key).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.avg("n").alias("mean"))


def poisson_trim(df: DataFrame, density: str = "density", q: float = 0.01) -> DataFrame:
    """Vertices that are not below a quantile of the density."""
    return with_scalar(df, quantile(df, density, q)).filter(F.col(density) >= F.col("q")).drop("q")


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(*[F.min(c).alias(f"min_{c}") for c in "xyz"], *[F.max(c).alias(f"max_{c}") for c in "xyz"])


def voxel_downsample(df: DataFrame, size: float, attributes: tuple[str, ...] = (), key: str = "id") -> DataFrame:
    """One mean point for each voxel; its id is the smallest of the voxel."""
    low = df.agg(*[F.min(c).alias(f"__l{c}") for c in "xyz"])
    voxel = [F.floor((F.col(c) - F.col(f"__l{c}")) / F.lit(float(size))).alias(f"__v{c}") for c in "xyz"]
    means = [F.avg(c).alias(c) for c in ("x", "y", "z", *attributes)]
    return with_scalar(df, low).groupBy(*voxel).agg(F.min(key).alias(key), *means).select(key, "x", "y", "z", *attributes)


def adaptive_voxel_size(df: DataFrame, size: float, radius: float, min_points: int = 10_000, sample: int = 1000, key: str = "id") -> float:
    """``size``, scaled by the mean neighbour count of the first points of a large cloud."""
    if df.count() <= min_points:
        return float(size)
    first = df.orderBy(key).limit(sample)
    mean = spatial.radius_join(first, df, (2 * radius) ** 2, key, key).groupBy("aid").count().agg(F.avg("count")).first()[0] or 0.0
    return size * min(2.0, max(0.5, 50.0 / max(1e-6, mean)))


def outlier_scores(df: DataFrame, neighbours: int = 20, key: str = "id") -> DataFrame:
    """(id, mean): mean distance to the nearest points, the point itself included."""
    near = spatial.knn_join(df, df, neighbours, key, key)
    return near.groupBy(F.col("aid").alias(key)).agg(F.avg(F.sqrt("d2")).alias("mean"))


def statistical_outlier(df: DataFrame, neighbours: int = 20, ratio: float = 2.0, key: str = "id") -> DataFrame:
    """Points whose mean distance lies above 0 and below mean + ratio * deviation of all."""
    scores = outlier_scores(df, neighbours, key)
    limits = scores.agg((F.avg("mean") + F.lit(float(ratio)) * F.stddev_samp("mean")).alias("limit"))
    keep = with_scalar(scores, limits).filter("mean > 0 and mean < limit").select(key)
    return df.join(keep, key, "left_semi")


def clean(df: DataFrame, voxel: float | None = None, neighbours: int = 20, ratio: float = 2.0, max_distance: float | None = None, attributes: tuple[str, ...] = (), key: str = "id") -> DataFrame:
    """Downsample, drop outliers, drop far points; the id is the one traced through."""
    if voxel is not None:
        df = voxel_downsample(df, voxel, attributes, key)
    df = statistical_outlier(df, neighbours, ratio, key)
    return df if max_distance is None else remove_far(df, max_distance=max_distance, key=key)


def accuracy(reconstruction: DataFrame, reference: DataFrame, percent: float = 90.0) -> DataFrame:
    """Percentile of the distances from the reconstruction to the reference."""
    d = spatial.nn_join(reconstruction, reference)
    return quantile(d, "distance", percent / 100.0).select(F.col("q").alias("accuracy"))


def completeness(reconstruction: DataFrame, reference: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Percent of the reference that is closer than the threshold to the reconstruction."""
    d = spatial.nn_join(reference, reconstruction)
    return d.agg((F.avg((F.col("distance") < F.lit(float(threshold))).cast("double")) * 100).alias("completeness"))


def angular_error(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Angle between unit vectors in radians, for each row."""
    cosine = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def normal_error(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return 1.0 - (a[0] * b[0] + a[1] * b[1] + a[2] * b[2])


def features_to_vertices(points: DataFrame, vertices: DataFrame, k: int = 5, sdf_trunc: float = 0.03, width: int | None = None, feature: str = "f", key: str = "id") -> DataFrame:
    """(id, f): features of points spread over their ``k`` nearest vertices.

    Points whose nearest vertex is farther than ``sdf_trunc`` are left out; one
    sigma, the mean of all remaining distances, gives Gaussian weights, which are
    normalised for each point; untouched vertices have zeros.
    """
    if width is None:
        first = points.select(F.size(feature).alias("n")).first()
        width = first["n"] if first else 0
    near = spatial.knn_join(points, vertices, k, key, key).withColumn("d", F.sqrt("d2"))
    close = near.groupBy("aid").agg(F.min("d").alias("nearest")).filter(F.col("nearest") <= F.lit(float(sdf_trunc))).select("aid")
    kept = near.join(close, "aid", "left_semi")
    sigma = kept.agg(F.avg("d").alias("sigma"))
    raw = with_scalar(kept, sigma).withColumn("e", F.when(F.col("sigma") > 0, F.exp(-F.col("d2") / F.nullif(2 * F.col("sigma") * F.col("sigma"), F.lit(0.0)))).otherwise(F.lit(1.0)))
    total = raw.groupBy("aid").agg(F.sum("e").alias("total"))
    weights = raw.join(total, "aid").select("aid", "bid", (F.col("e") / F.col("total")).alias("weight"))
    spread = weights.join(points.select(F.col(key).alias("aid"), F.col(feature).alias("__f")), "aid")
    # one sum for each dimension keeps the aggregate in fixed columns
    sums = spread.groupBy("bid").agg(F.sum("weight").alias("w"), *[F.sum(F.col("weight") * F.col("__f")[i]).alias(f"s{i}") for i in range(width)])
    values = F.array(*[F.coalesce(F.col(f"s{i}") / F.nullif(F.col("w"), F.lit(0.0)), F.lit(0.0)) for i in range(width)]) if width else F.array().cast("array<double>")
    return vertices.select(F.col(key).alias("bid")).join(sums, "bid", "left").select(F.col("bid").alias(key), values.alias(feature))


def normals_to_vertices(points: DataFrame, vertices: DataFrame, k: int = 5, sdf_trunc: float = 0.03, feature: str = "n", key: str = "id") -> DataFrame:
    """Spread normals, then divide by length + 1e-8."""
    spread = features_to_vertices(points, vertices, k, sdf_trunc, 3, feature, key)
    length = F.sqrt(sum((F.col(feature)[i] * F.col(feature)[i] for i in (1, 2)), F.col(feature)[0] * F.col(feature)[0]))
    return spread.withColumn(feature, F.array(*[F.col(feature)[i] / (length + 1e-8) for i in range(3)]))
