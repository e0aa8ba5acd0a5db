"""Semantic scoring: features against query embeddings.

Features are ``(id columns, f array<double>)``; queries are ``(qid, polarity,
emb)``.  The set of queries is a handful of rows, collected once and put into the
expression, so that a score needs no join, no shuffle and no explode.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators import pointcloud

TEMPERATURE = 0.05
METHODS = ("standard", "pairwise")
DEFAULT_NEGATIVES = ("object",)


def normalised(emb: Column) -> Column:
    n = F.sqrt(F.aggregate(emb, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(emb, lambda x: x / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def query_rows(queries: DataFrame, limit: int = 1000) -> list[tuple[int, bool, list[float]]]:
    """The queries as numbers; more than ``limit`` of them are refused."""
    rows = queries.select("qid", "polarity", "emb").orderBy("qid").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} queries")
    return [(r["qid"], r["polarity"] == "positive", list(r["emb"])) for r in rows]


def _raw(f: Column, emb: Sequence[float]) -> Column:
    return dot(f, F.array(*[F.lit(float(x)) for x in emb]))


def raw_similarity(features: DataFrame, queries: DataFrame, feature: str = "f") -> DataFrame:
    """One row for each feature and query: the feature's columns, ``qid``, ``similarity``."""
    rows = query_rows(queries)
    each = F.array(*[F.struct(F.lit(q).alias("qid"), _raw(F.col(feature), e).alias("similarity")) for q, _, e in rows])
    return features.select("*", F.explode(each).alias("__s")).select("*", "__s.*").drop("__s", feature)


def similarity(features: DataFrame, queries: DataFrame, method: str = "standard", temperature: float = TEMPERATURE, feature: str = "f") -> DataFrame:
    """``features`` without ``feature``, with ``similarity``.

    standard: softmax over all queries, summed over the positive ones.
    pairwise: softmax over the stack of the mean positive (once for each
    negative) and the negatives; the share of one mean row, which is at most 1/m.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    rows = query_rows(queries)
    positive = [e for _, p, e in rows if p]
    negative = [e for _, p, e in rows if not p]
    if not positive or (method == "pairwise" and not negative):
        raise ValueError("a positive query, and for pairwise a negative one, is needed")
    embs = positive + negative
    width = len(embs[0])
    flat = F.array(*[F.lit(float(x)) for e in embs for x in e])
    # all products from one literal array; then a closed form of a few numbers
    raw = F.transform(F.sequence(F.lit(0), F.lit(len(embs) - 1)), lambda k: dot(F.col(feature), F.slice(flat, k * width + 1, width)))
    df = features.withColumn("__raw", raw)
    s = [F.col("__raw")[k] for k in range(len(embs))]
    if method == "standard":
        top = F.greatest(*s) if len(s) > 1 else s[0]
        e = [F.exp((x - top) / temperature) for x in s]
        value = sum(e[1 : len(positive)], e[0]) / sum(e[1:], e[0])
    else:
        m = len(negative)
        mean = sum(s[1 : len(positive)], s[0]) / float(len(positive))
        top = F.greatest(mean, *s[len(positive) :])
        p = F.exp((mean - top) / temperature)
        value = F.nanvl(p / (float(m) * p + sum((F.exp((x - top) / temperature) for x in s[len(positive) + 1 :]), F.exp((s[len(positive)] - top) / temperature))), F.lit(0.0))
    return df.withColumn("similarity", value).drop("__raw", feature)


def similarity_colors(df: DataFrame, value: str = "similarity") -> DataFrame:
    """Score by the largest score, if that is positive, as red; green and blue 0."""
    most = df.agg(F.max(value).alias("__most"))
    red = F.when(F.col("__most") > 0, F.col(value) / F.nullif("__most", F.lit(0.0))).otherwise(F.col(value))
    return df.crossJoin(F.broadcast(most)).withColumns({"red": red, "green": F.lit(0.0), "blue": F.lit(0.0)}).drop("__most")  # one row


def scoring_enabled(feature_type: str) -> bool:
    """Scores exist only for encoders that share a space with text."""
    return "clip" in feature_type.lower()


def with_negatives(negatives: Sequence[str] | None, default: Sequence[str] = DEFAULT_NEGATIVES) -> list[str]:
    return list(default if negatives is None else negatives)


def mlp_decode(df: DataFrame, hidden: tuple[np.ndarray, np.ndarray], branches: dict[str, tuple[np.ndarray, np.ndarray]], feature: str = "f") -> DataFrame:
    """relu(x W + b), then one linear map for each branch; weights travel with the function."""
    w1, b1 = (np.asarray(a, float) for a in hidden)
    heads = {n: (np.asarray(w, float), np.asarray(b, float)) for n, (w, b) in branches.items()}
    names = sorted(heads)

    @F.pandas_udf(", ".join(f"{n} array<double>" for n in names))
    def decode(f: pd.Series) -> pd.DataFrame:
        h = np.maximum(np.stack(f.to_numpy()) @ w1 + b1, 0) if len(f) else np.zeros((0, w1.shape[1]))
        return pd.DataFrame({n: list(h @ heads[n][0] + heads[n][1]) for n in names})

    return df.withColumn("__d", decode(F.col(feature))).select("*", "__d.*").drop("__d", feature)


def pca_rgb(df: DataFrame, feature: str = "f", keys: Sequence[str] = ("id",)) -> DataFrame:
    """Projection of the uncentred features on the three main axes, from the 1% to the 99% point, clamped to 0..1.

    The axes come from one aggregate of fixed size (sums and products of pairs).
    """
    width = df.select(F.size(feature).alias("n")).first()["n"]
    x = [F.col(feature)[i] for i in range(width)]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(width)], *[F.sum(x[i] * x[j]).alias(f"c{i}_{j}") for i in range(width) for j in range(i, width)]).first()
    n = sums["n"]
    mean = np.array([sums[f"s{i}"] for i in range(width)]) / n
    cov = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(width)] for i in range(width)]) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :3]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), range(3)] < 0, -1, 1)
    out = df.select(*keys, *[_raw(F.col(feature), axes[:, k]).alias(f"p{k}") for k in range(3)])
    marks = [(k, t, q) for k in range(3) for t, q in (("lo", 0.01), ("hi", 0.99))]
    if n <= pointcloud.EXACT_ROWS:
        ends = out.agg(*[F.percentile(f"p{k}", F.lit(q)).alias(f"q{k}_{t}") for k, t, q in marks])
    else:
        ends = out.sparkSession.createDataFrame([tuple(pointcloud.quantile(out, f"p{k}", q).first()[0] for k, _, q in marks)], ", ".join(f"q{k}_{t} double" for k, t, _ in marks))
    scaled = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(f"p{k}") - F.col(f"q{k}_lo")) / F.nullif(F.col(f"q{k}_hi") - F.col(f"q{k}_lo"), F.lit(0.0)))).alias(c) for k, c in enumerate(("red", "green", "blue"))]
    return out.crossJoin(F.broadcast(ends)).select(*keys, *scaled)  # one row
