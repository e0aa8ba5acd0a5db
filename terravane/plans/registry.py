"""Registry of queries with the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Relations:
    """The relations of one data folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return fixtures.relation(self.spark, self.sf_dir, name)


def query(oracle: str | None = None) -> Callable:
    """Register a function of :class:`Relations` under its own name."""

    def register(f: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if oracle:
            ORACLES[name] = fixtures.with_relations(oracle)
        return f

    return register


def r9(value: Column | str) -> Column:
    """Nine places; a negative zero counts as zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, 9) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r9(c).alias(c) if c in names else F.col(c) for c in df.columns])
