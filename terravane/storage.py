"""Storage that driver and executors share, and tables written to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset, a folder in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, kind: str = "t") -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` as it is materialised, and its rows, counted while they are written."""
    seen = Observation()
    return materialise(df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]
