"""Small helpers for the operators: shared storage and column handling."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.storage import counted, fresh_path, materialise, shared_dir

__all__ = ["add_up", "counted", "fresh_path", "held_out", "if_few", "materialise", "shared_dir", "ship", "table", "unused"]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


_shipped: set[str] = set()
#: bytes of one Arrow batch; bounds the memory of tasks and workers
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give the package's code to the executors, once for each application.

    Also bounds the session's Arrow batches by bytes: texts have very unequal sizes;
    and lets the first rows of each group be chosen before they are shuffled.
    """
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", 1 << 20)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = os.path.join(tempfile.mkdtemp(), "terravane_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "terravane")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


#: ids that are given to every task (16 MB); more of them are joined by a shuffle
BROADCAST_IDS = 1 << 21


def if_few(ids: DataFrame, n: int | None = None) -> DataFrame:
    """Stored ``ids`` with a broadcast hint if they are counted (``n``) to be few.

    Texts that are joined with them then stay where they are.
    """
    return F.broadcast(ids) if (ids.count() if n is None else n) <= BROADCAST_IDS else ids


#: vectors added up by one task
FAN_IN = 64


def add_up(df: DataFrame, n_parts: int, kind: str = "double") -> DataFrame:
    """(i, v): element-wise sums of the arrays of each ``i``; ``df`` has (i, part, v).

    At most ``FAN_IN`` arrays meet in a task, and are added by the order of
    ``part``; more parts are added in levels.  ``kind``: double or float.
    """
    numbers = pa.float64() if kind == "double" else pa.float32()

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        total = None
        for v in group.column("v"):
            v = v.values.to_numpy().astype(np.float64)
            total = v if total is None else total + v
        return pa.table({"i": group.column("i")[:1], "part": group.column("part")[:1], "v": pa.array([total], pa.list_(pa.float64())).cast(pa.list_(numbers))})

    while True:
        n_parts = -(-n_parts // FAN_IN)
        df = df.withColumn("at", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("i", "part").applyInArrow(add, f"i long, part long, v array<{kind}>")
        if n_parts <= 1:
            return df.select("i", "v")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
