"""Two-pass external shuffle into shards of equal row counts.

Pass one counts, then scatters records into memory-sized buckets by a seeded
hash of identifier and text; pass two runs a Fisher-Yates shuffle in each bucket
and writes it.  The running total of bucket counts turns a place in a bucket
into a place in one global random order, which is cut into shards whose counts
differ by at most one, so a bucket touches few shards and few files.

Buckets are sorted before they are shuffled, so a bucket that is computed again
after a lost executor gives the same order.  Rows that are equal in identifier and
text can't be told apart: more than ``MOST_COPIES`` of them are counted, and each
copy goes to a bucket of its own number, so that no bucket grows with them.

Null texts have no bytes; null ids and repeated rows are placed like any other row;
texts of any length stand in one row; an empty table gives empty shards.  Ties do
not occur: places are unique.  Other columns are not read, whatever their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.llm import _spark

LAW = "rows"


def fisher_yates(n: int, *seed: int) -> np.ndarray:
    """A seeded permutation of ``range(n)``; numpy's shuffle is Fisher-Yates."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([abs(s) for s in seed])).shuffle(order)
    return order


#: equal rows that may meet in a bucket, and tasks (beyond which a task shuffles several buckets, one after the other)
MOST_COPIES, MOST_TASKS = 1000, 50_000


def scatter(df: DataFrame, bucket_bytes: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Records with their bucket and the bucket's first place in the global order; the number of records."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    total, n = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    n_buckets = max(64, -(-total // bucket_bytes))
    name = F.xxhash64(F.lit(seed), "doc_id", "text")
    keyed = rows.withColumn("bucket", F.pmod(name, F.lit(n_buckets)).cast("int"))
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    if most > MOST_COPIES + 2 * n // n_buckets:
        # some bucket stands out: are there rows with very many copies?
        hot = _spark.materialise(rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_COPIES).select("name"))  # fewer than n / MOST_COPIES
        few = _spark.if_few(hot)
        copies = rows.withColumn("name", name).join(few, "name", "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
        step = 10_000
        each = copies.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))).alias("hi"))
        each = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(step).cast("long"), F.col("n") - F.col("hi") * step) - 1)).alias("lo"))
        each = each.select("doc_id", "text", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", F.col("hi") * step + F.col("lo")), F.lit(n_buckets)).cast("int").alias("bucket"))
        keyed = keyed.withColumn("name", name).join(few, "name", "left_anti").drop("name").unionByName(each)
        counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # one small row for every bucket_bytes of input, summed up in one task
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if n_buckets <= 100_000:  # 16 bytes a bucket; beyond that the join is left to the planner
        places = F.broadcast(places)
    # the one shuffle of texts; places and groups follow its partitioning
    return keyed.repartition(min(MOST_TASKS, n_buckets), "bucket").join(places, "bucket"), n


def shard_documents(df: DataFrame, n_shards: int = 24, seed: int = 20240, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write all records into ``n_shards`` folders of Parquet; return what was written.

    Columns: ``doc_id``, ``text``, ``slot`` (place in the shard, gapless from 0)
    and ``shard``.
    """
    spark = df.sparkSession
    path = path or _spark.fresh_path(spark, "shards")
    records, total = scatter(df, bucket_bytes, seed, id_col, text_col)
    q, r = divmod(total, n_shards)

    def shuffle(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
        group = group.take(pa.array(fisher_yates(group.num_rows, seed, key[0].as_py())))
        place = group.column("first").to_numpy() + np.arange(group.num_rows)
        edge = r * (q + 1)
        shard = np.where(place < edge, place // (q + 1), r + (place - edge) // max(q, 1))
        start = np.where(shard < r, shard * (q + 1), edge + (shard - r) * q)
        return pa.table({"doc_id": group.column("doc_id"), "text": group.column("text"), "slot": pa.array(place - start), "shard": pa.array(shard.astype(np.int32))})

    shuffled = records.groupBy("bucket").applyInArrow(shuffle, "doc_id long, text string, slot long, shard int")
    shuffled.write.mode("overwrite").partitionBy("shard").parquet(path)
    return spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
