"""The association of views as a stream: one micro-batch of views at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terravane.operators import assoc, shapes
from terravane.sources import io
from terravane.storage import materialise

LABELS, BANK = "view long, mask_id long, label long", "label long, gid long"
POINTS, MASKS = "view long, gid long, y int, x int, depth double", "mask_id long, shape array<struct<xa: int, xb: int, ya: int, yb: int>>"
SOURCES, FRESH = "label long, view long, sid long", "view long, sid long, label long, next long"


class ViewFold:
    """The association between micro-batches; views arrive in order.

    The state lies in ``folder`` on shared storage, one part for each batch: its
    labels, the bank after it, and last a mark with the next label.  A batch starts
    from the part before it, so a batch that is run again, also by a new driver,
    gives the same labels again.
    """

    def __init__(self, spark: SparkSession, folder: str, threshold: float = 0.1):
        self.spark, self.folder, self.threshold = spark, folder, threshold

    def _part(self, batch: int, name: str) -> str:
        return f"{self.folder}/{batch}/{name}"

    def _before(self, batch: int) -> tuple[DataFrame | None, int]:
        """Bank and next label after the last batch before this one."""
        for earlier in range(batch - 1, -1, -1):
            if io.exists(self.spark, self._part(earlier, "mark")):
                mark = io.read_json(self.spark, self._part(earlier, "mark"))
                return self.spark.read.schema(BANK).parquet(self._part(earlier, "bank")), mark["next_label"]
        return None, 0

    def add(self, seen: DataFrame, batch: int = 0) -> None:
        """Fold the views of one batch (view, mask_id, gid) into the bank."""
        self.spark = seen.sparkSession
        bank, next_label = self._before(batch)
        labels, bank, next_label = assoc.associate_views(materialise(seen), bank, next_label, self.threshold)
        labels.write.mode("overwrite").parquet(self._part(batch, "labels"))
        (bank if bank is not None else self.spark.createDataFrame([], BANK)).write.mode("overwrite").parquet(self._part(batch, "bank"))
        io.write_json(self.spark, self._part(batch, "mark"), {"next_label": next_label})

    @property
    def labels(self) -> DataFrame:
        """(view, mask_id, label) of all batches so far."""
        if not io.exists(self.spark, self.folder):
            return self.spark.createDataFrame([], LABELS)
        return self.spark.read.schema(LABELS).parquet(f"{self.folder}/*/labels")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frames(points: DataFrame, members: DataFrame) -> DataFrame:
    """One table of the primitives (view, gid, y, x, depth) and the masks (view, mask_id, shape) of views, for :class:`ShapeFold`."""
    return points.select("view", "gid", "y", "x", "depth").unionByName(members.select("view", "mask_id", "shape"), allowMissingColumns=True)


class ShapeFold(ViewFold):
    """:class:`ViewFold` from :func:`frames`, by :func:`assoc.associate_shapes`; a view lies in one batch.

    A part also holds the frames of its batch, as later views may have their primitives
    again, and of the bank the labels that began in it and the sources after it.
    """

    def __init__(self, spark: SparkSession, folder: str, share: float, py: Column, px: Column, threshold: float = 0.1):
        super().__init__(spark, folder, threshold)
        self.share, self.patch = share, (py, px)

    def add(self, seen: DataFrame, batch: int = 0) -> None:
        """Fold the frames of one batch into the bank."""
        seen.write.mode("overwrite").parquet(self._part(batch, "frames"))
        new = self._read([batch], "frames", f"{POINTS}, {MASKS}")
        shapes.numbered(new.filter("mask_id IS NOT NULL").select("view", "mask_id", "shape")).write.mode("overwrite").parquet(self._part(batch, "members"))
        before = [b for b in range(batch) if io.exists(self.spark, self._part(b, "mark"))]
        mark = io.read_json(self.spark, self._part(before[-1], "mark")) if before else {"next_label": 0, "views": []}
        bank = assoc.Bank(self._read(before[-1:], "sources", SOURCES), self._read(before, "fresh", FRESH), mark["next_label"]) if mark["views"] else None
        points = self._read([*before, batch], "frames", f"{POINTS}, {MASKS}").filter("mask_id IS NULL").select("view", "gid", "y", "x", "depth")
        members = self._read([*before, batch], "members", f"view long, {MASKS}, sid long")
        if mark["views"] and new.filter(F.col("view").isin(mark["views"])).limit(1).count():
            raise ValueError("a view lies in two batches")
        labels, bank = assoc.associate_shapes(points, members, self.share, *self.patch, self.threshold, bank, mark["views"])
        labels.write.mode("overwrite").parquet(self._part(batch, "labels"))
        sources, fresh = (self.spark.createDataFrame([], schema) if df is None else df for df, schema in ((bank.sources, SOURCES), (bank.fresh, FRESH)))
        sources.write.mode("overwrite").parquet(self._part(batch, "sources"))
        fresh.filter(F.col("label") >= F.lit(mark["next_label"])).write.mode("overwrite").parquet(self._part(batch, "fresh"))
        views = [r["view"] for r in labels.select("view").distinct().collect()]  # one number for each view
        io.write_json(self.spark, self._part(batch, "mark"), {"next_label": bank.next_label, "views": [*mark["views"], *views]})

    def _read(self, batches: list[int], name: str, schema: str) -> DataFrame:
        # by the session of the fold: the one of a stream doesn't adapt its plans
        return self.spark.read.schema(schema).parquet(*[self._part(b, name) for b in batches])


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    """Counts and sums in sliding windows with a watermark; runs on streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
