"""Identities across views: masks matched by the primitives that they share.

``seen``: (view, mask_id, gid), the primitives in front of each mask.  The bank is
(label, gid), distinct.  Views follow each other because the bank of one is the
start of the next; inside a view all masks are matched at once, against the bank
as it was before the view.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators import ranks, shapes
from terravane.storage import fresh_path, materialise


def shared_counts(seen: DataFrame, bank: DataFrame) -> DataFrame:
    """(view, mask_id, label, shared): distinct primitives in both."""
    a = seen.select("view", "mask_id", "gid").distinct()
    b = bank.select("label", "gid").distinct()
    return a.join(b, "gid").groupBy("view", "mask_id", "label").agg(F.count(F.lit(1)).alias("shared"))


def best_labels(seen: DataFrame, bank: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(mask_id, label): the label with the largest share, the smallest of equals; null below the threshold."""
    size = seen.select("mask_id", "gid").distinct().groupBy("mask_id").agg(F.count(F.lit(1)).alias("n"))
    return rated(shared_counts(seen, bank), size, threshold)


def rated(counts: DataFrame, size: DataFrame, threshold: float, by: str = "mask_id") -> DataFrame:
    """(by, label) of one view from ``counts`` (by, label, shared) and ``size`` (by, n), as :func:`best_labels` says."""
    share = F.col("shared") / (F.col("n") + F.col("shared") + 1e-8)
    all_shares = counts.select(by, "label", "shared").join(size.select(by, "n"), by).withColumn("share", share)
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("share"), "label"))
    best = all_shares.withColumn("r", first).filter("r = 1").filter(F.col("share") >= F.lit(float(threshold))).select(by, "label")
    return size.select(by).join(best, by, "left")


def best_labels_of_shapes(points: DataFrame, members: DataFrame, px: DataFrame, bank: DataFrame, threshold: float = 0.1) -> DataFrame:
    """:func:`best_labels` of one view: rated once for each shape, then given to its masks."""
    best = rated(shapes.shared_counts(points, px, bank), shapes.sizes(points, px), threshold, "shape")
    return members.join(best, "shape").select("mask_id", "label")


def assign(seen: DataFrame, bank: DataFrame | None, next_label: int, threshold: float = 0.1) -> DataFrame:
    """(mask_id, label) of one view; new labels count on from ``next_label`` by mask."""
    if bank is None:
        found = seen.select("mask_id").distinct().withColumn("label", F.lit(None).cast("long"))
    else:
        found = best_labels(seen, bank, threshold)
    return with_fresh(found, next_label)


def with_fresh(found: DataFrame, next_label: int) -> DataFrame:
    """New labels for the masks of (mask_id, label) that have none."""
    fresh = ranks.numbered(found.filter("label IS NULL").select("mask_id"), "mask_id", "__n")
    fresh = fresh.select("mask_id", (F.col("__n") + F.lit(next_label)).alias("label"))
    return found.filter("label IS NOT NULL").select("mask_id", F.col("label").cast("long").alias("label")).unionByName(fresh)


def merged_bank(bank: DataFrame | None, seen: DataFrame, labels: DataFrame) -> DataFrame:
    new = seen.join(labels, "mask_id").select("label", "gid")
    return (new if bank is None else bank.unionByName(new)).distinct()


def merged_by_pixel(bank: DataFrame, points: DataFrame, members: DataFrame, px: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`merged_bank` of one view where many masks have a label: its pixels are merged before they meet primitives."""
    shaped = members.join(labels, "mask_id").select(*shapes.SHAPE, "label").distinct()
    cells = shaped.join(px, shapes.SHAPE).select(*shapes.PIXEL, "label").distinct()
    new = points.join(cells, shapes.PIXEL).select("label", "gid")
    return bank.select("label", "gid").unionByName(new).distinct()


def merged_with_masks(bank: DataFrame, points: DataFrame, members: DataFrame, px: DataFrame) -> DataFrame:
    """:func:`merged_bank` of one view whose masks are their own labels.

    Pairs of distinct primitives and masks are distinct, so they are not shuffled;
    what the bank has in common with them is left out of the bank.
    """
    points = points.select("gid", "view", "y", "x").distinct()
    own = bank.select("label", "gid").distinct()
    named = members.join(own.select(F.col("label").alias("mask_id")).distinct(), "mask_id", "left_semi")
    covered = named.join(px, shapes.SHAPE).select(F.col("mask_id").alias("label"), *shapes.PIXEL)
    common = own.join(points, "gid").join(covered, ["label", *shapes.PIXEL]).select("label", "gid")
    rest = own.join(common, ["label", "gid"], "left_anti")
    masks = shapes.masks_by_pixel(members, px.withColumn("times", F.lit(1).cast("long")))
    return rest.unionByName(shapes.pairs(points, masks, once=True).select(F.col("mask_id").alias("label"), "gid"))


def associate_views(seen: DataFrame, bank: DataFrame | None, next_label: int, threshold: float = 0.1) -> tuple[DataFrame, DataFrame | None, int]:
    """Labels (view, mask_id, label) of the views of ``seen`` in order, the bank after them, and the next label.

    The labels of all views stand in one table that each view appends to.
    """
    spark, path = seen.sparkSession, fresh_path(seen.sparkSession, "labels")
    schema = "view long, mask_id long, label long"
    spark.createDataFrame([], schema).write.parquet(path)
    views = [r["view"] for r in seen.select("view").distinct().orderBy("view").collect()]  # one number for each view
    for view in views:
        own = seen.filter(F.col("view") == F.lit(view)).select("mask_id", "gid").withColumn("view", F.lit(view))
        labels = materialise(assign(own, bank, next_label, threshold))
        labels.select(F.lit(view).cast("long").alias("view"), "mask_id", "label").write.mode("append").parquet(path)
        bank = materialise(merged_bank(bank, own, labels))
        top = labels.agg(F.max("label")).first()[0]
        next_label = max(next_label, (top if top is not None else -1) + 1)
    return spark.read.schema(schema).parquet(path), bank, next_label


def associate(seen: DataFrame, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Labels (view, mask_id, label) of all views in order, and the final bank."""
    labels, bank, _ = associate_views(materialise(seen), None, 0, threshold)  # each view reads it
    return labels, bank if bank is not None else seen.sparkSession.createDataFrame([], "label long, gid long")


@dataclass
class Bank:
    """The bank by shape: of the labels that all have the primitives of one shape, the smallest stands for them.

    ``sources``: (label, view, sid), the shapes whose primitives a label has; a label
    is listed if it was taken by a later view or is the smallest of its shape that
    was not.  ``fresh``: (view, sid, label, next), the labels that began with each
    shape, and the one after each.
    """

    sources: DataFrame | None = None
    fresh: DataFrame | None = None
    next_label: int = 0

    def grown(self, view: int, labels: DataFrame) -> Bank:
        """The bank after a view with labels (mask_id, sid, label)."""
        here, first = F.lit(view).cast("long").alias("view"), F.lit(self.next_label)
        own = labels.filter(F.col("label") >= first).select(here, "sid", "label")
        own = materialise(own.withColumn("next", F.lead("label").over(Window.partitionBy("view", "sid").orderBy("label"))))
        begun = own.groupBy("view", "sid").agg(F.min("label").alias("label")).select("label", "view", "sid")
        if self.sources is None:
            sources, fresh = begun, own
        else:
            taken = labels.filter(F.col("label") < first).select("label", here, "sid").distinct()
            after = self.fresh.join(taken.select("label").distinct(), "label").filter("next IS NOT NULL").select(F.col("next").alias("label"), "view", "sid")
            sources, fresh = self.sources.unionByName(taken).unionByName(after).unionByName(begun).distinct(), self.fresh.unionByName(own)
        top = labels.agg(F.max("label")).first()[0]  # one number
        return Bank(materialise(sources), fresh, max(self.next_label, (-1 if top is None else top) + 1))


def associate_shapes(points: DataFrame, members: DataFrame, share: float, py: Column, px: Column, threshold: float = 0.1, bank: Bank | None = None, done: Collection[int] = ()) -> tuple[DataFrame, Bank]:
    """:func:`associate` of the front primitives of masks, without a row for each mask and primitive.

    ``points``: (view, gid, y, x, depth); ``members``: as of :func:`shapes.numbered`.
    Masks of one shape have the same primitives, so they are rated once, and get the
    same label or labels of their own.  Only primitives in more than one row can be
    in the bank already; those in front of the same shapes of each view are counted
    together.  ``bank`` is that after the views ``done``, whose points and members are
    given again; labels (view, mask_id, label) are those of the other views.
    """
    size, atoms, held = shapes.recurring_fronts(points, members, share, py, px)
    met = F.array_sort(F.collect_list(F.struct("view", "atom")))
    together = materialise(atoms.groupBy("gid").agg(met.alias("met")).filter(F.size("met") > 1).groupBy("met").agg(F.count(F.lit(1)).alias("n")).withColumn("tid", F.monotonically_increasing_id()))
    views = [r["view"] for r in size.select("view").distinct().orderBy("view").collect() if r["view"] not in done]  # one number for each view
    again = {r["view"] for r in together.select(F.explode("met.view").alias("view")).distinct().collect()}
    bank, parts = bank or Bank(), []
    for view in views:
        n = size.filter(F.col("view") == F.lit(view)).select("sid", "n")
        if view in again and bank.sources is not None:
            best = materialise(rated(shared_by_atoms(together, held, bank.sources, view), n, threshold, "sid"))
        else:
            best = n.select("sid", F.lit(None).cast("long").alias("label"))
        own = members.filter(F.col("view") == F.lit(view)).select("mask_id", "sid")
        found = with_fresh(own.join(best, "sid").select("mask_id", "label"), bank.next_label)
        labels = materialise(own.join(found, "mask_id").select("mask_id", "sid", "label"))
        parts.append(labels.select(F.lit(view).cast("long").alias("view"), "mask_id", "label"))
        bank = bank.grown(view, labels)
    empty = points.sparkSession.createDataFrame([], "view long, mask_id long, label long")
    return reduce(DataFrame.unionByName, parts) if parts else empty, bank


def shared_by_atoms(together: DataFrame, held: DataFrame, sources: DataFrame, view: int) -> DataFrame:
    """(sid, label, shared): distinct primitives of each shape of ``view`` that a label of the bank has from its own views."""
    here = together.withColumn("own", F.expr(f"get(filter(met, m -> m.view = {view}), 0).atom")).filter("own IS NOT NULL")
    other = here.select("tid", "own", "n", F.explode(F.expr(f"filter(met, m -> m.view <> {view})")).alias("m")).select("tid", "own", "n", F.col("m.atom").alias("atom"))
    named = sources.join(held, ["view", "sid"]).select("label", "atom").distinct()
    both = other.join(named, "atom").select("tid", "own", "n", "label").distinct()
    cells = both.groupBy(F.col("own").alias("atom"), "label").agg(F.sum("n").alias("n"))
    return held.filter(F.col("view") == F.lit(view)).join(cells, "atom").groupBy("sid", "label").agg(F.sum("n").alias("shared"))
