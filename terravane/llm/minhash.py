"""Near-duplicate detection with circulant MinHash.

Two permutations give the whole signature: sigma scatters shingles over
``2**32`` places, and coordinate k is the smallest pi(sigma(x) + k), that is one
permutation pi, shifted circularly by k.  Bands of the signature propose
candidates, which are confirmed with the exact Jaccard similarity of full
shingle sets; confirmed links are closed to components.

Copies (equal shingle sets) are one class from the start.  Members of a bucket
are compared with two leaders of the bucket, so a bucket costs rows in proportion
to its members.  Buckets whose members are then still in different components go on
in rounds: ``LEADERS`` members lead, all others are compared with those that are in
another component, the leaders retire, and the next round has four times as many.
A bucket ends when its members are in one component or have all led; no candidate
link between components is left out.

A pair goes to confirmation unless the sizes of the sets rule the similarity out,
or more than ``MOST_BITS`` of 240 signature bits differ (at the similarity 0.8 that
is 5 standard deviations from the mean).  The pairs of the rounds are moreover
compared by the smallest places of their sets: all of them, if the sets are small;
else ``LOWEST`` of them, with a limit that is 5 deviations below 0.8 also where one
set contains the other.

Documents without words, or with a null text, have an empty set and are linked
with nothing.  A null id is linked with nothing either; its component is null
and it is kept.  Repeated rows give repeated results; rows that share an id but not
a text are one node, whose links are confirmed with the smallest of its texts.
Texts of any length have all their shingles; an empty table gives no rows; the
smallest id is kept, so there are no ties.  Other columns are not read, or come
through the filter unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.llm import _spark, _text
from terravane.operators.graph import connected_components as linked

BANDS, ROWS = 40, 6
#: signature bits kept for comparison, in four words of 60
WORDS, MOST_BITS = 4, 48
#: smallest places of a set that are compared in the rounds
LOWEST = 256
#: members of a bucket that lead its first round
LEADERS = 8192
_BLOCK = 1 << 15


def sigma(values: np.ndarray) -> np.ndarray:
    return (_text.mix(values ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def signatures(places: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of each non-empty set; ``first`` has n + 1 entries."""
    n = len(first) - 1
    out = np.full((size, n), np.uint32(0xFFFFFFFF))
    t = 0
    while t < n:
        u = max(t + 1, int(np.searchsorted(first, first[t] + _BLOCK, "right")) - 1)
        part = places[first[t] : first[u]]
        at = first[t:u] - first[t]
        x, y = np.empty_like(part), np.empty_like(part)
        for k in range(size):
            np.add(part, np.uint32(k), out=x)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            out[k, t:u] = np.minimum.reduceat(x, at)
        t = u
    return out


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text."""
    hashes, first = _text.words(*_text.column_bytes(column))
    values, first = _text.grams(hashes, first, width)
    sets, sizes = [], np.zeros(len(first), np.int64)
    for t in range(len(first) - 1):
        v = np.sort(values[first[t] : first[t + 1]])
        if len(v) > 1:
            keep = np.ones(len(v), bool)
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            v = v[keep]
        sets.append(v)
        sizes[t + 1] = len(v)
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum(sizes)


def sketch(df: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``fp1``, ``fp2`` (name of the set), ``bits`` and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                values, first = shingle_sets(part.column(1), width)
                sizes = np.diff(first)
                some = np.flatnonzero(sizes)
                sums = np.zeros((2, len(sizes)), np.uint64)
                key = np.zeros((len(sizes), bands), np.uint64)
                bits = np.zeros((len(sizes), WORDS), np.uint64)
                if len(some):
                    at = first[:-1][some]
                    sums[0, some] = np.add.reduceat(_text.mix(values), at)
                    sums[1, some] = np.add.reduceat(_text.mix(values ^ np.uint64(0x1234567)), at)
                    sign = signatures(sigma(values), np.concatenate([at, first[-1:]]), bands * rows).astype(np.uint64)
                    for k in range(WORDS * 60):
                        bits[some, k // 60] |= (sign[k % len(sign)] & np.uint64(1)) << np.uint64(k % 60)
                    for b in range(bands):
                        h = np.full(len(some), np.uint64(b + 1))
                        for k in range(rows):
                            h = _text.mix(h * np.uint64(0x9E3779B97F4A7C15) + sign[b * rows + k])
                        key[some, b] = h
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1).view(np.int64))) for m in (bits, key)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *lists], ["doc_id", "n_shingles", "fp1", "fp2", "bits", "bands"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, bits array<long>, bands array<long>")


def lowest(texts: DataFrame, width: int) -> DataFrame:
    """``rep`` and ``low``: the ``LOWEST`` smallest places of each set, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                values, first = shingle_sets(part.column(1), width)
                places = sigma(values)
                low = [np.unique(places[first[t] : first[t + 1]])[:LOWEST].astype(np.int64) for t in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(low, pa.list_(pa.int64()))], ["rep", "low"])

    return texts.select("doc_id", "text").mapInArrow(run, "rep long, low array<long>")


def _close(percent: int) -> Column:
    """Whether the ``low`` of two members allow a link.

    Small sets are compared in full.  Of larger ones, ``LOWEST`` places of the
    larger set stand for all; the limit is then that of a similarity lower by 20.
    """
    large = F.greatest("a.size", "b.size")
    limit = F.when(large > LOWEST, F.lit(percent - 20)).otherwise(F.lit(percent))
    common = F.size(F.array_intersect("a.low", "b.low"))
    return common * (100 + limit) * large >= limit * (F.col("a.size") + F.col("b.size")) * F.least(large, F.lit(LOWEST))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * common >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for outer in _text.slices(batch, "text_a", 1 << 20):
                for part in _text.slices(outer, "text_b", 1 << 20):
                    va, fa = shingle_sets(part.column(2), width)
                    vb, fb = shingle_sets(part.column(3), width)
                    na, nb = np.diff(fa), np.diff(fb)
                    n = len(na)
                    both = np.concatenate([va, vb])
                    row = np.concatenate([np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)])
                    order = np.lexsort((both, row))
                    both, row = both[order], row[order]
                    same = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
                    common = np.bincount(row[1:][same], minlength=n)
                    keep = (100 * common >= percent * (na + nb - common)) & (common > 0)
                    yield part.select([0, 1]).filter(pa.array(keep))

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) from edges (a, b), for all nodes but the roots."""
    return linked(edges).filter("node <> root")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of ``labels`` (node, root) after more links (a, b)."""
    of = labels.selectExpr("node AS a", "root AS ra")
    roots = links.join(of, "a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
    of = labels.selectExpr("node AS b", "root AS rb")
    roots = roots.join(of, "b", "left").select("a", F.coalesce("rb", "b").alias("b"))
    tops = connected_components(roots).selectExpr("node AS root", "root AS top")
    moved = labels.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # a root that has moved, or a node that had no link yet, is a node now
    return moved.union(tops.selectExpr("root AS node", "top AS root"))


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    ``width``: words in a shingle; ``percent``: least similarity of a link, 80 or more.
    """
    if percent < 80:
        raise ValueError("bands and bits are laid out for similarities of 0.8 and more")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = _spark.materialise(sketch(docs, width))
    named = sketches.filter("n_shingles > 0 and doc_id is not null")
    chosen = named.groupBy("fp1", "fp2", "n_shingles").agg(F.min(F.struct("doc_id", "bits", "bands")).alias("m"))
    words = [F.col("m.bits")[k].alias(f"w{k}") for k in range(WORDS)]
    reps = _spark.materialise(chosen.select("fp1", "fp2", "n_shingles", F.col("m.doc_id").alias("rep"), F.col("n_shingles").alias("size"), *words, F.col("m.bands").alias("bands")))
    columns = ["size", *[f"w{k}" for k in range(WORDS)]]
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = _spark.materialise(keyed.join(buckets, "key").join(reps.select("rep", *columns), "rep"))
    wanted = _spark.counted(members.select(F.col("rep").alias("doc_id")).distinct())
    texts = docs.join(_spark.if_few(*wanted), "doc_id", "left_semi")
    if named.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = _spark.materialise(texts)

    def likely(a: str, b: str) -> Column:
        """Whether sizes and signature bits of two members allow a link."""
        small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
        differ = sum(F.bit_count(F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}"))) for k in range(WORDS))
        return (100 * small >= percent * large) & (differ <= MOST_BITS)

    # leaders of a bucket: its smallest id, and one that is smallest by a hash
    one = F.struct("rep", *columns)
    lead = members.groupBy("key").agg(F.min(one).alias("first"), F.min(F.struct(F.xxhash64("rep", F.col("key") % 2).alias("rank"), one.alias("one"))).alias("second"))
    lead = lead.select("key", F.explode(F.array("first", "second.one")).alias("b"))
    found = members.select("key", one.alias("a")).join(lead, "key").filter((F.col("a.rep") != F.col("b.rep")) & likely("a", "b"))
    first = _spark.materialise(found.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct())
    labels = connected_components(confirmed(first, texts, width, percent))

    # rounds of more leaders for buckets with members in different components
    leading, active, wide = LEADERS, members, None
    while True:
        active = active.join(labels, active["rep"] == labels["node"], "left").select("key", "rep", *columns, F.coalesce("root", "rep").alias("root"))
        mixed = active.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        active, n = _spark.counted(active.join(mixed, "key"))
        if not n:
            break
        if wide is None:
            few = texts.join(_spark.if_few(active.select(F.col("rep").alias("doc_id")).distinct(), n), "doc_id", "left_semi")
            wide = _spark.materialise(lowest(few, width).join(reps.select("rep", "bands"), "rep"))
        # only the leaders of a bucket meet in one task
        order = Window.partitionBy("key").orderBy(F.xxhash64("rep", F.lit(leading)), "rep")
        lead, led = _spark.counted(active.select("key", "rep").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= leading))
        active = active.join(lead, ["key", "rep"], "left")
        placed = active.join(wide, "rep")
        a, b = placed.alias("a"), placed.filter("place is not null").alias("b")
        # two leaders meet once, and of the buckets that a pair shares, a hash of the pair chooses one
        mask = F.xxhash64(F.least("a.rep", "b.rep"), F.greatest("a.rep", "b.rep"))
        here = F.array_min(F.transform(F.array_intersect("a.bands", "b.bands"), lambda k, mask=mask: k.bitwiseXOR(mask))) == F.col("a.key").bitwiseXOR(mask)
        apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.place").isNull() | (F.col("a.place") > F.col("b.place"))) & likely("a", "b") & here & _close(percent)
        found = a.join(b, apart).select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()
        found = found.join(first, ["a", "b"], "left_anti")
        fresh, links = _spark.counted(confirmed(found, texts, width, percent))
        if links:
            labels = _spark.materialise(_merged(labels, fresh))
        if led == n:
            break  # all members have led
        active = active.filter("place is null").drop("place", "root")
        leading *= 4
    rooted = reps.select("fp1", "fp2", "n_shingles", "rep").join(labels, reps["rep"] == labels["node"], "left").select("fp1", "fp2", "n_shingles", F.coalesce("root", "rep").alias("root"))
    placed = sketches.select("doc_id", "n_shingles", "fp1", "fp2").join(rooted, ["fp1", "fp2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group: that of its smallest id.

    Rows without an id stay.  Of rows that repeat an id that stays, the one with
    the smallest text stays.
    """
    found = _spark.materialise(near_duplicates(docs, width, percent, id_col, text_col))
    gone, place = _spark.unused(docs, "__gone"), _spark.unused(docs, "__place")
    dropped = _spark.counted(found.filter("not kept").select(F.col("doc_id").alias(gone)).distinct())
    left = docs.join(_spark.if_few(*dropped), F.col(id_col).cast("long") == F.col(gone), "left_anti")
    repeated = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if repeated:
        keyed = left.filter(F.col(id_col).isNotNull())
        first = Window.partitionBy(id_col).orderBy(text_col)
        keyed = keyed.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(place)
        left = left.filter(F.col(id_col).isNull()).unionByName(keyed)
    return left
