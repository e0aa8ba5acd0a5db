"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every window of ``seed_words`` words of a test item is a seed, however common it
is, so a copy is found by any part of it that is left.  Where a document holds a
seed, the words around it are aligned with the item (match +2, mismatch -1, gap
-1); the score is the best alignment divided by that of a perfect copy.  Windows
that overlap are one window, and what lies before and after an alignment in it is
searched again.  Windows are left out before alignment only if so few of the
item's words occur in them that the score could not reach the threshold.

The benchmark is a stated query set: it is broadcast in blocks of at most
``block_bytes`` of text, each block against all documents in place.  Documents
are never shuffled.  Null or empty texts match nothing.  An item with fewer words
than a seed is a seed as a whole, and is found wherever all of its words stand in
their order.  Texts of any length are aligned whole; of alignments with equal
scores the first is taken.  Repeated rows give repeated results; rows with a null
id are searched like any other, and an item with a null id is reported as -1.  An
empty benchmark or an empty table of documents gives no rows.  Other columns are
not read by the search and come through the filter unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import _text

SEED_WORDS, THRESHOLD, BLOCK_BYTES = 3, 0.55, 8 << 20
#: places of seeds that are held at once
HITS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the end (exclusive) of it in ``window``."""
    n = len(window)
    ramp = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.zeros(n + 1, np.int64)
        step[1:] = np.maximum(row[:-1] + np.where(window == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + ramp) - ramp  # gaps along the window
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


class Seeds:
    """The windows of ``n`` words of some items: of all with more words, or of those with just as many."""

    def __init__(self, words: np.ndarray, first: np.ndarray, chosen: np.ndarray, n: int):
        self.n = n
        seeds, at = _text.grams(words, first, n, whole_if_shorter=False)
        held = np.repeat(chosen, np.diff(at))
        self.item = np.repeat(np.arange(len(chosen)), np.diff(at))[held]
        self.at = (np.arange(len(seeds)) - np.repeat(at[:-1], np.diff(at)))[held]
        self.names, self.name = np.unique(seeds[held], return_inverse=True)

    def prepare(self) -> None:
        self.order = np.argsort(self.name, kind="stable")
        names = self.name[self.order]
        self.table = _text.HashTable(self.names, np.arange(len(self.names)))
        self.start = np.searchsorted(names, np.arange(len(self.names)))
        self.stop = np.searchsorted(names, np.arange(len(self.names)), "right")


class Items:
    """One block of test items with their seeds."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        self.ids = np.array(ids, np.int64)
        self.words, self.first = _text.words(*_text.column_bytes(pa.array(texts, pa.string())))
        size = np.diff(self.first)
        # shorter items are seeds as a whole, of their own width
        self.seeds = [Seeds(self.words, self.first, size >= n if k == n else size == k, k) for k in range(1, n + 1) if k == n or (size == k).any()]

    def prepare(self) -> None:
        for seeds in self.seeds:
            seeds.prepare()


def _stretches(query: np.ndarray, window: np.ndarray, threshold: float) -> Iterator[tuple[float, int, int]]:
    """Score, start of the search and end of each alignment in ``window`` that reaches the threshold."""
    todo = [(0, len(window))]
    while todo:
        lo, hi = todo.pop()
        part = window[lo:hi]
        if np.isin(query, part).sum() < threshold * len(query):
            continue
        best, end = smith_waterman(query, part)
        score = best / (MATCH * len(query))
        if score < threshold:
            continue
        yield score, lo, lo + end
        back = smith_waterman(query[::-1], part[:end][::-1])[1]
        todo += [(lo, lo + end - back), (lo + end, hi)]


def _align(items: Items, words: np.ndarray, first: np.ndarray, threshold: float) -> dict[str, list]:
    """All alignments at or above the threshold in a slice of documents."""
    out: dict[str, list] = {"text": [], "item": [], "score": [], "start": [], "end": []}
    for seeds in items.seeds:
        gram, gram_first = _text.grams(words, first, seeds.n, whole_if_shorter=False)
        name = seeds.table.get(gram)
        hit = np.flatnonzero(name >= 0)
        name = name[hit]
        held = np.searchsorted(gram_first, hit, "right") - 1
        total = np.cumsum(seeds.stop[name] - seeds.start[name])
        a = 0
        while a < len(hit):
            # whole texts with at most HITS places of seeds, or one text
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right")))
            if b < len(hit):
                b = int(np.searchsorted(held, held[b]))
                b = b if b > a else int(np.searchsorted(held, held[a], "right"))
            _align_hits(items, seeds, words, first, gram_first, hit[a:b], name[a:b], held[a:b], threshold, out)
            a = b
    return out


def _align_hits(items: Items, seeds: Seeds, words: np.ndarray, first: np.ndarray, gram_first: np.ndarray, hit: np.ndarray, name: np.ndarray, text: np.ndarray, threshold: float, out: dict[str, list]) -> None:
    times = seeds.stop[name] - seeds.start[name]
    seed = seeds.order[np.repeat(seeds.start[name], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    hit, text = np.repeat(hit, times), np.repeat(text, times)
    place = hit - gram_first[text]
    item = seeds.item[seed]
    begin = place - seeds.at[seed]
    order = np.lexsort((begin, item, text))
    text, item, begin = text[order], item[order], begin[order]
    i = 0
    while i < len(order):
        t, m = text[i], item[i]
        query = items.words[items.first[m] : items.first[m + 1]]
        size, whole = len(query), words[first[t] : first[t + 1]]
        pad = max(4, size // 4)
        j, stop = i + 1, begin[i] + size + pad
        while j < len(order) and text[j] == t and item[j] == m and begin[j] - pad <= stop:
            stop = begin[j] + size + pad
            j += 1
        lo, hi = max(0, begin[i] - pad), min(len(whole), stop)
        for score, start, end in _stretches(query, whole[lo:hi], threshold):
            out["text"].append(t)
            out["item"].append(items.ids[m])
            out["score"].append(score)
            out["start"].append(lo + start)
            out["end"].append(lo + end)
        i = j


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, seed_words: int) -> Iterator[Items]:
    """The test items, block by block; a block's text has a bounded size."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        ids.append(-1 if item is None else item)
        texts.append(text)
        size += len(text.encode())
        if size >= block_bytes:
            yield Items(ids, texts, seed_words)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, seed_words)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed_words: int = SEED_WORDS, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each aligned stretch: ``doc_id``, ``item_id``, ``score``, ``start_word``, ``end_word``."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes, seed_words):
        block = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            block.value.prepare()
            for batch in batches:
                for part in _text.slices(batch, "text"):
                    out = _align(block.value, *_text.words(*_text.column_bytes(part.column(1))), threshold)
                    ids = part.column(0).take(pa.array(np.array(out["text"], np.int64)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(out["item"], pa.int64()), pa.array(out["score"], pa.float64()), pa.array(out["start"], pa.int64()), pa.array(out["end"], pa.int64())], ["doc_id", "item_id", "score", "start_word", "end_word"])

        found = found.union(docs.mapInArrow(run, schema))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed_words: int = SEED_WORDS, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all columns, without the rows in which an item is found."""
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes, seed_words):
        block = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            block.value.prepare()
            for batch in batches:
                for part in _text.slices(batch, text_col):
                    column = part.column(part.schema.get_field_index(text_col))
                    out = _align(block.value, *_text.words(*_text.column_bytes(column)), threshold)
                    keep = np.ones(part.num_rows, bool)
                    keep[out["text"]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
