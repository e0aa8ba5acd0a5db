"""Quality classifier: random Fourier features over document statistics.

Each text is described by statistics of its bytes, words and lines.  Random
Fourier features approximate a Gaussian kernel over the standardised statistics;
every partition adds up its part of the normal equations, the parts are summed
by row, and the driver solves a ridge regression of fixed size.  Labelled rows
that the regression has not seen give an isotonic map from raw scores to
probabilities, fitted on a histogram of fixed size.

The model is fitted on all labelled rows of the training folds, or on a seeded
sample of some ``FIT_ROWS`` of them (the documented bound); every text is scored
whole, of any length.  A null text counts as empty; empty texts are scored like any
other.  Labels that are null are left out; a row with a null id gets a score but
can't carry a label; of several labels of an id each counts.  Repeated rows give
repeated results, and equal raw scores equal results.  Without any label all scores
are 0.5; an empty table gives no rows.  Other columns are not read, or come through
the filter unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import _spark, _text

WIDTH, BINS, RIDGE, GAMMA = 256, 2048, 1e-3, 0.06
#: labelled rows that the model is fitted on; of more of them a sample by a hash of the id
FIT_ROWS = 1 << 20

#: bytes counted together; each class's share of a text is one statistic
BYTE_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#", b"*", b"$%&", b"|", b"<>[]{}=\\/_~^", b"!", b"?", b".", b",", b";:", b"\"'()", b"@+-", b" ", b"\n", b"\t\r\x0b\x0c"]
N_STATS = len(BYTE_CLASSES) + 12


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``N_STATS`` numbers for each text."""
    offsets, data = _text.column_bytes(column)
    n = len(offsets) - 1
    lookup = np.full(256, len(BYTE_CLASSES), np.int64)
    for k, members in enumerate(BYTE_CLASSES):
        lookup[list(members)] = k
    size = np.diff(offsets)
    kinds = len(BYTE_CLASSES) + 1
    table = np.empty((n, kinds))
    group = np.eye(kinds)[lookup]
    for t in range(n):
        table[t] = np.bincount(data[offsets[t] : offsets[t + 1]], minlength=256) @ group
    out = np.zeros((n, N_STATS))
    out[:, : kinds] = np.sqrt(table / np.maximum(size, 1)[:, None])
    low = _text.LOWER[data]
    starts, ends, first = _text.word_spans(offsets, low)
    hashes = _text.span_hashes(low, starts, ends)
    lengths = ends - starts
    lead = np.zeros(len(starts), bool)
    if len(starts):
        lead = (data[starts] >= 65) & (data[starts] <= 90)
    for t in range(n):
        a, b = first[t], first[t + 1]
        m = b - a
        row = out[t, kinds:]
        row[0] = np.log1p(m) / 10
        text = data[offsets[t] : offsets[t + 1]]
        if m:
            w = lengths[a:b]
            h = np.sort(hashes[a:b])
            edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            runs = np.diff(np.append(edge, m))
            row[1] = w.mean() / 10
            row[2] = w.std() / 10
            row[3] = (w <= 3).mean()
            row[4] = len(runs) / m**0.9
            row[5] = runs.max() / m
            row[6] = lead[a:b].mean()
            row[7] = min(w.max(), 200) / 50
            g = hashes[a : b - 1] * np.uint64(3) + hashes[a + 1 : b] if m > 1 else h
            row[8] = len(np.unique(g)) / len(g)
            lines = bytes(text).split(b"\n")
            row[9] = len(set(lines)) / len(lines)
            row[10] = np.log1p(m / len(lines)) / 5
    return out


def fourier(stats: np.ndarray, centre: np.ndarray, scale: np.ndarray, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, np.sqrt(2 * GAMMA), (stats.shape[1], WIDTH))
    phase = rng.uniform(0, 2 * np.pi, WIDTH)
    x = np.clip((stats - centre) / scale, -8, 8)
    z = np.sqrt(2 / WIDTH) * np.cos(x @ weights + phase)
    return np.hstack([z, np.ones((len(z), 1))])


def summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], rows: int) -> np.ndarray:
    """Sum over all batches of a matrix of ``rows`` rows, added up by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                m = part(batch.slice(at, 4096))
                total = m if total is None else total + m
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, TaskContext.get().partitionId())), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part", "v"])

    found = _spark.add_up(df.mapInArrow(run, "i long, part long, v array<double>"), df.rdd.getNumPartitions()).collect()  # ``rows`` rows
    found = {r["i"]: r["v"] for r in found}
    return np.array([found[i] for i in range(rows)]) if found else np.zeros((rows, 0))


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest rising sequence."""
    blocks: list[list[float]] = []
    for w, m in zip(weights, means, strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), m) for _, m, n in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> dict:
    """Model from ``stats`` (doc_id, stats) and ``labels`` (doc_id, label)."""
    rows = stats.join(labels, "doc_id").select("stats", F.col("label").cast("double").alias("y"), (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("apart"))
    rows = _spark.materialise(rows)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b)
        return np.stack([x.sum(0), (x * x).sum(0), np.full(x.shape[1], float(len(x)))])

    m = summed(rows, moments, 3)
    if not m.size:
        return {"flat": 0.5}
    centre = m[0] / m[2]
    scale = np.sqrt(np.maximum(m[1] / m[2] - centre**2, 0)) + 1e-3

    def normal(b: pa.RecordBatch) -> np.ndarray:
        z, y = fourier(_matrix(b), centre, scale), b.column(1).to_numpy()
        return np.vstack([z.T @ z, (z.T @ y)[None, :]])

    eq = summed(rows.filter("not apart"), normal, WIDTH + 2)
    if not eq.size:
        eq = summed(rows, normal, WIDTH + 2)
    gram, right = eq[:-1], eq[-1]
    n = gram[-1, -1]
    beta = np.linalg.solve(gram + RIDGE * n / WIDTH * np.eye(len(gram)), right)

    def histogram(b: pa.RecordBatch) -> np.ndarray:
        raw, y = fourier(_matrix(b), centre, scale) @ beta, b.column(1).to_numpy()
        at = bins(raw)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)]).astype(float)

    h = summed(rows.filter("apart"), histogram, 2)
    if not h.size:
        h = summed(rows, histogram, 2)
    some = np.flatnonzero(h[0])
    level = isotonic(h[0, some], h[1, some] / h[0, some])
    return {"centre": centre, "scale": scale, "beta": beta, "at": some, "level": level}


def bins(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def predict(stats: np.ndarray, model: dict) -> np.ndarray:
    if "flat" in model:
        return np.full(len(stats), model["flat"])
    raw = fourier(stats, model["centre"], model["scale"]) @ model["beta"]
    return np.interp(bins(raw), model["at"], model["level"])


def statistics_table(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats`` of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                x = statistics(part.column(1)).astype(np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATS), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], ["doc_id", "stats"])

    return docs.mapInArrow(run, "doc_id long, stats array<float>")


def known_labels(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """``doc_id`` and ``label`` of the training folds, written to shared storage."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label")).filter("label is not null and doc_id is not null")
    known = known.filter(~_spark.held_out(F.col("doc_id"), 3, 1))
    n = known.count()
    if n > FIT_ROWS:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(n)) < FIT_ROWS)
    return _spark.materialise(known)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    stats = _spark.materialise(statistics_table(_texts(docs, id_col, text_col)))
    model = fit(stats, known_labels(labels, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = predict(_matrix(batch), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = stats.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", _spark.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs``, all columns, without the rows that are predicted 0.

    Only labelled texts are described for fitting; their ids are few, so texts stay in place.
    """
    known = known_labels(labels, label_col)
    texts = _texts(docs, id_col, text_col).join(_spark.if_few(known.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fit(statistics_table(texts), known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, text_col):
                column = part.column(part.schema.get_field_index(text_col))
                stats = statistics(column).astype(np.float32).astype(np.float64)
                yield part.filter(pa.array(predict(stats, model) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
