"""Language identification by cross-parsing entropy.

The labelled text of each language gives a suffix automaton.  A text is parsed
greedily, from its start to its end, into the longest phrases that occur in a
language's text.  A phrase costs what it takes to name it, log2 of the length of
the language's text and of the single symbols; the language with the least cost
for each symbol wins, the first by name among equals.

All automata stand in one transition table.  A batch is parsed in stretches of
``STRETCH`` symbols side by side, each as if a phrase began there.  Then every
stretch is entered once more with the phrase that its predecessor left open, up to
the first place where both parses begin a phrase: from there on they are the same.
The result is that of parsing each text in one go.

Learning uses at most ``SAMPLE_DOCS`` documents and ``SAMPLE_BYTES`` bytes of
each language (a bounded sample in the order of a seeded hash); prediction covers
every text, of any length.  Null texts and texts without a letter get ``und`` with
score 0.  Rows with a null language teach nothing, and a null id counts as not held
out; repeated rows give repeated results; with no labelled text every language is
``und``; an empty table gives no rows.  Other columns are not read, or come through
the filter unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import _spark, _text

SAMPLE_DOCS, SAMPLE_BYTES, STRETCH, SHARPNESS = 48, 16_000, 192, 8

#: bytes of text that a worker parses at a time; the parse takes some 30 bytes for each
SLICE = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def symbols(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with single blanks for all else; new offsets."""
    low = _text.LOWER[data]
    if len(low) > 1:  # capitals of Latin-1 in UTF-8
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][second] += 0x20
    low = np.where(_LETTER[low], low, np.uint8(32))
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    inner = offsets[:-1][offsets[:-1] < len(low)]
    keep[inner] = True
    total = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return low[keep], total[offsets]


def suffix_automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Transitions (state, symbol) of the automaton; 0 is the start, -1 none."""
    limit = 2 * len(text) + 2
    go = np.full((limit, width), -1, np.int32)
    link, length = [-1] * limit, [0] * limit
    size, last = 1, 0
    for c in text.tolist():
        cur = size
        size += 1
        length[cur] = length[last] + 1
        p = last
        while p >= 0 and go[p, c] < 0:
            go[p, c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = int(go[p, c])
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = size
                size += 1
                length[twin] = length[p] + 1
                go[twin] = go[q]
                link[twin] = link[q]
                while p >= 0 and go[p, c] == q:
                    go[p, c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go[:size]


class Parser:
    """All automata; ``cost`` is what a phrase of each language costs, in bits."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        texts = []
        for lang in self.languages:
            data = np.frombuffer(samples[lang], np.uint8)
            texts.append(symbols(np.array([0, len(data)]), data)[0])
        self.cost = np.log2(256 + np.array([len(t) for t in texts], float))
        present = np.unique(np.concatenate([np.zeros(0, np.uint8), *texts]))
        self.index = np.full(256, len(present), np.int64)
        self.index[present] = np.arange(len(present))
        width = len(present) + 1
        tables, self.roots, size = [], [], 1
        for text in texts:
            go = suffix_automaton(self.index[text], width)
            self.roots.append(size)
            tables.append(np.where(go >= 0, go + size, 0))
            size += len(go)
        self.width = width
        self.table = np.concatenate([np.zeros((1, width), np.int64), *tables]).astype(np.int32).reshape(-1)  # state 0 is dead

    def phrases(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language."""
        n = len(offsets) - 1
        out = np.zeros((len(self.languages), n), np.int64)
        size = np.diff(offsets)
        parts = -(-size // STRETCH)
        text = np.repeat(np.arange(n), parts)
        if not len(text):
            return out
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = offsets[:-1][text] + part * STRETCH
        stop = np.minimum(begin + STRETCH, offsets[1:][text])
        symbol = self.index[data]
        for k, root in enumerate(self.roots):
            starts, state = self._stretches(root, begin, stop, symbol)
            self._join(root, begin, stop, np.flatnonzero(part), symbol, starts, state)
            total = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
            np.cumsum(starts, out=total[1:])
            out[k] = total[offsets[1:]] - total[offsets[:-1]]
        return out

    def _stretches(self, root: int, begin: np.ndarray, stop: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases start if each stretch starts one, and the state at the end of each stretch."""
        order = np.argsort(begin - stop, kind="stable")  # longest first
        at, length = begin[order], (stop - begin)[order]
        alive = np.searchsorted(-length, -np.arange(STRETCH))  # stretches longer than each step
        starts = np.zeros(len(symbol), bool)
        # state 0 has no way on: the next symbol starts a phrase there
        state = np.zeros(len(at), np.int64)
        restart = self.table[root * self.width : (root + 1) * self.width].astype(np.int64)
        for step, live in enumerate(alive.tolist()):
            if not live:
                break
            place = at[:live] + step
            c = symbol[place]
            on = self.table[state[:live] * self.width + c].astype(np.int64)
            dead = on == 0
            starts[place] = dead
            state[:live] = np.where(dead, restart[c], on)
        out = np.empty(len(at), np.int64)
        out[order] = state
        return starts, out

    def _join(self, root: int, begin: np.ndarray, stop: np.ndarray, todo: np.ndarray, symbol: np.ndarray, starts: np.ndarray, state: np.ndarray) -> None:
        """Enter stretches with the open phrase of their predecessor, in place, until no end changes."""
        restart = self.table[root * self.width : (root + 1) * self.width].astype(np.int64)
        inner = np.zeros(len(begin) + 1, bool)
        inner[todo] = True
        while len(todo):
            lane, place, now = todo, begin[todo], state[todo - 1]
            changed = []
            while len(lane):
                c = symbol[place]
                on = self.table[now * self.width + c].astype(np.int64)
                dead = on == 0
                same = dead & starts[place]  # both parses start a phrase here
                starts[place] = dead
                now = np.where(dead, restart[c], on)
                place = place + 1
                over = place == stop[lane]
                ended = over & ~same
                if ended.any():
                    other = ended & (state[lane] != now)
                    state[lane[ended]] = now[ended]
                    changed.append(lane[other])
                going = ~(same | over)
                lane, place, now = lane[going], place[going], now[going]
            todo = np.sort(np.concatenate([np.zeros(0, np.int64), *changed])) + 1
            todo = todo[inner[todo]]


_parsers: dict[tuple, Parser] = {}


def _parser(samples: dict[str, bytes]) -> Parser:
    key = tuple(sorted(samples.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(samples)
    return _parsers[key]


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def identify(column: pa.Array, samples: dict[str, bytes]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    offsets, data = _text.column_bytes(column)
    n = len(offsets) - 1
    parser = _parser(samples)
    ascii_letter = np.zeros(len(data) + 1, np.int64)
    low = _text.LOWER[data]
    np.cumsum((low >= 97) & (low <= 122), out=ascii_letter[1:])
    lettered = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for t in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
        lettered[t] = _has_letter(data[offsets[t] : offsets[t + 1]].tobytes())
    if not parser.languages:
        return ["und"] * n, np.zeros(n)
    new_offsets_data = symbols(offsets, data)
    bits = np.maximum(parser.phrases(new_offsets_data[1], new_offsets_data[0]), 1) * parser.cost[:, None]
    weight = (bits.min(0) / bits) ** SHARPNESS
    best = bits.argmin(0)  # the first of equal ones
    score = weight[best, np.arange(n)] / weight.sum(0)
    return [parser.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Sample text of each language from the rows that are not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_spark.held_out(F.col("doc_id"), 5, 0))
    rows = rows.select("lang", F.coalesce(F.xxhash64("doc_id", F.lit(5)), F.lit(0)).alias("rank"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[int, str]]] = {}
        for batch in batches:
            ranks, langs = batch.column(1).to_numpy(), batch.column(0).to_pylist()
            for i in np.argsort(ranks, kind="stable"):
                own = best.setdefault(langs[i], [])
                if len(own) < SAMPLE_DOCS or ranks[i] < own[-1][0]:
                    own.append((int(ranks[i]), batch.column(2)[int(i)].as_py()[:SAMPLE_BYTES]))
                    own.sort()
                    del own[SAMPLE_DOCS:]
        out = [(lang, rank, text) for lang, own in best.items() for rank, text in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["lang", "rank", "text"])

    few = rows.mapInArrow(run, "lang string, rank long, text string")

    def join(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        chosen = sorted(zip(group.column("rank").to_pylist(), group.column("text").to_pylist(), strict=True))[:SAMPLE_DOCS]
        share = max(1, SAMPLE_BYTES // len(chosen))
        joined = " ".join(t[:share] for _, t in chosen)
        return pa.table({"lang": [key[0].as_py()], "text": [joined]})

    # one bounded row for each language
    return {r["lang"]: r["text"].encode()[: 2 * SAMPLE_BYTES] for r in few.groupBy("lang").applyInArrow(join, "lang string, text string").collect()}


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    samples = learn(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text", SLICE):
                lang, score = identify(part.column(1), samples)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", _spark.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, text_col: str = "text", **columns: str) -> DataFrame:
    """``docs``, all columns, without the rows that have no language (``und``)."""
    samples = learn(docs, text_col=text_col, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, text_col, SLICE):
                lang, _ = identify(part.column(part.schema.get_field_index(text_col)), samples)
                yield part.filter(pa.array([x != "und" for x in lang], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
