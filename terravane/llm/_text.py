"""Vectorised text kernels shared by the corpus operators.

Every kernel works on the UTF-8 bytes of an Arrow string column, so the cost of
Python is paid per batch and not per word.  Tokens are maximal runs of bytes
other than ``\\x20`` and ``\\x09-\\x0D``; a token is named by a 64-bit hash.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: bytes hashed at a time; bounds the scratch arrays whatever the text's length
WINDOW = 1 << 20
#: bytes of text handed to a kernel at a time (a single longer text goes alone)
SLICE_BYTES = 4 << 20

_BYTE_RANDOM = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = np.random.default_rng(0xBEEF).integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[str, np.ndarray] = {}
try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        table = np.full(max(n, WINDOW), U64(base))
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= WINDOW:
            _powers[name] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def give_back() -> None:
    """Return freed memory to the system: idle workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold at most ``limit`` bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    offsets, _ = column_bytes(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word (n + 1) of each text."""
    solid = ~SPACE[data]
    n = len(solid)
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from prefix sums of one polynomial."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + WINDOW, "right")))
        part = data[base : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_RANDOM[part] * _power_table("up", _BASE, len(part)), out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * _power_table("down", _BASE_INVERSE, len(part))[a]
        i = j
    return mix(out)


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text, and the first word (n + 1) of each text."""
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(offsets, data)
    return span_hashes(data, starts, ends), first


def word_hash(word: bytes) -> int:
    """The hash that :func:`words` gives to one lower-case word."""
    data = np.frombuffer(word, np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def grams(hashes: np.ndarray, first: np.ndarray, n: int, whole_if_shorter: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``n`` words, and the first window of each text.

    A text of 1 to n - 1 words gives its whole sequence as one window if
    ``whole_if_shorter``; a text without words gives none.
    """
    count = np.diff(first)
    per_text = np.maximum(count - n + 1, 0)
    if len(hashes) >= n:
        length = len(hashes) - n + 1
        sums = hashes[:length] * _GRAM[0]
        for k in range(1, n):
            sums += hashes[k : k + length] * _GRAM[k]
        sums = mix(sums)
    else:
        sums = np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < n)) if whole_if_shorter else np.zeros(0, np.int64)
    per_text[short] = 1
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(per_text, out=out_first[1:])
    at = np.repeat(first[:-1] - out_first[:-1], per_text) + np.arange(out_first[-1])
    if len(short):
        out = np.empty(out_first[-1], np.uint64)
        is_short = np.zeros(len(count), bool)
        is_short[short] = True
        plain = ~np.repeat(is_short, per_text)
        out[plain] = sums[at[plain]]
        for t in short:
            w = hashes[first[t] : first[t + 1]]
            with np.errstate(over="ignore"):
                out[out_first[t]] = mix(np.array([(w * _GRAM[: len(w)]).sum() ^ _GRAM[40 + len(w)]], np.uint64))[0]
        return out, out_first
    return sums[at], out_first


def distinct_per_text(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and the first value of each text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(np.bincount(text[keep], minlength=len(first) - 1), out=out_first[1:])
    return values[keep], out_first


class HashTable:
    """Maps 64-bit hashes to small integers: open addressing, vectorised."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2 + 1))))
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.used = np.zeros(1 << bits, bool)
        self.values = np.full(1 << bits, -1, np.int64)
        self.longest = 0
        slot = (keys >> self.shift).astype(np.int64)
        todo = np.arange(len(keys))
        step = 0
        while len(todo):
            at = (slot[todo] + step) & self.mask
            free = ~self.used[at]
            at, who = at[free], todo[free]
            at, winner = np.unique(at, return_index=True)
            who = who[winner]
            self.keys[at], self.values[at], self.used[at] = keys[who], values[who], True
            placed = np.zeros(len(keys), bool)
            placed[who] = True
            todo = todo[~placed[todo]]
            step += 1
        self.longest = step

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = (keys >> self.shift).astype(np.int64)
        out = np.where(self.used[slot] & (self.keys[slot] == keys), self.values[slot], -1)
        todo = np.flatnonzero((out < 0) & self.used[slot])
        for step in range(1, self.longest):
            if not len(todo):
                break
            at = (slot[todo] + step) & self.mask
            used = self.used[at]
            hit = used & (self.keys[at] == keys[todo])
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[used & ~hit]
        return out
