"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over 32 bytes cuts each text where the content says so, so equal
passages in different documents give equal chunks.  A worker encodes each chunk
once, as long as its bounded store holds it, and documents are put together from
stored chunks.  "Once" holds for each worker: ids shared between workers would have
to be shuffled, and they are larger than the texts.

A cut may split a pre-token, so each join is repaired: the stretch from the last
place before the cut where the left chunk ends a token to the first place behind it
where the right one does is encoded again, with a margin on both sides.  If the ids
in the margins are those of the chunks, the repair is exact; if not, the stretch is
widened to twice as many places, until they agree or the whole text is encoded.
The result equals that of encoding the whole text.

Nulls and empty texts give no ids.  Special tokens of the vocabulary file are
recognised in the text, as the tokenizers library does by default.  Texts of any
length are encoded whole.  Repeated rows give repeated results, a null id stays
null, and an empty table gives no rows; other columns are left out, whatever their
names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terravane.llm import _text

_ROLL = np.random.default_rng(77).integers(1, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True


def load_vocabulary(path: str) -> dict:
    """Token bytes by id, and special tokens, of a byte-level BPE JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain}
    alphabet |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = spec["model"]["merges"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    ids = [spec["model"]["vocab"][m] for m in merged]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        raise ValueError("ids must rise with the order of merges")
    return {"tokens": tokens, "special": special}


class Chunk:
    """Ids of a chunk, and the places in it where it can be joined.

    A place lies between a graphic ASCII character and a blank, where a token of
    the chunk ends; ``index`` tells how many ids lie before each.
    """

    __slots__ = ("ids", "index", "nbytes", "places")

    def __init__(self, data: bytes, ids: np.ndarray, lengths: np.ndarray):
        view, ends = np.frombuffer(data, np.uint8), np.cumsum(lengths[ids])
        places = np.flatnonzero(_GRAPHIC[view[:-1]] & _GAP[view[1:]]) + 1
        at = np.searchsorted(ends, places)
        good = ends[np.minimum(at, len(ends) - 1)] == places
        # the first and the last ones are all that a join needs, unless it is widened
        self.ids, self.places, self.index = ids, places[good].astype(np.int32), (at[good] + 1).astype(np.int32)
        self.nbytes = ids.nbytes + self.places.nbytes + self.index.nbytes


class Codec:
    """Encoder and decoder of one worker."""

    #: pre-token pattern of byte-level BPE (fixed value of the format)
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, vocabulary: dict, chunk_bits: int = 10, min_chunk: int = 256, store_bytes: int = 24 << 20):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=vocabulary["tokens"], special_tokens={})
        self.special = {k.encode(): v for k, v in vocabulary["special"].items()}
        top = max([*vocabulary["tokens"].values(), *vocabulary["special"].values()]) + 1
        self.token_bytes = [b""] * top
        for t, i in vocabulary["tokens"].items():
            self.token_bytes[i] = t
        for t, i in self.special.items():
            self.token_bytes[i] = t
        self.lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self.chunk_shift, self.min_chunk, self.store_bytes = np.uint32(32 - chunk_bits), min_chunk, store_bytes
        self.young: dict[bytes, Chunk] = {}
        self.old: dict[bytes, Chunk] = {}
        self.young_bytes = 0
        self.seams: dict[bytes, np.ndarray] = {}
        self.encoded = self.reused = self.widened = 0

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places where the rolling hash of the last 32 bytes ends a chunk."""
        h = _ROLL[data]
        factor, width = 0x01000193, 1
        while width < 32:
            h[width:] = h[width:] + h[:-width] * np.uint32(factor)
            factor, width = factor * factor % 2**32, width * 2
        at = np.flatnonzero((h >> self.chunk_shift) == 0) + 1
        at = at[at < len(data)]
        return at[(data[at] & 0xC0) != 0x80]

    def plain(self, data: bytes) -> np.ndarray:
        return self.encoding.encode_to_numpy(data.decode("utf-8"), disallowed_special=())

    def chunk(self, data: bytes) -> Chunk:
        found = self.young.get(data)
        if found is not None:
            self.reused += 1
            return found
        found = self.old.get(data)
        if found is None:
            found = Chunk(data, self.plain(data), self.lengths)
            self.encoded += 1
        else:
            self.reused += 1
        if len(data) <= 1 << 16:
            self.young[data] = found
            self.young_bytes += len(data) + found.nbytes + 600
            if self.young_bytes > self.store_bytes:
                self.old, self.young, self.young_bytes = self.young, {}, 0
        return found

    def seam(self, data: bytes) -> np.ndarray:
        found = self.seams.get(data)
        if found is None:
            if len(self.seams) > 100_000:
                self.seams = {}
            found = self.plain(data)
            if len(data) <= 128:
                self.seams[data] = found
        return found

    def encode(self, data: bytes) -> np.ndarray:
        """Ids of a whole text."""
        for token, i in self.special.items():
            if token in data:
                parts = []
                for k, part in enumerate(data.split(token)):
                    parts += [np.array([i], np.uint32)] * (k > 0) + [self.encode(part)]
                return np.concatenate(parts)
        if not data:
            return np.zeros(0, np.uint32)
        view = np.frombuffer(data, np.uint8)
        edges, last = [0], 0
        for p in self.cuts(view).tolist():
            if p - last >= self.min_chunk:
                edges.append(p)
                last = p
        edges.append(len(view))
        out: list[np.ndarray] = []
        left: tuple[int, Chunk] | None = None  # the last chunk with a place, whose ids are out as far as its last place
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            chunk = self.chunk(data[s:e])
            if s == 0 and e == len(view):
                return chunk.ids
            if s == 0:
                if len(chunk.places):
                    out.append(chunk.ids[: chunk.index[-1]])
                    left = 0, chunk
                continue
            if not len(chunk.places) and e < len(view):
                continue  # the next chunk's place ends the stretch
            seam = self.join(data, left, s, chunk)
            if seam is None:
                return self.plain(data)
            out.append(seam)
            if len(chunk.places):
                out.append(chunk.ids[chunk.index[0] : None if e == len(view) else chunk.index[-1]])
            left = s, chunk
        return np.concatenate(out)

    def join(self, data: bytes, left: tuple[int, Chunk] | None, s: int, right: Chunk) -> np.ndarray | None:
        """Ids between the left chunk's last place and the right one's first; none if the ids beside them never agree.

        Without a place, the stretch goes from the text's start, or to its end.
        """
        margin = 1
        while True:
            # ids of the chunks in the margins
            before = after = np.zeros(0, np.uint32)
            a, b = 0, len(data)
            if left is not None:
                places, index = left[1].places, left[1].index
                k = max(0, len(places) - 1 - margin)
                a, before = left[0] + int(places[k]), left[1].ids[index[k] : index[-1]]
            if len(right.places):
                k = min(margin, len(right.places) - 1)
                b, after = s + int(right.places[k]), right.ids[right.index[0] : right.index[k]]
            ids = self.seam(data[a:b])
            if len(ids) >= len(before) + len(after) and (ids[: len(before)] == before).all() and (ids[len(ids) - len(after) :] == after).all():
                return ids[len(before) : len(ids) - len(after)]
            self.widened += 1
            if margin >= max(len(left[1].places) if left else 0, len(right.places)):
                return None
            margin *= 2

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[tuple, Codec] = {}


def _codec(key: tuple, broadcast, **options) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(broadcast.value, **options)
    return _codecs[key]


def _prepared(df: DataFrame, tokenizer_path: str, options: dict):
    broadcast = df.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_path))  # one file of a few MB
    return broadcast, (tokenizer_path, df.sparkSession.sparkContext.applicationId, tuple(sorted(options.items())))


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``token_ids`` (array of int) of each row."""
    broadcast, key = _prepared(df, tokenizer_path, options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, broadcast, **options)
        for batch in batches:
            for part in _text.slices(batch, "text"):
                ids = [codec.encode((t or "").encode()) for t in part.column(1).to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n_tokens", "token_ids"])

    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>")


def decode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "token_ids", **options) -> DataFrame:
    """``doc_id`` and ``text`` from an array of ids; a null array gives an empty text."""
    broadcast, key = _prepared(df, tokenizer_path, options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, broadcast, **options)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [codec.decode(np.asarray(x if x is not None else [], np.int64)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{ids_col}` as token_ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Encode and decode each row in one pass; return the digests of both.

    Columns: ``doc_id``, ``n_tokens``, ``ids_sha256`` (ids as little-endian
    unsigned 32-bit integers), ``decoded_sha256`` (decoded text in UTF-8).
    """
    broadcast, key = _prepared(df, tokenizer_path, options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, broadcast, **options)
        for batch in batches:
            for part in _text.slices(batch, "text"):
                sizes, of_ids, of_text = [], [], []
                for t in part.column(1):
                    ids = codec.encode((t.as_py() or "").encode())
                    sizes.append(len(ids))
                    of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
