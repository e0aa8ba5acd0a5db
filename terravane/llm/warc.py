"""WARC writing and reading with segment reassembly.

Writing: rows with equal payloads of at least ``MIN_REVISIT`` bytes share one
``response`` record; the others are ``revisit`` records that refer to it.  The
payload stands in chunked transfer framing; a block longer than the segment size
is continued in ``continuation`` records (WARC-Segment-Number, -Origin-ID and
-Total-Length as in WARC 1.1).  Pages are not shuffled unless very many digests
occur twice; then each page goes by its digest, and those of the frequent digests
and of short payloads, which need no partner, by a spread key.

Reading: archives are read once, as binary files of bounded size, and cut into
records by their lengths.  A record in one piece is finished there; only segments
are grouped by origin identifier and ordered by segment number.  The total length
is verified before the framing is decoded.  A record that is cut off, that lacks a
segment or has one twice, or whose digest differs raises an error.

A null payload counts as empty, a null url as an empty one.  A row with a null id
has a record of its own and comes back with a null id; it revisits the response of
an equal payload with an id, and is a response if there is none.  Repeated page ids
and repeated rows are each written and read back.  Rows with the smallest id of a
payload are responses, also if there are several.  A payload of any length is cut
into segments.  An empty table gives an empty archive and no rows.  Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import _spark, _text

MIN_REVISIT, SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 100, 16 << 10, 4096, 512
#: a digest of more than one row in ``HOT`` is frequent, so that fewer than ``HOT`` are
HOT = 8192
#: rows of (digest, id) that are given to every task, some 100 bytes each
BROADCAST_DIGESTS = 1 << 18
_HEAD = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.S)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; chunks end at character boundaries."""
    out, at = [], 0
    while at < len(payload):
        stop = min(at + size, len(payload))
        while stop < len(payload) and payload[stop] & 0xC0 == 0x80:
            stop += 1
        out.append(b"%x\r\n%b\r\n" % (stop - at, payload[at:stop]))
        at = stop
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(block: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = block.index(b"\r\n", at)
        size = int(block[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if block[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(block[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def records_of(page_id: int | None, copy: int, url: str, payload: bytes, digest: str, original: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a response, in segments if long, or a revisit."""
    name = f"<urn:page:{'null' if page_id is None else page_id}:{digest[:32]}:{copy}>"
    same = [("WARC-Target-URI", re.sub(r"\s", "%20", url)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if original is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *same, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{original}:{digest[:32]}:0>"), ("X-Payload-Length", str(len(payload)))], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = [0]
    while cuts[-1] < len(block):
        stop = min(cuts[-1] + segment_bytes, len(block))
        while stop < len(block) and block[stop] & 0xC0 == 0x80:
            stop += 1
        cuts.append(stop)
    if len(cuts) == 2:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name), *same], block)
        return
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
        fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", name if k == 1 else f"{name[:-1]}:{k}>"), *same, ("WARC-Segment-Number", str(k))]
        fields += [("WARC-Segment-Origin-ID", name)] * (k > 1) + [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(cuts) - 1)
        yield _record(fields, block[a:b])


def _numbered(rows: DataFrame) -> DataFrame:
    """``copy``: 0 for one row of each id and payload, another number for each further one."""
    rows = _spark.materialise(rows.withColumn("serial", F.monotonically_increasing_id()))
    zero = rows.groupBy("page_id", "digest").agg(F.min("serial").alias("serial")).select("serial", F.lit(0).cast("long").alias("copy"))
    return rows.join(zero, "serial", "left").withColumn("copy", F.coalesce("copy", F.col("serial") + 1)).drop("serial")


def _with_first(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``first``: the smallest id of an equal payload, where a payload of ``MIN_REVISIT`` bytes occurs twice."""
    total = keys.count()
    same = keys.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = _spark.materialise(same)
    if same.count() <= BROADCAST_DIGESTS:
        return rows.join(F.broadcast(same.drop("n")), "digest", "left")
    hot = same.filter(F.col("n") * HOT > total).select("digest", F.col("first").alias("hot_first"))  # fewer than HOT rows
    rows = rows.join(F.broadcast(hot), "digest", "left")
    alone = (F.col("size") < MIN_REVISIT) | F.col("hot_first").isNotNull()
    spread = F.xxhash64("page_id", "url", F.monotonically_increasing_id()).cast("string")  # never equal to a digest
    rows = rows.withColumn("key", F.when(alone, spread).otherwise(F.col("digest")))
    cold = same.filter(F.col("n") * HOT <= total).select(F.col("digest").alias("key"), F.col("first").alias("cold_first"))
    return rows.join(cold, "key", "left").withColumn("first", F.coalesce("hot_first", "cold_first"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write one archive folder; files are gzipped WARC 1.1."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "size": F.octet_length("html")})
    keys = _spark.materialise(rows.select("page_id", "digest", "size"))
    if keys.groupBy("page_id", "digest").count().filter("count > 1").limit(1).count():
        rows = _numbered(rows)
    else:
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    rows = _with_first(rows, keys).select("page_id", "url", "html", "digest", "copy", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "html", 1 << 20):
                out = []
                for page, url, payload, digest, copy, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    original = first if first is not None and first != page else None
                    # the writer ends each record with its last line feed
                    out += [r.decode()[:-1] for r in records_of(page, copy, url, payload.encode(), digest, original, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows.mapInArrow(run, "value string").write.mode("overwrite").option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    at = 0
    while at < len(archive):
        head = _HEAD.match(archive, at)
        if head is None:
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in head[1].decode().split("\r\n"))
        size = int(fields["Content-Length"])
        block = archive[head.end() : head.end() + size]
        at = head.end() + size + 4
        if archive[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"record {fields['WARC-Record-ID']} is cut off")
        yield fields, block


def _page(name: str) -> int | None:
    """The page id in a record's name."""
    page = name.split(":")[2]
    return None if page == "null" else int(page)


def assembled(origin: str, digest: str, parts: list[tuple[int, str | None, bytes]]) -> bytes:
    """Payload of a record from (segment number, total length, block); one whole record has the number 0."""
    numbers = [p[0] for p in parts]
    block = b"".join(p[2] for p in parts)
    if numbers != [0] and (numbers != list(range(1, len(parts) + 1)) or parts[-1][1] != str(len(block))):
        raise ValueError(f"record {origin} is not complete")
    payload = unchunked(block[block.index(b"\r\n\r\n") + 4 :])
    if f"sha256:{hashlib.sha256(payload).hexdigest()}" != digest:
        raise ValueError(f"record {origin} has another digest")
    return payload


_RESULT = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
_SEGMENT = {"origin": pa.string(), "segment": pa.int64(), "total": pa.string(), "digest": pa.string(), "block": pa.binary()}


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each page in the archives.

    Columns: ``page_id``, ``record_type``, ``refers_to``, ``payload`` (binary;
    null for revisits, and everywhere unless ``payloads``), ``payload_bytes``,
    ``payload_digest`` (recomputed for responses and held against the header).
    """
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")

    def response(origin: str, digest: str, parts: list[tuple[int, str | None, bytes]]) -> tuple:
        payload = assembled(origin, digest, parts)
        return _page(origin), "response", None, payload if payloads else None, len(payload), digest.split(":")[1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, nothing = _RESULT | _SEGMENT, (None,) * len(_SEGMENT)
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for f, block in parse(gzip.decompress(content.as_py())):
                    name, digest = f["WARC-Record-ID"], f["WARC-Payload-Digest"]
                    if f["WARC-Type"] == "revisit":
                        out.append((_page(name), "revisit", _page(f["WARC-Refers-To"]), None, int(f["X-Payload-Length"]), digest.split(":")[1], *nothing))
                    elif "WARC-Segment-Number" not in f:
                        out.append((*response(name, digest, [(0, None, block)]), *nothing))
                    else:
                        out.append((*(None,) * len(_RESULT), f.get("WARC-Segment-Origin-ID", name), int(f["WARC-Segment-Number"]), f.get("WARC-Segment-Total-Length"), digest, block))
                    size += len(block)
                    if size > 1 << 20:
                        yield _batch(out, kinds)
                        out, size = [], 0
                yield _batch(out, kinds)
            _text.give_back()

    result = "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    records = _spark.materialise(files.mapInArrow(cut, result + ", origin string, segment long, total string, digest string, block binary"))
    split = records.filter("origin is not null").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "total", "digest", "block"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a row is one record, of any length
                row = batch.slice(at, 1).to_pylist()[0]
                parts = row["parts"]
                yield _batch([response(row["origin"], parts[0]["digest"], [(p["segment"], p["total"], p["block"]) for p in parts])], _RESULT)
            _text.give_back()

    return records.filter("origin is null").select(*_RESULT).union(split.mapInArrow(join, result))


def round_trip(pages: DataFrame, payloads: bool = True, **columns: str) -> DataFrame:
    """Write all pages to a fresh archive in the shared folder and read it back."""
    spark = pages.sparkSession
    path = _spark.fresh_path(spark, "warc")
    write_warc(pages, path, **columns)
    return read_warc(spark, path, payloads)
