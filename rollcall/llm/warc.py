"""WARC: reading, writing, and the reassembly of segmented records.

A record that was cut has a first segment (its own WARC-Type, segment number 1)
and ``continuation`` records that name it by WARC-Segment-Origin-ID; the last
one carries WARC-Segment-Total-Length. Segments are grouped by origin, ordered
by number, joined and checked against the total length; of an HTTP response the
header is taken off and chunked transfer framing is decoded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.session import ship

SCHEMA = "record_id string, warc_type string, target_uri string, origin_id string, segment_number int, total_length long, block binary"
_CRLF = b"\r\n"
_GZIP = b"\x1f\x8b\x08"
#: Bytes that are given to the decompressor at once.
STEP = 1 << 16
_HEX = re.compile(rb"[0-9A-Fa-f]+")


# --- The format -----------------------------------------------------------


def format_record(record_id: str, warc_type: str, block: bytes, target_uri: str | None = None, origin_id: str | None = None, segment_number: int | None = None, total_length: int | None = None) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + warc_type.encode(), b"WARC-Record-ID: <" + record_id.encode() + b">"]
    if target_uri is not None:
        head.append(b"WARC-Target-URI: " + target_uri.encode())
    if segment_number is not None:
        head.append(b"WARC-Segment-Number: %d" % segment_number)
    if origin_id is not None:
        head.append(b"WARC-Segment-Origin-ID: <" + origin_id.encode() + b">")
    if total_length is not None:
        head.append(b"WARC-Segment-Total-Length: %d" % total_length)
    head.append(b"Content-Length: %d" % len(block))
    return _CRLF.join(head) + _CRLF * 2 + block + _CRLF * 2


def _members(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """The records' bytes, and whether they are whole: gzip members one by one,
    or all of a plain file. After a damaged member, the next one that can be
    found is tried. Each byte is read once."""
    if data[:2] != _GZIP[:2]:
        yield data, True
        return
    view, at = memoryview(data), 0
    while at < len(data):
        z, pos, out = zlib.decompressobj(31), at, []
        try:
            while not z.eof and pos < len(data):
                out.append(z.decompress(view[pos : pos + STEP]))
                pos += min(STEP, len(data) - pos)
            good = z.eof
            if good:
                pos -= len(z.unused_data)
        except zlib.error:
            good, pos = False, data.find(_GZIP, at + 1)
        yield b"".join(out), good
        if not good and pos == len(data):
            return
        # Members may be padded.
        at = pos if data[pos : pos + 3] == _GZIP else data.find(_GZIP, pos)
        if pos < 0 or at < 0:
            return


def _whole(x: str | None) -> int | None:
    return int(x) if x is not None and x.isdigit() else None


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of a file, plain or gzipped by record. A record whose block ends
    before its Content-Length is ``truncated``; what can't be read of a damaged
    member is skipped."""
    for part, _ in _members(data):
        at = 0
        while (at := part.find(b"WARC/", at)) >= 0:
            end = part.find(_CRLF * 2, at)
            if end < 0:
                break
            fields: dict[str, str] = {}
            for line in part[at:end].split(_CRLF)[1:]:
                name, _, value = line.partition(b":")
                fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
            length = _whole(fields.get("content-length"))
            if length is None:
                at = end
                continue
            block = part[end + 4 : end + 4 + length]
            bare = lambda k, f=fields: f[k].strip("<>") if k in f else None
            yield {
                "record_id": bare("warc-record-id"), "warc_type": fields.get("warc-type"), "target_uri": bare("warc-target-uri"), "origin_id": bare("warc-segment-origin-id"),
                "segment_number": _whole(fields.get("warc-segment-number")), "total_length": _whole(fields.get("warc-segment-total-length")), "block": block, "truncated": len(block) < length,
            }
            at = end + 4 + length


def read_warc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of WARC files as rows of ``SCHEMA`` and ``truncated``; a task
    reads a file, which must be under 2 GB, as crawlers' files are."""
    ship(spark)
    schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("origin_id", pa.string()), ("segment_number", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary()), ("truncated", pa.bool_())])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse_records(content.as_py()):
                    rows.append(r)
                    size += len(r["block"])
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, SCHEMA + ", truncated boolean")


# --- HTTP -------------------------------------------------------------------


def encode_chunks(body: bytes, size: int) -> bytes:
    out = []
    for i in range(0, len(body), size):
        c = body[i : i + size]
        out.append(b"%x\r\n%b\r\n" % (len(c), c))
    return b"".join(out) + b"0\r\n\r\n"


def decode_chunks(data: bytes) -> bytes | None:
    """The body of chunked framing (extensions and trailers are skipped); None
    if the framing is broken or doesn't end."""
    out, at = [], 0
    while True:
        end = data.find(_CRLF, at)
        if end < 0:
            return None
        size = data[at:end].split(b";", 1)[0].strip()
        if not _HEX.fullmatch(size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        at = end + 2
        if data[at + n : at + n + 2] != _CRLF:
            return None
        out.append(data[at : at + n])
        at += n + 2


def http_body(message: bytes) -> tuple[bytes | None, str]:
    """Body and status (``complete``, ``bad header``, ``bad chunk``,
    ``truncated``: shorter than its Content-Length)."""
    end = message.find(_CRLF * 2)
    if end < 0 or not message.startswith(b"HTTP/"):
        return None, "bad header"
    body = message[end + 4 :]
    fields = {}
    for line in message[:end].split(_CRLF)[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    if fields.get(b"transfer-encoding", b"").lower().rsplit(b",", 1)[-1].strip() == b"chunked":
        body = decode_chunks(body)
        return body, "complete" if body is not None else "bad chunk"
    length = fields.get(b"content-length", b"")
    if length.isdigit() and len(body) < int(length):
        return None, "truncated"
    return body, "complete"


# --- Reassembly -------------------------------------------------------------


def join_segments(parts: Iterable[dict]) -> tuple[bytes | None, int, str]:
    """The joined block, the number of segments, and the status. Segments that
    repeat another byte for byte count once."""
    by: dict[int, dict] = {}
    for p in parts:
        n = p["n"] if p["n"] is not None else 1
        if n in by and by[n]["block"] != p["block"]:
            return None, len(by), "conflicting segments"
        if n not in by or by[n]["total"] is None:
            by[n] = p
    if any(p.get("truncated") for p in by.values()):
        return None, len(by), "truncated"
    if not by or sorted(by) != list(range(1, len(by) + 1)):
        return None, len(by), "missing segment"
    block = b"".join(by[n]["block"] or b"" for n in sorted(by))
    total = by[len(by)]["total"]
    if len(by) > 1 and total is None:
        return None, len(by), "missing segment"
    if total is not None and total != len(block):
        return None, len(by), "length mismatch"
    return block, len(by), "complete"


def reassemble(records: DataFrame) -> DataFrame:
    """(record_id, target_uri, n_segments, status, body): a row per record.

    ``record_id`` is the origin's. The status is ``complete``, ``missing
    segment`` (a gap, or no segment that carries the total length),
    ``conflicting segments`` (one number, two contents), ``length mismatch``,
    ``truncated`` (a block shorter than its length says), ``bad header`` or ``bad
    chunk``; where it isn't ``complete`` the body is
    null. ``response`` records lose their HTTP header and framing, others keep
    their block. Rows with neither record_id nor origin_id are left out; a null
    block counts as an empty one; further columns are ignored, but for a boolean
    ``truncated``, as ``read_warc`` gives it. Segments are joined in memory, so a
    record must be under 2 GB. An empty table gives an empty result.
    """
    ship(records.sparkSession)
    r = records.select(
        F.coalesce("origin_id", "record_id").alias("id"), F.when(F.col("origin_id").isNull(), F.col("warc_type")).alias("kind"), F.when(F.col("origin_id").isNull(), F.col("target_uri")).alias("uri"),
        F.struct(F.col("segment_number").alias("n"), F.col("total_length").alias("total"), "block", (F.col("truncated") if "truncated" in records.columns else F.lit(False)).alias("truncated")).alias("part"),
    ).where("id is not null")
    whole = r.groupBy("id").agg(F.max("kind").alias("kind"), F.max("uri").alias("uri"), F.collect_list("part").alias("parts"))

    def run(batches):
        for batch in batches:
            counts, states, bodies = [], [], []
            for kind, parts in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                block, n, state = join_segments(parts.as_py())
                if block is not None and kind is None:
                    block, state = None, "missing segment"
                if block is not None and kind == "response":
                    block, state = http_body(block)
                counts.append(n)
                states.append(state)
                bodies.append(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int32()), pa.array(states, pa.string()), pa.array(bodies, pa.binary())], names=["record_id", "target_uri", "n_segments", "status", "body"])

    return whole.mapInArrow(run, "record_id string, target_uri string, n_segments int, status string, body binary")


def segmented(pages: DataFrame, segment_bytes: int = 4096, chunk_bytes: int = 1500) -> DataFrame:
    """``pages`` as WARC response records, as a crawler with small files would
    store them: bodies chunked (but for each third page), and cut into segments.
    Rows are of ``SCHEMA``; a null html is an empty body."""
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                body = (html or "").encode()
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if page is not None and page % 3 == 0:
                    message = head + b"Content-Length: %d\r\n\r\n" % len(body) + body
                else:
                    message = head + b"Transfer-Encoding: chunked\r\n\r\n" + encode_chunks(body, chunk_bytes)
                name = f"urn:page:{page}"
                n = max(1, -(-len(message) // segment_bytes))
                for i in range(n):
                    first = i == 0
                    row = (name if first else f"{name}:{i + 1}", "response" if first else "continuation", url if first else None, None if first else name, i + 1 if n > 1 else None, len(message) if n > 1 and i == n - 1 else None, message[i * segment_bytes : (i + 1) * segment_bytes])
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, SCHEMA)
