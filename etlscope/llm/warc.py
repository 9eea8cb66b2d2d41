"""WARC archives of pages: writing with segmentation and revisits, reading with segment reassembly.

Writing: every page becomes a record whose block is an HTTP response with chunked transfer framing.  Blocks longer
than ``SEGMENT_BYTES`` are cut into a first record and continuation records.  Of pages with equal payloads of
``REVISIT_BYTES`` or more, that with the largest page_id is the response and the others are revisit records without a
payload, which name the response in WARC-Refers-To.  Each task begins with a warcinfo record.  Compressed files hold one gzip
member a record.  Files come from Spark's line writer, whose separator is the end of a record (its blank line, or the last byte
of its gzip member, which is zero for members below 16 MB), so they go to any store Spark writes to, under its commit protocol.

Reading: records have ``SEGMENT_BYTES`` at most, so a limit of records bounds a file by ``FILE_BYTES``; it is read whole and
inflated record by record.  Records are cut out by Content-Length, continuation records are grouped by their origin id, ordered
by segment number and checked against the total length, and the chunked framing is decoded.  Only segmented records are shuffled.

Edge cases: null html is an empty payload; null page_ids and urls are left out of the headers and read back as null;
repeated rows are records of their own, and equal page_ids that tie for the largest are all responses (and share the record id that others name); a null page_id
is never the larger one; control characters in urls are percent-encoded; an empty table gives an empty result.  A record
whose segments or digest do not fit comes back with ``intact`` false, and with null figures where it has no payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import new_folder

SEGMENT_BYTES, CHUNK_BYTES, REVISIT_BYTES = 1 << 16, 1 << 14, 1000
FILE_BYTES = 256 << 20  # of a file before compression
HEAD_BYTES = 4 << 10  # allowed for the headers of a record
FLUSH_BYTES = 4 << 20
CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


# --- records -----------------------------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of chunked framing; None if the framing is broken.  Extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != CRLF:
            return None
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block, its transfer framing removed."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def _safe(url: str | None) -> str | None:
    return url and "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _new_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def _page_record_id(page_id, digest: str) -> str:
    """The record id of a response that others refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def info_record(date: str) -> bytes:
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _new_id()), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: etlscope\r\nformat: WARC File Format 1.1\r\n")


def page_records(page_id, url, html: str, digest: str, refers_to, date: str, segment_bytes: int, named: bool = False) -> Iterator[bytes]:
    """The records of one page; without the blank line that ends each.  ``named``: others refer to it."""
    payload = html.encode("utf-8", "surrogatepass")
    name = base64.b32encode(bytes.fromhex(digest)).decode()
    page = None if page_id is None else str(page_id)
    common = [("WARC-Date", date), ("WARC-Target-URI", _safe(url)), ("WARC-Payload-Digest", f"sha1:{name}"), ("WARC-Page-ID", page)]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        extra = [("WARC-Profile", profile), ("WARC-Refers-To", _page_record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to)), ("WARC-Payload-Length", str(len(payload)))]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _new_id()), *common, *extra], b"")
        return
    block, own = HTTP + chunked(payload), _page_record_id(page_id, digest) if named else _new_id()
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, kind], block)
        return
    cuts = list(range(0, len(block), segment_bytes))
    for number, at in enumerate(cuts, 1):
        part = block[at : at + segment_bytes]
        segment = [("WARC-Segment-Number", str(number))]
        if number == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, kind, *segment], part)
        else:
            last = [("WARC-Segment-Total-Length", str(len(block)))] if at == cuts[-1] else []
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _new_id()), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own), *segment, *last], part)


def records_of(content: memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers by lower-case name, block) of each record of a file."""
    raw, at = content if isinstance(content, bytes) else bytes(content), 0
    while at < len(raw):
        if not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = raw.index(b"\r\n\r\n", at)
        fields = {}
        for line in raw[at:end].split(CRLF)[1:]:
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, memoryview(raw)[start:stop]
        at = stop + 4


def member(record: bytes) -> bytes:
    """A gzip member of one record, without its last byte, which is zero."""
    if len(record) >= 1 << 24:
        raise ValueError("records of 16 MB and more cannot be written compressed")
    return gzip.compress(record + CRLF + CRLF, 6, mtime=0)[:-1]


def members(content: memoryview, step: int = 1 << 14) -> Iterator[bytes]:
    """The inflated members of a gzip file, one at a time; a file without compression is one."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield bytes(content)
        return
    at = 0
    while at < len(content):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(content):
                raise ValueError("a gzip member is cut off")
            out.append(inflate.decompress(content[at : at + step]))
            at += min(step, len(content) - at)
        at -= len(inflate.unused_data)
        yield b"".join(out)


# --- archives ----------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to, named); only short rows are aggregated, hot payloads after map-side maxima."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    own = pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    groups = own.where(F.col("n") >= least).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).where("copies > 1")
    joined = own.join(groups.select("d", "best"), own["digest"] == groups["d"], "left")
    refers = F.when(F.col("best").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("best"))) & (F.col("n") >= least), F.col("best"))
    named = F.coalesce((F.col("page_id") == F.col("best")) & (F.col("n") >= least), F.lit(False))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"), named.alias("named"))


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, date: str = "2024-01-01T00:00:00Z", compression: str = "none") -> None:
    """Write WARC files of ``pages(page_id, url, html)``; compression ``gzip`` or ``none``."""
    packed = member if compression == "gzip" else bytes

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([packed(info_record(date))], pa.binary())], ["record"])
        for batch in batches:
            out, size = [], 0
            for page_id, url, html, digest, refers, named in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for record in page_records(page_id, url, html, digest, refers, date, segment_bytes, named):
                    out.append(packed(record))
                    size += len(out[-1])
                if size >= FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = with_revisits(pages).mapInArrow(run, "record binary")
    writer = records.select(F.col("record").cast("string").alias("value")).write
    most = max(1, FILE_BYTES // (segment_bytes + HEAD_BYTES))
    writer.options(lineSep="\0" if compression == "gzip" else "\r\n\r\n", maxRecordsPerFile=most).text(folder)


_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, n_segments int, intact boolean"
_PAGE_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("n_segments", pa.int32()), ("intact", pa.bool_())])
_SEGMENT = "origin string, number int, total long, page_id long, digest string, block binary"
_SEGMENT_ARROW = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])


def _whole(value: str | None) -> int | None:
    return None if value is None else int(value)


def _hex(fields: dict[str, str]) -> str | None:
    value = fields.get("warc-payload-digest")
    return base64.b32decode(value.removeprefix("sha1:")).hex() if value else None


def _page_row(page_id, block: bytes | None, digest: str | None, n_segments: int) -> dict:
    payload = payload_of(block) if block is not None else None
    found = hashlib.sha1(payload).hexdigest() if payload is not None else None
    return {"page_id": page_id, "payload_bytes": None if payload is None else len(payload), "payload_digest": found, "record_type": "response", "refers_to": None, "n_segments": n_segments, "intact": found is not None and found == digest}


def reassemble(segments: list[dict]) -> list[dict]:
    """The page row of the records of one origin, in any order; one row for each first segment, as repeated pages share their origin."""
    by_number: dict[int, list[dict]] = {}
    for s in segments:
        by_number.setdefault(s["number"], []).append(s)
    parts = [by_number[n][0] for n in sorted(by_number)]
    block, copies = b"".join(s["block"] for s in parts), len(by_number.get(1, [0]))
    whole = sorted(by_number) == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
    whole = whole and all(len(x) == copies and all(s["block"] == x[0]["block"] for s in x) for x in by_number.values())
    return [_page_row(s["page_id"], block if whole else None, s["digest"], len(parts)) for s in by_number[min(by_number)]]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per archived page: page_id, payload_bytes, payload_digest, record_type, refers_to, n_segments, intact."""
    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                for part in members(memoryview(content.as_buffer())):
                    yield from ((f, b) for f, b in records_of(part) if f["warc-type"] != "warcinfo")

    def pages(batches):
        out = []
        for fields, block in records(batches):
            if fields["warc-type"] == "continuation" or "warc-segment-number" in fields:
                continue
            page_id = _whole(fields.get("warc-page-id"))
            if fields["warc-type"] == "revisit":
                out.append({"page_id": page_id, "payload_bytes": _whole(fields.get("warc-payload-length")), "payload_digest": _hex(fields), "record_type": "revisit", "refers_to": _whole(fields.get("warc-refers-to-page-id")), "n_segments": 1, "intact": True})
            else:
                out.append(_page_row(page_id, bytes(block), _hex(fields), 1))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, _PAGE_ARROW)
                out = []
        yield pa.RecordBatch.from_pylist(out, _PAGE_ARROW)

    def segments(batches):
        for fields, block in records(batches):
            if fields["warc-type"] == "continuation" or "warc-segment-number" in fields:
                row = {
                    "origin": fields.get("warc-segment-origin-id") or fields["warc-record-id"], "number": int(fields["warc-segment-number"]),
                    "total": _whole(fields.get("warc-segment-total-length")), "page_id": _whole(fields.get("warc-page-id")), "digest": _hex(fields), "block": bytes(block),
                }
                yield pa.RecordBatch.from_pylist([row], _SEGMENT_ARROW)

    def joined(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(reassemble(table.to_pylist()), _PAGE_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    long = files.mapInArrow(segments, _SEGMENT).groupBy("origin").applyInArrow(joined, _PAGE)
    return files.mapInArrow(pages, _PAGE).unionByName(long)


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder, compression="gzip")
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
