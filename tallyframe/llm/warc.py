"""WARC archives: writing pages, and reading records with their segments reassembled.

A record's block is an HTTP response in chunked transfer framing. A block longer than a segment goes on in
continuation records, which name the first record as their origin, count up, and in the last one state the
length of the whole. Reading groups the segments by origin, orders them by number, verifies that none
is missing and that their length is the stated one, and then decodes the framing. Only records with
segments are shuffled. Of equal payloads one is a response and the others are revisits of it.

Archives are written by Spark's own writer and read by its own reader, which splits them at the version line, so
that no file is ever in memory and lost tasks are run again. The writer cuts chunks and segments so that neither a
payload nor what follows a piece of it makes up that line. Archives are gzip files of a partition each. Records of the other
version inside what the reader has split off are told by the lengths that records state; name the version that an
archive mostly has, so that a row of the reader is a record.

Odd cases: a null html is an empty payload, a null url leaves out the target. Of rows that repeat page_id
and payload, all are responses if one is. A null page_id sorts before all others. A record whose
length, numbers or framing are wrong, or that is followed by bytes of no record, is returned with ``complete`` false
and the bytes that are there.
Only page_id, url and html are read; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import map_batches
from tallyframe.session import cut_lineage

VERSION = b"WARC/1.1\r\n"
VERSIONS = (b"WARC/1.0\r\n", VERSION)
LINES = tuple(v[:-2].decode() for v in VERSIONS)
SEGMENT_BYTES = 32_768
CHUNK_CHARS = 8192
BATCH_BYTES = 4 << 20  # of records handed to the writer at once
DATE = "2000-01-01T00:00:00Z"  # archives of the same pages are the same
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, record_type string, target_uri string, refers_to string, stated_digest string,"
    " payload_bytes bigint, payload_digest string, complete boolean"
)
SEGMENT = "origin string, number int, total bigint, head binary, block binary, whole boolean"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- writing --------------------------------------------------------------------------------------
def chunked(payload: str) -> bytes:
    """``payload`` in UTF-8 and chunked framing, without a version line in any chunk or where one ends."""
    out = []
    for at in range(0, len(payload), CHUNK_CHARS):
        part = payload[at : at + CHUNK_CHARS]
        # What follows a chunk is CR LF, so a chunk must not end in the text of a version line either.
        while cuts := [cut for line in LINES if (cut := part.find(line)) >= 0]:
            out.append(part[: min(cuts) + 4])
            part = part[min(cuts) + 4 :]
        out.append(part)
    framed = [b"%x\r\n%b\r\n" % (len(b := p.encode()), b) for p in out if p]
    return b"".join([*framed, b"0\r\n\r\n"])


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return VERSION + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def segments(block: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes (12 at least) that each end where a character ends, and not in a version line."""
    out, at, size = [], 0, max(size, 12)
    while at < len(block):
        end = min(at + size, len(block))
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end -= 1
        if end < len(block) and block[:end].endswith(tuple(v[:-2] for v in VERSIONS)):
            end -= 1  # CR LF follows a segment
        out.append(block[at:end])
        at = end
    return out


def safe_uri(url: str) -> str:
    """``url`` as a header field: without white space, and its last character escaped where it ends in a version line."""
    made = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    return f"{made[:-1]}%{ord(made[-1]):02X}" if made.endswith(LINES) else made


def records(page_id: object, url: str | None, html: str | None, response_id: object, size: int) -> Iterator[bytes]:
    """The records of a page: a response and its continuations, or a revisit of the page ``response_id``."""
    html = html or ""
    digest = sha1_base32(html.encode())
    own, other = f"<urn:page:{page_id}:{digest}>", f"<urn:page:{response_id}:{digest}>"
    fields = {"WARC-Type": "response" if own == other else "revisit", "WARC-Record-ID": own, "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = safe_uri(url)
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if own != other:
        yield record(fields | {"WARC-Profile": REVISIT, "WARC-Refers-To": other}, b"")
        return
    block = HTTP + chunked(html)
    first, *rest = segments(block, size)
    yield record(fields | ({"WARC-Segment-Number": "1"} if rest else {}), first)
    for number, piece in enumerate(rest, 2):
        more = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"{own[:-1]}:{number}>",
            "WARC-Date": DATE,
            "WARC-Segment-Origin-ID": own,
            "WARC-Segment-Number": str(number),
        }
        yield record(more | ({"WARC-Segment-Total-Length": str(len(block))} if number == len(rest) + 1 else {}), piece)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = 0) -> None:
    """Write a record per page into gzip archives below ``path``.

    Of equal payloads of at least ``revisit_bytes``, the largest page_id is the response; the others
    revisit it. Payloads are equal if SHA-1, another hash and length are.
    """
    html = F.coalesce("html", F.lit(""))
    size = F.octet_length("html")
    keyed = pages.select("page_id", "url", html.alias("html")).withColumns(
        {"_sha": F.sha1("html"), "_hash": F.xxhash64("html"), "_size": size}
    )
    key = ["_sha", "_hash", "_size"]
    equal = keyed.filter(F.col("_size") >= revisit_bytes).groupBy(*key)
    equal = equal.agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1")
    joined = keyed.join(cut_lineage(equal.drop("_n").withColumn("_many", F.lit(True)), "equal"), key, "left")
    response = F.when(F.col("_many"), F.col("_last")).otherwise(F.col("page_id"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "response")]
            values, held = [], 0
            for row in zip(*columns, strict=True):
                for made in records(*row, segment_bytes):
                    values.append(made[:-1].decode())  # the writer adds the line feed that ends the record
                    held += len(made)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])
                    values, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

    rows = map_batches(joined.select("page_id", "url", "html", response.alias("response")), write, "value string")
    rows.write.option("compression", "gzip").text(path)


# -- reading --------------------------------------------------------------------------------------
def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes, bool, bytes]:
    """Header fields (lower-case names), header, block, whether it is right, and the record that follows, if any.

    A record is right if its block has the stated length and nothing but line ends stands behind it.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    stated = fields.get("content-length", "")
    length = int(stated) if stated.isdigit() else -1
    if length < 0:
        return fields, head, rest, False, b""
    behind = rest[length:].lstrip(b"\r\n")
    follows = behind if behind.startswith(VERSIONS) else b""
    return fields, head, rest[:length], len(rest) >= length and (not behind or bool(follows)), follows


def all_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes, bool]]:
    """The record that ``raw`` starts with, and those of the other version that follow it."""
    while raw:
        raw = raw.removeprefix(VERSIONS[0]).removeprefix(VERSIONS[1])
        *found, raw = parse(raw)
        yield tuple(found)


def payload_of(block: bytes) -> tuple[bytes, bool]:
    """The payload of an HTTP message, its chunks joined, and whether the framing is right."""
    if not block.startswith(b"HTTP/"):
        return block, True
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body, True
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size <= 0:
            return b"".join(out), size == 0
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
        if len(out[-1]) < size or body[at - 2 : at] != b"\r\n":
            return b"".join(out), False


def _row(fields: dict[str, str], block: bytes, complete: bool, with_payload: bool) -> tuple:
    payload, framed = payload_of(block)
    return (
        fields.get("warc-record-id"),
        fields.get("warc-type"),
        fields.get("warc-target-uri"),
        fields.get("warc-refers-to"),
        fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        len(payload),
        sha1_base32(payload),
        complete and framed,
        *([payload] if with_payload else []),
    )


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


_STR, _INT, _BIN, _BOOL = pa.string(), pa.int64(), pa.binary(), pa.bool_()


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, version: str = LINES[1]) -> DataFrame:
    """One row per record, continuations joined to their origin; with payload unless that is not wanted."""
    other = next(line for line in LINES if line != version)
    raw = spark.read.option("lineSep", f"{version}\r\n").text(path).filter("value <> ''")
    part = F.substring_index("value", "\r\n\r\n", 1)
    in_segments = F.lower(part).contains("warc-segment-number:") | F.col("value").contains(f"{other}\r\n")
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = [_STR] * 5 + [_INT, _STR, _BOOL] + [_BIN] * with_payload

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (parse(v) for v in batch.column(0).to_pylist())
            yield _batch([_row(fields, block, whole, with_payload) for fields, _, block, whole, _ in found], kinds, names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0).to_pylist():
                for fields, head, block, whole in all_records(value):
                    origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
                    number, total = fields.get("warc-segment-number", ""), fields.get("warc-segment-total-length", "")
                    rows.append((origin, int(number) if number.isdigit() else 0, int(total) if total.isdigit() else None, head, block, whole))
            yield _batch(rows, [_STR, pa.int32(), _INT, _BIN, _BIN, _BOOL], ["origin", "number", "total", "head", "block", "whole"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pieces in batch.column(0).to_pylist():
                by_number = {p["number"]: p for p in pieces}  # copies of a record are the same bytes
                if (alone := by_number.pop(0, None)) is not None:  # records without segments
                    fields = parse((alone["head"] or b"") + b"\r\n\r\n")[0]
                    rows += [_row(fields, alone["block"], alone["whole"], with_payload)] * alone["copies"]
                if not by_number:
                    continue
                ordered = [by_number[n] for n in sorted(by_number)]
                block = b"".join([p["block"] for p in ordered])
                right = all(p["whole"] for p in ordered) and sorted(by_number) == list(range(1, len(ordered) + 1))
                right = right and ordered[-1]["total"] == len(block)
                fields = parse((ordered[0]["head"] or b"") + b"\r\n\r\n")[0]
                copies = by_number[1]["copies"] if 1 in by_number else 1
                rows += [_row(fields, block, right, with_payload)] * copies
            yield _batch(rows, kinds, names)

    binary = F.col("value").cast("binary").alias("value")
    alone = map_batches(raw.filter(~in_segments).select(binary), whole, schema)
    pieces = map_batches(raw.filter(in_segments).select(binary), split, SEGMENT)
    # First one piece of each number, however many copies of a record there are; then a record's own pieces.
    single = pieces.groupBy("origin", "number").agg(F.first(F.struct("total", "head", "block", "whole")).alias("p"), F.count("*").alias("copies"))
    grouped = single.groupBy("origin").agg(F.collect_list(F.struct("number", "copies", "p.total", "p.head", "p.block", "p.whole")).alias("pieces"))
    return alone.union(map_batches(grouped.select("pieces"), join, schema))


def resolved(archive: DataFrame) -> DataFrame:
    """``archive`` (read without payload) with the bytes and digest of each revisit taken from what it refers to."""
    rows = cut_lineage(archive, "records")
    targets = rows.filter("record_type = 'response'").select(
        F.col("record_id").alias("_of"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")
    )
    joined = rows.join(targets.distinct(), F.col("refers_to") == F.col("_of"), "left")
    revisit = F.col("record_type") == "revisit"
    return joined.withColumns(
        {
            "payload_bytes": F.when(revisit, F.col("_bytes")).otherwise(F.col("payload_bytes")),
            "payload_digest": F.when(revisit, F.col("_digest")).otherwise(F.col("payload_digest")),
        }
    ).drop("_of", "_bytes", "_digest")
