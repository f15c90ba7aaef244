"""Web archives: legacy ARC files (versions 1 and 2) read, converted to WARC, written and read back.

ARC has no identifiers, record types or digests: a record is one line of fields, whose names the
file's own version block lists, and as many bytes as the line's last field declares. Conversion
makes what WARC wants of it: an identifier from the content (so a rerun makes the same one), an ISO
date from the 14-digit one, a type (response for HTTP content, resource for anything else, warcinfo
for the version block), digests, and revisit records in place of payloads seen before.

Files are written by Spark's text writer (records are valid UTF-8 and end with the format's own
terminator), gzip-compressed, each starting with its version or warcinfo block and closed after a
number of records that keeps it near `FILE_BYTES`; they are read by Spark's binaryFile source. So
they can live in any store, and no task holds more than a few such files.

Defined results: a null payload is empty; a null address is '-', and has no target in WARC; blanks
in addresses become %20; payloads below `LEAST` bytes are never revisits; equal payloads whose ids
are all null stay responses, and so do all rows that share the smallest id; a truncated or
malformed archive raises ValueError.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.session import cut_lineage

FILE_BYTES = 32 << 20
LEAST = 100
FETCHED = "20260101000000"
# The field names of the two ARC versions, and the WARC record terminator.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
TERMINATOR = "\r\n\r\n"
_BLANK = re.compile(r"[\x00-\x20\x7f]")
RECORD = "url string, ip string, date string, mime string, page_id bigint, payload_digest string, payload_bytes bigint, packed binary, head int"


@dataclass
class Record:
    """One ARC record: its named fields and its bytes."""

    fields: dict[str, str]
    block: bytes


# --- ARC -------------------------------------------------------------------------------------


def version_block(version: int, name: str) -> str:
    body = f"{version} 0 evalgrid\n{FIELDS[version]}\n"
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": FETCHED, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version].split()) + "\n" + body


def arc_record(version: int, name: str, offset: int, url: str, block: str, mime: str = "text/html") -> str:
    size = len(block.encode())
    values = {"URL": _BLANK.sub(lambda m: f"%{ord(m[0]):02X}", url) or "-", "IP-address": "0.0.0.0", "Archive-date": FETCHED, "Content-type": mime, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(size)}
    return " ".join(values[f] for f in FIELDS[version].split()) + "\n" + block


def http_response(page_id: int | None, payload: str) -> str:
    ident = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ident}Content-Length: {len(payload.encode())}\r\n\r\n{payload}"


def parse_arc(content: bytes) -> Iterator[Record]:
    """The records of an ARC file, the version block first. Field names come from that block."""
    names, at = FIELDS[1].split(), 0
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError("ARC header line without end")
        if end == at:  # blank line between records
            at += 1
            continue
        line = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        first = line[0].startswith("filedesc://")
        if not line[-1].isdigit() or (not first and len(line) != len(names)):
            raise ValueError(f"ARC header line not understood: {' '.join(line)[:200]}")
        size = int(line[-1])
        block = content[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError("ARC record shorter than declared")
        if first:
            told = block.decode("utf-8", "replace").split("\n")
            if len(told) < 2 or told[0].split(" ")[0] not in ("1", "2"):
                raise ValueError("ARC version block not understood")
            names = told[1].split()
        yield Record(dict(zip(names, line)) if len(line) == len(names) else {"URL": line[0], "Archive-length": line[-1]}, block)
        at = end + 1 + size


def head_of(block: bytes) -> int:
    """Bytes of the HTTP head with its blank line, 0 if the block is not an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return 0
    end = block.find(b"\r\n\r\n")
    return end + 4 if end >= 0 else 0


def header(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


# --- WARC ------------------------------------------------------------------------------------


def warc_record(kind: str, block: str, url: str | None, date: str, more: dict[str, str], mime: str) -> str:
    """A WARC/1.1 record without its terminator. The identifier follows from its content."""
    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    raw = block.encode()
    digest = "sha256:" + hashlib.sha256(raw).hexdigest()
    ident = uuid.uuid5(uuid.NAMESPACE_URL, "|".join([kind, url or "", date, digest, *more.values()]))
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Date: {iso}"]
    lines += [f"WARC-Target-URI: {url}"] if url else []
    lines += [f"WARC-Block-Digest: {digest}", *[f"{k}: {v}" for k, v in more.items()], f"Content-Type: {mime}", f"Content-Length: {len(raw)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def parse_warc(content: bytes) -> Iterator[Record]:
    """The records of a WARC file, by declared length."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or end < 0:
            raise ValueError("WARC header not understood")
        pairs = [line.partition(":") for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]]
        fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
        size = int(fields["content-length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) < size or content[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("WARC record shorter than declared")
        yield Record(fields, block)
        at = end + 8 + size


# --- Spark -----------------------------------------------------------------------------------


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for i in range(batch.num_rows):
            raw = batch.column(0)[i].as_py()
            yield gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def _strings(rows: Iterator[str], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """One string column, in batches of a few MB."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
            held, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


def _write(lines: DataFrame, path: str, per_file: int, end: str) -> None:
    lines.write.option("lineSep", end).option("maxRecordsPerFile", per_file).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def records_per_file(count: int, total_bytes: int) -> int:
    return max(2, int(FILE_BYTES * max(count, 1) / max(total_bytes, 1)))


def write_arc(pages: DataFrame, path: str, per_file: int, version: Callable[[int], int] = lambda task: 1 + task % 2) -> None:
    """Pages (page_id, url, html) as ARC files; each task writes the version that `version` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        kind, made, offset, name = version(task), 0, 0, ""

        def lines():
            nonlocal made, offset, name
            for batch in batches:
                for page_id, url, html in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                    if made % per_file == 0:
                        name, offset = f"part-{task}-{made // per_file}.arc", 0
                        yield (block := version_block(kind, name))
                        offset += len(block.encode()) + 1
                        made += 1
                    yield (rec := arc_record(kind, name, offset, url or "-", http_response(page_id, html or "")))
                    offset += len(rec.encode()) + 1
                    made += 1

        yield from _strings(lines())

    _write(pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "value string"), path, per_file, "\n")


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The content records of ARC files: fields, page id, payload digest and size, and the zlib-packed
    block (null unless asked for) with the length of its HTTP head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in _contents(batches):
            rows = []
            for rec in parse_arc(content):
                if rec.fields["URL"].startswith("filedesc://"):
                    continue
                head = head_of(rec.block)
                ident, payload = header(rec.block[:head], b"X-Page-Id"), rec.block[head:]
                packed = zlib.compress(rec.block, 1) if payloads else None
                rows.append((rec.fields["URL"], rec.fields.get("IP-address"), rec.fields.get("Archive-date"), rec.fields.get("Content-type"), int(ident) if ident else None, hashlib.sha256(payload).hexdigest(), len(payload), packed, head))
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in RECORD.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def first_copies(records: DataFrame) -> DataFrame:
    """payload_digest and original (smallest page id) of payloads that occur more than once."""
    large = records.where(F.col("payload_bytes") >= LEAST)
    return large.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 AND original IS NOT NULL").drop("n")


def write_warc(records: DataFrame, originals: DataFrame, path: str, per_file: int) -> None:
    """ARC records as WARC files; payloads that `originals` knows under another id become revisits."""
    joined = records.join(originals, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= LEAST) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    joined = joined.select("url", "date", "mime", "payload_digest", "payload_bytes", "packed", "head", F.when(revisit, F.col("original")).alias("original"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task = 0, TaskContext.get().partitionId()

        def lines():
            nonlocal made
            for batch in batches:
                for i in range(batch.num_rows):
                    url, date, mime, digest, size, packed, head, original = (batch.column(k)[i].as_py() for k in range(8))
                    if made % per_file == 0:
                        info = f"software: evalgrid\r\nformat: WARC File Format 1.1\r\nconforms-to: ARC conversion, task {task}, file {made // per_file}\r\n"
                        yield warc_record("warcinfo", info, None, FETCHED, {}, "application/warc-fields")
                        made += 1
                    block = zlib.decompress(packed).decode()
                    more = {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(size)}
                    kind = "revisit" if original is not None else "response" if head else "resource"
                    if original is not None:
                        more |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(original)}
                        block = block.encode()[:head].decode()
                    yield warc_record(kind, block, None if url == "-" else url, date or FETCHED, more, "application/http; msgtype=response" if head else mime or "application/octet-stream")
                    made += 1

        yield from _strings(lines())

    _write(joined.mapInArrow(run, "value string"), path, per_file, TERMINATOR)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id of the content
    records. Digests of stored payloads are computed anew and must agree with what is declared."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, record_id string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in _contents(batches):
            rows = []
            for rec in parse_warc(content):
                f = rec.fields
                if f["warc-type"] == "warcinfo":
                    continue
                head = head_of(rec.block)
                declared, size = f["warc-payload-digest"].removeprefix("sha256:"), int(f["x-payload-length"])
                if f["warc-type"] != "revisit":
                    payload = rec.block[head:]
                    if hashlib.sha256(payload).hexdigest() != declared or len(payload) != size:
                        raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
                ident, to = header(rec.block[:head], b"X-Page-Id"), f.get("x-refers-to-page")
                rows.append((int(ident) if ident else None, size, declared, f["warc-type"], int(to) if to else None, f.get("warc-target-uri"), f["warc-record-id"].strip("<>")))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str, per_file: int) -> None:
    """ARC files to WARC files. What the digests say is found first, from a pass without payloads;
    the table of repeated payloads is written, so its size is known when it is joined."""
    originals = cut_lineage(first_copies(read_arc(spark, arc_path, payloads=False)))
    write_warc(read_arc(spark, arc_path), originals, warc_path, per_file)


def archived_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Pages written as ARC files in `folder`, converted to WARC there, and read back."""
    spark = pages.sparkSession
    size = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("b")).first()
    per_file = records_per_file(size["n"], size["b"] or 0)
    write_arc(pages, f"{folder}/arc", per_file)
    convert(spark, f"{folder}/arc", f"{folder}/warc", per_file)
    return read_warc(spark, f"{folder}/warc")
