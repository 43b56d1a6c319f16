"""WARC archives: a writer with revisit records, and a reader that salvages damaged ones.

Archives are gzip files of one member per record, written to and read from the store
that the folder's address names. The reader checks every member, its version line,
its length and its payload digest. After a failed check it searches for the next
member (or, in an uncompressed archive, the next version line) that holds a record,
goes on from there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.tables import stored
from tracewell.session import scratch_dir

#: Payloads from this size on are written once and revisited.
REVISIT_BYTES = 100
FILE_BYTES = 16 << 20
VERSION = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16
#: Numbers as they are written, within 64 bits.
NUMBER, NUMBER_BYTES = re.compile(r"[0-9]{1,18}"), re.compile(rb"[0-9]{1,18}")
URN = re.compile(r"<urn:page:(-?[0-9]{1,18})>")


# -- writing

def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}\r\n" for k, v in fields if v is not None]
    return VERSION + "".join(lines).encode() + b"\r\n"


def record(page_id: int | None, url: str | None, digest: str, payload: bytes, n_bytes: int, refers_to: int | None) -> bytes:
    """One record: the payload behind an HTTP head, or a revisit without it."""
    body = b"" if refers_to is not None else HTTP + payload
    return _header([
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", n_bytes),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(body)),
    ]) + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def qualified(spark: SparkSession, folder: str) -> str:
    """The address of a folder with the scheme that the session's settings give it, so that
    executors write to the very store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full)


def _store(folder: str):
    """The store a qualified address names, and the folder in it; the folder is made."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    return store, root


def _write(folder: str, compress: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        part, attempt, number = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        # every attempt has names of its own; the table of archives lists those of the one
        # that counts, and only these are read
        out, at, n, temporary = None, 0, 0, ""
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out, number
            if out is None:
                return
            out.close()
            name = f"pages-{part:06d}-{attempt:08d}-{number:04d}.warc{'.gz' if compress else ''}"
            store.move(temporary, f"{root}/{name}")
            done.append((name, n, at))
            out, number = None, number + 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_id", "url", "digest", "payload", "n_bytes", "refers_to")]
            for row in zip(*columns, strict=True):
                data = record(*row)
                data = member(data) if compress else data
                if out is not None and at + len(data) > FILE_BYTES:
                    close()
                if out is None:
                    temporary, at, n = f"{root}/.{uuid.uuid4().hex}.part", 0, 0
                    out = store.open_output_stream(temporary)
                out.write(data)
                at, n = at + len(data), n + 1
        close()
        names, records, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
            names=["file", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                   folder: str | None = None, compress: bool = True) -> tuple[str, DataFrame]:
    """One record per row; the folder of the archives, and a row per archive written.

    Of rows with equal payloads of ``REVISIT_BYTES`` or more, the smallest page id is a
    response and rows of other ids revisit it. A null payload is an empty one; a null
    id is written as an empty one and never revisited; repeated rows are written each;
    further columns are left out; an empty table writes no archive.
    """
    folder = qualified(pages.sparkSession, folder or f"{scratch_dir(pages.sparkSession)}-warc")
    _store(folder)
    rows = pages.select(F.col(page_id).cast("long").alias("_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("_html")).select(
        "_id", "url", "_html", F.octet_length("_html").cast("long").alias("n_bytes"), F.sha2("_html", 256).alias("digest"))
    # combined in the map tasks, so a payload that many pages share is a row per task
    first = (rows.filter(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest")
             .agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first < _last").drop("_last"))
    joined = rows.join(first, "digest", "left")
    refers = F.when(F.col("_first") < F.coalesce("_id", F.lit((1 << 63) - 1)), F.col("_first"))
    ready = joined.select("_id", "url", "digest", refers.alias("refers_to"), "n_bytes", "_html").select(
        "_id", "url", "digest", "refers_to", "n_bytes",
        F.when(F.col("refers_to").isNull(), F.col("_html")).otherwise("").cast("binary").alias("payload"))
    return folder, stored(ready.mapInArrow(_write(folder, compress), "file string, records bigint, bytes bigint"), "archives")


# -- reading

@dataclass
class Found:
    """A record at a place of its archive, or a gap with the reason it was left out."""

    offset: int
    length: int
    fields: dict[str, str]
    payload: bytes
    reason: str | None = None


class BadRecord(ValueError):
    pass


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one whole record, every check passed."""
    if not data.startswith(b"WARC/"):
        raise BadRecord("no version line")
    head, mark, body = data.partition(b"\r\n\r\n")
    if not mark:
        raise BadRecord("no end of the header")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord("broken header line")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not NUMBER.fullmatch(fields.get("content-length", "")):
        raise BadRecord("no length")
    n = int(fields["content-length"])
    if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise BadRecord("wrong length")
    payload = body[:n]
    if payload.startswith(b"HTTP/"):
        payload = payload.partition(b"\r\n\r\n")[2]
    told = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "response" and told.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != told[7:]:
        raise BadRecord("wrong payload digest")
    return fields, payload


def _inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at a place, and where it ends."""
    expand, out = zlib.decompressobj(31), []
    end = at
    while not expand.eof:
        if end >= len(data):
            raise BadRecord("cut short")
        chunk = data[end: end + _CHUNK]
        try:
            out.append(expand.decompress(chunk))
        except zlib.error:
            raise BadRecord("broken member") from None
        end += len(chunk)
    return b"".join(out), end - len(expand.unused_data)


def _next_member(raw: bytes, data: memoryview, at: int) -> int:
    """Place of the next member that starts with a version line, or the end."""
    while (at := raw.find(MEMBER, at)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(data[at: at + 1024], 5) == b"WARC/":
                return at
        except zlib.error:
            pass
        at += 1
    return len(raw)


def _plain_end(raw: bytes, at: int) -> int:
    """End of the uncompressed record at a place, from its header."""
    stop = raw.find(b"\r\n\r\n", at)
    if not raw.startswith(b"WARC/", at) or stop < 0:
        raise BadRecord("no version line" if stop >= 0 else "cut short")
    for line in raw[at:stop].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and NUMBER_BYTES.fullmatch(value.strip()):
            end = stop + 4 + int(value) + 4
            if end > len(raw):
                raise BadRecord("cut short")
            return end
    raise BadRecord("no length")


def salvage(raw: bytes) -> Iterator[Found]:
    """All records of an archive that pass their checks, and the gaps between."""
    data, at = memoryview(raw), 0
    zipped = raw.startswith(b"\x1f\x8b") or (not raw.startswith(b"WARC/") and _next_member(raw, data, 0) < len(raw))
    while at < len(raw):
        try:
            if zipped:
                content, end = _inflate(data, at)
            else:
                end = _plain_end(raw, at)
                content = raw[at:end]
            fields, payload = parse_record(content)
            yield Found(at, end - at, fields, payload)
            at = end
        except BadRecord as fault:
            if zipped:
                after = _next_member(raw, data, at + 1)
            else:
                after = raw.find(b"\nWARC/1.", at + 1) + 1 or len(raw)
            yield Found(at, after - at, {}, b"", str(fault))
            at = after


def page_number(urn: str | None) -> int | None:
    found = URN.fullmatch(urn or "")
    return int(found[1]) if found else None


READ_SCHEMA = ("file string, offset bigint, length bigint, reason string, page_id bigint, url string, "
               "record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(),
             pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for i, path in enumerate(batch.column("path").to_pylist()):
            rows, held = [], 0
            for x in salvage(batch.column("content")[i].as_py()):
                f = x.fields
                revisit = f.get("warc-type") == "revisit"
                digest = f.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(x.payload).hexdigest()
                n = f.get("warc-payload-length", "") if revisit else str(len(x.payload))
                rows.append((path, x.offset, x.length, x.reason, page_number(f.get("warc-record-id")), f.get("warc-target-uri"),
                             f.get("warc-type"), None if x.reason else digest, int(n) if NUMBER.fullmatch(n) and not x.reason else None,
                             page_number(f.get("warc-refers-to")), x.payload))
                held += len(x.payload)
                if held > 8 << 20 or len(rows) == 5000:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, folder: str, archives: DataFrame | None = None) -> DataFrame:
    """Every record and gap of the archives in a folder: of those that ``archives`` (as
    ``write_archives`` returns it) lists, or of all.

    Records have a null ``reason``; a gap has one, with ``file``, ``offset`` and
    ``length`` of the quarantined bytes. A revisit has the digest and size of the
    payload it refers to, and an empty payload. Records come back as often as they
    were written; a folder without archives gives no rows.
    """
    files = (spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
             .option("pathGlobFilter", "*.warc*"))
    # a name per archive, each of up to FILE_BYTES
    names = [folder] if archives is None else [f"{folder}/{r['file']}" for r in archives.select("file").toLocalIterator()]
    if not names:
        return spark.createDataFrame([], READ_SCHEMA)
    files = files.load(names)
    return files.select("path", "content").mapInArrow(_read, READ_SCHEMA)


def quarantined(records: DataFrame) -> DataFrame:
    """The gaps: ``file``, ``offset``, ``length``, ``reason``."""
    return records.filter(F.col("reason").isNotNull()).select("file", "offset", "length", "reason")
