"""WARC archives: a writer with revisit records and a salvage reader.

Archives are files in a shared folder, a gzip member for each record. The reader checks every record (gzip checksum,
version line, headers, length, block and payload digests). After a failed check it searches for the next valid member
or version line, goes on from there, and logs the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probefleet.llm import text as T
from probefleet.llm.workspace import settled
from probefleet.session import shared_folder

#: An archive is closed once it has this many bytes; a larger record has an archive of its own.
ARCHIVE_BYTES = 16 << 20
#: Payloads of fewer bytes are always stored in full.
MIN_REVISIT_BYTES = 0

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FED = 1 << 16


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


_OWN_ID = re.compile(r"<urn:page:(-?\d+)>")


def _page_id(uri: str | None) -> int | None:
    """The page's id in a record id of this writer; null in any other."""
    own = _OWN_ID.fullmatch(uri or "")
    return int(own[1]) if own else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """An uncompressed record: a revisit if refers_to is given, else a response with the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _uri(page_id),
        "WARC-Date": date,
        **({"WARC-Target-URI": uri} if uri else {}),
        **({"WARC-Refers-To": _uri(refers_to), "WARC-Profile": _PROFILE} if refers_to is not None else {}),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    record_id: str
    page_id: int | None
    url: str
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str | None
    payload: bytes | None


def _differs(stated: str | None, data: bytes) -> bool:
    """Whether a stated digest is another one than the data's; digests of unknown kinds cannot be checked."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() == "sha1" and len(value) == 32:
        return digest(data) != value.upper()
    if kind.lower() in ("sha1", "sha256", "md5") and re.fullmatch("[0-9a-fA-F]+", value):
        return hashlib.new(kind.lower(), data).hexdigest() != value.lower()
    return False


class Broken(ValueError):
    """Bytes that are not a valid record."""


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record that starts at a position of uncompressed bytes, and where it ends."""
    version = _VERSION.match(data, at)
    if not version:
        raise Broken("no version line")
    head_end = data.find(b"\r\n\r\n", version.end() - 2)
    if head_end < 0:
        raise Broken("headers do not end")
    headers = {}
    for line in data[version.end() : head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("bad header line")
        headers[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    try:
        size, kind = int(headers[b"content-length"]), headers[b"warc-type"]
    except (KeyError, ValueError) as e:
        raise Broken(f"bad or missing header: {e}") from None
    start = head_end + 4
    end = start + size
    if size < 0 or data[end : end + 4] != b"\r\n\r\n":
        raise Broken("wrong length")
    block = data[start:end]
    if _differs(headers.get(b"warc-block-digest"), block):
        raise Broken("block digest differs")
    payload, length = block, size
    if headers.get(b"content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
        # A revisit leaves the payload out and states its length only here.
        length = int(stated[1]) if stated else len(payload)
        if kind != "revisit" and stated and length != len(payload):
            raise Broken("payload has another length")
    payload_digest = headers.get(b"warc-payload-digest")
    if kind != "revisit" and _differs(payload_digest, payload):
        raise Broken("payload digest differs")
    record_id, refers_to = headers.get(b"warc-record-id", ""), headers.get(b"warc-refers-to")
    found = Record(
        record_id, _page_id(record_id), headers.get(b"warc-target-uri", ""), kind, _page_id(refers_to), length,
        payload_digest.removeprefix("sha1:") if payload_digest else None, None if kind == "revisit" else payload,
    )
    return found, end + 4


def _records_in(content: bytes) -> tuple[list[Record], str]:
    """The valid records of a member, and why bytes of it hold none, if so."""
    found: list[Record] = []
    at, reason = 0, ""
    while at < len(content):
        try:
            record_, at = _parse(content, at)
            found.append(record_)
        except Broken as e:
            reason = reason or str(e)
            at = _next_version(content, at + 1)
            if at < 0:
                break
    return found, reason


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a position, and where the member ends."""
    unpack, parts = zlib.decompressobj(31), []
    try:
        while not unpack.eof:
            if at >= len(data):
                raise Broken("member is cut off")
            parts.append(unpack.decompress(data[at : at + _FED]))
            at += min(_FED, len(data) - at)
    except zlib.error as e:
        raise Broken(f"bad member: {e}") from None
    return b"".join(parts), at - len(unpack.unused_data)


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """Valid records of an archive, gzipped or not, in order; (from, to, reason) for the bytes that hold none.

    A gap ends where the next valid record starts. Of a member that holds several records the valid ones are given, and the
    member is a gap too if it holds more than these. An empty archive holds nothing.
    """
    view, at, gap, reason = memoryview(data), 0, None, ""
    while at < len(data):
        found, inner = [], ""
        try:
            if data[at : at + 3] == _MEMBER:
                content, end = _member(view, at)
                found, inner = _records_in(content)
                if inner and not found:
                    raise Broken(inner)
            else:
                record_, end = _parse(data, at)
                found = [record_]
        except Broken as e:
            if gap is None:
                gap, reason = at, str(e)
            candidates = [x for x in (data.find(_MEMBER, at + 1), _next_version(data, at + 1)) if x >= 0]
            at = min(candidates, default=len(data))
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield from found
        if inner:
            yield at, end, inner
        at = end
    if gap is not None:
        yield gap, len(data), reason


def _next_version(data: bytes, at: int) -> int:
    found = _VERSION.search(data, at)
    return found.start() if found else -1


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id of the pages with an equal payload, where that is another.

    A null html is an empty payload. A null page_id refers to the smallest id with the payload, if any; nothing refers
    to a null page_id. Pages below min_bytes refer to nothing.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    firsts = (
        own.where(F.octet_length("html") >= min_bytes)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return own.join(firsts, "sha", "left").select("page_id", "url", "html", refers_to.alias("refers_to"))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, Spark's default one where none is named."""
    if "://" in folder:
        return folder
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return f"file://{folder}" if default.startswith("file:") else f"{default.rstrip('/')}{folder}"


def write_archives(
    pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Writes page_id, url, html, refers_to rows as archives below a folder; a row (name, records) for each archive.

    The rows name what was committed: a task that ran twice leaves files under a name of its own, which the reader
    skips.
    """

    target = qualified(pages.sparkSession, folder)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(target)
        place.create_dir(root, recursive=True)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        names, counts, out = [], [], None
        for batch in T.text_slices(batches, "html", 8 << 20):
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"{stem}-{len(names):04d}.warc.gz")
                    counts.append(0)
                    out = place.open_output_stream(f"{root}/{names[-1]}", compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], date)
                out.write(pack.compress(data) + pack.flush())
                counts[-1] += 1
                if out.tell() >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["name", "records"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(rows, "name string, records long")


_READ = (
    "name string, record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long,"
    " payload_digest string, payload string, gap_from long, gap_to long, reason string"
)


def read_archives(spark: SparkSession, folder: str, written: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """A row for each record and for each quarantined gap (gap_from, gap_to, reason; record columns null).

    written restricts the archives to the names in it. Records of any writer are read: their ids are texts, and page_id and
    refers_to are null unless they are ids of `write_archives`; digests are checked where stated. Payloads that are not UTF-8 come with replacement characters.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    if written is not None:
        files = files.join(written.select("name"), "name", "left_semi")
    fields = [x.split()[0] for x in _READ.split(",")]
    types = {"name": pa.string(), "record_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload": pa.string(), "reason": pa.string()}

    def batch_of(found: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([r.get(c) for r in found], types.get(c, pa.int64())) for c in fields]
        return pa.RecordBatch.from_arrays(arrays, fields)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                for x in salvage(content.as_py()):
                    if isinstance(x, tuple):
                        found.append({"name": name, "gap_from": x[0], "gap_to": x[1], "reason": x[2]})
                    else:
                        row = {"name": name} | {k: getattr(x, k) for k in fields[1:9] if k != "payload"}
                        if payloads and x.payload is not None:
                            row["payload"] = x.payload.decode("utf-8", "replace")
                            size += len(x.payload)
                        found.append(row)
                    if len(found) >= 4096 or size >= 8 << 20:
                        yield batch_of(found)
                        found, size = [], 0
        yield batch_of(found)

    return files.mapInArrow(rows, _READ)


def archive_pages(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The records of all pages after a round trip through archives: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A gap in an archive that was just written is an error."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    written = settled(write_archives(with_revisits(pages, min_bytes), folder), "warc-names")
    if written.isEmpty():
        return written.selectExpr(
            "records page_id", "records payload_bytes", "name payload_digest", "name record_type", "records refers_to"
        )
    found = read_archives(spark, folder, written, payloads=False)
    failed = F.raise_error(F.concat(F.lit("unreadable bytes in "), F.col("name"))).cast("long")
    return found.select(
        F.when(F.col("gap_from").isNotNull(), failed).otherwise(F.col("page_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
    )
