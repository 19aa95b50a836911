"""Legacy archive conversion: ARC records to WARC records, and WARC files written and read at scale."""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridact.llm.common import may_hold, materialize, shared_path

# The header fields of both ARC versions, in order, and the marks of the WARC format.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"
# Digits of a date that an ARC record may leave out.
DATE_REST = "00010101000000"
EPOCH = "1970-01-01T00:00:00Z"
RECORDS_PER_ARC = 256
#: Bytes of a WARC file, at most, but for its last record.
FILE_BYTES = 16 << 20
#: Bytes that the decompressor gets at a time.
FEED = 64 << 10
#: What closes a file: a gzip member without content.
_CLOSE = gzip.compress(b"", mtime=0)


class ArchiveError(ValueError):
    """An archive that breaks its format."""


@dataclass
class ArcRecord:
    """One record of an ARC file: its header fields by name, and its bytes."""

    header: dict[str, str]
    content: bytes
    version: int


@dataclass
class WarcRecord:
    """One WARC record: headers in order, and the block."""

    headers: dict[str, str]
    block: bytes = b""
    kind: str = field(init=False)

    def __post_init__(self) -> None:
        self.kind = self.headers.get("WARC-Type", "")

    def to_bytes(self) -> bytes:
        """The record without the two line ends that close it."""
        lines = [WARC_VERSION, *(f"{k}: {v}" for k, v in self.headers.items()), f"Content-Length: {len(self.block)}"]
        return "\r\n".join(lines).encode() + RECORD_END + self.block


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(content: bytes) -> tuple[bytes, bytes] | None:
    """An HTTP message's head, with the empty line that ends it, and its payload; None if it isn't one."""
    if not content.startswith(b"HTTP/"):
        return None
    head, gap, payload = content.partition(RECORD_END)
    return (head + gap, payload) if gap else None


def http_header(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name.lower():
            return value.strip()
    return None


def write_arc(records: Iterable[tuple[str, str, str, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of that version from (url, date, content type, content) records, version block first."""
    fields = ARC_FIELDS[version]

    def line(url: str, date: str, kind: str, size: int, offset: int, code: str) -> bytes:
        values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": code, "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(size)}
        return (" ".join(values[f].replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "-" for f in fields) + "\n").encode()

    body = f"{version} 0 origin\n{' '.join(fields)}\n".encode()
    out = [line(f"filedesc://{name}", "19960101000000", "text/plain", len(body), 0, "200"), body, b"\n"]
    size = sum(map(len, out))
    for url, date, kind, content in records:
        head = line(url, date, kind, len(content), size, "200")
        out += [head, content, b"\n"]
        size += len(head) + len(content) + 1
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file. The version block says which header line its records have; declared lengths delimit them."""
    at, fields, version = 0, ARC_FIELDS[1], 1
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError(f"no end of the header line at {at}")
        values = data[at:end].decode("utf-8", "replace").split(" ")
        if values[0].startswith("filedesc://"):
            declared = data[end + 1 :].split(b" ", 1)[0]
            version = int(declared) if declared.isdigit() else 0
            if version not in ARC_FIELDS:
                raise ArchiveError(f"unknown version {declared[:20]!r}")
            fields = ARC_FIELDS[version]
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ArchiveError(f"header line at {at} doesn't have the {len(fields)} fields of version {version}")
        size = int(values[-1])
        content = data[end + 1 : end + 1 + size]
        if len(content) != size:
            raise ArchiveError(f"record at {at} declares {size} bytes and has {len(content)}")
        yield ArcRecord(dict(zip(fields, values)), content, version)
        at = end + 1 + size


def warc_date(date: str) -> str:
    """An ARC date as a WARC date: what is left out begins its year, month or day; what isn't a date or time is left out.

    Without a valid year it is the epoch.
    """
    for n in range(min(14, len(date)) // 2 * 2, 3, -2):
        digits = date[:n] + DATE_REST[n:]
        if digits.isascii() and digits.isdigit():
            try:
                return datetime.datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
            except ValueError:
                continue
    return EPOCH


def convert(record: ArcRecord) -> WarcRecord:
    """The equivalent WARC record: identifier, timestamp, type and digests are derived from what the ARC record holds.

    The identifier depends on the record's header and payload only, so converting again gives the same one.
    """
    header, content = record.header, record.content
    date, stamp = header["Archive-date"], warc_date(header["Archive-date"])
    http = split_http(content)
    if header["URL"].startswith("filedesc://"):
        name = header["URL"].removeprefix("filedesc://")
        block = f"software: converted from ARC {record.version}\r\nformat: WARC File Format 1.1\r\n".encode()
        return WarcRecord({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", name, digest(content)), "WARC-Date": stamp, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, block)
    payload = http[1] if http else content
    page = http_header(http[0], "X-Page-Id") if http else None
    headers = {
        "WARC-Type": "response" if http else "resource",
        "WARC-Record-ID": record_id(page if page is not None else f"{header['URL']} {date}", digest(payload)),
        "WARC-Date": stamp,
        "WARC-Target-URI": header["URL"],
        "WARC-IP-Address": header["IP-address"],
        "WARC-Block-Digest": f"sha1:{digest(content)}",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http; msgtype=response" if http else header["Content-type"],
    }
    if header["IP-address"] in ("0.0.0.0", "-"):
        del headers["WARC-IP-Address"]
    return WarcRecord(headers, content)


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def as_revisit(record: WarcRecord, original_id: str, original_page: int) -> WarcRecord:
    """A response as a revisit of another with an equal payload: its block keeps the HTTP head alone."""
    head = (split_http(record.block) or (b"", b""))[0]
    headers = record.headers | {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": original_id, "WARC-Refers-To-Page": str(original_page), "WARC-Block-Digest": f"sha1:{digest(head)}", "WARC-Truncated": "length"}
    return WarcRecord(headers, head)


def _decompressed(data: bytes) -> Iterator[bytes]:
    """The bytes of plain or gzipped data, of one or many members, part by part."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        stream = zlib.decompressobj(31)
        while not stream.eof:
            part = data[at : at + FEED]
            if not part:
                raise ArchiveError("compressed data end early")
            out = stream.decompress(part)
            at += len(part) - len(stream.unused_data)
            if out:
                yield out


def _record_at(data: bytearray, at: int) -> tuple[WarcRecord, int] | None:
    """The record that begins there and where it ends; None if it goes on beyond the data."""
    end = data.find(RECORD_END, at)
    if end < 0:
        return None
    first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ArchiveError(f"no record at {first[:40]!r}")
    headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    begin = end + len(RECORD_END)
    close = begin + int(headers.pop("Content-Length"))
    if len(data) < close + len(RECORD_END):
        return None
    if data[close : close + len(RECORD_END)] != RECORD_END:
        raise ArchiveError(f"{headers.get('WARC-Record-ID')} isn't closed where its length says")
    return WarcRecord(headers, bytes(data[begin:close])), close + len(RECORD_END)


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """Records of a WARC file, plain or gzipped in one or many members; declared lengths delimit them.

    Data are decompressed as records are taken, so that one record and one part are held at a time.
    """
    held = bytearray()
    for part in _decompressed(data):
        held += part
        at = 0
        while at < len(held) and (found := _record_at(held, at)):
            record, at = found
            yield record
        del held[:at]
    if held:
        raise ArchiveError(f"the last record, {bytes(held[:40])!r}, has no end")


def first_pages(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, payload, refers_to): pages whose payload, named by its SHA-1, of ``min_bytes`` or more a smaller id has too.

    Digests are taken and written once; per digest, ids are reduced before the shuffle. Only digests move, not payloads.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    marked = materialize(pages.select(F.col(id_col).alias("page_id"), F.sha1(payload).alias("payload"), F.octet_length(payload).alias("size")), "digests")
    shared = marked.filter(F.col("size") >= min_bytes)
    least = shared.groupBy("payload").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return shared.join(least, "payload").filter("page_id > refers_to").select("page_id", "payload", "refers_to").distinct()


def write_pages(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0, date: str = "20240101000000", file_bytes: int = FILE_BYTES,
) -> None:
    """Write a WARC record for every row, by way of ARC: rows are put in ARC archives of both versions and converted.

    Equal payloads of at least ``min_bytes`` bytes: the smallest id is a response, the others revisit it. Every record is
    a gzip member, and a file is closed once it has ``file_bytes``. Null payloads are empty, null addresses
    ``about:blank``; a row without id is a response; rows that repeat an id are judged each by its own payload, and of
    rows that repeat both, each is a response or each a revisit. Payloads of pages that may be revisits move once; the
    others stay where they are.
    """
    revisits = materialize(first_pages(pages, id_col, payload_col, min_bytes), "revisits")
    source = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("about:blank")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("content"))
    marked = may_hold(source.withColumn("page_key", F.xxhash64("page_id")), "page_key", revisits.select(F.xxhash64("page_id").alias("page_key"))).drop("page_key")
    some = marked.filter("may_hold").withColumn("payload", F.sha1("content")).join(revisits, ["page_id", "payload"], "left")
    others = marked.filter("NOT may_hold").withColumn("refers_to", F.lit(None).cast(revisits.schema["refers_to"].dataType))
    columns = ["page_id", "url", "content", "refers_to"]
    ordered = some.select(*columns).union(others.select(*columns))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        chunk = 0
        for batch in batches:
            for at in range(0, batch.num_rows, RECORDS_PER_ARC):
                rows = batch.slice(at, RECORDS_PER_ARC).to_pylist()
                arc = write_arc(((r["url"], date, "text/html", _message(r)) for r in rows), 1 + chunk % 2)
                chunk += 1
                for row, record in zip([None, *rows], map(convert, read_arc(arc))):
                    if row is not None and row["refers_to"] is not None:
                        payload = record.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        record = as_revisit(record, record_id(str(row["refers_to"]), payload), row["refers_to"])
                    yield gzip.compress(record.to_bytes() + RECORD_END, mtime=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for member in members(batches):
            held.append(member)
            size += len(member)
            if size >= file_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])

    files = ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    # The text sink writes each value's bytes as they are and closes it with the line end, here an empty gzip member. One
    # value is one file.
    files.write.option("encoding", "ISO-8859-1").option("lineSep", _CLOSE.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def _message(row: dict) -> bytes:
    page = f"X-Page-Id: {row['page_id']}\r\n" if row["page_id"] is not None else ""
    return f"HTTP/1.1 200 OK\r\n{page}Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(row['content'])}\r\n\r\n".encode() + row["content"]


def read_pages(spark, path: str) -> DataFrame:
    """(page_id, uri, payload_bytes, payload_digest, record_type, refers_to) of every page in the WARC files below ``path``.

    A file is read by one task, record by record; its bounded size bounds the task's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                out: list[tuple] = []
                for r in read_warc(data.as_py()):
                    if r.kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(r.block)
                    size = int(http_header(head, "Content-Length"))
                    name = r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if r.kind == "response" and (len(payload) != size or digest(payload) != name):
                        raise ArchiveError(f"{r.headers['WARC-Record-ID']} doesn't hold what its digest says")
                    page, refers = http_header(head, "X-Page-Id"), r.headers.get("WARC-Refers-To-Page")
                    out.append((int(page) if page else None, r.headers["WARC-Target-URI"], size, name, r.kind, int(refers) if refers else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, **kw) -> DataFrame:
    """Write the pages to new WARC files in shared storage and read these back."""
    path = shared_path(pages.sparkSession, "warc")
    write_pages(pages, path, **kw)
    return read_pages(pages.sparkSession, path)
