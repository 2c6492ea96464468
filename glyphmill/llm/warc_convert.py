"""Legacy ARC archives to WARC.

ARC files hold records of one header line and as many bytes as that line declares; a file begins with a version block
that says which fields header lines have (version 1: five fields; version 2: ten). The converter reads files by these
lengths alone, as bytes, so blocks may hold anything. Each document becomes a WARC/1.1 record with an identifier made
from its content and place, the archive date in ISO form, digests of block and payload, and a type: of HTTP responses
with equal payloads one stays a response, the others revisit it; blocks that aren't HTTP become resources. Every file
begins with a warcinfo record, and every record is a gzip member of its own, so readers can seek to it. Archives are
written by Spark's own text writer, as bytes, file by file under its commit protocol. Reading takes a file as one value
of Spark's binaryFile source, of at most 2 GB.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.scratch import cut, drop, new_path, small_batches

#: Records in a WARC file at most, its warcinfo record among them. An ARC file holds what a task reads.
FILE_RECORDS = 20_000
#: Equal payloads of fewer bytes are not made revisits.
LEAST_BYTES = 0
#: Names of the header fields by version, as the version block gives them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_DATE = "20240101000000"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ORIGIN = "X-Origin-Record"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(url: str | None) -> str:
    """A url fit for a header line: white space and control characters escaped, - for none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def _member(record: bytes) -> bytes:
    """The record as a gzip member without its last byte, 0, which the writer puts between values: the highest byte of the length."""
    gzip = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = gzip.compress(record) + gzip.flush()
    return (out if out[-1] == 0 else out + _NOTHING)[:-1]


_NOTHING = zlib.compress(b"", 1, 31)


# --- writing ARC ---------------------------------------------------------------------------------------------------


def _arc_version(version: int, name: str) -> str:
    body = f"{version} 0 glyphmill\n{FIELDS[version]}\n"
    if version == 1:
        return f"filedesc://{name} 0.0.0.0 {_DATE} text/plain {len(body)}\n{body}"
    return f"filedesc://{name} 0.0.0.0 {_DATE} text/plain 200 - - 0 {name} {len(body)}\n{body}"


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of ARC files, a value per record; the files of odd parts are of version 1, of even ones of version 2."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    version, offset = 2 - part % 2, 0
    name, began = f"part-{part:05d}.arc", False
    for batch in batches:
        out = []
        if batch.num_rows and not began:
            first = f"{_arc_version(version, name)}\n".encode()
            out.append(_member(first))
            offset, began = len(first), True
        for page, url, html in zip(batch["id"].to_pylist(), batch["url"].to_pylist(), batch["payload"].to_pylist()):
            body = html.encode()
            block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{_ORIGIN}: {page}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
            head = f"{_clean(url)} 0.0.0.0 {_DATE} text/html"
            head += f" {len(block)}\n" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name} {len(block)}\n"
            record = head.encode() + block + b"\n"
            out.append(_member(record))
            offset += len(record)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def _archive(records: DataFrame, path: str, **options) -> None:
    """A gzip member per value (binary, as _member() makes it), one after another."""
    records.select(F.col("value").cast("string")).write.options(**{"lineSep": "\0", "compression": "none"}, **options).text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """pages as ARC files of both versions. A null payload is empty, a null url is '-'."""
    small_batches(pages.sparkSession)
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    _archive(own.mapInArrow(_arc_records, "value binary"), path)


# --- reading archives ----------------------------------------------------------------------------------------------


class _Stream:
    """Bytes of a file, gunzipped as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.passed = memoryview(data), 0, bytearray(), 0
        self.gzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + (1 << 20)]
        self.at += len(piece)
        if self.gzip is None:
            self.held += piece
            return True
        self.held += self.gzip.decompress(piece)
        while self.gzip.eof and self.gzip.unused_data:  # the next member
            rest, self.gzip = self.gzip.unused_data, zlib.decompressobj(31)
            self.held += self.gzip.decompress(rest)
        if self.gzip.eof and self.at < len(self.data):
            self.gzip = zlib.decompressobj(31)
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """What comes up to mark, which is passed over; None at the end."""
        seen = 0
        while (k := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.held[:k])
        del self.held[: k + len(mark)]
        self.passed += k + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError(f"the archive ends {n - len(self.held)} bytes early")
        out = bytes(self.held[:n])
        del self.held[:n]
        self.passed += n
        return out


def parse_arc(data: bytes) -> Iterator[dict]:
    """Documents of an ARC file: the fields its version block declares, by lower-case name, the block, and the offset in what the file holds unzipped."""
    stream, fields = _Stream(data), None
    while (at := stream.passed, line := stream.upto(b"\n"))[1] is not None:
        if not line.strip():
            continue
        line = line.decode("latin-1").rstrip("\r")
        # white space that a url shouldn't have stays in it
        values = line.rsplit(" ", len(fields) - 1) if fields else line.split(" ")
        size = int(values[-1])
        block = stream.take(size)
        if fields is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            version = int(block.split(b" ", 1)[0])
            fields = block.split(b"\n")[1].decode("latin-1").lower().split()
            if version not in FIELDS or len(fields) != len(values):
                raise ValueError(f"ARC version {version} with {len(values)} fields is unknown")
            continue
        if len(values) != len(fields):
            raise ValueError(f"a header line has {len(values)} of {len(fields)} fields")
        yield dict(zip(fields, values)) | {"block": block, "at": at}


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers, by lower-case name, and block of each record of a WARC file."""
    stream = _Stream(data)
    while (head := stream.upto(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record begins with its WARC version")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")
        yield headers, block


def http_parts(block: bytes) -> tuple[dict, bytes] | None:
    """Headers, by lower-case name, and body of a block, or None if it isn't HTTP."""
    if not block.startswith(b"HTTP/"):
        return None
    mark = min((m for m in (b"\r\n\r\n", b"\n\n") if m in block), key=block.index, default=None)
    head, _, body = block.partition(mark) if mark else (block, b"", b"")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").splitlines()[1:])}, body


# --- converting ----------------------------------------------------------------------------------------------------


def _iso(date: str) -> str:
    """Archive dates of 8 to 14 digits in ISO form; others are the epoch."""
    d = date.ljust(14, "0") if re.fullmatch(r"\d{8,14}", date) else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _read_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch["path"].to_pylist(), batch["content"]):
            rows, size = [], 0
            for doc in parse_arc(data.as_py()):
                http = http_parts(doc["block"])
                headers, body = http or ({}, doc["block"])
                origin = headers.get(_ORIGIN.lower()) or f"{path.rpartition('/')[2]}:{doc['at']}"
                rows.append((origin, doc["url"], _iso(doc["archive-date"]), doc["ip-address"], doc["content-type"], doc["block"], http is not None, len(body), sha1_base32(body)))
                size += len(doc["block"])
                if size > 4 << 20:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)


_ARC = "origin string, url string, date string, ip string, kind string, block binary, http boolean, payload_bytes bigint, payload_digest string"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 5 + [pa.binary(), pa.bool_(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in _ARC.split(", ")])


def record_id(origin: str, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{origin} {url} {digest}')}>"


def _record(headers: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *headers, f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _warc_records(now: str, file_records: int):
    """now: when the files are made. The writer begins a file after every file_records values, and each begins with a warcinfo record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, info = TaskContext.get().partitionId(), 0, ""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if n % file_records == 0:
                    info = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{now} {part} {n}')}>"
                    about = b"software: glyphmill\r\nformat: WARC File Format 1.1\r\n"
                    out.append(_member(_record(["WARC-Type: warcinfo", f"WARC-Record-ID: {info}", f"WARC-Date: {now}", "Content-Type: application/warc-fields"], about)))
                    n += 1
                n += 1
                block, revisit = r["block"], r["first"] is not None
                if revisit:
                    block = block[: len(block) - r["payload_bytes"]]
                kind = "revisit" if revisit else "response" if r["http"] else "resource"
                headers = [
                    f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(r['origin'], r['url'], r['payload_digest'])}", f"WARC-Warcinfo-ID: {info}",
                    f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
                    f"Content-Type: {'application/http;msgtype=response' if r['http'] else r['kind']}", f"{_ORIGIN}: {r['origin']}",
                ]
                if revisit:
                    headers += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(r['first'], r['first_url'], r['payload_digest'])}", f"WARC-Refers-To-Target-URI: {r['first_url']}", f"WARC-Refers-To-Date: {r['first_date']}", f"{_ORIGIN}-Refers-To: {r['first']}", f"{_ORIGIN}-Bytes: {r['payload_bytes']}"]
                out.append(_member(_record(headers, block)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def convert_arcs(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = LEAST_BYTES, pattern: str = "*") -> None:
    """The ARC files under arc_path whose names fit pattern as WARC files under warc_path.

    A document's origin is the number that its HTTP header X-Origin-Record gives, else its file and offset. Of HTTP
    responses with equal payloads of least_bytes or more, that with the largest origin stays a response, numbers before
    places; the others become revisits of it. Those that tie for the largest number are all responses.
    """
    small_batches(spark)
    arcs = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(arc_path).select("path", "content")
    documents = cut(arcs.mapInArrow(_read_arcs, _ARC), "arc-documents")
    number = F.expr("try_cast(origin as bigint)")
    firsts = documents.where(F.col("http") & (F.col("payload_bytes") >= least_bytes)).groupBy("payload_digest").agg(F.max(F.struct(number.alias("n"), "origin", "url", "date")).alias("f"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # written first, so that a join with few of them, by their size, moves no payloads
    firsts = cut(firsts.select(F.col("payload_digest").alias("d"), "f"), "arc-firsts")
    joined = documents.join(firsts, F.col("http") & (F.col("payload_digest") == F.col("d")), "left")
    same = number.eqNullSafe(F.col("f.n")) & (number.isNotNull() | (F.col("origin") == F.col("f.origin")))
    revisits = F.col("f").isNotNull() & ~same
    records = joined.select("origin", "url", "date", "ip", "kind", "block", "http", "payload_bytes", "payload_digest", *[F.when(revisits, F.col(f"f.{c}")).alias(a) for c, a in (("origin", "first"), ("url", "first_url"), ("date", "first_date"))])
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    _archive(records.mapInArrow(_warc_records(now, FILE_RECORDS), "value binary"), warc_path, maxRecordsPerFile=FILE_RECORDS)
    drop(documents, firsts)


def _agrees(said: str | None, data: bytes) -> bool:
    """Whether data has the digest said; other algorithms than SHA-1 aren't checked."""
    name, _, value = (said or "").partition(":")
    return name.lower() != "sha1" or value.upper() in (sha1_base32(data), hashlib.sha1(data).hexdigest().upper())


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdigit() else None


def _read_warcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "date"]
    types = [pa.string(), pa.int64()] + [pa.string()] * 6
    for batch in batches:
        for data in batch["content"]:
            rows = []
            for headers, block in parse_warc(data.as_py()):
                kind, name = headers.get("warc-type"), headers.get("warc-record-id")
                if not _agrees(headers.get("warc-block-digest"), block):
                    raise ValueError(f"the block of {name} isn't what its digest says")
                if kind not in ("response", "revisit", "resource"):
                    continue
                http, body = (http_parts(block) if kind != "resource" else None) or ({}, block)
                said = headers.get("warc-payload-digest")
                size = len(body)
                if kind == "revisit":
                    size = _number(headers.get(f"{_ORIGIN}-bytes".lower()) or http.get("content-length"))
                elif not http.get("transfer-encoding") and not _agrees(said, body):  # encodings count in some archives
                    raise ValueError(f"the payload of {name} isn't what its digest says")
                digest = said.partition(":")[2] if said else None if kind == "revisit" else sha1_base32(body)
                rows.append((headers.get(_ORIGIN.lower()) or http.get(_ORIGIN.lower()), size, digest, kind, headers.get(f"{_ORIGIN}-refers-to".lower()) or headers.get("warc-refers-to"), name, headers.get("warc-target-uri"), headers.get("warc-date")))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_warcs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A row per response, revisit and resource of the WARC files under path whose names fit pattern, with digests checked where records have them.

    id is the origin of records that convert_arcs() made, else null. A revisit has no payload: payload_bytes are those
    that its headers declare, null if they don't. Other types of records are passed over.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content")
    return files.mapInArrow(_read_warcs, "id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, record_id string, target_uri string, date string")


def archive_pages(pages: DataFrame, warc_path: str, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """pages written as ARC, and that converted to WARC under warc_path.

    Ids are integers. A null payload is empty, and equal to other empty ones; a null url is '-'. Rows with equal ids
    and payloads are all responses if no larger id has the payload. No pages make no files with records. Pages with a
    null id have the origin None, are below all others, and read back with a null id. Other columns are not read.
    """
    spark = pages.sparkSession
    arc = new_path(spark, "arc")
    write_arc(pages, arc, id_col, url_col, html_col)
    convert_arcs(spark, arc, warc_path, least_bytes, "part-*")
    p = spark._jvm.org.apache.hadoop.fs.Path(arc)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def op9(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_warcs(spark, path, "part-*")
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return records.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "record_id")
