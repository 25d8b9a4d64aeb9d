"""WARC archives as a Spark data source, and deduplicated archives of pages.

``WarcDataSource`` (format "warc") writes records with their payloads and reads archives back. A writing
task makes one file; the driver's commit lists the files that count in a manifest with record-aligned offsets
every SPLIT_BYTES, so a task that ran twice leaves nothing that readers see. Reading plans one partition for
each such range; in a folder without a manifest, one for each .warc and .warc.gz file. Filters on record type and
header columns are pushed down, headers are parsed first, and the payload of a record that no filter keeps (or
of any record with option payload=false) is skipped and never decoded.

Compressed archives hold one gzip member a record, as the format asks. The member's header says in an extra field
how long the member is (RFC 1952 leaves such fields to the writer; other readers pass over them), so a reader
unpacks the head of a record and seeks to the next. In archives of others the members are unpacked to
their ends, and payloads that nobody asks for are dropped unseen.

Options: path (a folder that all executors reach; file:, hdfs:, s3: and what else pyarrow opens), payload,
compression (gzip or none).

Columns: of an HTTP response the payload is the body, unchunked; of other records it is the block; of revisits null.
full_payload_bytes is the payload's length, of a revisit or a skipped payload the header's word for it, else null.

Defined results: a null html is an empty payload; a null url leaves out WARC-Target-URI and reads back as
null; line breaks in a url are percent-encoded; rows that share the largest page_id of a payload are all
responses; a null page_id counts as smaller than any other; an empty table gives an archive without files; rows
that repeat page_id and payload repeat the record id.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import shared_path, workers_import_this

SPLIT_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
MANIFEST = "_manifest.json"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date that pages without one get, and the record id of a page.
UNDATED = "1970-01-01T00:00:00Z"
PAGE_ID = "urn:x-page:"
#: Our header field for the length of a payload, which a revisit does not hold.
PAYLOAD_LENGTH = "X-Full-Payload-Length"
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "date": "WARC-Date",
}
READ_SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", full_payload_bytes long, payload binary"


def opened(path: str):
    """File system and path of a folder named as Spark names it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, refers_to: str | None, gzip: bool = False) -> bytes:
    """One record; a revisit keeps digest and length of its payload but not the payload."""
    block = _http(payload) + (b"" if kind == "revisit" else payload)
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Target-URI", uri and uri.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        (PAYLOAD_LENGTH, str(len(payload))),
        ("WARC-Profile", REVISIT_PROFILE if kind == "revisit" else None),
        ("WARC-Refers-To", f"<{refers_to}>" if refers_to else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head if v is not None), f"Content-Length: {len(block)}", "", ""]
    written = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    return zipped(written) if gzip else written


def zipped(data: bytes) -> bytes:
    """One gzip member whose extra field "SL" holds the length of the member."""
    packer = zlib.compressobj(1, wbits=-15)
    body = packer.compress(data) + packer.flush()
    size = MEMBER_HEAD.size + len(body) + 8
    return MEMBER_HEAD.pack(0x1F, 0x8B, 8, 4, 0, 0, 255, 8, b"SL", 4, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


#: Fixed values, RFC 1952: magic, method, flag of the extra field, time, flags, system; length of the field, its name and length.
MEMBER_HEAD = struct.Struct("<BBBBIBBH2sHI")


@dataclass
class Written(WriterCommitMessage):
    file: str
    size: int
    splits: list[int]


class WarcWriter(DataSourceArrowWriter):
    """Rows record_type, record_id, target_uri, date, payload, refers_to; see ``record``."""

    def __init__(self, path: str, gzip: bool):
        self.path, self.gzip = path, gzip

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = opened(self.path)
        name, at, splits, out = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, 0, [0], None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.create_dir(folder, recursive=True)
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                if at - splits[-1] >= SPLIT_BYTES:
                    splits.append(at)
                data = record(row["record_type"], row["record_id"], row["target_uri"], row["date"], row["payload"] or b"", row["refers_to"], self.gzip)
                out.write(data)
                at += len(data)
        if out is not None:
            out.close()
        return Written(name if out is not None else "", at, splits)

    def commit(self, messages: list[Written]) -> None:
        files, folder = opened(self.path)
        files.create_dir(folder, recursive=True)
        known = listed(files, folder) or []
        with files.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(known + [[m.file, m.size, m.splits] for m in messages if m and m.file]).encode())

    def abort(self, messages: list[Written]) -> None:
        files, folder = opened(self.path)
        for m in messages:
            if m and m.file:
                files.delete_file(f"{folder}/{m.file}")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def listed(files: fs.FileSystem, folder: str) -> list[list] | None:
    """The manifest's files with sizes and splits; None without a manifest."""
    if files.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{folder}/{MANIFEST}") as written:
        return json.loads(written.read())


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):  # noqa: N802
        """Takes equality, IN, prefix and not-null tests on header columns; Spark does the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.tests.append((HEADERS[column].lower(), type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        files, folder = opened(self.path)
        written = listed(files, folder)
        if written is None:
            found = files.get_file_info(fs.FileSelector(folder, recursive=True))
            named = [(f.path[len(folder) :].lstrip("/"), f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".warc", ".warc.gz"))]
            written = [[name, size, [0]] for name, size in sorted(named) if size]
        return [Range(file, a, b) for file, size, splits in written for a, b in zip(splits, [*splits[1:], size], strict=True)]

    def kept(self, head: dict[str, str]) -> bool:
        for name, test, value in self.tests:
            own = head.get(name)
            if own is None or test == "EqualTo" and own != value or test == "In" and own not in value or test == "StringStartsWith" and not own.startswith(value):
                return False
        return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, folder = opened(self.path)
        rows, held = [], 0
        with files.open_input_file(f"{folder}/{partition.file}") as raw:
            raw.seek(partition.start)
            source = Buffered(raw)
            records = members(source, partition.end - partition.start) if partition.file.lower().endswith(".gz") else plain(source, partition.end - partition.start)
            for stream in records:
                head = headers(stream.until(b"\r\n\r\n"))
                length, payload = int(head["content-length"]), None
                full = int(head[PAYLOAD_LENGTH.lower()]) if PAYLOAD_LENGTH.lower() in head else None
                if not self.kept(head):
                    stream.skip(length + 4)
                    continue
                if self.payload and head.get("warc-type") != "revisit":
                    payload = body(head, stream.take(length))
                    full = len(payload)
                    stream.skip(4)
                else:
                    stream.skip(length + 4)
                rows.append([*(head.get(h.lower()) for h in HEADERS.values()), full, payload])
                held += len(payload or b"") + 200
                if held >= BATCH_BYTES:
                    yield batched(rows)
                    rows, held = [], 0
        if rows:
            yield batched(rows)


def plain(source: Buffered, size: int) -> Iterator[Buffered]:
    """The stream at each record of an archive that is not compressed."""
    while source.at < size:
        yield source


def members(source: Buffered, size: int) -> Iterator[Buffered]:
    """The unpacked stream at each record. Members that say their length are left without a look at what was not
    asked for; several records of one member follow each other in its stream."""
    while source.at < size:
        start, head = source.at, source.take(min(MEMBER_HEAD.size, size - source.at))
        fields_ = MEMBER_HEAD.unpack(head) if len(head) == MEMBER_HEAD.size else ()
        known = fields_[-1] if fields_ and fields_[3] == 4 and fields_[7:10] == (8, b"SL", 4) else None
        member = Member(source, head)
        stream = Buffered(member)
        if known:
            yield stream
            source.skip(start + known - source.at)
            continue
        while stream.more():
            yield stream


class Member:
    """Unpacked bytes of the gzip member that ``source`` is at; ``head`` are its first bytes."""

    def __init__(self, source: Buffered, head: bytes):
        self.source, self.unpack = source, zlib.decompressobj(31)
        self.out = self.unpack.decompress(head)
        source.back(self.unpack.unused_data)

    def read(self, n: int) -> bytes:
        """Some bytes, about ``n`` at most; none at the member's end."""
        while not self.out and not self.unpack.eof:
            given = self.source.some(4096)
            self.out = self.unpack.decompress(given)
            self.source.back(self.unpack.unused_data)
        out, self.out = self.out, b""
        return out


def body(head: dict[str, str], block: bytes) -> bytes:
    """The payload of a record: of HTTP messages what follows their header, in one piece."""
    if not head.get("content-type", "").lower().startswith("application/http"):
        return block
    before, mark, payload = block.partition(b"\r\n\r\n")
    if not mark:
        return b""
    if not re.search(rb"\r\ntransfer-encoding:[^\r]*\bchunked\b", before, re.IGNORECASE):
        return payload
    out, at = [], 0
    while m := CHUNK.match(payload, at):
        n = int(m[1], 16)
        if not n:
            break
        out.append(payload[m.end() : m.end() + n])
        at = m.end() + n + 2
    return b"".join(out) if out or CHUNK.match(payload) else payload


#: The line before a chunk of an HTTP body.
CHUNK = re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n")


def batched(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*HEADERS, "full_payload_bytes", "payload"])


class Buffered:
    """Forward reads over a file or member; of a seekable file, what is skipped beyond the buffer is never read."""

    def __init__(self, raw, size: int = 1 << 18):
        self.raw, self.size, self.have, self.pos, self.at = raw, size, b"", 0, 0

    def more(self) -> bool:
        """Whether bytes are left."""
        if self.pos == len(self.have):
            self.have, self.pos = self.raw.read(self.size), 0
        return self.pos < len(self.have)

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if not self.more():
                raise EOFError("a WARC record is cut short")
            part = self.have[self.pos : self.pos + n - have]
            self.pos += len(part)
            self.at += len(part)
            have += len(part)
            parts.append(part)
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def some(self, n: int) -> bytes:
        """Up to ``n`` bytes, one at least."""
        if not self.more():
            raise EOFError("a gzip member is cut short")
        return self.take(min(n, len(self.have) - self.pos))

    def back(self, data: bytes) -> None:
        """Takes back the last bytes that it gave."""
        n = len(data)
        if n <= self.pos:
            self.pos -= n
        else:
            self.have, self.pos = data + self.have[self.pos :], 0
        self.at -= n

    def skip(self, n: int) -> None:
        inside = min(n, len(self.have) - self.pos)
        self.pos += inside
        self.at += n
        if n > inside:
            if hasattr(self.raw, "seek"):
                self.raw.seek(self.raw.tell() + n - inside)
            else:
                self.drop(n - inside)

    def drop(self, n: int) -> None:
        """Unpacked bytes pass unseen; a member may end with its record's block."""
        while n > 0 and self.more():
            step = min(n, len(self.have) - self.pos)
            self.pos += step
            n -= step

    def until(self, mark: bytes) -> bytes:
        while (end := self.have.find(mark, self.pos)) < 0:
            more = self.raw.read(self.size)
            if not more:
                raise EOFError("a WARC header is cut short")
            self.have, self.pos = self.have[self.pos :] + more, 0
        return self.take(end + len(mark) - self.pos)


def headers(written: bytes) -> dict[str, str]:
    """Header fields by lower-case name; digests and ids without their marks."""
    lines = written[:-4].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    head, last = {}, ""
    for line in lines[1:]:
        if line[:1] in " \t" and last:  # a field that goes on
            head[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        head[last] = value.strip()
    for k in ("warc-record-id", "warc-refers-to"):
        if k in head:
            head[k] = head[k].removeprefix("<").removesuffix(">")
    if "warc-payload-digest" in head:
        head["warc-payload-digest"] = head["warc-payload-digest"].removeprefix("sha1:")
    return head


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip") == "gzip")


def register(spark: SparkSession) -> None:
    workers_import_this(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Records of pages. Light rows (page_id, digest) find the largest page_id of each payload; only the
    pairs (page, response) of the revisits meet the pages again, by page_id, so a payload that a third of
    the pages share puts no texts together."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    keys = base.filter(F.octet_length("payload") >= min_payload).select("page_id", F.sha1("payload").alias("sha1"))
    first = keys.groupBy("sha1").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1 AND response_id IS NOT NULL").select("sha1", "response_id")
    revisits = keys.join(first, "sha1").filter("page_id IS NULL OR page_id < response_id").select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "response_id").distinct()
    # A page_id may repeat with other payloads: the digest belongs to the key.
    joined = base.withColumn("_own", F.sha1("payload")).join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha1")), "left")
    return joined.select(
        F.when(F.col("response_id").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.concat(F.lit(PAGE_ID), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.col("_own")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(UNDATED).alias("date"),
        "payload",
        F.concat(F.lit(PAGE_ID), F.col("response_id").cast("string"), F.lit(":"), F.col("_own")).alias("refers_to"),
    )


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    register(records.sparkSession)
    records.write.format("warc").option("path", path).option("compression", compression).mode("append").save()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def base32(sha1: F.Column) -> F.Column:
    """Upper-case base32 of a hexadecimal SHA-1: eight groups of five hexadecimal digits are four letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = lambda k: F.conv(F.substring(sha1, 5 * k + 1, 5), 16, 10).cast("int")
    letter = lambda v, s: F.substring(F.lit(letters), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(letter(group(k), s) for k in range(8) for s in (15, 10, 5, 0)))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Digests and lengths of responses are worked out anew from the payloads that were read back; those of
    revisits come from their headers."""
    path = shared_path(spark, "warc")
    write(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    page = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) AS bigint)")
    back = read(spark, path)
    own = F.col("record_type") == "response"
    return back.select(
        page("record_id").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("full_payload_bytes")).alias("payload_bytes"),
        F.when(own, base32(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
