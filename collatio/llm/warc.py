"""WARC archives as a Python data source.

Writing: every task writes archives of gzip members, one for each record, and the driver commits the list of files, so
archives of failed or repeated tasks are never read. A member's gzip header has a field with the member's length.

Reading: the driver plans partitions: of archives written here parts that begin at records, by the places that their
writer listed, of others whole files. A partition parses the headers of each record first; predicates on
headers (record type, id, target, digest) are pushed down to it, and the payload of a record that fails one, or whose
type is not in the option ``payloads``, is skipped by the member's length without being inflated (archives of other
writers, without that field, are inflated in pieces and thrown away).

Options: ``path``; ``payloads``: record types whose payload is decoded, comma-separated (default ``response``; ``none``);
``archive_bytes``: size at which a task begins another archive; ``partition_bytes``: size of the parts. Paths are those that pyarrow can open (file, hdfs, s3, gs).

Defined results: null payloads count as empty, null targets and ids are left out of the headers and read as null;
repeated records are written and read each; an archive without records, or an empty folder, gives no rows.
"""

from __future__ import annotations

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
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import all_cores, bounded_batches, shared_path, stored

SCHEMA = (
    "record_id string, warc_type string, target_uri string, payload_digest string, refers_to string, "
    "payload_length bigint, content_type string, payload binary"
)
HEADERS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
LENGTH = "X-Payload-Length"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"  # the tables hold no date of capture
_MANIFEST = "_archives-"
PARTITION_BYTES = 32 << 20
_FIELD = b"CL"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it."""
    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}")


def member(data: bytes, level: int = 3) -> bytes:
    """One gzip member whose header says how long it is."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = _FIELD + struct.pack("<HQ", 8, size)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict) -> bytes:
    """A record's bytes: WARC headers, HTTP headers and, for all but revisits, the payload."""
    payload, kind = row["payload"] or b"", row["warc_type"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {row['content_type'] or 'text/html; charset=utf-8'}\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"{LENGTH}: {row['payload_length']}"]
    for column in ("record_id", "target_uri", "payload_digest", "refers_to"):
        if row[column] is not None:
            lines.append(f"{HEADERS[column]}: {_clean(row[column])}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {IDENTICAL}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Archives(WriterCommitMessage):
    files: dict[str, list[int]]  # of each archive the places at which a reader may begin, and its size


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.limit = options["path"].rstrip("/"), int(options.get("archive_bytes", 256 << 20))
        self.part = int(options.get("partition_bytes", PARTITION_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        files: dict[str, list[int]] = {}
        out, size, places = None, 0, []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name, size, places = f"{uuid.uuid4().hex}.warc.gz", 0, [0, 0]  # a new name for every attempt
                        files[name], out = places, store.open_output_stream(f"{root}/{name}", compression=None)
                    if size - places[-2] >= self.part:
                        places.insert(-1, size)
                    data = member(record(row))
                    out.write(data)
                    size += len(data)
                    places[-1] = size
                    if size >= self.limit:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Archives(files)

    def commit(self, messages: list[Archives | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        files = {name: places for m in messages if m for name, places in m.files.items()}
        with store.open_output_stream(f"{root}/{_MANIFEST}{uuid.uuid4().hex}.json") as out:  # its own: writers do not meet
            out.write(json.dumps(files, sort_keys=True).encode())

    def abort(self, messages: list[Archives | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            for f in m.files if m else ():
                store.delete_file(f"{root}/{f}")


def _committed(store: fs.FileSystem, listed: dict[str, fs.FileInfo]) -> dict[str, list[int]] | None:
    """Of each committed archive the places at which a reader may begin, and its size; None where no list is."""
    lists = [i.path for name, i in sorted(listed.items()) if name.startswith(_MANIFEST)]
    out: dict[str, list[int]] = {}
    for path in lists:
        with store.open_input_stream(path) as f:
            out |= json.loads(f.read())
    return out if lists else None


@dataclass
class Span:
    """What one task reads of an archive; without an end all of it."""

    path: str
    begin: int = 0
    end: int | None = None


@dataclass
class Files(InputPartition):
    spans: list[Span]


class Part:
    """The bytes of a file from one place to another."""

    def __init__(self, raw, begin: int, end: int | None):
        self.raw, self.end = raw, end
        raw.seek(begin)

    def read(self, n: int) -> bytes:
        return self.raw.read(n if self.end is None else max(0, min(n, self.end - self.raw.tell())))

    def seek(self, at: int) -> None:
        self.raw.seek(at if self.end is None else min(at, self.end))

    def tell(self) -> int:
        return self.raw.tell()


class Inflated:
    """Reads one record at a time of an archive, compressed by member or not."""

    def __init__(self, raw, piece: int = 1 << 16):
        self.raw, self.piece = raw, piece
        self.buffer, self.ended = b"", False

    def _fill(self, least: int) -> bool:
        while len(self.buffer) < least and not self.ended:
            more = self.raw.read(max(self.piece, least - len(self.buffer)))
            self.ended = not more
            self.buffer += more
        return len(self.buffer) >= least

    def records(self, wanted) -> Iterator[tuple[dict, bytes | None]]:
        """(headers, block or None): ``wanted`` says by the headers 0 to drop a record, 1 for headers alone, 2 for its block."""
        while self._fill(2) or self.buffer:
            yield from self._member(wanted) if self.buffer[:2] == b"\x1f\x8b" else self._plain(wanted)

    def _plain(self, wanted) -> Iterator[tuple[dict, bytes | None]]:
        skip = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
        if skip:
            self.buffer = self.buffer[skip:]
            return
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._fill(len(self.buffer) + 1):
                self.buffer = b""  # cut off within the headers
                return
        headers = parse_headers(self.buffer[:end])
        self.buffer = self.buffer[end + 4 :]
        length, want = int(headers.get("content-length", 0)), wanted(headers)
        if want == 2:
            self._fill(length)
            block, self.buffer = self.buffer[:length], self.buffer[length:]
            yield headers, block
            return
        if length > len(self.buffer):
            self.raw.seek(self.raw.tell() + length - len(self.buffer))
            self.buffer = b""
        else:
            self.buffer = self.buffer[length:]
        if want:
            yield headers, None

    def _member(self, wanted) -> Iterator[tuple[dict, bytes | None]]:
        self._fill(24)
        size = None
        if self.buffer[3] & 4 and self.buffer[12:14] == _FIELD:
            size = struct.unpack("<Q", self.buffer[16:24])[0]
        inflate, text = zlib.decompressobj(31), b""
        used = 0  # bytes of this member handed to the inflater
        while (end := text.find(b"\r\n\r\n")) < 0 and not inflate.eof:
            if not self._fill(used + 1):
                break
            given = self.buffer[used : used + 1024]
            used += len(given)
            text += inflate.decompress(given)
        if end < 0:
            self.buffer = self._after(inflate, used, size)
            return
        headers = parse_headers(text[:end])
        want = wanted(headers)
        if want < 2 and size is not None:  # the rest stays compressed
            if size > len(self.buffer):
                self.raw.seek(self.raw.tell() + size - len(self.buffer))
                self.buffer = b""
            else:
                self.buffer = self.buffer[size:]
            if want:
                yield headers, None
            return
        parts = [text[end + 4 :]]
        if size is not None and want == 2:
            self._fill(size)
            parts.append(inflate.decompress(self.buffer[used:size]))
            used = size
            self.buffer = self.buffer[size:]
        else:
            while not inflate.eof and self._fill(used + 1):
                given = self.buffer[used : used + self.piece]
                self.buffer, used = self.buffer[used + len(given) :], 0
                more = inflate.decompress(given)
                if want == 2:
                    parts.append(more)
            self.buffer = inflate.unused_data + self.buffer[used:] if inflate.eof else b""
        if want:
            yield headers, b"".join(parts)[: int(headers.get("content-length", 0))] if want == 2 else None

    def _after(self, inflate, used: int, size: int | None) -> bytes:
        return self.buffer[size:] if size is not None and size <= len(self.buffer) else inflate.unused_data + self.buffer[used:] if inflate.eof else b""


def parse_headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payloads = {x.strip() for x in options.get("payloads", "response").split(",")} - {"none", ""}
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and column != "content_type" and isinstance(f, (EqualTo, In)):
                self.tests.append((HEADERS[column].lower(), (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = opened(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [Files([Span(root)])]
        listed = {i.base_name: i for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True))}
        committed = _committed(store, listed)
        if committed is None:  # of another writer: whole files
            found = [(Span(i.path), i.size) for name, i in sorted(listed.items()) if re.search(r"\.warc(\.gz)?$", name)]
        else:
            found = [(Span(f"{root}/{name}", a, b), b - a) for name, places in sorted(committed.items()) for a, b in zip(places, places[1:])]
        out: list[Files] = []
        size = self.partition_bytes
        for span, n in found:
            if size >= self.partition_bytes:
                out.append(Files([]))
                size = 0
            out[-1].spans.append(span)
            size += n
        return out or [Files([])]  # without any partition Spark would read one of its own making

    def _wanted(self, headers: dict[str, str]) -> int:
        for name, values in self.tests:
            if headers.get(name) not in values:
                return 0
        return 2 if headers.get("warc-type") in self.payloads else 1

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        schema = pa.schema([pa.field(n, pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string()) for n in (x.split()[0] for x in SCHEMA.split(", "))])
        rows, size = [], 0
        for span in partition.spans:
            with store.open_input_file(span.path) as raw:
                for headers, block in Inflated(Part(raw, span.begin, span.end)).records(self._wanted):
                    head, _, payload = block.partition(b"\r\n\r\n") if block is not None else (b"", b"", None)
                    inner = parse_headers(head)
                    row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
                    length = headers.get(LENGTH.lower())
                    row |= {"content_type": inner.get("content-type"), "payload": payload, "payload_length": int(length) if length is not None else None}
                    rows.append(row)
                    size += len(payload or b"")
                    if len(rows) >= 512 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only ever added; write to a new path")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bounded_batches(spark)


def to_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least: int = 1000) -> DataFrame:
    """Records (see SCHEMA) of pages. Of records with equal payloads of at least ``least`` bytes that with the largest key
    is the response and the others revisit it; rows that repeat the largest key are responses each.

    Which record revisits which is found on keys and digests alone; the pages then meet only their own key and digest, so
    a payload that many pages have is no hot key."""
    payload = F.coalesce(F.encode(F.col(body), "UTF-8"), F.lit(b""))
    rows = all_cores(pages.select(F.col(key).alias("k"), F.col(url).alias("target_uri"), payload.alias("payload"))).withColumns({"digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("bigint")})
    slim = pages.select(F.col(key).alias("k"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    keepers = slim.groupBy("digest").agg(F.max("k").alias("keeper"), F.min("k").alias("low")).where("low <> keeper").select("digest", "keeper")
    again = stored(slim.select("k", "digest").join(keepers, "digest").where("k <> keeper").distinct(), "revisits")
    found = rows.join(again, ["k", "digest"], "left")
    revisit = F.col("keeper").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return found.select(
        urn(F.col("k")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("warc_type"), "target_uri", F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        F.when(revisit, urn(F.col("keeper"))).alias("refers_to"), "payload_length", F.lit(None).cast("string").alias("content_type"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, path: str | None = None) -> str:
    """Writes records to archives under a new path of the shared folder (or the given one) and returns it."""
    register(records.sparkSession)
    path = path or shared_path(records.sparkSession, "warc")
    records.write.format("warc").mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, payloads: str = "response") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payloads", payloads).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of responses are those of the payload that was read, of revisits those that the headers state.
    """
    back = read(pages.sparkSession, write(to_records(pages)))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("bigint")
    here = F.col("payload").isNotNull()
    return back.select(
        page(F.col("record_id")).alias("page_id"), F.when(here, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(here, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"), F.col("warc_type").alias("record_type"), page(F.col("refers_to")).alias("refers_to"), F.col("target_uri").alias("url"),
    )
