"""WARC archives as a Python data source of Spark: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition per file. Filters on the record type and on header columns are pushed down: the header of a record is parsed first, and the
payload of a record that fails is skipped. Our own files name the length of each compressed member in its gzip header, so a skipped record isn't even
inflated; members of other writers are inflated and thrown away. Files are opened through ``pyarrow.fs``, which knows local and shared stores.

Writing uses a file per task under a name of its own attempt; only files of successful tasks are moved into place at the commit.

Defined results: a null payload is an empty one; a null target is left out; control characters and spaces of a target are percent-encoded; an archive
folder without files gives no rows; other columns of the written rows are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)

from pairspan.session import fresh_path

SCHEMA = (
    "record_id string, warc_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_bytes long, "
    "content_length long, headers map<string,string>, payload binary"
)
HEADER_COLUMNS = {
    "record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
ARROW = pa.schema(
    [(c, pa.string()) for c in HEADER_COLUMNS]
    + [("payload_bytes", pa.int64()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)
LEAST_REVISIT = 100  # payload bytes from which equal payloads are stored once
READ_BYTES, INFLATE_BYTES, WINDOW_BYTES, BATCH_BYTES = 1 << 13, 1 << 16, 1 << 20, 4 << 20
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


# ---------------------------------------------------------------------------------------------------------------- writing


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field ``ML`` holds its whole length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"ML" + struct.pack("<HI", 4, 12 + 8 + len(body) + 8)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 8) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """One WARC record. A revisit keeps the length and digest of the whole payload in its header and stores only the response line and headers."""
    payload = row["payload"] or b""
    revisit = row["warc_type"] == "revisit"
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['warc_date'] or DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {len(payload)}",
    ]
    if row["target_uri"]:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["target_uri"]))
    if revisit:
        head += [f"WARC-Refers-To: <{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Written(WriterCommitMessage):
    def __init__(self, name: str) -> None:
        self.name = name


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(f"{root}/_attempts", recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{root}/_attempts/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(member(record(row)))
        return _Written(name)

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        if self.overwrite:
            for f in _files(store, root):
                store.delete_file(f)
        for k, m in enumerate(x for x in messages if x is not None):
            store.move(f"{root}/_attempts/{m.name}", f"{root}/part-{k:05d}-{m.name}")
        store.delete_dir(f"{root}/_attempts")

    def abort(self, messages: list) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/_attempts/{m.name}")


# ---------------------------------------------------------------------------------------------------------------- reading


def _files(store: fs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    inner = lambda p: p[len(root.rstrip("/")) + 1 :]
    return sorted(f.path for f in found if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path) and not re.search(r"(^|/)[_.]", inner(f.path)))


class _Source:
    """Bytes of one record of a file: plain, or one gzip member after the other. The file is read in windows."""

    def __init__(self, file, zipped: bool) -> None:
        self.file, self.zipped, self.at, self.size = file, zipped, 0, file.size()
        self.window, self.window_at = b"", 0

    def _next(self) -> bytes:
        """The next bytes of the file after those taken so far."""
        lo = self.at + self.taken
        if not self.window_at <= lo <= self.window_at + len(self.window) - READ_BYTES:  # a record's first bytes are never cut
            self.file.seek(lo)
            self.window, self.window_at = self.file.read(WINDOW_BYTES), lo
        got = self.window[lo - self.window_at :][:READ_BYTES]
        self.taken += len(got)
        return got

    def open(self) -> bool:
        """Go to the record that starts here; False at the end."""
        if self.at >= self.size:
            return False
        self.inflate, self.buffer, self.length, self.taken = zlib.decompressobj(31), b"", None, 0
        self.raw = self._next()
        if self.zipped and self.raw[3:4] == b"\x04" and self.raw[12:14] == b"ML":
            self.length = struct.unpack("<I", self.raw[16:20])[0]
        return True

    def more(self) -> bool:
        """Add bytes to the buffer; False if the record has no more."""
        if not self.zipped:
            new, self.raw = self.raw or self._next(), b""
            self.buffer += new
            return bool(new)
        if self.inflate.eof:
            return False
        self.raw = self.raw or self._next()
        new = self.inflate.decompress(self.raw, INFLATE_BYTES)
        ended = not self.raw and not new
        self.raw = self.inflate.unconsumed_tail
        self.buffer += new
        return not ended

    def header(self) -> bytes | None:
        while True:
            start = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
            end = self.buffer.find(b"\r\n\r\n", start)
            if end >= 0:
                self.body_at = end + 4
                return self.buffer[start:end]
            if not self.more():
                return None

    def block(self, n: int) -> bytes:
        parts, have = [self.buffer[self.body_at :]], len(self.buffer) - self.body_at
        while have < n:
            self.buffer = b""
            if not self.more():
                break
            parts.append(self.buffer)
            have += len(self.buffer)
        self.body_at, self.buffer = 0, b"".join(parts)
        return self.buffer[:n]

    def close(self, n: int, header_end: int) -> None:
        """Go past this record, whose block has n bytes, without decoding what is left of it."""
        if not self.zipped:
            self.at += header_end + n
        elif self.length:
            self.at += self.length
        else:
            while self.more():
                self.buffer = b""
            self.at += self.taken - len(self.inflate.unused_data)


def parse_header(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:  # folded
            out[last] += " " + line.strip()
            continue
        key, _, value = line.partition(":")
        last = key.strip().lower()
        out[last] = value.strip()
    return out


def column_of(headers: dict[str, str], name: str) -> str | None:
    value = headers.get(HEADER_COLUMNS[name])
    if value is not None and name in ("record_id", "refers_to"):
        value = value.strip("<>")
    if value is not None and name == "payload_digest":
        value = value.rpartition(":")[2].lower()
    return value


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.value = self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1 else None
            if name not in HEADER_COLUMNS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, "in", {f.value}))
            elif isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", f.value))
            else:
                self.tests.append((name, "there", None))

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            has = column_of(headers, name)
            if has is None or (kind == "in" and has not in value) or (kind == "prefix" and not has.startswith(value)):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.path)
        return [_File(f) for f in _files(store, root)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = _store(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.path) as file:
            source = _Source(file, partition.path.endswith(".gz"))
            while source.open():
                head = source.header()
                if head is None:
                    if source.buffer.strip(b"\r\n\0"):
                        raise ValueError(f"{partition.path}: no WARC header at byte {source.at}")
                    break
                headers = parse_header(head)
                n, header_end = int(headers.get("content-length", 0)), source.body_at
                if self.wanted(headers):
                    row = {c: column_of(headers, c) for c in HEADER_COLUMNS}
                    row |= {"content_length": n, "headers": list(headers.items()), "payload": None}
                    if self.payload:
                        block = source.block(n)
                        http = headers.get("content-type", "").startswith("application/http")
                        row["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
                    own = headers.get("x-payload-length")
                    row["payload_bytes"] = int(own) if own else len(row["payload"]) if self.payload else None
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                source.close(n, header_end)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` = false leaves all payloads undecoded and null."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ------------------------------------------------------------------------------------------------------------- operators


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Rows to write for ``pages`` (page_id, url, html): of equal payloads of ``least`` bytes or more the smallest page_id is the response.

    Only ids and digests meet by digest; the payloads are shuffled once, by their page. Rows with one page_id and one payload are one page.
    A null page_id can't be referred to: such a row is a response unless another page has its payload.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("target_uri"), html.alias("html"), F.sha2(html, 256).alias("payload_digest"))
    small = rows.where(F.octet_length("html") >= least).select("page_id", "payload_digest")
    first = small.groupBy(F.col("payload_digest").alias("d")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = small.join(first, small.payload_digest == first.d).where(~F.col("page_id").eqNullSafe(F.col("first")))
    later = later.select(F.col("page_id").alias("p"), "d", "first").distinct()
    met = rows.join(later, rows.page_id.eqNullSafe(later.p) & (rows.payload_digest == later.d), "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return met.select(
        urn("page_id").alias("record_id"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("warc_type"), "target_uri",
        F.lit(None).cast("string").alias("warc_date"), F.when(F.col("first").isNotNull(), urn("first")).alias("refers_to"), "payload_digest",
        F.octet_length("html").cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("content_length"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.col("html").cast("binary").alias("payload"),
    )


def write_archive(pages: DataFrame, path: str | None = None) -> str:
    """Write the archives into the shared folder (or ``path``) and return where they are."""
    spark = pages.sparkSession
    register(spark)
    path = path or fresh_path(spark, "warc")
    with_revisits(pages).write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` read back: responses by their payloads, revisits by their headers alone."""
    spark = pages.sparkSession
    path = write_archive(pages)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    full = read_archive(spark, path).where("warc_type = 'response'")
    full = full.select("record_id", "warc_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    again = read_archive(spark, path, payload=False).where("warc_type = 'revisit'")
    again = again.select("record_id", "warc_type", "refers_to", "payload_bytes", "payload_digest")
    both = full.unionAll(again)
    return both.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))
