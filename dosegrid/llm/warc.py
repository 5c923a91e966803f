"""WARC archives: a data source for reading and writing them, and archives of pages."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from dosegrid.session import broadcast_if_small, durable, scratch_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, "
    "payload_digest string, refers_to string, headers map<string,string>, "
    "content_length long, payload binary"
)
# Header fields of the format.
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
LENGTH, KIND = "Content-Length", "Content-Type"
_KNOWN = {name.lower(): name for name in (*FIELDS.values(), LENGTH, KIND)}
#: Name in ``headers`` for the HTTP head of a record, which stands before the payload in its block.
HTTP = "http"
VERSION = "WARC/1.1"
DONE = "_archives"
_CHUNK = 1 << 16


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address that Spark accepts."""
    if "://" not in path:
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (
        fs.LocalFileSystem(), path
    )


# A gzip member carries its own length, so that a reader can pass over it unread.
_EXTRA = "<2sHII"


def member(record: bytes, level: int = 1) -> bytes:
    """One record as a gzip member with its packed and its plain length in the header."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    packed = packer.compress(record) + packer.flush()
    extra = struct.calcsize(_EXTRA)
    size = 10 + 2 + extra + len(packed) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", extra)
    head += struct.pack(_EXTRA, b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + packed + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(headers: dict[str, str], payload: bytes) -> bytes:
    """One record in plain form."""
    lines = [VERSION, *(f"{k}: {_one_line(v)}" for k, v in headers.items() if v is not None)]
    lines.append(f"{LENGTH}: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


class _Plain:
    """A stream of bytes that can be read on and passed over."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        self.held = b""

    def more(self) -> bytes:
        return self.file.read(_CHUNK)

    def until(self, end: bytes) -> bytes | None:
        """What comes before ``end``; nothing where the stream is over."""
        parts, seen = bytearray(self.held), 0
        while (at := parts.find(end, max(0, seen - len(end)))) < 0:
            seen = len(parts)
            chunk = self.more()
            if not chunk:
                if parts.strip():
                    raise ValueError("cut off within a record")
                return None
            parts += chunk
        self.held = bytes(parts[at + len(end) :])
        return bytes(parts[:at])

    def read(self, n: int) -> bytes:
        parts = bytearray(self.held)
        while len(parts) < n:
            chunk = self.more()
            if not chunk:
                raise ValueError("cut off within a record")
            parts += chunk
        self.held = bytes(parts[n:])
        return bytes(parts[:n])

    def skip(self, n: int) -> None:
        """Pass over bytes by moving in the file, without reading them."""
        if n > len(self.held):
            self.file.seek(n - len(self.held), io.SEEK_CUR)
            self.held = b""
        else:
            self.held = self.held[n:]


class _Member(_Plain):
    """The plain bytes of one gzip member, unpacked as far as they are asked for."""

    def __init__(self, file: BinaryIO) -> None:
        super().__init__(file)
        self.start = file.tell()
        self.unpack = zlib.decompressobj(zlib.MAX_WBITS | 16)
        self.size = 0
        head = file.read(12 + struct.calcsize(_EXTRA))
        if len(head) == 12 + struct.calcsize(_EXTRA) and head[3] & 4:
            name, length, packed, _ = struct.unpack(_EXTRA, head[12:])
            self.size = packed if name == b"sl" and length == 8 else 0
        file.seek(self.start)

    def more(self) -> bytes:
        out = b""
        while not out and not self.unpack.eof:
            packed = self.unpack.unconsumed_tail or self.file.read(8192)
            if not packed:
                break
            out = self.unpack.decompress(packed, _CHUNK)
        return out

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held = self.more()
            if not self.held:
                raise ValueError("cut off within a record")
        self.held = self.held[n:]

    def close(self) -> None:
        """Go to the next member, by the stored length."""
        self.file.seek(self.start + self.size)


class _Members(_Plain):
    """The plain bytes of all gzip members on from here, one after another."""

    def __init__(self, file: BinaryIO) -> None:
        super().__init__(file)
        self.unpack = zlib.decompressobj(zlib.MAX_WBITS | 16)

    def more(self) -> bytes:
        out = b""
        while not out:
            packed = self.unpack.unconsumed_tail or self.unpack.unused_data or self.file.read(_CHUNK)
            if not packed:
                break
            if self.unpack.eof:
                if not packed.strip(b"\0"):  # padding behind the last member
                    break
                self.unpack = zlib.decompressobj(zlib.MAX_WBITS | 16)
            out = self.unpack.decompress(packed, _CHUNK)
        return out

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held = self.more()
            if not self.held:
                raise ValueError("cut off within a record")
        self.held = self.held[n:]


Head = dict[str, str]


def _head(stream: _Plain) -> Head | None:
    """Header of the next record; names that are known are spelt as the format has them."""
    text = b""
    while not text.strip():  # the blank lines behind the record before
        text = stream.until(b"\r\n\r\n")
        if text is None:
            return None
    version, *lines = text.decode("utf-8", "replace").strip().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    head = {}
    for line in lines:
        name, _, value = line.partition(":")
        name = name.strip()
        head[_KNOWN.get(name.lower(), name)] = value.strip()
    return head


def _taken(
    stream: _Plain, wanted: Callable[[Head], bool], payloads: bool
) -> Iterator[tuple[Head, bytes | None]]:
    while (head := _head(stream)) is not None:
        size, take = int(head.get(LENGTH, 0)), wanted(head)
        payload = stream.read(size) if take and payloads else None
        if payload is None:
            stream.skip(size)
        if take:
            yield head, payload


def http_body(head: Head, block: bytes) -> tuple[str | None, bytes]:
    """HTTP head and payload of a block, if the record says that it holds such a message."""
    if not head.get(KIND, "").lower().startswith("application/http"):
        return None, block
    text, found, body = block.partition(b"\r\n\r\n")
    return (text.decode("utf-8", "replace"), body) if found else (None, block)


def records(
    file: BinaryIO, wanted: Callable[[Head], bool], payloads: bool
) -> Iterator[tuple[Head, bytes | None]]:
    """Records whose header is wanted. Other payloads are passed over, not decoded.

    Members that carry their length are passed over as a whole. Others are
    unpacked, however many records one member holds, or members a record takes.
    """
    start = file.read(2)
    file.seek(0)
    if start != b"\x1f\x8b":
        yield from _taken(_Plain(file), wanted, payloads)
        return
    while file.read(1):
        file.seek(-1, io.SEEK_CUR)
        stream = _Member(file)
        if not stream.size:
            yield from _taken(_Members(file), wanted, payloads)
            return
        head = _head(stream)
        if head is not None and wanted(head):
            yield head, stream.read(int(head.get(LENGTH, 0))) if payloads else None
        stream.close()


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class WarcReader(DataSourceReader):
    """Reads archives file by file; tests on header fields are made before a payload is touched.

    The payload of a record that holds an HTTP message is its body; the head is
    in ``headers`` then, under ``http``. content_length is that of the block.
    """

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path = options["path"]
        self.bytes = int(options.get("partitionBytes", 64 << 20))
        self.columns = schema.names
        self.payloads = options.get("payloads", "true") == "true"
        self.tests: list[tuple[str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership tests on header columns are taken over."""
        for test in filters:
            name = test.attribute[0] if isinstance(test, (EqualTo, In)) else None
            if name in FIELDS and len(test.attribute) == 1:
                values = (test.value,) if isinstance(test, EqualTo) else tuple(test.value)
                self.tests.append((FIELDS[name], values))
            else:
                yield test

    def partitions(self) -> Sequence[InputPartition]:
        """Whole files, small ones together up to the size of a partition."""
        store, path = _place(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            return [_Files([path])]
        names = None
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        lists = [f.path for f in found if f.base_name.startswith(DONE)]
        if lists:  # archives of finished jobs only
            names = set()
            for each in lists:
                with store.open_input_stream(each) as lines:
                    names.update(lines.read().decode().split())
        files = [
            f
            for f in found
            if f.type == fs.FileType.File
            and f.base_name.endswith((".warc", ".warc.gz"))
            and (names is None or f.base_name in names)
        ]
        groups: list[_Files] = []
        size = self.bytes
        for file in sorted(files, key=lambda f: f.path):
            if size + file.size > self.bytes:
                groups.append(_Files([]))
                size = 0
            groups[-1].paths.append(file.path)
            size += file.size
        return groups or [_Files([])]

    def _wanted(self, head: Head) -> bool:
        return all(head.get(field) in values for field, values in self.tests)

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = _place(self.path)
        payloads = self.payloads and "payload" in self.columns
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for head, payload in records(file, self._wanted, payloads):
                    row: dict[str, Any] = {k: head.get(v) for k, v in FIELDS.items()}
                    row["content_length"] = int(head.get(LENGTH, 0))
                    http, row["payload"] = http_body(head, payload) if payload else (None, payload)
                    row["headers"] = head if http is None else head | {HTTP: http}
                    yield tuple(row[c] for c in self.columns)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Writes one archive after another per task, each up to a size.

    A reader takes the archives that the job has listed at its end, so what
    failed or repeated tasks have left behind is never read.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.bytes = int(options.get("archiveBytes", 256 << 20))
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.job = uuid.uuid4().hex[:12]
        store, path = _place(self.path)
        store.create_dir(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = _place(self.path)
        task = TaskContext.get().taskAttemptId()
        names: list[str] = []
        out, size = None, self.bytes
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    record = self._record(row)
                    if size >= self.bytes:
                        if out:
                            out.close()
                        ending = "warc.gz" if self.gzip else "warc"
                        names.append(f"part-{self.job}-{task}-{len(names)}.{ending}")
                        out, size = store.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                    out.write(record)
                    size += len(record)
        finally:
            if out:
                out.close()
        return _Written(names)

    def _record(self, row: dict[str, Any]) -> bytes:
        headers = dict(row.get("headers") or [])
        headers |= {v: row[k] for k, v in FIELDS.items() if row.get(k) is not None}
        headers.pop(LENGTH, None)
        http, payload = headers.pop(HTTP, None), row.get("payload") or b""
        block = payload if http is None else http.encode() + b"\r\n\r\n" + payload
        record = record_bytes(headers, block)
        return member(record) if self.gzip else record

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _place(self.path)
        names = [n for m in messages if m for n in m.names]
        with store.open_output_stream(f"{path}/{DONE}-{self.job}", compression=None) as out:
            out.write("\n".join(names).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Unlisted archives are never read."""


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


LEAST_BYTES = 1000
_PAGE = "urn:page:"
_SIZE = "WARC-Payload-Length"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def page_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One WARC record per page.

    Of the pages with one payload of ``least_bytes`` or more, the one with the
    largest id keeps it; the others become revisits of that page, with the
    digest and the length of the payload but not the payload. Only digests and
    ids move to find them; the bodies then meet their verdict by page.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    page = F.col("page_id").cast("long")
    hashed = pages.select(page.alias("page_id"), "url", payload.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")}
    )
    long_ones = hashed.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull())
    ids = long_ones.select("page_id", "digest")
    owners = (
        ids.groupBy("digest")
        .agg(F.max("page_id").alias("owner"), F.min("page_id").alias("other"))
        .where("owner > other")
        .drop("other")
    )
    # Few pages are revisits; where their list is small, the bodies stay where they are.
    revisits = broadcast_if_small(
        durable(ids.join(owners, "digest").where("page_id < owner").distinct())
    )
    again = F.col("owner").isNotNull()
    return (
        hashed.join(revisits, ["page_id", "digest"], "left")
        .select(
            F.concat(F.lit(f"<{_PAGE}"), F.col("page_id"), F.lit(">")).alias("record_id"),
            F.when(again, "revisit").otherwise("response").alias("record_type"),
            F.col("url").alias("target_uri"),
            F.lit("1970-01-01T00:00:00Z").alias("date"),
            F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
            F.when(again, F.concat(F.lit(f"<{_PAGE}"), F.col("owner"), F.lit(">"))).alias("refers_to"),
            F.map_concat(
                F.create_map(F.lit(_SIZE), F.col("size").cast("string")),
                F.when(again, F.create_map(F.lit("WARC-Profile"), F.lit(_PROFILE))).otherwise(
                    F.create_map().cast("map<string,string>")
                ),
            ).alias("headers"),
            F.when(~again, F.col("payload")).alias("payload"),
        )
    )


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the records of some pages as archives below ``path``."""
    register(pages.sparkSession)
    writer = page_records(pages).write.format("warc").option("compression", compression)
    writer.mode("append").save(path)


def _page_of(column: str) -> Column:
    return F.regexp_extract(column, f"^<{_PAGE}(-?[0-9]+)>$", 1).try_cast("long")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of archives by :func:`write_archives`; a payload is held against its digest.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to,
    url. Of a response, size and digest are those of the bytes read; of a
    revisit, those of its header, and its payload is not there to decode.
    """
    register(spark)
    archives = spark.read.format("warc").load(path)
    headers = spark.read.format("warc").option("payloads", "false").load(path)
    page, url = _page_of("record_id"), F.col("target_uri").alias("url")
    said = F.regexp_replace("payload_digest", "^sha1:", "")
    body = archives.where("record_type = 'response'")
    seen = F.sha1("payload")
    wrong = F.raise_error(F.concat(F.lit("digest does not fit in "), F.col("record_id")))
    responses = body.select(
        page.alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(seen == said, seen).otherwise(wrong).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
        url,
    )
    heads = headers.where("record_type = 'revisit'").select(
        page.alias("page_id"),
        F.element_at("headers", _SIZE).cast("long").alias("payload_bytes"),
        said.alias("payload_digest"),
        "record_type",
        _page_of("refers_to").alias("refers_to"),
        url,
    )
    return responses.union(heads)


def through_archives(pages: DataFrame, compression: str = "gzip") -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read them back; see :func:`read_pages`.

    A null html is an empty payload; a null url is left out of the header. Pages
    of less than the least size are always responses, and so are pages without
    an id, which read back with a null page_id. Rows with equal ids and
    payloads share their type. Other columns are not read.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path, compression)
    return read_pages(spark, path)
