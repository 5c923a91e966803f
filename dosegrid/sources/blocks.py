"""Block gzip: text files of gzip members that say how long they are.

A file is cut into byte ranges, and each range is unpacked by a task of its own,
so that one large ``.vcf.gz`` is read by many. Lines are those of a plain read.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urlsplit
from uuid import uuid4

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this module travel with their jobs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Compressed bytes that one task unpacks.
RANGE_BYTES = 32 << 20
#: Unpacked bytes that are turned into rows at a time.
BATCH_BYTES = 4 << 20

# Fixed values of the format: start of a member with an extra field, largest member, text bytes
# that a writer puts into one, and the empty member that ends a file.
_START = b"\x1f\x8b\x08\x04"
_LARGEST = 1 << 16
_TEXT_BYTES = 0xFF00
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")

_CANNOT_OPEN = (OSError, ValueError, NotImplementedError, ImportError)


def open_input(uri: str):
    """Seekable file of a path or URI; stores other than the local disk go through Arrow."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path) if parts.scheme else uri, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(unquote(uri.replace("s3a://", "s3://", 1)))
    return system.open_input_file(path)


def member_size(head: bytes) -> int | None:
    """Bytes of the member that begins with ``head``, if it is one that tells."""
    if len(head) < 18 or not head.startswith(_START):
        return None
    extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
    while len(extra) >= 4:
        (length,) = struct.unpack_from("<H", extra, 2)
        if extra.startswith(b"BC") and length == 2 and len(extra) >= 6:
            return struct.unpack_from("<H", extra, 4)[0] + 1
        extra = extra[4 + length :]
    return None


def _is_block_gzip(uri: str) -> bool:
    """False also for a file that cannot be opened here; it is left to Spark's reader."""
    try:
        with open_input(uri) as file:
            return member_size(file.read(_LARGEST)) is not None
    except _CANNOT_OPEN:
        return False


def _unpacks(member: bytes) -> bool:
    try:
        zlib.decompress(member, 31)  # checks length and checksum
    except zlib.error:
        return False
    return True


def _first_member(file, start: int, size: int) -> int:
    """Place of the first member at or after ``start``; ``size`` if there is none.

    The sign of a start may also turn up within packed data, so a member has to
    be whole, and followed by another one or by the end of the file.
    """
    file.seek(start)
    window = file.read(3 * _LARGEST)
    at = window.find(_START)
    while at >= 0 and at <= _LARGEST:
        length = member_size(window[at : at + _LARGEST])
        if length:
            after = start + at + length
            follows = window[at + length : at + length + _LARGEST]
            if (after == size or member_size(follows) is not None) and _unpacks(window[at : at + length]):
                return start + at
        at = window.find(_START, at + 1)
    return size


def _members(file, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of all members from ``start`` on."""
    at, held, place = start, b"", 0
    file.seek(start)
    while at < size:
        if len(held) - place < _LARGEST:
            held, place = held[place:] + file.read(1 << 20), 0
        length = member_size(held[place : place + _LARGEST])
        if length is None or length > len(held) - place:
            raise ValueError(f"broken block at byte {at}")
        yield at, zlib.decompress(held[place : place + length], 31)
        at, place = at + length, place + length


def _range_text(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """Whole lines that belong to a range, in pieces that end with a line.

    A range has the lines that begin after the first line break of its first
    member, up to the first line break after its last member; the first range
    also has the first line.
    """
    own = start == 0
    held: list[bytes] = []
    n = 0
    for at, text in _members(file, _first_member(file, start, size), size):
        if not own:
            if at >= end:
                return  # a line of an earlier range fills this one
            _, found, text = text.partition(b"\n")
            own = bool(found)
            if not own:
                continue
        if at >= end:
            line, found, _ = text.partition(b"\n")
            held.append(line + found)
            if found:
                break
            continue
        cut = text.rfind(b"\n") + 1
        if cut and n + cut >= BATCH_BYTES:
            yield b"".join([*held, text[:cut]])
            held, n, text = [], 0, text[cut:]
        held.append(text)
        n += len(text)
    yield b"".join(held)


def _read_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with open_input(row["source"]) as file:
                for text in _range_text(file, row["start"], row["end"], row["size"]):
                    lines = text.splitlines()  # of bytes: at \n, \r and \r\n
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["source"]] * len(lines), pa.string()),
                            pa.array(lines, pa.binary()).cast(pa.string(), safe=False),
                        ],
                        ["source", "value"],
                    )


def _probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = [_is_block_gzip(uri) for uri in batch.column("source").to_pylist()]
        yield batch.append_column("blocks", pa.array(kinds, pa.bool_()))


def _first_line(uri: str) -> str | None:
    """First line that is not empty; nothing if there is none, or the file cannot be opened here."""
    try:
        with open_input(uri) as file:
            text, unpack = b"", None
            while more := file.read(1 << 16):
                if unpack is None:
                    unpack = zlib.decompressobj(47) if uri.endswith((".gz", ".bgz")) else False
                if unpack:
                    data = more
                    more = unpack.decompress(data)
                    while unpack.eof and unpack.unused_data:  # the next member
                        data, unpack = unpack.unused_data, zlib.decompressobj(47)
                        more += unpack.decompress(data)
                text = (text + more).lstrip(b"\r\n")
                if b"\n" in text or b"\r" in text:
                    break
            return text.splitlines()[0].decode(errors="replace") if text else None
    except (*_CANNOT_OPEN, zlib.error):
        return None


def _first_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [_first_line(uri) for uri in batch.column("source").to_pylist()]
        yield batch.append_column("value", pa.array(lines, pa.string()))


def first_lines(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(source, value): the first line of each file that has one.

    Only the start of a file is read. What cannot be opened outside Spark, or
    is packed in another way than gzip, is read by Spark as a whole.
    """
    if not uris:
        return spark.createDataFrame([], "source string, value string")
    paths = [escaped(u) for u in uris]
    listed = spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("source")
    )
    heads = listed.mapInArrow(_first_lines, "source string, value string").collect()  # a row for each file
    unread = [f.source for f in heads if f.value is None]
    found = spark.createDataFrame([f for f in heads if f.value is not None], "source string, value string")
    if not unread:
        return found
    place = F.col("_metadata.file_path")
    text = spark.read.text(paths).where(place.isin(unread) & (F.length("value") > 0)).select(
        place.alias("source"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth"), "value"
    )
    first = F.min_by("value", F.struct("at", "nth")).alias("value")
    return found.union(text.groupBy("source").agg(first))


def block_files(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(source, size) of the files that are block gzip; each is looked at by a task."""
    sizes = spark.read.format("binaryFile").load([escaped(u) for u in uris]).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_size").alias("size")
    )
    return sizes.mapInArrow(_probe, "source string, size long, blocks boolean").where("blocks").drop("blocks")


def escaped(uri: str) -> str:
    """A listed URI as a path to read: decoded, and signs of patterns as themselves."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in unquote(uri))


def read_blocks(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(source, value): all lines of block gzip files (source, size), a task for each range.

    Ranges are dealt out as rows of an RDD: the few bytes of a list of ranges, once it was shuffled,
    would pass for the size of the lines, and adaptive execution would broadcast those in a join.
    """
    start = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.select("source", "size", F.explode(start).alias("start")).select(
        "source", "start", (F.col("start") + range_bytes).alias("end"), "size"
    )
    tasks = max(1, ranges.count())
    dealt = files.sparkSession.createDataFrame(ranges.repartition(tasks).rdd, ranges.schema)
    return dealt.mapInArrow(_read_ranges, "source string, value string")


class _Writer:
    """One block gzip file, visible under its name when it is whole."""

    def __init__(self, folder: str, name: str) -> None:
        parts = urlsplit(folder)
        self.system = None
        if parts.scheme in ("", "file"):
            self.folder = unquote(parts.path) if parts.scheme else folder
            os.makedirs(self.folder, exist_ok=True)
        else:
            from pyarrow import fs

            self.system, self.folder = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
            self.system.create_dir(self.folder, recursive=True)
        self.path = f"{self.folder}/{name}"
        self.hidden = f"{self.folder}/.{name}-{uuid4().hex}"
        self.file = (
            self.system.open_output_stream(self.hidden) if self.system else open(self.hidden, "wb")
        )
        self.held = b""

    def write(self, text: bytes) -> None:
        text = self.held + text
        whole = len(text) - len(text) % _TEXT_BYTES
        for at in range(0, whole, _TEXT_BYTES):
            self.file.write(pack_member(text[at : at + _TEXT_BYTES]))
        self.held = text[whole:]

    def close(self) -> None:
        if self.held:
            self.file.write(pack_member(self.held))
        self.file.write(_END)
        self.file.close()
        if self.system:
            self.system.move(self.hidden, self.path)
        else:
            os.replace(self.hidden, self.path)


def pack_member(text: bytes) -> bytes:
    """One member that tells its own size."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(text) + packer.flush()
    if len(packed) + 26 > _LARGEST:  # does not shrink
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        packed = packer.compress(text) + packer.flush()
    extra = b"BC" + struct.pack("<HH", 2, len(packed) + 25)
    head = _START + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + packed + struct.pack("<II", zlib.crc32(text), len(text))


def _write(folder: str, suffix: str) -> Callable:
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = writer = None
        n = 0
        written: list[tuple[str, int]] = []
        for batch in batches:
            sources = batch.column("source").to_pylist()
            values = batch.column("value").to_pylist()
            for source, value in zip(sources, values):
                if source != name:
                    if writer:
                        writer.close()
                        written.append((name, n))
                    name, n, writer = source, 0, _Writer(folder, source + suffix)
                writer.write(value.encode() + b"\n")
                n += 1
        if writer:
            writer.close()
            written.append((name, n))
        names, counts = zip(*written) if written else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["source", "lines"]
        )

    return write


def write_blocks(lines: DataFrame, folder: str, order: list, suffix: str = ".vcf.gz") -> DataFrame:
    """(source, lines) of the block gzip files written: one for each source, named after it.

    Lines of a file are in the given order. A file is written by one task, under
    a hidden name until it is whole, so a task that is run again does no harm.
    """
    dealt = lines.repartition("source").sortWithinPartitions("source", *order)
    done = dealt.select("source", "value").mapInArrow(_write(folder, suffix), "source string, lines long")
    return lines.sparkSession.createDataFrame(done.collect(), "source string, lines long")  # a row for each file
