"""Words, hashes and batches shared by the corpus operators."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dosegrid.session import broadcast_if_small

# Words of one text are split at these six characters, which is what bytes.split does.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, from one pruned pass."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def groups_of(total: int, size: int) -> int:
    """How many groups of about ``size`` hold ``total``."""
    return max(1, math.ceil(total / size))


def spread(groups: int, *columns: str) -> Column:
    """Group number of a row, even whatever the columns hold."""
    return F.pmod(F.xxhash64(*columns), F.lit(groups)).cast("int")


def small_side(df: DataFrame) -> DataFrame:
    """A side of a join, broadcast if its measured size allows it."""
    return broadcast_if_small(df)


class WordHashes(dict):
    """64-bit hash of a word; forgets all when full, so memory is bounded."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lowered(text: bytes) -> bytes:
    """A-Z in lower case, all else as it is."""
    return text.lower()


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return column.cast(pa.large_binary()).to_pylist()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 2 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have about ``size`` bytes; none is cut itself.

    A worker process serves many tasks: what the last one has freed is given
    back to the system first.
    """
    _give_back()
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        part = np.cumsum(lengths.astype(np.int64)) // size
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit integers, so that all bits depend on all."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


#: Base of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(words: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp value of every run of ``window`` word hashes, modulo 2**64.

    The rolling sum is taken from prefix sums: sum(w[i+j] * b**j) is the
    difference of two prefixes times b**-i.
    """
    n = len(words)
    if n < window:
        return np.empty(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(BASE, n), out=prefix[1:])
    starts = n - window + 1
    return mixed((prefix[window:] - prefix[:starts]) * powers(INVERSE, starts))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window that begins at one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:n]) > 0


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def span_lists(spans: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """One list of (start, end) per row."""
    offsets = np.cumsum([0, *(len(s) for s, _ in spans)])
    both = [np.concatenate(x) if spans else np.empty(0) for x in zip(*spans)] or [np.empty(0)] * 2
    values = pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int32)) for x in both], fields=list(SPAN)
    )
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def by_group(
    batches: Iterable[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in sorted batches, one at a time."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns)):
            if key != current:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield current, pa.Table.from_batches(held)
                held, start, current = [], i, key
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield current, pa.Table.from_batches(held)
