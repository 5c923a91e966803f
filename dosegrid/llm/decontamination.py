"""Passages of test items found in documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosegrid.llm.common import SPAN, covered, groups_of, raw, runs, slices, span_lists, spread
from dosegrid.session import broadcast_if_small, durable

#: Normal form: A-Z in lower case, other ASCII but digits and letters to a space.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: bytes | None) -> list[bytes]:
    """Words of a text in normal form."""
    return text.translate(_NORMAL).split() if text else []


class Items:
    """The windows of some test items, as one Aho-Corasick automaton over word numbers."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normal_words(text)]
            if words:
                for start in range(max(1, len(words) - window + 1)):
                    key = tuple(words[start : start + window])
                    self.windows.setdefault(key, set()).add(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in self.windows.items():
            self.automaton.add_word(key, (len(key), names))
        self.automaton.make_automaton()

    def found(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in a window of an item, and the items; one scan."""
        names: set[str] = set()
        if not self.windows or not words:
            return np.zeros(len(words), bool), names
        get = self.numbers.get
        ends, sizes = [], []
        for end, (size, owners) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            ends.append(end)
            sizes.append(size)
            names |= owners
        if not ends:
            return np.zeros(len(words), bool), names
        starts = np.array(ends) - np.array(sizes) + 1
        return covered(starts, np.array(sizes), len(words)), names


_Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _places(text: str, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans of words as positions of characters in the text as it was given."""
    if not spans:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    return [{"start": words[a][0], "end": words[b - 1][1]} for a, b in spans]


def _held(items: Broadcast, window: int) -> Items:
    """The automaton of a block, built once in each worker process, whose broadcast value it shares."""
    if "built" not in items.value:
        items.value["built"] = Items(items.value["items"], window)
    return items.value["built"]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast items, in blocks of about ``block_bytes``, and whether there is one block only.

    A block is made when the one before it has been used, and that one is freed.
    """
    narrow = items.select(F.col("item_id").cast("string").alias("name"), "text").dropna()
    blocks = groups_of(narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0, block_bytes)
    for block in range(blocks):
        rows = narrow.where(spread(blocks, "name") == block).toLocalIterator()
        block_items = [(r["name"], r["text"].encode()) for r in rows]
        sent = items.sparkSession.sparkContext.broadcast({"items": block_items})
        yield sent, blocks == 1
        if blocks > 1:
            sent.unpersist()


_SPANS = "array<struct<start:int,end:int>>"


def _row(docs: DataFrame) -> DataFrame:
    """What is read of a document; equal ids and texts have equal results."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")


def _scan(items: Broadcast, window: int) -> _Scan:
    """Words in passages of the items of one block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _held(items, window)
        for batch in slices(batches):
            counts, spans, names, places = [], [], [], []
            for text in raw(batch.column("text")):
                words = normal_words(text)
                hit, found = block.found(words)
                counts.append(len(words))
                spans.append(runs(hit))
                names.append(sorted(found))
                ranges = list(zip(*(x.tolist() for x in spans[-1])))
                places.append(_places(text.decode(), ranges) if ranges else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(counts, pa.int64()),
                    span_lists(spans),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(places, pa.list_(SPAN)),
                ],
                ["doc_id", "text_hash", "n_words", "hits", "items", "places"],
            )

    return scan


def find_items(
    docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 2 << 20
) -> DataFrame:
    """Words of documents that lie in a passage of a test item.

    A passage is ``window`` consecutive words of an item, or the whole item if
    it is shorter. All passages form one Aho-Corasick automaton, which goes to
    the executors; documents are scanned once, where they are, without a
    shuffle. Items of more than ``block_bytes`` are taken block by block: one
    job with one automaton for each, which stores what it found and frees its
    block, so no more than a block is ever held by the driver or a worker.

    Returns per row: doc_id, n_words, hits (spans of words, end exclusive),
    items (ids as text, sorted) and places (the hits as positions of characters
    in the original text). Items without an id or without words are left out;
    items with equal ids count as one. A null or empty text has no words.
    Other columns are not read.
    """
    schema = f"doc_id long, text_hash long, n_words long, hits {_SPANS}, items array<string>, places {_SPANS}"
    narrow = _row(docs)
    columns = ["doc_id", "n_words", "hits", "items", "places"]
    found = []
    for block, only in _blocks(items, block_bytes):
        scanned = narrow.mapInArrow(_scan(block, window), schema)
        if only:
            return scanned.select(*columns)
        found.append(durable(scanned.where(F.size("items") > 0).drop("n_words").distinct()))
    # At most one row of each block for a document.
    merged = reduce(DataFrame.union, found).groupBy("doc_id", "text_hash").agg(
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    same = F.col("c.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("c.text_hash") == F.col("f.text_hash"))
    joined = narrow.alias("c").join(broadcast_if_small(durable(merged)).alias("f"), same, "left")
    given = joined.select("c.doc_id", "c.text", "f.hits", "f.items")
    return given.mapInArrow(
        _united, f"doc_id long, n_words long, hits {_SPANS}, items array<string>, places {_SPANS}"
    )


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the scans of several blocks found, as spans that don't touch."""
    for batch in slices(batches):
        counts, spans, places = [], [], []
        for text, hits in zip(raw(batch.column("text")), batch.column("hits").to_pylist()):
            words = normal_words(text)
            hit = np.zeros(len(words), bool)
            for span in hits or ():
                hit[span["start"] : span["end"]] = True
            counts.append(len(words))
            spans.append(runs(hit))
            ranges = list(zip(*(x.tolist() for x in spans[-1])))
            places.append(_places(text.decode(), ranges) if ranges else [])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(counts, pa.int64()),
                span_lists(spans),
                pa.array([x or [] for x in batch.column("items").to_pylist()], pa.list_(pa.string())),
                pa.array(places, pa.list_(SPAN)),
            ],
            ["doc_id", "n_words", "hits", "items", "places"],
        )


def _clean(items: Broadcast, window: int) -> _Scan:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _held(items, window)
        for batch in slices(batches):
            texts = raw(batch.column("text"))
            hit = [bool(block.found(normal_words(t))[1]) for t in texts]
            yield batch.filter(pa.array([not h for h in hit], pa.bool_()))

    return clean


def contaminated_removed(
    docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 2 << 20
) -> DataFrame:
    """Rows of ``docs`` without any passage of an item, with all their columns."""
    for block, only in _blocks(items, block_bytes):
        docs = docs.mapInArrow(_clean(block, window), docs.schema)
        docs = docs if only else durable(docs)
    return docs
