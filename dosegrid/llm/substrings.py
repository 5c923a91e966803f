"""Removal of token windows that an earlier document has already."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosegrid.llm.common import (
    WordHashes,
    covered,
    groups_of,
    raw,
    rolling,
    runs,
    span_lists,
    spread,
    text_bytes,
)

SCHEMA = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, text string"
_OFFERS = "batch int, bucket int, hashes binary, owners binary, again binary"
_ANSWERS = "batch int, hashes binary, owners binary"


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes; the high ones are mostly zero and compress away."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True) + len(values).to_bytes(4, "big")


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[-4:], "big")
    planes = pa.decompress(packed[:-4], 8 * n, "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(8, n).T.copy().view(np.uint64).reshape(-1)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


def _zigzag(values: np.ndarray) -> np.ndarray:
    """Signed to unsigned, small either side of zero."""
    return ((values << 1) ^ (values >> 63)).view(np.uint64)


def _unzigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def _offers(window: int, buckets: int):
    """Of each batch: its distinct windows, their first owner, and whether they repeat in it."""
    cache = WordHashes()

    def offers(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        hashes, owners = [], []
        for doc_id, text in zip(docs["doc_id"].to_pylist(), raw(docs["text"])):
            if doc_id is not None and text:
                own = np.unique(rolling(cache.of(text.split()), window))
                hashes.append(own)
                owners.append(np.full(len(own), doc_id, np.int64))
        out: dict[str, list] = {"bucket": [], "hashes": [], "owners": [], "again": []}
        if hashes:
            every, owner = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))[: len(every)]
            low = np.minimum.reduceat(owner, first) if len(first) else owner
            again = (np.maximum.reduceat(owner, first) if len(first) else owner) > low
            every = every[first]
            bucket = ((every >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
            for start, end in zip(cuts, [*cuts[1:], len(every)]):
                out["bucket"].append(int(bucket[start]))
                out["hashes"].append(_pack_sorted(every[start:end]))
                out["owners"].append(_pack(_zigzag(low[start:end])))
                out["again"].append(np.packbits(again[start:end]).tobytes())
        batch = pa.array([key[0].as_py()] * len(out["bucket"]), pa.int32())
        return pa.table(
            {
                "batch": batch,
                "bucket": pa.array(out["bucket"], pa.int32()),
                "hashes": pa.array(out["hashes"], pa.binary()),
                "owners": pa.array(out["owners"], pa.binary()),
                "again": pa.array(out["again"], pa.binary()),
            }
        )

    return offers


def _answers(offers: pa.Table) -> pa.Table:
    """To each batch: the windows in it that have a smaller owner than some document there."""
    parts = [_unpack_sorted(x) for x in offers["hashes"].to_pylist()]
    sizes = [len(x) for x in parts]
    every = np.concatenate(parts)
    low = np.concatenate([_unzigzag(_unpack(x)) for x in offers["owners"].to_pylist()])
    bits = [np.frombuffer(x, np.uint8) for x in offers["again"].to_pylist()]
    again = np.concatenate([np.unpackbits(x, count=n) for x, n in zip(bits, sizes)]).astype(bool)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    least = np.repeat(
        np.minimum.reduceat(low[order], first), np.diff(np.append(first, len(ranked)))
    )
    owner = np.empty_like(low)
    owner[order] = least
    wanted = again | (owner < low)
    out: dict[str, list] = {"batch": [], "hashes": [], "owners": []}
    end = 0
    for batch, size in zip(offers["batch"].to_pylist(), sizes):
        start, end = end, end + size
        own = wanted[start:end]
        if own.any():
            out["batch"].append(batch)
            out["hashes"].append(_pack_sorted(every[start:end][own]))
            out["owners"].append(_pack(_zigzag(owner[start:end][own])))
    return pa.table(
        {
            "batch": pa.array(out["batch"], pa.int32()),
            "hashes": pa.array(out["hashes"], pa.binary()),
            "owners": pa.array(out["owners"], pa.binary()),
        }
    )


def _cut(window: int):
    cache = WordHashes()

    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        hashes = [_unpack_sorted(x) for x in answers["hashes"].to_pylist()]
        owners = [_unzigzag(_unpack(x)) for x in answers["owners"].to_pylist()]
        known = np.concatenate([*hashes, np.empty(0, np.uint64)])
        owner = np.concatenate([*owners, np.empty(0, np.int64)])
        order = np.argsort(known)
        known, owner = known[order], owner[order]
        ids, counts, spans, kept = docs["doc_id"].to_pylist(), [], [], []
        for doc_id, text in zip(ids, raw(docs["text"])):
            words = (text or b"").split()
            gone = np.zeros(len(words), bool)
            if doc_id is not None and len(words) >= window and len(known):
                own = rolling(cache.of(words), window)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                starts = np.flatnonzero((known[at] == own) & (owner[at] < doc_id))
                gone = covered(starts, window, len(words))
            counts.append(len(words))
            spans.append(runs(gone))
            left = (w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else words
            kept.append(b" ".join(left))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array(counts, pa.int64()),
                "spans": span_lists(spans),
                "text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return cut


def remove_repeats(docs: DataFrame, window: int = 13, batch_bytes: int = 8 << 20) -> DataFrame:
    """Cut the words of every window that a document with a smaller id has too.

    Each run of ``window`` words gets a 64-bit Rabin-Karp value. Documents are
    dealt evenly into batches of about ``batch_bytes``; a batch sends each of
    its distinct windows once, with the smallest id that has it, so a passage
    found in any share of the corpus is one entry per batch and never one group
    of documents. Buckets of values are compared, and a batch gets back only
    the windows that some document in it must give up. Overlapping windows
    merge into maximal spans.

    Returns per row: doc_id, n_words, spans (word positions, end exclusive) and
    text (kept words joined by one space). Windows are judged on the input.
    A null or empty text has no words; a text shorter than the window loses
    nothing. Rows with equal ids do not take from each other, and a row without
    an id neither gives nor takes. Other columns are not read. Two different
    windows share a value with a chance of about 2**-64 for each pair.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    batches = groups_of(text_bytes(narrow), batch_bytes)
    placed = narrow.withColumn("batch", spread(batches, "doc_id", "text"))
    offers = placed.groupBy("batch").applyInArrow(_offers(window, batches), _OFFERS)
    answers = offers.groupBy("bucket").applyInArrow(_answers, _ANSWERS)
    return (
        placed.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(_cut(window), SCHEMA)
    )
