"""Which tokens of two tokenisers stand for the same bytes, corpus-wide."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosegrid.llm.common import raw, slices
from dosegrid.session import broadcast_if_small, durable

#: Public vocabularies by file name or path; executors find them in place.
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

#: Pairs that a task holds before it writes their counts out.
HELD_PAIRS = 1 << 20
#: Pairs in one row of counts.
ROW_PAIRS = 1 << 16
#: Parts that a hot pair is dealt out to where its counts are not broadcast.
SALTS = 16


# Fixed value: how byte-level vocabularies cut words.
_WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Characters of a chunk from which on it is not encoded by ranks.
_LONG = 4096

_SPACE_AND_MORE = re.compile(r" \s")


def _path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_symbol() -> dict[str, int]:
    """Byte that each symbol of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others for the code points from
    256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenisers, the bytes of their entries, and the identity map between them."""

    def __init__(self, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> None:
        import sentencepiece

        self.path = _path(byte_level)
        with open(self.path, encoding="utf-8") as file:
            model = json.load(file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=_path(pieces))
        symbols = _byte_of_symbol()
        entries = model["model"]["vocab"] | {t["content"]: t["id"] for t in model.get("added_tokens", ())}
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            known = all(c in symbols for c in entry)
            self.bytes_a[i] = bytes(symbols[c] for c in entry) if known else entry.encode()
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(self.b.piece_size())))
        ]
        self.ranked = self._ranked(model)
        by_bytes = {b: i for i, b in reversed([*enumerate(self.bytes_b)])}
        #: B-id with the same bytes as each A-id, or -1.
        self.identity = np.array([by_bytes.get(b, -1) for b in self.bytes_a], np.int64)
        self.length_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.length_b = np.array([len(b) for b in self.bytes_b], np.int64)

    @cached_property
    def a(self):
        """The byte-level tokeniser itself, loaded where ranks don't do."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        loaded = Tokenizer.from_file(self.path)
        loaded.encode_special_tokens = True
        return loaded

    def _ranked(self, model: dict):
        """The same tokeniser by ranks, which takes plain texts faster, where its rules are those.

        They are if merges come in the order of their ids, and words are cut as
        byte-level vocabularies do by themselves.
        """
        import tiktoken

        cut, bpe = model.get("pre_tokenizer") or {}, model["model"]
        as_usual = (
            model.get("normalizer") is None and bpe["type"] == "BPE" and not bpe.get("dropout")
            and not bpe.get("ignore_merges") and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        )
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in bpe.get("merges", ())]
        ranks = {self.bytes_a[i]: i for i in range(min(256 + len(merges), len(self.bytes_a)))}
        single = sum(len(b) == 1 for b in self.bytes_a[:256])
        in_order = all(bpe["vocab"].get(m) == 256 + i for i, m in enumerate(merges))
        if not (as_usual and in_order and single == 256 and len(ranks) == 256 + len(merges)):
            return None
        return tiktoken.Encoding("ranked", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, chunks: list[str]) -> list[int]:
        """Ids of some chunks one after another; very long ones are merged in linear steps."""
        text = "".join(chunks)
        if self.ranked is None or max(map(len, chunks)) > _LONG:
            return self.a.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    @cached_property
    def cuts_at_spaces(self) -> bool:
        """Whether B's tokens before a space do not depend on what follows it.

        So it is if no piece holds a space after another character, and texts
        are taken as they are.
        """
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.b.serialized_model_proto())
        spec = model.normalizer_spec
        as_it_is = (
            spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
        )
        own = any(p.type == p.USER_DEFINED for p in model.pieces)
        inside = any("▁" in p.piece.lstrip("▁") for p in model.pieces)
        return as_it_is and not own and not inside

    def chunks(self, text: str) -> list[str]:
        """Pieces of space + text that both tokenisers take one by one.

        It is cut before a space that follows another character and comes before
        one that is not white space; both start a new token there.
        """
        if not self.cuts_at_spaces:
            return [" " + text]
        words = text.split(" ")
        if not (text[0].isspace() or text[-1] == " " or _SPACE_AND_MORE.search(text)):
            return [" " + w for w in words]
        out = [" " + words[0]]
        for before, word in zip(words, words[1:]):
            if before and word and not word[0].isspace():
                out.append(" " + word)
            else:
                out[-1] += " " + word
        return out


class Chunks:
    """Tokens, groups and links of the chunks met lately."""

    #: Chunks and links to hold; beyond, all are forgotten.
    limit = 250_000
    limit_links = 4_000_000

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.of = tokenizers
        n_b = len(tokenizers.bytes_b)
        self.width = n_b
        ids = [b"%d" % i for i in range(max(n_b, len(tokenizers.bytes_a)))]
        #: Text of an id before a comma, a bar and a semicolon.
        self.before = [[i + sign for i in ids] for sign in (b",", b"|", b";")]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[bytes] = []
        self.counts = np.empty((0, 4), np.int64)
        self.valid = np.empty(0, bool)
        self.starts = np.zeros(1, np.int64)
        self.links = np.empty(0, np.int64)

    def learn(self, documents: list[list[str]]) -> None:
        if len(self.known) > self.limit or len(self.links) > self.limit_links:
            self.forget()
        new = {c for chunks in documents for c in chunks if c not in self.known}
        # What follows these may change their tokens; the others go in one call.
        alone = [
            c for c in new if c[-1] == " " or "▁" in c or len(c) > _LONG or not self.of.cuts_at_spaces
        ]
        for part in [[*new.difference(alone)], *([c] for c in alone)]:
            if part and not self._add(part):
                for c in part:
                    if len(part) == 1 or not self._add([c]):
                        self._keep([c], [b""], np.zeros((1, 4), np.int64), self.links[:0], False)

    def _add(self, chunks: list[str]) -> bool:
        """Learn some chunks, if the tokens of both sides join to their bytes."""
        plain = [c.encode() for c in chunks]
        text = b"".join(plain)
        a = self.of.encode_a(chunks)
        b = [i for ids in self.of.b.encode([c[1:] for c in chunks], num_threads=1) for i in ids]
        if b"".join([self.of.bytes_a[i] for i in a]) != text or b"".join([self.of.bytes_b[i] for i in b]) != text:
            return False
        flat_a, flat_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.of.length_a[flat_a]), np.cumsum(self.of.length_b[flat_b])
        limits = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
        groups = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not (groups[np.searchsorted(groups, limits)] == limits).all():
            return False
        # Where a token of either side ends, a stretch ends that lies in one token of each side:
        # every stretch is one link. Where both end, a group ends.
        ends = np.union1d(ends_a, ends_b)
        links = (
            flat_a[np.searchsorted(ends_a, ends)] * self.width
            + flat_b[np.searchsorted(ends_b, ends)]
        )
        upto = [np.searchsorted(x, limits, "right") for x in (ends_a, ends_b, groups, ends)]
        counts = np.stack([np.diff(x, prepend=0) for x in upto], axis=1)
        # Tokens in the order of the text: those of A, then those of B, group by group.
        in_a, in_b = np.searchsorted(ends_a, groups, "right"), np.searchsorted(ends_b, groups, "right")
        group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        at_a = np.arange(len(flat_a)) + np.concatenate(([0], in_b))[group_a]
        at_b = np.arange(len(flat_b)) + in_a[group_b]
        ids = np.empty(len(flat_a) + len(flat_b), np.int64)
        sign = np.zeros(len(ids), np.int64)
        ids[at_a], ids[at_b] = flat_a, flat_b
        sign[at_a[in_a - 1]], sign[at_b[in_b - 1]] = 1, 2
        before = self.before
        parts = [before[s][i] for s, i in zip(sign.tolist(), ids.tolist())]
        cut = (upto[0] + upto[1]).tolist()
        texts = [b"".join(parts[i:j]) for i, j in zip([0, *cut], cut)]
        self._keep(chunks, texts, counts, links, True)
        return True

    def _keep(
        self, chunks: list[str], texts: list[bytes], counts: np.ndarray, links: np.ndarray, valid: bool
    ) -> None:
        first = len(self.known)
        self.known.update(zip(chunks, range(first, first + len(chunks))))
        self.text += texts
        self.counts = np.concatenate((self.counts, counts))
        self.valid = np.concatenate((self.valid, np.full(len(chunks), valid)))
        self.starts = np.concatenate((self.starts, len(self.links) + np.cumsum(counts[:, 3])))
        self.links = np.concatenate((self.links, links))

    def numbers(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def links_of(self, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, link, times) of the distinct links of each document, sorted."""
        sizes = np.array([len(d) for d in documents], np.int64)
        owner = np.repeat(np.arange(len(documents)), sizes)
        chunk = np.concatenate([*documents, np.empty(0, np.int64)])
        both, times = np.unique(owner * max(1, len(self.text)) + chunk, return_counts=True)
        owner, chunk = np.divmod(both, max(1, len(self.text)))
        n = np.diff(self.starts)[chunk]
        at = np.arange(n.sum()) + np.repeat(self.starts[chunk] - np.cumsum(n) + n, n)
        every = len(self.of.bytes_a) * self.width
        keys = np.repeat(owner, n) * every + self.links[at]
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], np.repeat(times, n)[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return *np.divmod(keys[first], every), np.add.reduceat(times, first) if len(first) else times


_SCHEMA = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " own array<int>, own_n array<long>, pairs array<long>, pairs_n array<long>"
)
_NAMES = [c.split()[0] for c in _SCHEMA.split(",")]


def _lists(owner: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


class _Counts:
    """Documents that hold each pair: a vector for the identity map, the rest as sorted pairs."""

    def __init__(self, size: int) -> None:
        self.own = np.zeros(size, np.int64)
        self.pairs = np.empty(0, np.int64)
        self.n = np.empty(0, np.int64)
        self.new: list[np.ndarray] = []
        self.n_new = 0

    def add(self, own: np.ndarray, pairs: np.ndarray) -> None:
        self.own += np.bincount(own, minlength=len(self.own))
        self.new.append(pairs)
        self.n_new += len(pairs)
        if self.n_new > HELD_PAIRS:
            self.merge()

    def merge(self) -> None:
        every = np.concatenate([self.pairs, *self.new])
        n = np.concatenate([self.n, np.ones(self.n_new, np.int64)])
        self.pairs, inverse = np.unique(every, return_inverse=True)
        self.n = np.bincount(inverse, n, len(self.pairs)).astype(np.int64)
        self.new, self.n_new = [], 0

    def written(self, own: bool) -> Iterator[pa.RecordBatch]:
        """The pairs so far, and the vector at the end; both start anew."""
        self.merge()
        at = np.flatnonzero(self.own) if own else np.empty(0, np.int64)
        for start in range(0, max(len(self.pairs), 1), ROW_PAIRS):
            part = slice(start, start + ROW_PAIRS)
            lists = [at, self.own[at], self.pairs[part], self.n[part]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            nulls = [pa.nulls(1, pa.int64())] * 6 + [pa.nulls(1, pa.string())]
            one = [_lists(np.zeros(len(x), int), x, 1, k) for x, k in zip(lists, kinds)]
            yield pa.RecordBatch.from_arrays(nulls + one, _NAMES)
            at = at[:0]
        self.pairs, self.n = self.pairs[:0], self.n[:0]


def _decoded(text: bytes | None) -> str:
    try:
        return text.decode() if text else ""
    except UnicodeDecodeError:  # not the bytes of any text, so nothing can equal it
        return ""


def _align(byte_level: str, pieces: str, held: Broadcast) -> Callable:
    """``held`` keeps the tokenisers of a worker process from one task to the next."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if "tokenizers" not in held.value:
            held.value["tokenizers"] = Tokenizers(byte_level, pieces)
        tokenizers = held.value["tokenizers"]
        known = Chunks(tokenizers)
        counts = _Counts(len(tokenizers.bytes_a))
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, size=1 << 20):
            texts = [_decoded(t) for t in raw(batch.column("text"))]
            cut = [tokenizers.chunks(t) if t else [] for t in texts]
            known.learn(cut)
            numbers = [known.numbers(c) for c in cut]
            numbers = [n if known.valid[n].all() else n[:0] for n in numbers]
            sums = np.stack([known.counts[n].sum(axis=0) for n in numbers])
            digests = [
                hashlib.sha256(b"".join([known.text[i] for i in n])[:-1]).hexdigest()
                if len(n)
                else ""
                for n in map(np.ndarray.tolist, numbers)
            ]
            owner, link, times = known.links_of(numbers)
            a, b = np.divmod(link, known.width)
            same = tokenizers.identity[a] == b
            counts.add(a[same], link[~same])
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + rows)),
                    batch.column("doc_id"),
                    *(pa.array(sums[:, i]) for i in range(4)),
                    pa.array(digests, pa.string()),
                    _lists(owner[same], a[same], rows, pa.int32()),
                    _lists(owner[same], times[same], rows, pa.int64()),
                    _lists(owner[~same], link[~same], rows, pa.int64()),
                    _lists(owner[~same], times[~same], rows, pa.int64()),
                ],
                _NAMES,
            )
            row += rows
            if len(counts.pairs) > HELD_PAIRS:
                yield from counts.written(own=False)
        yield from counts.written(own=True)

    return align


def tokenised(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Stored: a row for each document, and rows without a number that count pairs."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    held = docs.sparkSession.sparkContext.broadcast({})
    return durable(narrow.mapInArrow(_align(byte_level, pieces, held), _SCHEMA))


def pair_counts(aligned: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """(a, b, own, n, best): documents that hold a pair of ids linked.

    ``own`` marks the pairs of the identity map, which come from the vectors;
    there is one for each entry of A at most. ``best`` marks the pairs with the
    highest count of their A-id, ties included.
    """
    tokenizers = Tokenizers(byte_level, pieces)
    spark, width = aligned.sparkSession, len(tokenizers.bytes_b)
    identity = spark.createDataFrame(
        [(a, int(b)) for a, b in enumerate(tokenizers.identity) if b >= 0], "a int, b int"
    )
    told = aligned.where("row IS NULL")
    summed = F.sum("n").alias("n")
    own = (
        told.select(F.explode(F.arrays_zip("own", "own_n")).alias("x"))
        .select(F.col("x.own").alias("a"), F.col("x.own_n").alias("n"))
        .groupBy("a")
        .agg(summed)
        .join(F.broadcast(identity), "a")
        .select("a", "b", F.lit(True).alias("own"), "n")
    )
    beside = (
        told.select(F.explode(F.arrays_zip("pairs", "pairs_n")).alias("x"))
        .select(F.col("x.pairs").alias("pair"), F.col("x.pairs_n").alias("n"))
        .groupBy("pair")
        .agg(summed)
        .select(
            F.floor(F.col("pair") / width).cast("int").alias("a"),
            F.pmod("pair", F.lit(width)).cast("int").alias("b"),
            F.lit(False).alias("own"),
            "n",
        )
    )
    every = durable(own.union(beside))
    # One row for each entry of A at most.
    highest = every.groupBy("a").agg(F.max("n").alias("highest"))
    return durable(
        every.join(F.broadcast(highest), "a").select(
            "a", "b", "own", "n", (F.col("n") == F.col("highest")).alias("best")
        )
    )


def id_map(counts: DataFrame) -> DataFrame:
    """(a, b, n): for each A-id the B-id that most documents link it with; ties: the smallest."""
    return (
        counts.where("best").groupBy("a").agg(F.min("b").alias("b"), F.first("n").alias("n"))
    )


def _own_sums(n: np.ndarray, best: np.ndarray) -> Callable:
    """Replace the identity links of a document by the sums over them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own")
            ids = own.flatten().to_numpy()
            times = batch.column("own_n").flatten().to_numpy()
            offsets = np.cumsum(np.concatenate(([0], own.value_lengths().to_numpy())))
            added = []
            for values in (times * best[ids], times * n[ids]):
                upto = np.concatenate(([0], np.cumsum(values)))
                added.append(pa.array(upto[offsets[1:]] - upto[offsets[:-1]], pa.int64()))
            kept = [c for c in batch.schema.names if c not in ("own", "own_n")]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), *added], [*kept, "own_best", "own_sum"]
            )

    return sums


def _pair_sums(documents: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """(row, best, sum) over the links beside the identity map."""
    spread = documents.select(
        "row", F.explode(F.arrays_zip("pairs", "pairs_n")).alias("x")
    ).select("row", F.col("x.pairs").alias("pair"), F.col("x.pairs_n").alias("times"))
    beside = counts.where("NOT own").select(
        (F.col("a").cast("long") * width + F.col("b")).alias("pair"), "n", "best"
    )
    small = broadcast_if_small(beside, within=counts)
    if small is beside:
        salt = F.pmod(F.col("row"), F.lit(SALTS)).cast("int")
        spread = spread.withColumn("salt", salt)
        small = beside.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = spread.join(small, ["pair", "salt"])
    else:
        joined = spread.join(small, "pair")
    return joined.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("pair_best"),
        F.sum(F.col("times") * F.col("n")).alias("pair_sum"),
    )


def align_tokens(
    docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES
) -> DataFrame:
    """Groups and links of the tokens of two tokenisers, and how common the links are.

    Each text is encoded by a byte-level vocabulary (A, of space + text) and by
    a piece vocabulary (B, which adds the space). Byte offsets at which tokens
    of both end cut them into groups; an A- and a B-token whose bytes overlap
    are linked. The count of a pair of ids is the number of documents that hold
    it linked; pairs of ids with the same bytes are counted in vectors as long
    as A's vocabulary, and only the others are shuffled.

    Returns per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose
    count is the highest of their A-id, ties included), count_sum (of the
    counts, over the links), groups_sha256 (of "a1,a2|b1;a3|b2,b3"). Null and
    empty texts, and those whose tokens don't join to space + text, have no
    tokens: zeros and an empty string. Rows are documents of their own, also
    with equal or null ids. Other columns are not read.
    """
    aligned = tokenised(docs, byte_level, pieces)
    return _scored(aligned, pair_counts(aligned, byte_level, pieces), byte_level, pieces)


def _scored(aligned: DataFrame, counts: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    tokenizers = Tokenizers(byte_level, pieces)
    n = np.zeros(len(tokenizers.bytes_a), np.int64)
    best = np.zeros(len(n), np.int64)
    for entry in counts.where("own").select("a", "n", "best").collect():  # as A's vocabulary
        n[entry.a], best[entry.a] = entry.n, entry.best
    columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    documents = aligned.where("row IS NOT NULL")
    own = documents.select(*columns, "own", "own_n").mapInArrow(
        _own_sums(n, best),
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long,"
        " groups_sha256 string, own_best long, own_sum long",
    )
    beside = _pair_sums(documents, counts, len(tokenizers.bytes_b))
    added = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return own.join(beside, "row", "left").select(
        *columns[1:-1],
        added("own_best", "pair_best").alias("n_best"),
        added("own_sum", "pair_sum").alias("count_sum"),
        "groups_sha256",
    )
