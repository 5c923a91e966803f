"""Near duplicates: circulant MinHash, banding, exact Jaccard similarity."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosegrid.llm.common import (
    WordHashes,
    by_group,
    lowered,
    mixed,
    raw,
    rolling,
    slices,
    small_side,
)
from dosegrid.session import durable

SHINGLE = 5
#: Size of the universe that the two permutations act on.
UNIVERSE = 1 << 20
ROWS = 8
#: Shingles, over all its documents, that one comparing task takes.
BLOCK_SHINGLES = 1 << 20


def shingles(text: bytes | None, cache: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit values of the word shingles; a short text is one shingle."""
    words = lowered(text).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(cache.of(words), min(size, len(words))) + np.uint64(len(words) < size))


def bands_for(percent: int, rows: int = ROWS, missed: float = 1e-5) -> int:
    """Bands so that a pair at the threshold shares none with a chance of ``missed`` at most."""
    return math.ceil(math.log(missed) / math.log(1 - (percent / 100) ** rows))


class Circulant:
    """All signature coordinates from two permutations.

    The first scatters the shingles over the places of a circle. Coordinate k is
    the smallest value that the second permutation, shifted by k places around
    the circle, has at those places; the shifted values of one place lie side by
    side, so it is the minimum over slices of one array. Of several shingles at
    the place that is found the one with the smallest hash is taken, and this
    hash is the coordinate: sets of more shingles than there are places still
    differ.
    """

    def __init__(self, coordinates: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.scatter = rng.permutation(UNIVERSE).astype(np.int32)
        circle = rng.permutation(UNIVERSE).astype(np.int32)
        self.place = np.empty(UNIVERSE, np.int32)
        self.place[circle] = np.arange(UNIVERSE, dtype=np.int32)
        self.shift = np.arange(coordinates)
        circle = np.concatenate((circle, circle[:coordinates]))
        self.shifted = np.lib.stride_tricks.sliding_window_view(circle, coordinates)

    def signature(self, values: np.ndarray) -> np.ndarray:
        """``values`` are sorted."""
        places = self.scatter[(values & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        least = self.shifted[places[:4096]].min(axis=0)
        for start in range(4096, len(places), 4096):
            np.minimum(least, self.shifted[places[start : start + 4096]].min(axis=0), out=least)
        found = (self.place[least] - self.shift) % UNIVERSE
        order = np.argsort(places, kind="stable")
        return values[order[np.searchsorted(places[order], found)]]


def _node(own: np.ndarray) -> int:
    """Number of a shingle set: equal sets have equal ones."""
    digest = hashlib.blake2b(own.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "big", signed=True)


def _sign(bands: int, rows: int) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        family = Circulant(bands * rows)
        weights = mixed(np.arange(1, rows + 1, dtype=np.uint64))
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(32))
        for batch in slices(batches):
            sizes, nodes, keys = [], [], []
            for text in raw(batch.column("text")):
                own = shingles(text, cache)
                sizes.append(len(own))
                if len(own):
                    nodes.append(_node(own))
                    rows_of = family.signature(own).reshape(bands, rows)
                    keys.append(mixed(mixed(rows_of + weights).sum(axis=1) + salt).view(np.int64))
                else:
                    nodes.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "node", "keys"],
            )

    return sign


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the text by its shingles; a text that only shares its id with the class goes."""
    cache = WordHashes()
    for batch in slices(batches):
        nodes = batch.column("node").to_pylist()
        sets = [shingles(t, cache) for t in raw(batch.column("text"))]
        at = [i for i, (own, node) in enumerate(zip(sets, nodes)) if _node(own) == node]
        names = [n for n in batch.schema.names if n not in ("class_id", "text")]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(n).take(pa.array(at, pa.int64())) for n in names),
                pa.array([sets[i].tobytes() for i in at], pa.binary()),
            ],
            [*names, "set"],
        )


class _Members:
    """Shingle sets of some documents, and the links among them."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes = np.split(codes, np.cumsum(self.sizes)[:-1])
        self.rebuild(np.arange(len(sets)))

    def rebuild(self, active: np.ndarray) -> None:
        """Postings of the documents that are still to be compared."""
        self.active = active
        codes = [self.codes[i] for i in active] or [np.empty(0, np.int64)]
        every = np.concatenate(codes)
        owner = np.repeat(active, self.sizes[active]) if len(active) else every
        order = np.argsort(every, kind="stable")
        self.posted, self.owner = every[order], owner[order]

    def linked(self, i: int) -> np.ndarray:
        """Active documents whose similarity to document ``i`` reaches the threshold."""
        low = np.searchsorted(self.posted, self.codes[i], "left")
        high = np.searchsorted(self.posted, self.codes[i], "right")
        counts = high - low
        total = int(counts.sum())
        if not total:
            return np.empty(0, np.int64)
        at = np.arange(total) + np.repeat(low - np.cumsum(counts) + counts, counts)
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        either = self.sizes[i] + self.sizes - shared
        return np.flatnonzero((shared > 0) & (100 * shared >= self.percent * either))

    def spanning(self, labels: np.ndarray) -> list[tuple[int, int]]:
        """Links that join all documents which are connected; one less than their number.

        ``labels`` says which are known to be connected. Every document is
        searched for among those not reached yet, so no pair across two
        components goes unseen, and pairs within one are mostly never made.
        """
        links: list[tuple[int, int]] = []
        _, labels = np.unique(labels, return_inverse=True)
        groups = np.split(np.argsort(labels, kind="stable"), np.cumsum(np.bincount(labels))[:-1])
        waiting = np.ones(len(labels), bool)
        for start in sorted(range(len(groups)), key=lambda g: -len(groups[g])):
            if not waiting[groups[start][0]]:
                continue
            queue = list(groups[start])
            waiting[queue] = False
            for i in queue:
                if 2 * int(waiting.sum()) < len(self.active) or len(self.active) == len(labels):
                    self.rebuild(np.flatnonzero(waiting))
                if not len(self.active):
                    break
                for j in self.linked(i):
                    if waiting[j]:
                        links.append((i, int(j)))
                        more = groups[labels[j]]
                        waiting[more] = False
                        queue.extend(more)
        return links


def _compare(percent: int) -> Callable:
    """Within each task: links that connect what is connected."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_group(batches, ["cluster", "task"]):
            ids, once = np.unique(np.array(rows["node"].to_pylist(), np.int64), return_index=True)
            labels = np.array(rows["label"].to_pylist(), np.int64)[once]
            sets = [np.frombuffer(rows["set"][int(i)].as_py(), np.uint64) for i in once]
            if len(ids) > 1 and len(set(labels.tolist())) > 1:
                links = _Members(sets, percent).spanning(labels)
                if links:
                    a, b = np.array(links, np.int64).T
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a]), pa.array(ids[b])], ["a", "b"]
                    )

    return compare


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each one reaches over links (a, b).

    Labels spread to neighbours and then jump to the label of their label, so
    long chains take few rounds. Each round is stored.
    """
    both = durable(links.union(links.select("b", "a")).toDF("a", "b").distinct())
    labels = durable(
        both.groupBy("a").agg(F.min("b").alias("n")).select(
            F.col("a").alias("node"), F.least("a", "n").alias("label")
        )
    )
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, labels.node == near.a, "left").select(
            "node", "label", F.least("label", "near").alias("next")
        )
        ahead = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = durable(
            stepped.join(ahead, "next", "left").select(
                "node", F.least("next", "jump").alias("label"), (F.least("next", "jump") < F.col("label")).alias("changed")
            )
        )
        changed = moved.where("changed").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def _buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (node, cluster) of the buckets that several classes share, and (cluster, first, n)."""
    banded = classes.select("node", F.posexplode("keys").alias("band", "key"))
    keyed = banded.select("node", F.xxhash64("band", "key").alias("cluster"))
    shared = durable(
        keyed.groupBy("cluster")
        .agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return durable(keyed.join(shared.select("cluster"), "cluster")), shared


def _verify(percent: int) -> Callable:
    """Within each group: members whose similarity to the first reaches the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (first, _), rows in by_group(batches, ["first", "salt"]):
            nodes = rows["node"].to_pylist()
            sets = [np.frombuffer(s.as_py(), np.uint64) for s in rows["set"]]
            own = sets[nodes.index(first)] if first in nodes else np.empty(0, np.uint64)
            linked = []
            for node, other in zip(nodes, sets):
                if node != first and len(own):
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int((own[at] == other).sum())
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        linked.append(node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(linked, pa.int64()), pa.array([first] * len(linked), pa.int64())], ["a", "b"]
            )

    return verify


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """Stored (a, b) of the pairs (node, first) that are links; each first meets its members in groups."""
    sized = pairs.join(sets.select("node", "n").distinct(), "node")
    salts = sized.groupBy("first").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt")
    members = sized.join(salts, "first").select("first", "node", salt)
    firsts = salts.select(
        "first", F.col("first").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    keys = ["first", "salt"]
    dealt = members.union(firsts).join(sets.select("node", "set"), "node").repartition(*keys)
    return durable(dealt.sortWithinPartitions(*keys).mapInArrow(_verify(percent), "a long, b long"))


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of all nodes; one that has no link is its own label."""
    found = components(links)
    return nodes.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _stars(docs: DataFrame, classes: DataFrame, percent: int, block_shingles: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links found by comparing each class with the first one of its buckets, and what they leave.

    Every class is compared with the smallest of the firsts it meets, and then
    with those others that it is not connected with by now. Returns the links,
    the stored sets (node, n, set) of all classes in a shared bucket, and
    (node, cluster, label) of the buckets in which a pair may still be unseen:
    those of three classes or more that are not all connected.
    """
    placed, shared = _buckets(classes)
    met = classes.select("node", "class_id").join(placed.select("node").distinct(), "node")
    sets = docs.withColumnRenamed("doc_id", "class_id").join(small_side(durable(met)), "class_id")
    sets = durable(
        sets.mapInArrow(_shingle_sets, "node long, set binary").withColumn(
            "n", (F.octet_length("set") / 8).cast("long")
        )
    )
    star = placed.join(shared, "cluster").where("node != first").select("node", "first")
    star = durable(star.distinct())
    nearest = star.groupBy("node").agg(F.min("first").alias("first"))
    links = _verified(nearest, sets, percent, block_shingles)
    nodes = placed.select("node").distinct()
    labels = durable(_labelled(nodes, links))
    others = (
        star.join(labels, "node")
        .join(labels.select(F.col("node").alias("first"), F.col("label").alias("other")), "first")
        .where("label != other")
        .join(nearest, ["node", "first"], "left_anti")
        .select("node", "first")
    )
    links = links.union(_verified(others, sets, percent, block_shingles))
    labels = durable(_labelled(nodes, links))
    spread = placed.join(labels, "node")
    unsure = (
        spread.join(shared.where("n > 2").select("cluster"), "cluster")
        .groupBy("cluster")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low < high")
        .select("cluster")
    )
    return links, sets, durable(spread.join(unsure, "cluster"))


_KEYS = ["cluster", "task"]


def _links(rows: DataFrame, percent: int) -> DataFrame:
    placed = rows.select(*_KEYS, "node", "label", "set").repartition(*_KEYS)
    return placed.sortWithinPartitions(*_KEYS).mapInArrow(_compare(percent), "a long, b long")


def _connected(
    docs: DataFrame, classes: DataFrame, percent: int, block_shingles: int
) -> DataFrame:
    """(node, label) of all classes that are linked to another one."""
    links, sets, unsure = _stars(docs, classes, percent, block_shingles)
    if not unsure.limit(1).count():
        return components(links)
    sized = unsure.join(sets.select("node", "n").distinct(), "node")
    blocks = sized.groupBy("cluster").agg(
        F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")
    placed = sized.join(blocks, "cluster").select("node", "cluster", "label", "blocks", block)
    placed = placed.join(sets.select("node", "set"), "node")
    one = F.col("blocks") == 1
    if not blocks.where(~one).limit(1).count():
        return components(links.union(_links(placed.withColumn("task", F.col("block")), percent)))
    return components(links.union(_block_links(durable(placed), one, percent, block_shingles)))


def _block_links(
    sets: DataFrame, one: Column, percent: int, block_shingles: int
) -> DataFrame:
    """The same where some buckets take several tasks.

    Every block is compared with the first one of its bucket, and then with
    all that this has left outside the largest component, in chunks.
    """
    first = F.col("block") == 0
    to_blocks = F.sequence(F.lit(1), F.col("blocks") - 1)
    beside = F.when(one | ~first, F.array("block")).otherwise(to_blocks)
    found = durable(_links(sets.withColumn("task", F.explode(beside)), percent))
    # Labels known so far, with what the first blocks have told of them.
    told = sets.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a != b").distinct()
    labels = durable(components(found.union(told)))
    many = (
        sets.where(~one)
        .drop("label")
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    counts = many.groupBy("cluster", "label").count()
    largest = counts.groupBy("cluster").agg(F.max_by("label", "count").alias("largest"))
    many = durable(many.join(largest, "cluster"))
    rest = many.where("label != largest")
    chunks = rest.groupBy("cluster").agg(
        F.ceil(F.sum(F.octet_length("set")) / (8 * block_shingles)).cast("int").alias("chunks")
    )
    task = (F.col("chunk") * F.col("blocks") + F.col("block")).alias("task")
    columns = ["cluster", "node", "label", "set", task]
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    every_chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    moving = (
        rest.join(chunks, "cluster")
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "node"), "chunks").cast("int"))
        .withColumnRenamed("block", "own")
        .withColumn("block", every_block)
        .where("block != own")
        .select(*columns)
    )
    staying = many.join(chunks, "cluster").withColumn("chunk", every_chunk).select(*columns)
    return found.union(_links(moving.unionByName(staying), percent))


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    rows: int = ROWS,
    missed: float = 1e-5,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Components of documents whose shingle sets are similar.

    Two documents are linked if 100 * intersection >= ``percent`` * union of
    their sets of lower-cased five-word shingles. Equal sets form one class,
    and only classes go on. A class has ``rows`` circulant MinHash coordinates
    in each of so many bands that a linked pair meets in no band with a chance
    of ``missed`` at most. In each bucket of classes that meet, all are compared
    on the full sets with its first one, unless they are connected by then. Only
    buckets of three or more that this leaves in several components are compared
    further: documents until they are connected, in tasks of bounded size, and a
    bucket too large for one task is split into blocks, which are compared with
    each other as far as they are not connected yet. Classes are connected by
    verified links alone. No partner is dropped, and no list of pairs is made.

    Returns per row: doc_id, n_shingles, component_id (smallest id that is
    reached, itself included), kept (doc_id = component_id). A null or empty
    text has no shingles and is linked with nothing; a row without an id has a
    null component, links nothing and is kept. Rows with equal ids and texts
    share their verdict; with different texts they are linked like any others.
    Other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    bands = bands_for(percent, rows, missed)
    signed = durable(
        narrow.mapInArrow(
            _sign(bands, rows), "doc_id long, n_shingles long, node long, keys array<long>"
        )
    )
    linkable = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    classes = durable(
        signed.where(linkable)
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("class_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("keys").alias("keys"),
        )
    )
    labels = _connected(narrow, classes, percent, block_shingles)
    labelled = classes.select("node", "class_id").join(labels, "node", "left").select(
        "node", "class_id", F.coalesce("label", "node").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("class_id").alias("component_id"))
    reached = labelled.join(smallest, "label").select("node", "component_id")
    columns = ["doc_id", "n_shingles", "component_id"]
    linked = signed.where(linkable).join(reached, "node").select(*columns)
    alone = signed.where(~linkable).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return linked.union(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80, rows: int = 6) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    The lower threshold takes fewer rows a band, else there would be many bands.

    An id names one document here: of rows with equal ids, all go if one has
    to. Rows without an id stay.
    """
    gone = durable(near_duplicates(docs, percent, rows).where("NOT kept").select("doc_id").distinct())
    gone = small_side(gone)
    same = F.col("doc.doc_id") == F.col("gone.doc_id")
    return docs.alias("doc").join(gone.alias("gone"), same, "left_anti")
