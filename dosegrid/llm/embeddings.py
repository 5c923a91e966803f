"""Vectors of high cosine similarity, by an epsilon grid order join."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosegrid.llm.common import by_group, groups_of
from dosegrid.llm.near_duplicates import components
from dosegrid.session import broadcast_if_small, durable

#: Leading principal dimensions that order and separate the vectors.
DIMENSIONS = 16
#: Bytes of the vectors in one interval of the sequence, and vectors in the least interval of a task.
INTERVAL_BYTES = 2 << 20
LEAF = 64
#: Pairs of intervals that a task compares, one after another.
PAIRS = 8
#: Intervals in one of the next level.
FAN = 8
#: Slack for rounding, far above that of a dot product and far below any distance that matters.
SLACK = 1e-9


def _matrix(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors of a batch."""
    lengths = column.value_lengths().to_numpy()
    starts = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    values = column.flatten().to_numpy()
    found = []
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        found.append((at, values[starts[at][:, None] + np.arange(length)]))
    return found


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision; scaled first, so that squares don't overflow."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows; the key of a vector that can be compared is a 128-bit hash of it."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        vectors = batch.column("embedding")
        keys: list[bytes | None] = []
        for vector in vectors:
            values = vector.values
            key = None
            if values is not None and len(values) and not values.null_count:
                plain = values.to_numpy() + 0  # one zero only
                if np.isfinite(plain).all() and plain.any():
                    key = hashlib.blake2b(plain.tobytes(), digest_size=16).digest()
            keys.append(key)
        rows = pa.array(np.arange(row, row + batch.num_rows))
        yield pa.RecordBatch.from_arrays(
            [rows, batch.column("vec_id"), pa.array(keys, pa.binary()), vectors],
            ["row", "vec_id", "key", "embedding"],
        )
        row += batch.num_rows


def _moments(length: int, width: int) -> Callable:
    """Second moments of all vectors times a random matrix, from one pass."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(3).standard_normal((length, width))
        total = np.zeros((length, width))
        for batch in batches:
            for _, vectors in _matrix(batch.column("embedding")):
                own = unit(vectors)
                total[: own.shape[1]] += own.T @ (own @ random[: own.shape[1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(length * width)), pa.array(total.ravel())], ["at", "value"]
        )

    return moments


def principal_axes(vectors: DataFrame, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Leading principal axes of the unit vectors, one a column, from all of them.

    Only sums of the size of one vector times some more than ``dimensions``
    reach the driver. The axes are those of the low-rank form of the second
    moments; whatever they are, a distance along them is never too long. Shorter
    vectors are taken as filled up with zeros.
    """
    length = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if not length:
        return np.zeros((1, 1))
    width = min(length, dimensions + 16)
    sums = vectors.select("embedding").mapInArrow(_moments(length, width), "at long, value double")
    total = np.zeros(length * width)
    for at, value in sums.groupBy("at").agg(F.sum("value")).collect():
        total[at] = value
    seen = total.reshape(length, width)
    random = np.random.default_rng(3).standard_normal((length, width))
    values, basis = np.linalg.eigh(random.T @ seen)
    kept = values > values[-1] * 1e-12
    left, _, _ = np.linalg.svd(seen @ (basis[:, kept] / np.sqrt(values[kept])), full_matrices=False)
    return np.linalg.qr(left[:, :dimensions])[0]


def _cells(axes: np.ndarray, width: float) -> Callable:
    """Grid cell of every vector: its length, then places along the axes."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((batch.num_rows, 1 + axes.shape[1]), np.int32)
            for at, vectors in _matrix(batch.column("embedding")):
                out[at, 0] = vectors.shape[1]
                out[at, 1:] = np.floor(unit(vectors) @ axes[: vectors.shape[1]] / width)
            offsets = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ["node", "copies", "embedding"]), listed],
                ["node", "copies", "embedding", "cell"],
            )

    return cells


def _bounds(dimensions: int) -> list[str]:
    return [f"{side}{i}" for i in range(dimensions + 1) for side in ("low", "high")]


def _interval_schema(dimensions: int) -> str:
    bounds = ", ".join(f"{b} double" for b in _bounds(dimensions))
    return f"part int, start long, nodes binary, copies binary, vectors binary, {bounds}"


def _pack(axes: np.ndarray, interval_bytes: int) -> Callable:
    """Packed stretches of the sequence: vectors of one length, and the box that holds them.

    ``start`` is the place, in bytes, among the vectors of this length and task.
    """

    def packed(nodes: list, copies: list, vectors: list, part: int, start: int) -> pa.RecordBatch:
        own = np.concatenate(vectors)
        places = unit(own) @ axes[: own.shape[1]]
        bounds = [float(own.shape[1])] * 2
        for low, high in zip(places.min(axis=0), places.max(axis=0)):
            bounds += [float(low), float(high)]
        blobs = [np.concatenate(x).tobytes() for x in (nodes, copies)]
        values = [part, start, *blobs, own.tobytes(), *bounds]
        names = ["part", "start", "nodes", "copies", "vectors", *_bounds(axes.shape[1])]
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 3 + [pa.float64()] * len(bounds)
        arrays = [pa.array([v], k) for v, k in zip(values, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, length, before, held = TaskContext.get().partitionId(), None, 0, 0
        parts: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            nodes, copies = (batch.column(c).to_numpy() for c in ("node", "copies"))
            # Vectors come sorted by length, so the rows of each length are a stretch.
            for at, vectors in _matrix(batch.column("embedding")):
                most = max(1, interval_bytes // vectors[0].nbytes)
                start = 0
                while start < len(at):
                    if held and (length != vectors.shape[1] or held >= most):
                        yield packed(*parts, part, before)
                        before += sum(v.nbytes for v in parts[2])
                        parts, held = ([], [], []), 0
                    if length != vectors.shape[1]:
                        length, before = vectors.shape[1], 0
                    end = min(len(at), start + most - held)
                    for kept, new in zip(parts, (nodes[at], copies[at], vectors)):
                        kept.append(new[start:end])
                    held, start = held + end - start, end
        if held:
            yield packed(*parts, part, before)

    return pack


def sequence_intervals(
    vectors: DataFrame, axes: np.ndarray, width: float, interval_bytes: int = INTERVAL_BYTES
) -> DataFrame:
    """Intervals of the grid order, numbered along it, in one or several stored rows each.

    Vectors are sorted by their cells along the leading principal axes, equal
    cells by node, so a hot cell is cut into intervals like any other. An
    interval has vectors of one length, of up to twice ``interval_bytes``, from
    however many sorting tasks.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = vectors.select("node", "copies", "embedding").mapInArrow(
        _cells(axes, width), f"node long, copies long, embedding {kind}, cell array<int>"
    )
    order = ["cell", "node"]
    packed = durable(
        durable(placed)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("node", "copies", "embedding")
        .mapInArrow(_pack(axes, interval_bytes), _interval_schema(axes.shape[1]))
    )
    # A row for each task and length.
    sizes = packed.groupBy("low0", "part").agg(F.sum(F.octet_length("vectors")).alias("n"))
    offsets, first, before, length = [], 0, 0, None
    for row in sizes.orderBy("low0", "part").collect():
        if length is not None and row.low0 != length:
            first, before = first + math.ceil(before / interval_bytes), 0
        length = row.low0
        offsets.append((length, row.part, first, before))
        before += row.n
    where = vectors.sparkSession.createDataFrame(offsets, "low0 double, part int, first long, before long")
    nth = F.floor((F.col("before") + F.col("start")) / interval_bytes)
    return (
        packed.join(F.broadcast(where), ["low0", "part"])
        .withColumn("interval", F.col("first") + nth)
        .drop("part", "start", "first", "before")
    )


def _gap(i: int) -> Column:
    """Distance of two boxes along one axis."""
    return F.greatest(
        F.lit(0.0),
        F.col(f"a.low{i}") - F.col(f"b.high{i}"),
        F.col(f"b.low{i}") - F.col(f"a.high{i}"),
    )


def near_intervals(intervals: DataFrame, dimensions: int, reach: float) -> DataFrame:
    """(a, b), a <= b: pairs of intervals that are not provably more than ``reach`` apart.

    The join is recursive: it begins with long intervals, made of ``FAN`` shorter
    ones each, and goes into those pairs alone whose boxes come near enough.
    """
    bounds = _bounds(dimensions)
    merged = [(F.min if b.startswith("low") else F.max)(b).alias(b) for b in bounds]
    level = boxes = durable(intervals.groupBy("interval").agg(*merged))
    levels = [level]
    n = boxes.agg(F.max("interval")).first()[0]
    while n:  # one round for each level
        n //= FAN
        level = level.groupBy(F.floor(F.col("interval") / FAN).alias("interval")).agg(*merged)
        levels.append(level)
    apart = reduce(lambda x, i: x + _gap(i) * _gap(i), range(2, dimensions + 1), _gap(1) * _gap(1))
    near = (_gap(0) == 0) & (apart <= reach * reach + SLACK)
    pairs = levels.pop().select(F.col("interval").alias("a"), F.col("interval").alias("b"))
    while levels:
        children = broadcast_if_small(
            levels.pop().withColumn("parent", F.floor(F.col("interval") / FAN)), within=boxes
        )
        pairs = (
            pairs.join(children.alias("a"), F.col("a") == F.col("a.parent"))
            .join(children.alias("b"), F.col("b") == F.col("b.parent"))
            .where((F.col("a.interval") <= F.col("b.interval")) & near)
            .select(F.col("a.interval").alias("a"), F.col("b.interval").alias("b"))
        )
    return durable(pairs)


class _Groups:
    """Which of ``n`` vectors are connected."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def of(self, at: np.ndarray) -> np.ndarray:
        found = self.up[at]
        while True:
            above = self.up[found]
            if (above == found).all():
                return found
            found = above

    def connect(self, one: np.ndarray, other: np.ndarray) -> None:
        """Join the groups of each two; pairs of one group cost no step in Python."""
        while len(one):
            one, other = self.of(one), self.of(other)
            differ = one != other
            if not differ.any():
                return
            low = np.minimum(one, other)[differ]
            high = np.maximum(one, other)[differ]
            np.minimum.at(self.up, high, low)  # of several, the least; the others come again
            one, other = low, high


class _Side:
    """Vectors of one interval, with its halves, quarters and so on down to the leaves."""

    def __init__(self, rows: list[dict], kind: np.dtype, axes: np.ndarray, leaf: int) -> None:
        self.nodes = np.frombuffer(b"".join([r["nodes"] for r in rows]), np.int64)
        self.copies = np.frombuffer(b"".join([r["copies"] for r in rows]), np.int64)
        self.raw = np.frombuffer(b"".join([r["vectors"] for r in rows]), kind).reshape(len(self.nodes), -1)
        self.unit = unit(self.raw)
        places = self.unit @ axes[: self.raw.shape[1]]
        self.starts = np.arange(0, len(self.nodes), leaf)
        self.ends = np.minimum(self.starts + leaf, len(self.nodes))
        boxes = [(np.minimum.reduceat(places, self.starts), np.maximum.reduceat(places, self.starts))]
        while len(boxes[-1][0]) > 1:
            low, high = boxes[-1]
            half = np.arange(0, len(low), 2)
            boxes.append((np.minimum.reduceat(low, half), np.maximum.reduceat(high, half)))
        self.boxes = boxes
        sizes = (self.ends - self.starts)[:, None]
        self.centre = np.add.reduceat(self.unit, self.starts) / sizes
        away = self.unit - np.repeat(self.centre, sizes[:, 0], axis=0)
        self.radius = np.sqrt(np.maximum.reduceat((away * away).sum(axis=1), self.starts))
        self.n = np.zeros(len(self.nodes), np.int64)

    def box(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        return self.boxes[min(level, len(self.boxes) - 1)]


def _leaf_pairs(one: _Side, other: _Side, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of both sides that are not provably distant, found from the whole intervals down."""
    a = b = np.zeros(1, np.int64)
    for level in range(max(len(one.boxes), len(other.boxes)) - 1, -1, -1):
        (low_a, high_a), (low_b, high_b) = one.box(level), other.box(level)
        gap = np.maximum(low_a[a] - high_b[b], low_b[b] - high_a[a])
        np.maximum(gap, 0, out=gap)
        near = (gap * gap).sum(axis=1) <= reach * reach + SLACK
        if one is other:
            near &= a <= b
        a, b = a[near], b[near]
        if level:
            halves = [
                (2 * x[:, None] + [0, 1] if level < len(s.boxes) else x[:, None])
                for x, s in ((a, one), (b, other))
            ]
            n_a, n_b = (h.shape[1] for h in halves)
            a, b = np.repeat(halves[0], n_b, axis=1).ravel(), np.tile(halves[1], (1, n_a)).ravel()
            inside = (a < len(one.box(level - 1)[0])) & (b < len(other.box(level - 1)[0]))
            a, b = a[inside], b[inside]
    return a, b


def _match(one: _Side, other: _Side, groups: _Groups, threshold: float, reach: float) -> None:
    """Count the links of two intervals for each vector, and connect the groups."""
    shift = 0 if one is other else len(one.nodes)
    a, b = _leaf_pairs(one, other, reach)
    if not len(a):
        return
    between = np.sqrt(((one.centre[a] - other.centre[b]) ** 2).sum(axis=1))
    all_near = between + one.radius[a] + other.radius[b] < reach - 1e-6
    for i, j, whole in zip(a.tolist(), b.tolist(), all_near.tolist()):
        rows, columns = slice(one.starts[i], one.ends[i]), slice(other.starts[j], other.ends[j])
        same = one is other and i == j
        if whole:
            one.n[rows] += other.copies[columns].sum() - (one.copies[rows] if same else 0)
            if not same:
                other.n[columns] += one.copies[rows].sum()
            inside = np.concatenate((np.arange(rows.start, rows.stop), np.arange(columns.start, columns.stop) + shift))
            groups.connect(inside[1:], np.full(len(inside) - 1, inside[0]))
            continue
        cosine = one.unit[rows] @ other.unit[columns].T
        linked = cosine >= threshold
        for x, y in zip(*np.nonzero(np.abs(cosine - threshold) < SLACK)):
            u, v = (s.raw[at].astype(np.float64) for s, at in ((one, rows.start + x), (other, columns.start + y)))
            plain = u @ v / (math.sqrt(u @ u) * math.sqrt(v @ v))
            linked[x, y] = plain >= threshold if math.isfinite(plain) else cosine[x, y] >= threshold
        if same:
            np.fill_diagonal(linked, False)
        if linked.any():
            one.n[rows] += linked @ other.copies[columns]
            if not same:
                other.n[columns] += one.copies[rows] @ linked
            x, y = np.nonzero(linked)
            groups.connect(x + rows.start, y + columns.start + shift)


_FOUND = "node long, n long, root long"


def _compare(kind: str, axes: np.ndarray, threshold: float, reach: float, leaf: int) -> Callable:
    """For each pair of intervals: links of every vector, and one vector of its group."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, table in by_group(batches, ["a", "b"]):
            rows = table.to_pylist()
            of = [[r for r in rows if r["interval"] == i] for i in sorted(set(pair))]
            sides = [_Side(r, np.dtype(kind), axes, leaf) for r in of]
            one, other = sides[0], sides[-1]
            groups = _Groups(sum(len(s.nodes) for s in sides))
            _match(one, other, groups, threshold, reach)
            nodes = np.concatenate([s.nodes for s in sides])
            n = np.concatenate([s.n for s in sides])
            at = np.flatnonzero(n)
            columns = [nodes[at], n[at], nodes[groups.of(at)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "n", "root"])

    return compare


def _links(
    intervals: DataFrame, axes: np.ndarray, kind: str, threshold: float, reach: float, leaf: int
) -> DataFrame:
    pairs = near_intervals(intervals, axes.shape[1], reach)
    n = pairs.count()
    tasks = max(groups_of(n, PAIRS), min(n, 2 * intervals.sparkSession.sparkContext.defaultParallelism))
    pairs = broadcast_if_small(pairs)
    blobs = intervals.select("interval", "nodes", "copies", "vectors")
    one = pairs.join(blobs, F.col("a") == F.col("interval"))
    other = pairs.where("a < b").join(blobs, F.col("b") == F.col("interval"))
    keys = ["a", "b"]
    dealt = one.unionByName(other).repartition(max(1, tasks), *keys).sortWithinPartitions(*keys)
    return durable(dealt.mapInArrow(_compare(kind, axes, threshold, reach, leaf), _FOUND))


def similar_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    dimensions: int = DIMENSIONS,
    interval_bytes: int = INTERVAL_BYTES,
    leaf: int = LEAF,
) -> DataFrame:
    """Links and components of vectors whose cosine is ``threshold`` (above 0) or more.

    Equal vectors form one class, and classes are compared. They are sorted by
    their cells along the leading principal axes, cells as wide as the distance
    that the threshold allows; the sequence is cut into intervals, and pairs of
    intervals are gone into down to short ones unless their boxes are farther
    apart than that. What is left is compared in double precision, with no
    limit on partners. A task compares two intervals and returns a row for each
    vector that it found links of, not the links.

    Returns per row: vec_id, n_links (other rows linked directly), component_id
    (smallest vec_id reached, itself included), kept (vec_id = component_id).
    A vector that is null, empty, zero, or holds a null or something not finite
    links with nothing; so do vectors of different lengths with each other, and
    rows without an id, which have no component and are kept. Rows with equal
    ids are vectors of their own. Other columns are not read.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "float" if isinstance(element, T.FloatType) else "double"
    rows = durable(
        vectors.select(
            F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>")
        ).mapInArrow(_keyed, f"row long, vec_id long, key binary, embedding array<{kind}>")
    )
    comparable = F.col("key").isNotNull() & F.col("vec_id").isNotNull()
    classes = durable(
        rows.where(comparable)
        .groupBy("key")
        .agg(
            F.min("vec_id").alias("class_id"),
            F.count(F.lit(1)).alias("copies"),
            F.min("row").alias("node"),
        )
    )
    firsts = classes.select(F.col("node").alias("row"), "node", "copies")
    chosen = durable(rows.join(broadcast_if_small(firsts), "row").select("node", "copies", "embedding"))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    axes = principal_axes(chosen, dimensions)
    intervals = sequence_intervals(chosen, axes, max(reach, 1e-3), interval_bytes)
    dtype = "float32" if kind == "float" else "float64"
    found = _links(intervals, axes, dtype, threshold, reach, leaf)
    labels = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    judged = durable(
        classes.join(counted, "node", "left")
        .join(labels, "node", "left")
        .select(
            "key",
            "class_id",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("label", "node").alias("label"),
        )
    )
    smallest = judged.groupBy("label").agg(F.min("class_id").alias("component_id"))
    verdict = judged.join(smallest, "label").select("key", "n_links", "component_id")
    linked = rows.where(comparable).select("vec_id", "key").join(
        broadcast_if_small(verdict, within=judged), "key"
    )
    alone = rows.where(~comparable).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.drop("key").unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
