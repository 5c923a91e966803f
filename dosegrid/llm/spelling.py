"""Words that differ by one character, by pairs of trie nodes."""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosegrid.session import durable

#: Words are runs of these letters; only A-Z are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Kinds of pair rows: the place between two characters, and a skipped character, which is
#: the first of a run of equal ones or a later one.
_GAP, _SKIP, _SKIP_LATER = 0, 1, 2

#: Local numbers below the number of a sorted part.
_PART_BITS = 40


def runs_of_letters(docs: DataFrame) -> DataFrame:
    """(doc_id, word) of each occurrence; a null text has none, a null id is an empty string."""
    folded = F.translate("text", _CAPITALS, _CAPITALS.lower())
    return docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.regexp_extract_all(folded, F.lit(LETTERS), F.lit(0))).alias("word"),
    )


def count_words(occurrences: DataFrame, length: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of at least ``length`` characters and ``least`` occurrences."""
    return (
        occurrences.where(F.char_length("word") >= length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )


_NODES = "part long, id long, word string, n long, nodes array<long>, first string"
_NODE_NAMES = [c.split()[0] for c in _NODES.split(",")]


def _number_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trie nodes on the way to each of the sorted words of one part.

    Node 0 is the root; others are numbered as they are met. Of a word only the
    nodes are given that a neighbour in the order goes through as well (all of
    the first and last word, whose neighbours are not seen); the others lead to
    no second word. The last row has no id and tells the first and last word of
    the part, with all nodes of the last.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    base = part << _PART_BITS
    count = row = 0
    first = before = None
    chain, shared = [0], 0
    rows: list[tuple] = []

    def written() -> pa.RecordBatch:
        columns = zip(*rows)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, _NODE_NAMES)

    for batch in batches:
        names = batch.schema.names
        ids = batch.column("id").to_pylist() if "id" in names else None
        counts = batch.column("n").to_pylist()
        for i, word in enumerate(batch.column("word").to_pylist()):
            common = 0
            if before is None:
                first = word
            else:
                common = len(commonprefix((before[1], word)))
                rows.append((part, *before, chain[: max(shared, common) + 1], None))
            chain = chain[: common + 1]
            new = len(word) - common
            chain.extend(range(base + count + 1, base + count + new + 1))
            count += new
            shared = len(word) if before is None else common
            before = (ids[i] if ids else base + row, word, counts[i])
            row += 1
        if rows:
            yield written()
    if before is not None:
        rows += [(part, *before, chain, None), (part, None, before[1], None, chain, first)]
        yield written()


def trie_nodes(words: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(id, word, n, nodes) of sorted words, and the numbers that nodes have in earlier parts.

    Words are sorted over all tasks. A node that two parts have is on the way to
    the first word of the later one, so the first and last word of each part
    tell them all.
    """
    numbered = durable(
        words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(_number_nodes, _NODES)
    )
    earlier: dict[int, int] = {}
    last, nodes = "", [0]
    for border in numbered.where("id IS NULL").orderBy("part").collect():  # a row for each part
        base = border.part << _PART_BITS
        for depth in range(1, len(commonprefix((last, border.first))) + 1):
            earlier[base + depth] = nodes[depth]
        last, nodes = border.word, [earlier.get(x, x) for x in border.nodes]
    return numbered.where("id IS NOT NULL").select("id", "word", "n", "nodes"), earlier


def _flat(column: pa.ListArray, earlier: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of all rows by their final number, the first place of each row, and its length."""
    nodes = column.flatten().to_numpy()
    if earlier:
        old = np.array(sorted(earlier), np.int64)
        new = np.array([earlier[x] for x in old.tolist()], np.int64)
        at = np.minimum(np.searchsorted(old, nodes), len(old) - 1)
        nodes = np.where(old[at] == nodes, new[at], nodes)
    sizes = column.value_lengths().to_numpy().astype(np.int64)
    return nodes, np.cumsum(sizes) - sizes, sizes


_PAIRS = "prefix long, suffix long, id long, n long, kind int"


def _pairs(earlier: dict[int, int], earlier_reversed: dict[int, int]):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            length = pc.utf8_length(words).to_numpy().astype(np.int64)
            text = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
            letters = np.cumsum(length) - length
            pre, pre_at, pre_n = _flat(batch.column("pre"), earlier)
            suf, suf_at, suf_n = _flat(batch.column("suf"), earlier_reversed)
            ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            for left_out in (0, 1):
                # Prefixes of i characters and suffixes of the rest that both have a node here.
                rest = length - left_out
                low, high = np.maximum(0, rest - suf_n + 1), np.minimum(pre_n - 1, rest)
                many = np.maximum(high - low + 1, 0)
                row = np.repeat(np.arange(len(ids)), many)
                i = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
                if left_out:
                    at = letters[row] + i
                    later = (i > 0) & (text[at] == text[at - 1])
                    kind = np.where(later, _SKIP_LATER, _SKIP)
                else:
                    kind = np.full(len(row), _GAP)
                columns = [
                    pre[pre_at[row] + i],
                    suf[suf_at[row] + rest[row] - i],
                    ids[row],
                    n[row],
                    kind.astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], [c.split()[0] for c in _PAIRS.split(",")]
                )

    return pairs


def node_pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered words (id, word, n), and their pairs (prefix, suffix, id, n, kind).

    Numbers follow the order of the words by code points. A word gives a pair
    for each place between two of its characters, and one for each character
    left out, as far as both nodes are on the way to another word too.
    """
    forward, earlier = trie_nodes(words)
    backward, earlier_reversed = trie_nodes(forward.select("id", F.reverse("word").alias("word"), "n"))
    both = forward.withColumnRenamed("nodes", "pre").join(
        backward.select("id", F.col("nodes").alias("suf")), "id"
    )
    return forward.drop("nodes"), both.mapInArrow(_pairs(earlier, earlier_reversed), _PAIRS)


def _rated(condition: Column | None = None) -> Column:
    """More occurrences first, then the smaller number; null where the condition fails."""
    rate = F.struct("n", (-F.col("id")).alias("down"))
    return rate if condition is None else F.when(condition, rate)


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): words one character away, and the commonest of them.

    Words with the same pair and one character left out differ by it alone: a
    replacement. A word with the pair at a place between characters lacks the
    character that another one leaves out; in a run of equal characters only the
    first counts, as leaving out any of them gives the same word. A pair is
    held by one word at most between characters, and by no more words with one
    left out than there are characters.
    """
    bucket = Window.partitionBy("prefix", "suffix")
    ranked = bucket.orderBy(F.col("kind") == _GAP, F.desc("n"), "id").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    is_gap, is_skip = F.col("kind") == _GAP, F.col("kind") == _SKIP
    seen = pairs.select(
        "id",
        "kind",
        F.count(F.when(~is_gap, 1)).over(ranked).alias("skips"),
        F.count(F.when(is_skip, 1)).over(ranked).alias("firsts"),
        F.max(_rated(is_gap)).over(ranked).alias("gap"),
        F.max(_rated(is_skip)).over(ranked).alias("first_best"),
        F.first(_rated(~is_gap)).over(ranked).alias("best"),
        F.nth_value(_rated(~is_gap), 2).over(ranked).alias("second"),
    )
    own = F.col("best")["down"] == -F.col("id")
    other = F.when(own, F.col("second")).otherwise(F.col("best"))
    shorter = F.when(is_skip, F.col("gap"))
    return (
        seen.select(
            "id",
            F.when(is_gap, F.col("firsts"))
            .otherwise(F.col("skips") - 1 + shorter.isNotNull().cast("long"))
            .alias("n_near"),
            F.when(is_gap, F.col("first_best")).otherwise(F.greatest(other, shorter)).alias("best"),
        )
        .where("n_near > 0")
        .groupBy("id")
        .agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): the last word that is reached from form to form.

    Each round doubles the steps taken, and is stored; a form has at least twice
    the occurrences, so there are few.
    """
    reached = durable(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        stepped = durable(
            reached.join(ahead, "root", "left").select(
                "id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
            )
        )
        reached = stepped.select("id", "root")
        if not stepped.where("moved").limit(1).count():
            return reached


def spelling_variants(occurrences: DataFrame, length: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """Each frequent word with the common word that it may be a variant of.

    ``occurrences`` has a row for each occurrence, with its ``word``; null words
    don't count, other columns are not read. Two words are near if one inserted,
    deleted or replaced character (code point) turns one into the other; all such
    pairs are found, by equal pairs of trie nodes. The form of a word is its
    near word with most occurrences (ties: the first by code points) if that has
    at least ``times`` as many; forms are followed up to the root.

    Returns per word: word, form (or null), root (the word itself without a
    form), n, n_near, form_n. An empty table gives no rows.
    """
    counted = durable(count_words(occurrences.select("word"), length, least))
    numbered, pairs = node_pairs(counted)
    near = durable(numbered.join(neighbours(pairs), "id", "left"))
    has_form = F.col("best.n") >= times * F.col("n")
    rooted = near.where(has_form).select(
        "id", (-F.col("best.down")).alias("form"), F.col("best.n").alias("form_n")
    )
    rooted = rooted.join(roots(rooted), "id")
    names = numbered.select(F.col("id").alias("named"), F.col("word").alias("name"))
    named = (
        rooted.join(names, F.col("form") == F.col("named"))
        .select("id", "form_n", "root", F.col("name").alias("form"))
        .join(names, F.col("root") == F.col("named"))
        .select("id", "form_n", "form", F.col("name").alias("root"))
    )
    return near.join(named, "id", "left").select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        "form_n",
    )
