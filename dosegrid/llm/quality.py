"""Quality rules: text statistics and tokeniser fertility with bands per language."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosegrid.llm.common import covered, mixed, raw, rolling, slices, small_side
from dosegrid.session import durable

#: Public vocabularies by file name or path; executors find them in place.
VOCABULARIES = ("piece_bpe_32k.model",)

# Fixed values of the base rules.
_SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


class Vocabulary:
    """Tokens of single words, remembered for the words met lately.

    Words are encoded one by one, so that white space costs no tokens; pieces
    of the given vocabularies do not span words. A known word has a number, and
    the tokens of all of them lie in one array.
    """

    limit = 150_000

    def __init__(self, name: str) -> None:
        self.known: dict[bytes, int] = {}
        self.forget()
        if not os.path.isabs(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        if name.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(name, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encoding = tiktoken.Encoding(
                "own",
                pat_str=public_tokenizers.PATTERN,
                mergeable_ranks=ranks,
                special_tokens={},
            )
            self.encode = lambda words: [encoding.encode_ordinary(" " + w) for w in words]
            single = [v for k, v in ranks.items() if len(k) == 1 and k[0] >= 128]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=name)
            self.encode = lambda words: model.encode(words, num_threads=1)
            single = [i for i in range(model.piece_size()) if model.is_byte(i)]
        self.is_byte = np.zeros(max(single) + 1, bool)
        self.is_byte[single] = True

    def forget(self) -> None:
        self.known.clear()
        self.tokens = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def learn(self, texts: list[list[bytes]]) -> None:
        """Encode the words of some texts that are not known yet, in one call."""
        if len(self.known) > self.limit:
            self.forget()
        new = list({w for words in texts for w in words if w not in self.known})
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        encoded = self.encode([w.decode() for w in new])
        ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))
        tokens = np.fromiter(chain.from_iterable(encoded), np.int32)
        self.starts = np.concatenate((self.starts, len(self.tokens) + ends))
        self.tokens = np.concatenate((self.tokens, tokens))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def measures(self, words: list[bytes], characters: int) -> tuple[float, float, float]:
        return self.measures_of(self.numbers(words), characters)

    def measures_of(self, numbers: np.ndarray, characters: int) -> tuple[float, float, float]:
        """Characters per token, share of byte tokens, entropy of the tokens over its maximum."""
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        if n == 0:
            return 0.0, 0.0, 0.0
        tokens = self.tokens[np.arange(n) + np.repeat(self.starts[numbers] - ends + sizes, sizes)]
        tokens.sort()
        counts = np.diff(np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True]))))
        low = tokens[: np.searchsorted(tokens, len(self.is_byte))]
        share = counts / n
        entropy = float(-(share * np.log2(share)).sum() / np.log2(n)) if n > 1 else 1.0
        return characters / n, float(self.is_byte[low].sum() / n), entropy


def _repeated_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip():  # of bytes: the six white space characters
            seen.add(line)
    return repeated


def _repeated_words(hashes: np.ndarray) -> int:
    """Words in runs of three words that the text has twice or more."""
    windows = rolling(hashes, 3)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    return int(covered(order[twice], 3, len(hashes)).sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "byte_share", "entropy")


def _measure(vocabularies: tuple[str, ...]) -> Callable:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Vocabulary(name) for name in vocabularies]
        not_symbol = bytes(c for c in range(256) if c not in _SYMBOLS)
        not_continued = bytes(c for c in range(256) if not 0x80 <= c < 0xC0)
        for batch in slices(batches, size=1 << 20):
            texts = [t or b"" for t in raw(batch.column("text"))]
            words = [t.split() for t in texts]
            for model in models:
                model.learn(words)
            columns: dict[str, list] = {c: [] for c in (*COUNTS, *MEASURES)}
            for text, own in zip(texts, words):
                characters = sum(map(len, own)) - len(text.translate(None, not_continued))
                numbered = [m.numbers(own) for m in models]
                values = [
                    len(own),
                    characters,
                    len(text.translate(None, not_symbol)),
                    _repeated_lines(text),
                    _repeated_words(mixed(numbered[0].view(np.uint64))),
                ]
                for name, value in zip(COUNTS, values):
                    columns[name].append(value)
                by_model = list(zip(*(m.measures_of(n, characters) for m, n in zip(models, numbered))))
                for name, value in zip(MEASURES, by_model):
                    columns[name].append(list(value))
            added = [pa.array(columns[c], pa.int64()) for c in COUNTS]
            added += [pa.array(columns[c], pa.list_(pa.float64())) for c in MEASURES]
            keys = ["doc_id", "text_hash", "lang"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keys), *added], [*keys, *COUNTS, *MEASURES]
            )

    return measure


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )


def measure_documents(
    docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES
) -> DataFrame:
    """Counts and fertility of each row, in one narrow pass; see :func:`quality_report`.

    It takes one vocabulary at least; its numbers of the words also tell which repeat.
    """
    counts = ", ".join(f"{c} long" for c in COUNTS)
    measures = ", ".join(f"{c} array<double>" for c in MEASURES)
    return docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "lang", "text"
    ).mapInArrow(
        _measure(vocabularies), f"doc_id long, text_hash long, lang string, {counts}, {measures}"
    )


#: Steps in which measures are counted, in one unit.
TICKS = 10_000


def _quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, n, middle, spread) from counted ticks: median and interquartile range."""
    ticks = counts.groupBy(*keys, "measure", "tick").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("tick"))
    placed = ticks.withColumns({"upto": upto, "total": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("total")), F.col("tick"))) / TICKS
    return placed.groupBy(*keys, "measure").agg(
        F.first("total").alias("n"), at(0.5).alias("middle"), (at(0.75) - at(0.25)).alias("spread")
    )


def bands(measured: DataFrame, width: float = 6.0, prior: float = 30.0) -> DataFrame:
    """Accepted range of every measure by language and size class, over all documents.

    The middle is the median; the half width is ``width`` robust deviations
    (interquartile range / 1.349), at least a twentieth of the middle. Size classes
    are powers of four of the number of words, as short texts vary more. The
    figures of a class are drawn to those of its language, and these to those
    of all documents, as if ``prior`` documents more stood there. Quartiles are
    exact, of values in ticks, whatever task counts which rows.
    """
    tick = F.round(F.col("value") * TICKS).cast("long").alias("tick")
    values = [F.struct(F.lit(m).alias("measure"), F.element_at(m, 1).alias("value")) for m in MEASURES]
    counts = durable(
        measured.where(~base_failed())
        .select("lang", _size_class(), F.inline(F.array(*values)))
        .groupBy("lang", "size_class", "measure", tick)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = _quartiles(counts, []).withColumnsRenamed({"middle": "up_middle", "spread": "up_spread"}).drop("n")
    keys: list[str] = []
    for key in ("lang", "size_class"):
        own, above = _quartiles(counts, [*keys, key]).alias("o"), F.broadcast(found).alias("a")
        same = F.col("o.measure") == F.col("a.measure")
        for k in keys:
            same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"a.{k}"))
        keys.append(key)
        drawn = [
            ((F.col("o.n") * F.col(f"o.{c}") + prior * F.col(f"a.up_{c}")) / (F.col("o.n") + prior)).alias(f"up_{c}")
            for c in ("middle", "spread")
        ]
        found = own.join(above, same).select(*(f"o.{k}" for k in keys), "o.measure", *drawn)
    half = F.greatest(width * F.col("up_spread") / 1.349, 0.05 * F.col("up_middle"))
    edges = {"low": F.col("up_middle") - half, "high": F.col("up_middle") + half}
    columns = [
        F.first(F.when(F.col("measure") == m, edge), ignorenulls=True).alias(f"{m}_{side}")
        for m in MEASURES
        for side, edge in edges.items()
    ]
    return found.groupBy(*keys).agg(*columns)


def _size_class() -> Column:
    return F.floor(F.log2(F.greatest("n_words", F.lit(1))) / 2).cast("int").alias("size_class")


def quality_report(
    docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, width: float = 6.0
) -> DataFrame:
    """Text statistics, fertility and verdict of each document.

    A document fails the base rules with fewer than 50 words, or if more than
    half of its words lie in repeated runs of three. The others are held
    against the bands of their language (:func:`bands`): characters per token
    on either side, the share of byte tokens from above, and the entropy of
    the tokens from below. With several vocabularies the first decides.

    Returns per row: doc_id, text_hash, lang, the counts, the measures (one per
    vocabulary), base_failed, kept. A null text is an empty one. A null
    language is a language of its own. Repeated rows are judged alike; other
    columns are not read. The measured rows are stored once, as the bands need
    all of them.
    """
    measured = durable(measure_documents(docs, vocabularies))
    ranges = small_side(durable(bands(measured, width).withColumnRenamed("lang", "band_lang")))
    rows = measured.withColumn("size_class", _size_class()).alias("m")
    joined = rows.join(
        ranges.alias("b"),
        F.col("m.lang").eqNullSafe(F.col("b.band_lang"))
        & (F.col("m.size_class") == F.col("b.size_class")),
        "left",
    )
    fertility, fallback, entropy = (F.element_at(f"m.{m}", 1) for m in MEASURES)
    outside = (
        (fertility < F.col("chars_per_token_low"))
        | (fertility > F.col("chars_per_token_high"))
        | (fallback > F.col("byte_share_high") + 0.05)
        | (entropy < F.col("entropy_low"))
    )
    failed = base_failed()
    return joined.select(
        *(F.col(f"m.{c}") for c in ("doc_id", "text_hash", "lang", *COUNTS, *MEASURES)),
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(outside, F.lit(False))).alias("kept"),
    )


def quality_filter(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that the report keeps, with all their columns."""
    rejected = durable(
        quality_report(docs, **options).where("NOT kept").select("doc_id", "text_hash").distinct()
    )
    return without(docs, rejected)


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are not listed as (doc_id, text_hash)."""
    gone = small_side(rejected).alias("gone")
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("gone.doc_id")) & (
        F.xxhash64("doc.text") == F.col("gone.text_hash")
    )
    return docs.alias("doc").join(gone, same, "left_anti")
