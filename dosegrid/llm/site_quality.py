"""Quality of documents from their own words and from the sites they stand on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosegrid.llm.common import WordHashes, lowered, raw, slices, small_side
from dosegrid.llm.quality import _SYMBOLS, _repeated_words
from dosegrid.session import durable

_SPACES = "[\\x20\\x09-\\x0D]+"
_MARKS = ".,;:!?\"'()[]{}<>"
DENSE = 5
#: Probabilities stay this far from 0 and 1.
EDGE = 1e-4


def _forms(text: bytes) -> tuple[list[bytes], set[bytes]]:
    """Words in lower case; these and the same without the marks around them."""
    words = lowered(text).split()
    distinct = set(words)
    return words, distinct.union(w.strip(_MARKS.encode()) for w in distinct)


def _dense(text: bytes, words: list[bytes], cache: WordHashes) -> list[float]:
    """Size, symbols, repetition and word length, each about between 0 and 1."""
    n = max(1, len(words))
    symbols = len(text.translate(None, bytes(c for c in range(256) if c not in _SYMBOLS)))
    return [
        1.0,
        float(np.log2(n)) / 10,
        min(1.0, symbols / n),
        _repeated_words(cache.of(words)) / n,
        min(2.0, len(text) / n / 10),
    ]


def _features(vocabulary: dict[bytes, int]) -> Callable:
    """Numbers of the known words in each text, and its dense features."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches):
            known, dense = [], []
            for text in raw(batch.column("text")):
                words, forms = _forms(text or b"")
                known.append(sorted(vocabulary[w] for w in vocabulary.keys() & forms))
                dense.append(_dense(text or b"", words, cache))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("good"),
                    pa.array(known, pa.list_(pa.int32())),
                    pa.array(dense, pa.list_(pa.float64())),
                ],
                ["good", "known", "dense"],
            )

    return features


class Classifier:
    """Logistic regression over the presence of some words and a few dense features."""

    def __init__(self, vocabulary: dict[bytes, int], weights: np.ndarray, rate: float) -> None:
        self.vocabulary = vocabulary
        self.weights = weights
        #: Share of good documents in training, which the evidence is relative to.
        self.rate = rate

    def probabilities(self, texts: list[bytes | None], cache: WordHashes) -> np.ndarray:
        scores = []
        for text in texts:
            words, forms = _forms(text or b"")
            own = [self.vocabulary[w] for w in self.vocabulary.keys() & forms]
            dense = _dense(text or b"", words, cache)
            scores.append(self.weights[own].sum() + self.weights[-DENSE:] @ dense)
        return 1 / (1 + np.exp(-np.clip(scores, -30, 30)))


def _trained(good: np.ndarray, known: list[list[int]], dense: np.ndarray, size: int) -> np.ndarray:
    """Weights by full gradients with adaptive steps; a constant number of them."""
    row = np.repeat(np.arange(len(known)), [len(k) for k in known])
    word = np.array([w for k in known for w in k], np.int64)
    weights = np.zeros(size + DENSE)
    squares = np.full(size + DENSE, 1e-8)
    for _ in range(600):
        score = dense @ weights[-DENSE:]
        score += np.bincount(row, weights[word], len(known))
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - good
        slope = np.concatenate((np.bincount(word, error[row], size), dense.T @ error))
        slope = slope / len(good) + 1e-5 * weights
        squares += slope**2
        weights -= 0.3 * slope / np.sqrt(squares)
    return weights


def fit_classifier(
    docs: DataFrame, labels: DataFrame, fit_rows: int = 8000, words: int = 4096, sure: float = 4.0
) -> Classifier:
    """Train on ``fit_rows`` labelled documents at most, which a hash of their ids picks.

    Good is quality 1 without toxicity. Of the words in at least five of these
    documents, those are features whose share of good ones is ``sure`` standard
    errors from the mean, the ``words`` surest at most; that table and the
    features of the sample are all that reaches the driver.
    """
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    picked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.min(good).alias("good"))
        .orderBy(F.xxhash64(F.lit("fit"), "labelled"), "labelled")
        .limit(fit_rows)
    )
    # An id may stand in several rows, so the bound holds for the rows that are found.
    place = F.xxhash64(F.lit("fit"), "doc_id", "text")
    found = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("labelled"))
    sample = durable(found.orderBy(place, "doc_id", "text").limit(fit_rows).select("good", "text"))
    n = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("good"), F.lit(0))).first()
    rate = (n[1] + 1) / (n[0] + 2)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tokens = F.split(F.translate(F.coalesce("text", F.lit("")), upper, lower), _SPACES)
    bare = F.transform(tokens, lambda w: F.btrim(w, F.lit(_MARKS)))
    tokens = F.array_distinct(F.concat(tokens, bare))
    counts = (
        sample.select("good", F.explode(tokens).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("g"))
        .where("n >= 5 AND word != ''")
    )
    surprise = F.abs(F.col("g") - rate * F.col("n")) / F.sqrt(rate * (1 - rate) * F.col("n"))
    told = counts.withColumn("surprise", surprise).where(F.col("surprise") >= sure)
    chosen = told.orderBy(F.desc("surprise"), "word").limit(words).select("word").collect()
    vocabulary = {r["word"].encode(): i for i, r in enumerate(chosen)}
    rows = sample.mapInArrow(
        _features(vocabulary), "good int, known array<int>, dense array<double>"
    ).collect()
    weights = np.zeros(len(vocabulary) + DENSE)
    if rows:
        target = np.array([r["good"] for r in rows], float)
        dense = np.array([r["dense"] for r in rows])
        weights = _trained(target, [r["known"] for r in rows], dense, len(vocabulary))
    return Classifier(vocabulary, weights, rate)


def _evidence(classifier: Classifier) -> Callable:
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches):
            p = classifier.probabilities(raw(batch.column("text")), cache)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(np.clip(p, EDGE, 1 - EDGE))],
                [*kept, "p"],
            )

    return evidence


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - EDGE)), F.lit(EDGE))
    return F.log(p / (1 - p))


def _strength(sums: DataFrame, groups: int, middle: Column) -> float:
    """Pseudo-documents of the prior over some groups, by the method of moments.

    Groups that scatter about ``middle`` no more than chance get a strong prior.
    """
    mean = F.col("s") / F.col("n")
    spread = F.greatest(middle * (1 - middle), F.lit(EDGE))
    n, squares, q = sums.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)),
        F.coalesce(F.sum(F.col("n") * (mean - middle) * (mean - middle) / spread), F.lit(0.0)),
    ).first()
    free = max(1, groups)
    room = n - squares / max(1, n) - free
    share = (q - free) / room if room > 0 else 0.0
    share = min(0.99, max(1e-3, share))
    return 1 / share - 1


def judge_documents(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    least: float = 0.5,
    fit_rows: int = 8000,
    classifier: Classifier | None = None,
) -> DataFrame:
    """Probability that a document is good, from its words and its site.

    A classifier gives each document a probability. Its sums per host, and per
    path within a host, are shrunk by empirical Bayes: a host towards the mean
    of all documents, a path towards its host, each as if a number of
    pseudo-documents (found from how much groups differ) stood there. A
    document's own evidence is taken out of the sums that judge it. The
    posterior odds are the evidence of the words, relative to the training
    rate, times the odds of the path. Hosts of any size are summed by grouped
    aggregation, with partial sums before the shuffle.

    Returns per row: doc_id, host, path, p_document, p_host, p_path, p_good,
    kept (p_good >= ``least``). A null or empty text is judged by its size
    features; null hosts and paths are groups of their own. Repeated rows count
    as often as they stand there. Without labels every document has the same
    evidence. Other columns are not read.
    """
    classifier = classifier or fit_classifier(docs, labels, fit_rows)
    scored = durable(
        docs.select(
            F.col("doc_id").cast("long"),
            F.coalesce(host.cast("string"), F.lit("")).alias("host"),
            F.coalesce(path.cast("string"), F.lit("")).alias("path"),
            "text",
        ).mapInArrow(_evidence(classifier), "doc_id long, host string, path string, p double")
    )
    paths = durable(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    hosts = durable(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("paths")))
    total = hosts.agg(F.sum("n"), F.sum("s"), F.count(F.lit(1)), F.sum("paths")).first()
    mean = (total[1] or 0.0) / total[0] if total[0] else classifier.rate
    for_hosts = _strength(hosts, total[2] - 1, F.lit(float(mean)))
    within = paths.join(
        small_side(hosts.select("host", (F.col("s") / F.col("n")).alias("host_mean"))), "host"
    )
    for_paths = _strength(within, (total[3] or 0) - total[2], F.col("host_mean"))
    sites = paths.select("host", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s")).join(
        small_side(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))), "host"
    )
    joined = scored.join(small_side(durable(sites)), ["host", "path"])
    p_host = (F.col("host_s") - F.col("p") + for_hosts * mean) / (F.col("host_n") - 1 + for_hosts)
    p_path = (F.col("path_s") - F.col("p") + for_paths * F.col("p_host")) / (
        F.col("path_n") - 1 + for_paths
    )
    odds = _logit(F.col("p")) - _logit(F.lit(classifier.rate)) + _logit(F.col("p_path"))
    return (
        joined.withColumn("p_host", p_host)
        .withColumn("p_path", p_path)
        .withColumn("p_good", 1 / (1 + F.exp(-odds)))
        .select(
            "doc_id", "host", "path", F.col("p").alias("p_document"), "p_host", "p_path", "p_good",
            (F.col("p_good") >= least).alias("kept"),
        )
    )
