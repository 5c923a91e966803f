"""Personal data: fixed patterns, and a skip-chain conditional random field over tokens."""

from __future__ import annotations

import copy
import pickle
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosegrid.llm.common import slices
from dosegrid.session import durable

#: Kinds in the order of the report; label 0 of the field is "none".
KINDS = ("email", "ip", "card", "phone")

# The base patterns. The quantifiers never give back, where that
# cannot change a match, so that time is linear in the text.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Check sum of card numbers."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _HOST.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            found.append((start, done))
        at = text.find("@", max(done, at + 1))
    return found


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by kind and place."""
    if not _HINT.search(text):
        return []
    spans = [("email", *s) for s in _emails(text)]
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    spans += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
    return spans + [
        ("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15
    ]


#: Places of hashed features.
FEATURES = 1 << 14
LABELS = 1 + len(KINDS)
#: Edges: neighbours, equal tokens, similar tokens.
CHAIN, EQUAL, SIMILAR = range(3)
_EDGE_KINDS = 3
_BIAS = zlib.crc32(b"bias") % FEATURES
_AROUND = ".,;:!?\"'<>[]{}"


class _Token:
    """A token with a digit or an @, without the punctuation around it, and its features."""

    __slots__ = ("start", "end", "features", "keys", "label")

    def __init__(self, start: int, core: str, near: tuple[str, str, str], label: int) -> None:
        self.start, self.end, self.label = start, start + len(core), label
        digits = _digits(core)
        n = len(digits)
        size = sum(n >= limit for limit in (1, 4, 6, 7, 9, 10, 13, 16, 20))
        letters = "a" if any(c.isalpha() for c in core) else ""
        sums = "L" if 13 <= n <= 19 and luhn(digits) else ""
        dots = min(core.count("."), 3)
        marks = "".join(c for c in "@+(-" if c in core)
        form = re.sub("[0-9]+", lambda m: f"9{min(len(m[0]), 5)}", core) if len(core) < 40 else "long"
        told = [
            "bias",
            f"shape={size}{marks}{dots}{letters}{sums}",
            f"size={size}{letters}{sums}",
            f"form={re.sub('[^0-9@+().:/=_-]+', 'a', form)}",
            f"marks={marks}{dots}",
            *(f"{place}={word}" for place, word in zip(("before2", "before", "after"), near)),
        ]
        self.features = [zlib.crc32(f.encode()) % FEATURES for f in told]
        self.keys = _keys(core, digits)


def _keys(core: str, digits: str) -> tuple[list[str], list[str]]:
    """What equal tokens share, and what similar ones do.

    Numbers are equal by their last seven digits, and similar if the last nine
    differ by one digit. Names before an @ are equal whatever their case, and
    similar without marks, digits and what follows a plus.
    """
    if "@" in core:
        name = core.partition("@")[0].lower()
        plain = re.sub("[^a-z]", "", name.partition("+")[0])
        return ([f"@{name}"] if name else []), ([f"~{plain}"] if len(plain) > 2 else [])
    if len(digits) < 6:
        return [], []
    last = digits[-9:]
    cut = sorted({f"~{len(last)}{last[:i]}-{last[i + 1 :]}" for i in range(len(last))}) if len(digits) >= 9 else []
    return [digits[-7:]], cut


def _tokens(text: str, spans: list[Span]) -> list[_Token]:
    order = sorted((start, end, KINDS.index(kind) + 1) for kind, start, end in spans)
    words = list(_TOKEN.finditer(text))
    bare = lambda i: words[i][0].strip(_AROUND).lower()[:20] if 0 <= i < len(words) else ""
    found, at, open_spans = [], 0, []
    for i, match in enumerate(words):
        word = match[0]
        core = word.strip(_AROUND) if _HINT.search(word) else ""
        if not core:
            continue
        start = match.start() + word.index(core)
        end = start + len(core)
        while at < len(order) and order[at][0] < end:
            open_spans.append(order[at])
            at += 1
        open_spans = [span for span in open_spans if span[1] > start]
        near = tuple(_DIGITS.sub("9", bare(j)) for j in (i - 2, i - 1, i + 1))
        found.append(_Token(start, core, near, open_spans[0][2] if open_spans else 0))
    return found


def _edges(tokens: list[_Token]) -> list[tuple[int, int, int]]:
    """(token, token, kind): neighbours, and each token with the last ones that resemble it."""
    edges = [
        (i, i + 1, CHAIN) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if b.start - a.end <= 3
    ]
    seen: dict[str, int] = {}
    for i, token in enumerate(tokens):
        linked: set[int] = set()
        for kind, keys in zip((EQUAL, SIMILAR), token.keys):
            for key in keys:
                other = seen.get(key)
                if other is not None and other not in linked:
                    linked.add(other)
                    edges.append((other, i, kind))
                seen[key] = i
    return edges


class Graph:
    """Tokens of some texts with their edges, as arrays."""

    def __init__(self, texts: list[list[_Token]]) -> None:
        edges: list[tuple[int, int, int]] = []
        first = 0
        for tokens in texts:
            edges += [(a + first, b + first, kind) for a, b, kind in _edges(tokens)]
            first += len(tokens)
        every = [t for tokens in texts for t in tokens]
        self.n = len(every)
        self.labels = np.array([t.label for t in every], np.int64)
        self.feature = np.array([f for t in every for f in t.features], np.int64)
        self.owner = np.repeat(np.arange(self.n), [len(t.features) for t in every])
        self.pairs = np.array(edges, np.int64).reshape(-1, 3)

    def without(self, tokens: np.ndarray) -> Graph:
        """The same with nothing known of some tokens but their edges."""
        out = copy.copy(self)
        use = ~tokens[self.owner] | (self.feature == _BIAS)
        out.feature, out.owner = self.feature[use], self.owner[use]
        return out

    def scores(self, field: Field) -> np.ndarray:
        out = np.zeros((self.n, LABELS))
        np.add.at(out, self.owner, field.weights[self.feature])
        return out

    def beliefs(
        self, field: Field, given: np.ndarray | None = None, rounds: int = 8
    ) -> tuple[np.ndarray, np.ndarray]:
        """Log-potentials of each label after loopy messages, and the messages of the edges.

        ``given`` has the label of each token, or -1 where it is open. Messages
        go along all edges at once, first from the first to the second token of
        each, then back.
        """
        nodes = self.scores(field)
        if given is not None:
            known = np.flatnonzero(given >= 0)
            nodes[known] = -30.0
            nodes[known, given[known]] = 0.0
        a, b, kind = self.pairs.T
        n = len(a)
        source, target = np.concatenate((a, b)), np.concatenate((b, a))
        back = np.concatenate((np.arange(n, 2 * n), np.arange(n)))
        of_kind = [np.flatnonzero(np.concatenate((kind, kind)) == k) for k in range(_EDGE_KINDS)]
        powers = np.exp(field.edges)
        messages = np.zeros((2 * n, LABELS))
        total = nodes
        for _ in range(rounds if n else 0):
            sent = total[source] - messages[back]
            sent = np.exp(sent - sent.max(axis=1, keepdims=True))
            new = np.empty_like(messages)
            for at, power in zip(of_kind, powers):
                new[at] = np.log(sent[at] @ power + 1e-300)
            new -= new.max(axis=1, keepdims=True)
            messages = 0.5 * messages + 0.5 * new
            total = nodes.copy()
            np.add.at(total, target, messages)
        return total, messages

    def pair_shares(self, field: Field, total: np.ndarray, messages: np.ndarray) -> np.ndarray:
        """Probabilities of the label pairs of each edge."""
        a, b, kind = self.pairs.T
        n = len(a)
        left, right = total[a] - messages[n:], total[b] - messages[:n]
        return _shares(left[:, :, None] + right[:, None, :] + field.edges[kind])


def _shares(potentials: np.ndarray) -> np.ndarray:
    """Probabilities from log-potentials, over all axes but the first."""
    if not len(potentials):
        return potentials
    flat = potentials.reshape(len(potentials), -1)
    flat = np.exp(flat - flat.max(axis=1, keepdims=True))
    return (flat / flat.sum(axis=1, keepdims=True)).reshape(potentials.shape)


class Field:
    """A skip-chain conditional random field: weights of features and of edges by label."""

    def __init__(self) -> None:
        self.weights = np.zeros((FEATURES, LABELS))
        self.edges = np.zeros((_EDGE_KINDS, LABELS, LABELS))

    def slopes(self, graph: Graph, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes of the log-likelihood; edge weights are the same in both directions."""
        shares, pairs = [], []
        for labels in (given, None):
            total, messages = graph.beliefs(self, labels)
            shares.append(_shares(total))
            pairs.append(graph.pair_shares(self, total, messages))
        slope, slope_edges = np.zeros_like(self.weights), np.zeros_like(self.edges)
        np.add.at(slope, graph.feature, (shares[0] - shares[1])[graph.owner])
        difference = pairs[0] - pairs[1]
        np.add.at(slope_edges, graph.pairs[:, 2], (difference + difference.transpose(0, 2, 1)) / 2)
        return slope, slope_edges

    def fit(self, graph: Graph, rounds: int = 100, prior: float = 0.02) -> Field:
        """Raise the likelihood of the labels by adaptive gradient steps.

        The slope is the difference of what features and edges are expected
        with the labels given and without, both by loopy messages. A token
        without a label that an edge of resemblance links to a labelled one is
        left open: it may be what the patterns miss. In each round the features
        of every other token, by chance, are left out, so that edges have to
        tell labels as well.
        """
        given = graph.labels.copy()
        for a, b, kind in graph.pairs:
            if kind != CHAIN:
                for one, other in ((a, b), (b, a)):
                    if graph.labels[one] and not graph.labels[other]:
                        given[other] = -1
        n = max(1, graph.n)
        squares, squares_edges = np.full_like(self.weights, 1e-8), np.full_like(self.edges, 1e-8)
        chance = np.random.default_rng(5)
        for _ in range(rounds if graph.n else 0):
            slope, slope_edges = self.slopes(graph.without(chance.random(graph.n) < 0.5), given)
            slope = (slope - prior * self.weights) / n
            slope_edges = (slope_edges - prior * self.edges) / n
            squares += slope**2
            squares_edges += slope_edges**2
            self.weights += 0.3 * slope / np.sqrt(squares)
            self.edges += 0.3 * slope_edges / np.sqrt(squares_edges)
        return self


def _merged(text: str, tokens: list[tuple[_Token, int]]) -> list[Span]:
    """Tokens of one kind with nothing but blanks and number marks between them are one span."""
    spans: list[Span] = []
    for token, label in tokens:
        kind = KINDS[label - 1]
        if spans and spans[-1][0] == kind != "email" and not text[spans[-1][2] : token.start].strip(" ().-"):
            spans[-1] = (kind, spans[-1][1], token.end)
        else:
            spans.append((kind, token.start, token.end))
    return spans


def _all_spans(texts: list[str | None], field: Field, sure: float) -> list[list[tuple[Span, bool]]]:
    """Base spans and added ones (False) of each text; one field for all texts of a batch."""
    base = [base_spans(text) if text else [] for text in texts]
    tokens = [
        _tokens(text, spans) if text and _HINT.search(text) else [] for text, spans in zip(texts, base)
    ]
    graph = Graph(tokens)
    # Tokens in base spans have their label given, the others are open.
    beliefs = _shares(graph.beliefs(field, np.where(graph.labels > 0, graph.labels, -1))[0])
    best = beliefs[:, 1:].argmax(axis=1) + 1
    added = (graph.labels == 0) & (beliefs[np.arange(graph.n), best] >= sure)
    every, first = [], 0
    for text, spans, own in zip(texts, base, tokens):
        new = [(own[i], int(best[first + i])) for i in range(len(own)) if added[first + i]]
        first += len(own)
        found = [(s, True) for s in spans] + [(s, False) for s in _merged(text or "", new)]
        every.append(sorted(found, key=lambda s: (KINDS.index(s[0][0]), s[0][1])))
    return every


def _with_hint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of texts that may hold personal data, without what is not used of them."""
    for batch in slices(batches):
        kept = []
        for text in batch.column("text").to_pylist():
            tokens = _tokens(text, base_spans(text)) if text and _HINT.search(text) else []
            kept.append([(t.start, t.end, t.features, *t.keys, t.label) for t in tokens])
        columns = [pa.array([pickle.dumps(k) for k in kept], pa.binary()), pa.array([len(k) for k in kept], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("place"), *columns], ["place", "tokens", "n"])


def _restored(rows: list[tuple]) -> list[_Token]:
    tokens = []
    for start, end, features, equal, similar, label in rows:
        token = _Token.__new__(_Token)
        token.start, token.end, token.features = start, end, features
        token.keys, token.label = (equal, similar), label
        tokens.append(token)
    return tokens


def fit_field(docs: DataFrame, fit_rows: int = 4000, fit_tokens: int = 20_000) -> Field:
    """Train on ``fit_rows`` rows and ``fit_tokens`` tokens at most, which a hash picks.

    Rows are those with a digit or an @. Their tokens are labelled by the base
    patterns; rows are taken in the order of the hash as long as they have no
    more tokens together, and no more than these reach the driver.
    """
    place = F.xxhash64(F.lit("fit"), "doc_id", "text")
    told = docs.select("text", place.alias("place")).where(F.col("text").rlike("[0-9@]"))
    # Only the numbers of the hash are sorted; texts are read of the rows that are picked, equal
    # ones once.
    last = told.select("place").orderBy("place").limit(fit_rows).agg(F.max("place")).first()[0]
    within = told.where(F.col("place") <= F.lit(last).cast("long"))
    picked = durable(within.groupBy("place").agg(F.min("text").alias("text")))
    rows = picked.mapInArrow(_with_hint, "place long, tokens binary, n long").where(F.col("n").between(1, fit_tokens))
    texts, total = [], 0
    for row in rows.orderBy("place", "tokens").toLocalIterator():
        if total + row["n"] > fit_tokens:
            break
        texts.append(_restored(pickle.loads(row["tokens"])))
        total += row["n"]
    return Field().fit(Graph(texts))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _report(field: Field, sure: float) -> Callable:
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _all_spans(batch.column("text").to_pylist(), field, sure)
            base = [[s for s, given in spans if given] for spans in found]
            numbers = [
                pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in KINDS
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *numbers,
                    pa.array([_joined(s) for s in base], pa.string()),
                    pa.array([_joined([s for s, _ in spans]) for spans in found], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    return report


def find_private_data(
    docs: DataFrame, field: Field | None = None, sure: float = 0.9, fit_rows: int = 4000
) -> DataFrame:
    """Personal data of each document.

    Fixed patterns give the base spans. A skip-chain conditional random field
    over the tokens with a digit or an @ adds spans. Features are the form of a
    token and the words beside it; neighbours are linked, and so are distant
    tokens that are equal or similar numbers or names. Tokens in base spans have
    their label given; messages are passed for a fixed number of rounds, and a
    token is added if one label has a probability of ``sure``. The field is
    trained by likelihood (:func:`fit_field`), unless it is given.

    Returns per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base
    and spans (kind:start:end, joined by commas; code points, end exclusive).
    A null or empty text has no spans. Repeated rows are read alike; other
    columns are not read. One narrow pass, after the small one for training.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    field = field or fit_field(narrow, fit_rows)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return narrow.mapInArrow(_report(field, sure), f"doc_id long, {counts}, base string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with <KIND> in place of each span; of overlapping ones, one mark."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _redact(field: Field, sure: float) -> Callable:
    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = _all_spans(texts, field, sure)
            new = [redacted(t, [s for s, _ in spans]) if spans else t for t, spans in zip(texts, found)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return redact


def redact_private_data(
    docs: DataFrame, field: Field | None = None, sure: float = 0.9, fit_rows: int = 4000
) -> DataFrame:
    """All rows and columns of ``docs``, with a mark in place of each span; n_chars follows the text."""
    field = field or fit_field(docs, fit_rows)
    done = docs.mapInArrow(_redact(field, sure), docs.schema)
    if "n_chars" in docs.columns:
        length = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        done = done.withColumn("n_chars", length)
    return done
