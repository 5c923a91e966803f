"""Base patterns against the plain regular expressions; the field against enumeration."""

import itertools
import random
import re
import time

import numpy as np
import pytest

from dosegrid.llm import private_data
from dosegrid.llm.private_data import (
    CHAIN,
    EQUAL,
    KINDS,
    LABELS,
    SIMILAR,
    Field,
    Graph,
    _all_spans,
    _shares,
    _tokens,
    base_spans,
    find_private_data,
    fit_field,
    luhn,
    redact_private_data,
)

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return spans + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_equals_plain_patterns():
    rng = random.Random(4)
    pieces = ["a@b.c", "@", ".", "+1", " ", "-", "(702)", "555-0742", "1.2.3.4", "999", "4111111111111111",
              "4111 1111 1111 1111", "é", "x.y@z-1.example.com", "+", "0", "255.255.255.255", "\n", "_%", "٣"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert base_spans(text) == plain(text), text


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "+1 ", "@@", "1 ", "a.", "+1+"])
def test_base_takes_linear_time(unit):
    began = time.perf_counter()
    base_spans("7@" + unit * 200_000)
    assert time.perf_counter() - began < 10


def sample():
    rows = []
    for i in range(60):
        card, phone = "4111111111111111", f"+1 (702) 555-{1000 + i}"
        rows.append((i, f"call {phone} or write to ann.{i}@mail.example.com today, again {phone}, page {i} of 90"))
        rows.append((100 + i, f"card {card} and then {card} in year 19{10 + i}, room 12"))
        years = " then ".join(str(1900 + k) for k in range(i, i + 40))
        rows.append((200 + i, f"{years}, item {4400000 + i} and again item {4400000 + i}"))
    return rows


def test_field_adds_what_resembles_and_keeps_base(make_docs):
    text = "call +1 (702) 555-1003 now. Later 702-555-1003 was busy; item 4400555 and 1999 stay"
    rows = [*sample(), (500, text), (501, "only 702-555-1003 here, in 1999")]
    field = fit_field(make_docs(sample()))
    got = {r.doc_id: r for r in find_private_data(make_docs(rows), field, sure=0.6).collect()}
    for i, t in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(t))
        assert got[i].base == base
        assert set(base.split(",")) <= set(got[i].spans.split(","))
    start = text.index("702-555")
    assert f"phone:{start}:{start + 12}" in got[500].spans.split(",")
    assert got[500].spans.count(":") == 4 and got[501].spans == ""  # alike, but for the edge
    assert all(r.spans == r.base for r in got.values() if r.doc_id < 500)


def random_field(seed):
    rng = np.random.default_rng(seed)
    field = Field()
    field.weights = rng.normal(0, 0.5, field.weights.shape)
    field.edges = rng.normal(0, 1, field.edges.shape)
    field.edges = field.edges + field.edges.transpose(0, 2, 1)
    return field


def graph_of(text, labelled=False):
    return Graph([_tokens(text, base_spans(text) if labelled else [])])


def enumerated(graph, field, given=None):
    """(log of the sum, probabilities) over all labellings."""
    scores = graph.scores(field)
    total, every = np.zeros((graph.n, LABELS)), 0.0
    for labels in itertools.product(range(LABELS), repeat=graph.n):
        if given is not None and any(g >= 0 and g != y for g, y in zip(given, labels)):
            continue
        score = sum(scores[i, y] for i, y in enumerate(labels))
        score += sum(field.edges[kind, labels[a], labels[b]] for a, b, kind in graph.pairs)
        every += np.exp(score)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    return np.log(every), total / total.sum(axis=1, keepdims=True)


#: A chain of two, linked by an equal and by a similar number to distant ones; no circle.
TREE = "x1 702-555-1003 much later 7025551003 and 702-555-100 some words 1-702-555-1009 no"
CIRCLE = "a1 702-555-1003 b2 7025551003 c3 702-555-1004"


def test_messages_equal_enumeration_with_skip_edges():
    graph = graph_of(TREE)
    assert sorted(graph.pairs[:, 2].tolist()) == [CHAIN, EQUAL, SIMILAR] and graph.n == 5
    for seed in range(3):
        field = random_field(seed)
        shares = _shares(graph.beliefs(field, rounds=80)[0])
        assert np.allclose(shares, enumerated(graph, field)[1], atol=1e-4)


def test_messages_around_a_circle_come_near():
    graph = graph_of(CIRCLE)
    assert {CHAIN, EQUAL, SIMILAR} <= set(graph.pairs[:, 2].tolist()) and len(graph.pairs) >= graph.n
    field = random_field(1)
    field.edges /= 4
    shares = _shares(graph.beliefs(field, rounds=80)[0])
    assert np.abs(shares - enumerated(graph, field)[1]).max() < 0.05


def test_slopes_are_those_of_the_likelihood():
    graph, field = graph_of(TREE), random_field(5)
    given = np.array([0, 4, -1, 4, 0])
    many = lambda f: enumerated(graph, f, given)[0] - enumerated(graph, f)[0]
    beliefs = Graph.beliefs
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Graph, "beliefs", lambda self, f, g=None: beliefs(self, f, g, rounds=80))
        slope, slope_edges = field.slopes(graph, given)
    for feature, label in [(graph.feature[0], 0), (graph.feature[9], 4), (graph.feature[20], 2)]:
        before = many(field)
        field.weights[feature, label] += 1e-5
        assert abs((many(field) - before) / 1e-5 - slope[feature, label]) < 1e-3
    for kind, y, z in [(CHAIN, 0, 4), (EQUAL, 4, 4), (SIMILAR, 4, 4), (EQUAL, 0, 3)]:
        before = many(field)
        field.edges[kind, y, z] += 1e-5
        field.edges[kind, z, y] = field.edges[kind, y, z]
        expected = slope_edges[kind, y, z] * (1 if y == z else 2)
        assert abs((many(field) - before) / 1e-5 - expected) < 1e-3


def plain_added(text, field, sure=0.9, rounds=8):
    """Added spans by messages in dictionaries, edge by edge."""
    tokens = _tokens(text, plain(text))
    nodes = []
    for t in tokens:
        score = sum(field.weights[f] for f in t.features)
        nodes.append(np.where(np.arange(LABELS) == t.label, 0.0, -30.0) if t.label else score)
    edges = [(a, b, k) for a, b, k in Graph([tokens]).pairs.tolist()]
    message = {(s, t, n): np.zeros(LABELS) for n, (a, b, _) in enumerate(edges) for s, t in ((a, b), (b, a))}

    def total(i, without=None):
        return nodes[i] + sum((m for (_, t, n), m in message.items() if t == i and n != without), np.zeros(LABELS))

    for _ in range(rounds):
        new = {}
        for (s, t, n), old in message.items():
            sent = total(s, without=n)
            out = np.log(np.exp(sent - sent.max()) @ np.exp(field.edges[edges[n][2]]))
            new[s, t, n] = 0.5 * old + 0.5 * (out - out.max())
        message = new
    found = []
    for i, t in enumerate(tokens):
        share = np.exp(total(i) - total(i).max())
        share /= share.sum()
        best = 1 + int(share[1:].argmax())
        if not t.label and share[best] >= sure:
            kind = KINDS[best - 1]
            if found and found[-1][0] == kind != "email" and not text[found[-1][2] : t.start].strip(" ().-"):
                found[-1] = (kind, found[-1][1], t.end)
            else:
                found.append((kind, t.start, t.end))
    return found


def test_added_spans_equal_a_plain_version(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.collect() if r.text and re.search("[0-9@]", r.text)]
    texts += [t for _, t in sample()[:40]] + ["call +1 (702) 555-1003 now. Later 702-555-1003 was busy, 7025551003 too"]
    field = fit_field(make_docs(sample()))
    fitted = field.edges.copy()
    got = _all_spans(texts, field, 0.6)
    added = [[s for s, given in spans if not given] for spans in got]
    assert added == [sorted(plain_added(t, field, 0.6), key=lambda s: (KINDS.index(s[0]), s[1])) for t in texts]
    assert any(added)
    assert fitted[EQUAL, 4, 4] > fitted[EQUAL, 0, 4]  # equal numbers have equal labels


def test_share_of_documents_changed(spark):
    """The field adds to few of the given documents, and to none without a number or an @."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = find_private_data(docs).collect()
    changed = [r for r in rows if r.spans != r.base]
    assert len(changed) <= 0.01 * len(rows)


def test_bound_on_the_rows_of_a_fit(spark, make_docs, monkeypatch):
    fitted = []
    monkeypatch.setattr(Field, "fit", lambda self, graph: fitted.append(graph) or self)
    docs = make_docs([(None, f"mail a{i}@b.c now") for i in range(500)] + [(7, f"call +1 202 555 {1000 + i}") for i in range(500)])
    fit_field(docs, fit_rows=40)
    fit_field(docs, fit_rows=400, fit_tokens=30)
    assert fitted[0].n <= 40 * 4 and 0 < fitted[1].n <= 30


def test_edges(make_docs, clashing):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "é a@b.c"), (3, "é a@b.c"), (4, "no data")]
    df = clashing(make_docs(rows))
    got = [(r.doc_id, r.n_email, r.spans) for r in find_private_data(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, ""), (2, 0, ""), (None, 1, "email:0:5"), (3, 1, "email:2:7"), (3, 1, "email:2:7"), (4, 0, "")],
        key=str,
    )
    done = redact_private_data(df)
    assert done.columns == df.columns and done.dtypes == df.dtypes
    texts = sorted(((r.doc_id, r.text, r.n_chars) for r in done.collect()), key=str)
    assert (3, "é <EMAIL>", 9) in texts and (1, None, 0) in texts and len(texts) == 6


def test_empty_table_and_long_text(make_docs):
    assert find_private_data(make_docs([])).count() == 0
    assert redact_private_data(make_docs([])).count() == 0
    row = find_private_data(make_docs([(1, "w1 " * 100_000 + "a@b.c")])).first()
    assert row.n_email == 1


def test_untrained_field_adds_nothing():
    text = "card 4111111111111111 and 4111111111111112"
    assert [given for _, given in _all_spans([text], Field(), 0.9)[0]] == [True]
    assert KINDS == ("email", "ip", "card", "phone")
