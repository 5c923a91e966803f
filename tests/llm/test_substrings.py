"""Substring removal against a search of every window."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dosegrid.llm.substrings import remove_repeats

from .words import WORD, sentence


def plain(rows, window):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=str)


def found(df):
    rows = [
        (r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.text) for r in df.collect()
    ]
    return sorted(rows, key=str)


@pytest.mark.parametrize("window, batch", [(13, 8 << 20), (3, 400)])
def test_equals_plain_search(make_docs, window, batch):
    rng = random.Random(3)
    passages = [sentence(rng.randint(8, 60), s) for s in range(6)]
    rows = []
    for i in range(60):
        parts = [sentence(rng.randint(0, 30), 100 + i), rng.choice(passages)]
        rng.shuffle(parts)
        rows.append((2**61 + i if i % 7 == 0 else i - 5, " \n".join(parts)))
    got = found(remove_repeats(make_docs(rows), window, batch))
    assert got == plain(rows, window)


def test_edges(make_docs, clashing):
    long = sentence(20, 1)
    rows = [(3, long), (1, long), (3, long), (None, long), (4, None), (5, ""), (6, "a b"),
            (7, " \t".join(long.split())), (8, long + "\x85" + long)]
    got = found(remove_repeats(clashing(make_docs(rows))))
    assert got == plain(rows, 13)
    assert [r[2] for r in got if r[0] == 3] == [20, 20]
    assert [r[2] for r in got if r[0] in (1, None)] == [0, 0]


def test_spans_are_maximal(make_docs):
    shared, tail = sentence(40, 2), sentence(9, 3)
    rows = [(1, shared), (2, f"{tail} {shared} {tail}")]
    spans = {r.doc_id: r.spans for r in remove_repeats(make_docs(rows)).collect()}
    assert [(s.start, s.end) for s in spans[2]] == [(9, 49)]


def test_very_long_text_and_empty_table(make_docs):
    long = sentence(120_000, 4)
    rows = [(1, long), (2, long)]
    got = remove_repeats(make_docs(rows)).withColumn("sha", F.sha2("text", 256)).collect()
    assert {r.doc_id: r.sha for r in got} == {
        1: hashlib.sha256(long.encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()
    }
    assert remove_repeats(make_docs([])).count() == 0
