"""Near duplicates against all pairs."""

import random

import numpy as np
import pytest

from dosegrid.llm.near_duplicates import (
    Circulant,
    bands_for,
    components,
    drop_near_duplicates,
    near_duplicates,
    shingles,
)
from dosegrid.llm.common import WordHashes

from .words import near_components, sentence, shingle_set


def edited(text, rate, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > rate else f"x{seed}" for w in text.split())


def family():
    """A hub with many copies that are mostly closer to it than to each other, and strangers."""
    rows = []
    for f in range(4):
        base = sentence(150, f)
        rows += [(1000 * f + 500, base)]
        rows += [(1000 * f + k, edited(base, 0.013, 10 * f + k)) for k in range(40)]
    shared = sentence(40, 99)
    rows += [(9000 + k, f"{shared} {sentence(60, 700 + k)}") for k in range(30)]
    return rows


@pytest.mark.parametrize("percent, block", [(85, 1 << 20), (85, 1500), (80, 4000)])
def test_equals_all_pairs(make_docs, percent, block):
    rows = family()
    got = near_duplicates(make_docs(rows), percent, block_shingles=block).collect()
    assert {r.doc_id: r.component_id for r in got} == near_components(rows, percent)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(make_docs, clashing):
    text = sentence(30, 1)
    rows = [(5, text), (4, text.upper()), (5, text), (None, text), (6, None), (7, ""), (8, "a b"),
            (9, "A  b"), (10, "b a"), (11, "one two three four five"), (12, "one two three four five")]
    got = near_duplicates(clashing(make_docs(rows))).collect()
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows)
    assert by_id == {
        5: (26, 4, False), 4: (26, 4, True), None: (26, None, True), 6: (0, 6, True),
        7: (0, 7, True), 8: (1, 8, True), 9: (1, 8, False), 10: (1, 10, True),
        11: (1, 11, True), 12: (1, 11, False),
    }
    df = clashing(make_docs(rows))
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [10, 11, 4, 6, 7, 8, None]


def test_equal_ids_with_different_texts(make_docs):
    a, b = sentence(30, 1), sentence(30, 2)
    got = near_duplicates(make_docs([(1, a), (1, b), (2, b)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1)]


def test_empty_table_and_long_text(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    long = sentence(60_000, 3)
    rows = [(1, long), (2, long + " end")]
    got = near_duplicates(make_docs(rows), block_shingles=1000).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1}


def test_signatures_estimate_similarity():
    base = sentence(400, 8)
    other = edited(base, 0.03, 4)
    cache, family_ = WordHashes(), Circulant(512)
    a, b = (shingles(t.encode(), cache) for t in (base, other))
    alike = (family_.signature(a) == family_.signature(b)).mean()
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs(alike - true) < 0.08
    assert bands_for(85) > bands_for(95)


def test_long_sets_do_not_fill_the_signature():
    """Disjoint sets of more shingles than there are places share no coordinate."""
    rng = np.random.default_rng(0)
    family_ = Circulant(64)
    a, b = (np.unique(rng.integers(0, 1 << 63, 3_000_000).astype(np.uint64)) for _ in range(2))
    assert not (family_.signature(a) == family_.signature(b)).any()
    assert (family_.signature(a) == family_.signature(np.union1d(a, b[:10_000]))).mean() > 0.9


def test_shared_boilerplate_is_compared_little(spark, make_docs, monkeypatch):
    """Two thousand texts alike by 40 %, none of them linked: few pairs of sets meet."""
    from dosegrid.llm import near_duplicates as module

    shared = sentence(60, 99)
    rows = [(k, f"{shared} {sentence(40, 700 + k)}") for k in range(2000)]
    stars, bucket = [], []
    verified, links = module._verified, module._links
    monkeypatch.setattr(module, "_verified", lambda pairs, *a: stars.append(pairs.count()) or verified(pairs, *a))
    monkeypatch.setattr(module, "_links", lambda df, percent: bucket.extend(
        r["count"] for r in df.groupBy("cluster", "task").count().collect()) or links(df, percent))
    got = near_duplicates(make_docs(rows)).collect()
    assert all(r.kept for r in got) and len(got) == 2000
    compared = sum(stars) + sum(n * (n - 1) // 2 for n in bucket)
    assert sum(stars) <= bands_for(85) * 2000
    assert compared < 0.1 * 2000 * 1999 / 2


def test_linked_beside_an_unlinked_first(make_docs):
    """Texts that meet in a bucket whose first one is linked with neither of them."""
    base = sentence(120, 1)
    rows = [(0, edited(base, 0.035, 1))]
    for k in range(1, 40):
        other = edited(base, 0.035, 100 + k)
        rows += [(2 * k, other), (2 * k + 1, edited(other, 0.008, 500 + k))]
    got = near_duplicates(make_docs(rows), 80).collect()
    assert {r.doc_id: r.component_id for r in got} == near_components(rows, 80)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 199)], "a long, b long")
    labels = {r.node: r.label for r in components(links).collect()}
    assert labels == {**{i: 0 for i in range(61)}, 199: 199, 200: 199}
