"""Passages of items against a search of every window."""

import random

import pytest

from dosegrid.llm.decontamination import contaminated_removed, find_items

from .words import NORMAL, lower, sentence


def plain(docs, items, window=10):
    windows = {}
    for name, text in items:
        words = NORMAL.findall(lower(text or ""))
        if name is not None and words:
            for k in range(max(1, len(words) - window + 1)):
                windows.setdefault(tuple(words[k : k + window]), set()).add(str(name))
    out = []
    for i, text in docs:
        words = NORMAL.findall(lower(text or ""))
        hit, names = [False] * len(words), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if (own := tuple(words[k : k + size])) in windows:
                    names |= windows[own]
                    hit[k : k + size] = [True] * size
        out.append((i, len(words), sum(hit), sorted(names)))
    return sorted(out, key=str)


def found(df):
    return sorted(
        [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.hits), r["items"]) for r in df.collect()],
        key=str,
    )


def test_blocks_give_the_same_in_one_scan_each(spark, make_docs, make_items, monkeypatch):
    from dosegrid.llm import decontamination

    rng = random.Random(9)
    items = [(i, sentence(rng.choice([3, 12, 30]), i, "abcd")) for i in range(20)]
    docs = [(i, f"{sentence(5, 90 + i)} {rng.choice(items)[1]} {rng.choice(items)[1]}") for i in range(20)]
    docs += [(3, docs[3][1]), (None, items[1][1]), (21, None)]
    kept = []
    stored = decontamination.durable
    monkeypatch.setattr(decontamination, "durable", lambda df: kept.append(df) or stored(df))
    whole = find_items(make_docs(docs), make_items(items))
    assert not kept
    cut = find_items(make_docs(docs), make_items(items), block_bytes=200)
    assert len(kept) > 4
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in kept]
    assert all(p.count("MapInArrow") <= 1 for p in plans)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(cut) == rows(whole)


@pytest.fixture
def make_items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block", [2 << 20, 300])
def test_equals_plain_search(make_docs, make_items, block):
    rng = random.Random(5)
    items = [(i, sentence(rng.choice([1, 4, 9, 10, 11, 40]), i, "abcdé")) for i in range(30)]
    docs = []
    for i in range(40):
        words = rng.choice(items)[1].split()
        start = rng.randint(0, len(words) // 2)
        middle = ", ".join(words[start : start + 15]).upper().replace("É", "é")
        docs.append((i, f"{sentence(12, 500 + i)}! {middle}?{sentence(7, 900 + i)}"))
    got = found(find_items(make_docs(docs), make_items(items), block_bytes=block))
    assert got == plain(docs, items)
    assert any(r[2] for r in got)
    clean = {r.doc_id for r in contaminated_removed(make_docs(docs), make_items(items), block_bytes=block).collect()}
    assert clean == {r[0] for r in got if not r[3]}


def test_edges(make_docs, make_items, clashing):
    items = [(1, "one two"), (1, "three four"), (None, "five six"), (3, None), (4, "..."), (10, "One TWO")]
    docs = [(1, "Zero ONE-two, three;four"), (1, "Zero ONE-two, three;four"), (2, None), (3, ""),
            (None, "one two"), (4, "five six"), (5, "onetwo")]
    df = clashing(make_docs(docs))
    rows = find_items(df, make_items(items))
    assert found(rows) == plain(docs, items)
    places = [[(s.start, s.end) for s in r.places] for r in rows.collect() if r.doc_id == 1]
    assert places == [[(5, 24)]] * 2
    kept = contaminated_removed(df, make_items(items))
    assert kept.columns == df.columns and kept.count() == 4


def test_no_items_and_no_documents(make_docs, make_items):
    assert found(find_items(make_docs([(1, "a b")]), make_items([]))) == [(1, 2, 0, [])]
    assert find_items(make_docs([]), make_items([(1, "a")])).count() == 0


def test_very_long_text(make_docs, make_items):
    text = sentence(200_000, 6)
    item = " ".join(text.split()[150_000:150_030])
    row = find_items(make_docs([(1, text)]), make_items([(7, item)])).first()
    assert row["items"] == ["7"] and row.n_words == 200_000
    assert text[row.places[0].start : row.places[0].end] == item
