"""Links of two tokenisers against a plain version."""

import hashlib
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F

from dosegrid.llm import alignment
from dosegrid.llm.alignment import Tokenizers, align_tokens, id_map, pair_counts, tokenised

COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.fixture(scope="module")
def both():
    return Tokenizers()


def groups_and_links(both, text):
    """(n_a, n_b, groups, links) of one whole text, by byte ranges."""
    if not text:
        return 0, 0, "", []
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    plain = (" " + text).encode()
    if b"".join(both.bytes_a[i] for i in a) != plain or b"".join(both.bytes_b[i] for i in b) != plain:
        return 0, 0, "", []

    def ranges(ids, table):
        start, out = 0, []
        for i in ids:
            out.append((start, start + len(table[i]), i))
            start = out[-1][1]
        return out

    left, right = ranges(a, both.bytes_a), ranges(b, both.bytes_b)
    links = []
    first = 0
    for s, e, i in left:
        while right[first][1] <= s:
            first += 1
        k = first
        while k < len(right) and right[k][0] < e:
            links.append((i, right[k][2]))
            k += 1
    cuts = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
    named, start = [], 0
    for cut in cuts:
        inside = [",".join(str(i) for s, _, i in side if start <= s < cut) for side in (left, right)]
        named.append("|".join(inside))
        start = cut
    return len(a), len(b), ";".join(named), links


def plain(both, rows):
    parts = [(i, *groups_and_links(both, t)) for i, t in rows]
    held = Counter(p for *_, links in parts for p in set(links))
    highest = Counter()
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    return sorted(
        (
            str(i),
            str(n_a),
            str(n_b),
            str(len(groups.split(";")) if groups else 0),
            str(len(links)),
            str(sum(held[p] == highest[p[0]] for p in links)),
            str(sum(held[p] for p in links)),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for i, n_a, n_b, groups, links in parts
    ), held


ROWS = [
    (1, "The cat sat on the mat."),
    (2, "The cat sat on the mat."),
    (3, ""),
    (4, None),
    (5, " "),
    (6, "  leading and   inner  spaces  "),
    (7, "tabs\tand\nlines\n\n next \r\n  wide　space end"),
    (8, "<|endoftext|> <s> </s> <unk> <0x41> as plain text"),
    (9, "a▁b"),
    (10, "café naïve 你好世界 \U0001f600\U0001f3fd é ﬁ"),
    (11, "antidisestablishmentarianism " * 40),
    (12, "x" * 5000),
    (None, "no id here, no id here"),
    (13, "nul \x00 and \x85 \x1c controls \x7f"),
    (14, "abababab ababab'll 12345 3.14159 don't I'VE"),
    (14, "same id, another text"),
    (15, "\n"),
    (16, "trailing space "),
]


def collected(df):
    return sorted(tuple(str(r[c]) for c in COLUMNS) for r in df.collect())


def test_equals_plain(spark, make_docs, both):
    expected, held = plain(both, ROWS)
    aligned = tokenised(make_docs(ROWS).repartition(3))
    counts = pair_counts(aligned)
    assert {(r.a, r.b): r.n for r in counts.collect()} == dict(held)
    assert all(r.own == (both.identity[r.a] == r.b) for r in counts.collect())
    assert collected(align_tokens(make_docs(ROWS))) == expected
    best = {r.a: (r.b, r.n) for r in id_map(counts).collect()}
    for a, (b, n) in best.items():
        most = max(c for (x, _), c in held.items() if x == a)
        assert n == most and b == min(y for (x, y), c in held.items() if x == a and c == most)


def test_pairs_beside_the_map_without_broadcast(spark, make_docs, both, no_broadcast, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 3)
    monkeypatch.setattr(alignment, "ROW_PAIRS", 2)
    assert collected(align_tokens(make_docs(ROWS))) == plain(both, ROWS)[0]


def test_given_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert collected(align_tokens(docs)) == plain(both, rows)[0]


def test_forgetting_changes_nothing(both):
    texts = ["one two three", "two three four five", "one five six"]
    known = alignment.Chunks(both)
    known.limit = 2
    for text in texts * 2:
        cut = both.chunks(text)
        known.learn([cut])
        joined = b"".join(known.text[i] for i in known.numbers(cut))[:-1].decode()
        assert joined == groups_and_links(both, text)[2]


@pytest.mark.parametrize("text", [t for _, t in ROWS if t])
def test_chunks_are_taken_one_by_one(both, text):
    cut = both.chunks(text)
    assert "".join(cut) == " " + text
    whole = both.a.encode(" " + text, add_special_tokens=False).ids
    assert [i for c in cut for i in both.a.encode(c, add_special_tokens=False).ids] == whole
    if "▁" not in text:
        assert [i for c in cut for i in both.b.encode(c[1:])] == both.b.encode(text)


def test_ranks_give_the_same_tokens(both):
    assert both.ranked is not None
    for text in [t for _, t in ROWS if t]:
        cut = both.chunks(text)
        assert both.encode_a(cut) == both.a.encode(" " + text, add_special_tokens=False).ids


def test_only_pairs_beside_the_map_are_shuffled(spark, make_docs, both):
    aligned = tokenised(make_docs([(1, "the cat and the dog"), (2, "the end")]))
    for r in aligned.where("row IS NOT NULL").collect():
        assert all(both.identity[p // len(both.bytes_b)] != p % len(both.bytes_b) for p in r.pairs)
        assert r.own


def test_clashing_columns(make_docs, both):
    docs = make_docs(ROWS)
    names = "row own own_n pairs pairs_n a b n best salt n_a n_b own_best pair_best".split()
    docs = docs.withColumns({c: F.lit("x") for c in names})
    assert collected(align_tokens(docs)) == plain(both, ROWS)[0]


def test_empty_table(make_docs):
    out = align_tokens(make_docs([]))
    assert out.columns == COLUMNS and out.count() == 0
