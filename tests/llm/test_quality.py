"""Quality rules: counts against plain Python, fertility against whole encodings, bands."""

import collections
import math
import random

import pytest

from dosegrid.llm.quality import (
    Vocabulary,
    measure_documents,
    quality_filter,
    quality_report,
)

from .words import WORD, sentence


def plain(text):
    text = text or ""
    words, seen, repeated = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = [False] * len(words)
    for k in range(len(words) - 2):
        if runs[tuple(words[k : k + 3])] > 1:
            marked[k : k + 3] = [True] * 3
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    n = len(words)
    return (n, sum(map(len, words)), symbols, repeated, sum(marked), n < 50 or 100 * sum(marked) > 50 * n)


def test_counts_equal_plain_python(make_docs):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "é é é é", "a b c a b c d", "x\n\nx\n \nx\n y\n y", "<a|b> #$%&* é\x85ü",
             "one\u00a0word", "a b c " * 30, sentence(49, 1), sentence(50, 2), sentence(60_000, 3)]
    texts += ["\n".join(sentence(rng.randint(0, 5), rng.randint(0, 6), "ab") for _ in range(40)) for _ in range(30)]
    rows = quality_report(make_docs(list(enumerate(texts)))).collect()
    got = {
        r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in rows
    }
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert not any(r.kept for r in rows if r.base_failed)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"])
def test_tokens_are_those_of_the_vocabulary(name):
    model = Vocabulary(name)
    words = "Häuser and houses, naïve 数据 𒀀𒁀 the".encode().split()
    model.learn([words])
    tokens = [t for w in words for t in model.encode([w.decode()])[0]]
    characters = sum(len(w.decode()) for w in words)
    per_token, byte_share, entropy = model.measures(words, characters)
    assert per_token == pytest.approx(characters / len(tokens))
    assert 0 < byte_share < 1 and 0 < entropy <= 1
    assert model.measures([], 0) == (0.0, 0.0, 0.0)


def corpus():
    good = [(i, sentence(120 + i, i, "etaoinshr")) for i in range(120)]
    odd = [(1000, "☃" * 3 + " " + " ".join(f"☃{w}☃☃" for w in sentence(120, 5).split())),
           (1001, " ".join(random.Random(2).choices(["uuuuu", "ooooo", "aaaaa"], k=130)))]
    return good, odd


def test_bands_reject_what_is_far_out_and_keep_the_rest(make_docs):
    good, odd = corpus()
    kept = {r.doc_id for r in quality_report(make_docs(good + odd)).collect() if r.kept}
    assert kept >= {i for i, _ in good}
    assert 1000 not in kept


def plain_verdicts(rows, width=6.0, prior=30.0):
    """{doc_id: kept} from the measures, by plain sorting."""
    size_class = lambda r: math.floor(math.log2(max(1, r.n_words)) / 2)
    judged = [r for r in rows if not r.base_failed]

    def own(group, m):
        ticks = sorted(round(getattr(r, m)[0] * 10_000) for r in group)
        at = lambda q: ticks[math.ceil(q * len(ticks)) - 1] / 10_000
        return at(0.5), at(0.75) - at(0.25)

    def drawn(group, m, above):
        n = len(group)
        return tuple((n * x + prior * y) / (n + prior) for x, y in zip(own(group, m), above))

    kept = {}
    for r in rows:
        kept[r.doc_id] = not r.base_failed
        if r.base_failed:
            continue
        lang = [x for x in judged if x.lang == r.lang]
        group = [x for x in lang if size_class(x) == size_class(r)]
        for m in ("chars_per_token", "byte_share", "entropy"):
            middle, spread = drawn(group, m, drawn(lang, m, own(judged, m)))
            half, value = max(width * spread / 1.349, 0.05 * middle), getattr(r, m)[0]
            high = m != "entropy" and value > middle + half + (0.05 if m == "byte_share" else 0)
            kept[r.doc_id] &= not (high or (m != "byte_share" and value < middle - half))
    return kept


def test_verdicts_equal_plain_bands(spark, make_docs):
    rng = random.Random(3)
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "en", "de", "fr", None])
        letters = {"en": "etaoinshr", "de": "äöüßen", "fr": "éèçaiu", None: "xyz"}[lang]
        text = sentence(rng.choice([20, 60, 70, 300, 1200]), i, letters if i % 40 else "☃日本語")
        rows.append((i, text, lang, "s", len(text)))
    for docs in (make_docs(rows), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        got = quality_report(docs.repartition(5), width=2.0).collect()
        expected = plain_verdicts(got, width=2.0)
        assert {r.doc_id: r.kept for r in got} == expected
        assert len(set(expected.values())) == 2
    good, odd = corpus()
    got = quality_report(make_docs(good + odd)).collect()
    assert {r.doc_id: r.kept for r in got} == plain_verdicts(got)
    assert {r.doc_id for r in got if not r.kept} == {1000, 1001}


def test_filter_keeps_columns_and_repeated_rows(make_docs, clashing):
    good, odd = corpus()
    rows = [*good, good[0], (None, good[1][1]), (None, "short"), (7, None), *odd]
    df = clashing(make_docs(rows))
    kept = quality_filter(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 2 and ids.count(None) == 1 and ids.count(7) == 1 and 1000 not in ids


def test_null_language_and_empty_table(make_docs):
    row = (1, sentence(60, 1), None, None, None)
    assert quality_report(make_docs([row])).first().kept
    assert quality_report(make_docs([])).count() == 0
    assert quality_filter(make_docs([])).count() == 0


def test_several_vocabularies(make_docs):
    both = ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
    row = measure_documents(make_docs([(1, "some plain words")]), both).first()
    assert len(row.chars_per_token) == 2


def test_forgetting_words_changes_no_measure():
    texts = [[b"one", b"two", b"one"], [b"three"], [b"two", b"one"], []]
    free, tight = Vocabulary("piece_bpe_32k.model"), Vocabulary("piece_bpe_32k.model")
    tight.limit = 0
    free.learn(texts)
    for words in texts:
        tight.learn([words])
        size = sum(map(len, words))
        assert tight.measures(words, size) == free.measures(words, size)
        assert set(tight.known) == set(words)
