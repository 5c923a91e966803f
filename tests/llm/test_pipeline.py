"""The pipeline against the same stages in plain Python."""

import random

import pytest

import corpus_pipeline
from dosegrid.llm import queries
from dosegrid.llm.private_data import base_spans, redacted

from . import test_mixing
from .conftest import SCHEMA
from .test_decontamination import plain as plain_items
from .test_quality import plain as plain_counts
from .words import near_components, sentence


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        text = sentence(rng.randint(60, 200), i, "etaoinshr")
        rows.append([i, text])
    for i in range(120, 150):  # near and exact copies
        words = rows[i - 120][1].split()
        if i % 2:
            words[5] = "changed"
        rows.append([i, " ".join(words)])
    items = [(k, sentence(25, 5000 + k, "etaoinshr")) for k in range(3)]
    for i in range(150, 156):
        rows.append([i, f"{sentence(70, i, 'etaoinshr')} {items[i % 3][1]} {sentence(20, i + 500, 'etaoinshr')}"])
    for i in range(156, 170):
        rows.append([i, f"{sentence(70, i, 'etaoinshr')} mail ann.{i}@example.org or +1 (702) 555-{i:04d} now"])
    rows += [[170, "too short"], [171, None], [172, ""], [173, "a b c " * 40]]
    docs = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src13", "src17", "src19"]), len(t or ""))
            for i, t in rows]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs, items = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_equals_plain_stages(spark, tables, monkeypatch):
    docs, items = corpus()
    left = [r for r in docs if not plain_counts(r[1])[-1]]
    component = near_components([(r[0], r[1]) for r in left], 80)
    left = [r for r in left if component[r[0]] == r[0]]
    hit = {r[0] for r in plain_items([(r[0], r[1]) for r in left], items) if r[3]}
    left = [r for r in left if r[0] not in hit]
    left = [(*r[:1], redacted(r[1], base_spans(r[1])), *r[2:]) for r in left]
    monkeypatch.setattr(test_mixing, "WEIGHTS", queries.TARGETS)
    monkeypatch.setattr(test_mixing, "DEFAULTS", queries.DEFAULTS)
    named = {s: d for d, sources in queries.DOMAINS.items() for s in sources}
    monkeypatch.setattr(test_mixing, "domain", lambda s: named.get(s, "other"))
    copies = test_mixing.plain_mix(left, 0.5, 4, 11)
    texts = {r[0]: r[1] for r in left}

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, tables).collect()}
    assert {i: r.copies for i, r in got.items()} == copies
    assert {i: r.text for i, r in got.items()} == {i: texts[i] for i in copies}
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert 150 not in got and 170 not in got and not any(120 <= i < 150 for i in got)


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "decontamination", "private_data", "source_mixing"
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).dtypes == docs.dtypes
        empty = stage(spark, docs.limit(0), tables)
        assert empty.dtypes == docs.dtypes and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), tables).count() == 0
