"""Licence families: held-out wordings, look-alikes, whole texts, a plain version, plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosegrid.llm.licences import (
    CALIBRATION,
    DENIALS,
    FAMILIES,
    TEMPLATES,
    UNKNOWN,
    _grams,
    _words,
    classify,
    denials_of,
    gate_words,
    grams_of,
    paragraphs_of,
    scan_licences,
    trained,
    variants_of,
    words_of,
)

from .words import sentence

HELD_OUT = [
    ("This file is released under the MIT License, see below", "MIT"),
    ("// Licensed under the Apache License, Version 2.0 (the \"License\");", "Apache-2.0"),
    ("this program is licensed under the GNU General Public License version 3", "GPL-3.0"),
    ("All texts on this site are licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("The pictures are licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("licensed under the gnu affero general public license, version 3", "AGPL-3.0"),
    ("THE SOURCE CODE FORM IS SUBJECT TO THE TERMS OF THE MOZILLA PUBLIC LICENSE, V. 2.0.", "MPL-2.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD"),
    ("Licensed under the GNU General Public License, version 2", "GPL-2.0"),
    ("Licensed under the GNU Lesser General Public License v2.1", "LGPL-2.1"),
    ("Licensed under the Mozilla Public License, version 1.1", "MPL-1.1"),
    ("Released under the BSD 2-Clause License", "BSD-2-Clause"),
    ("Licensed under CC BY 3.0", "CC-BY-3.0"),
    ("This work is licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"),
    ("This program is made available under the terms of the Eclipse Public License 2.0", "EPL-2.0"),
    ("My driving licence was renewed last week", UNKNOWN),
    ("Copyright 2021 by the city of Bern", UNKNOWN),
    ("The apache tribe kept no license for the fishing grounds near mit", UNKNOWN),
    ("Licensed under our own terms", UNKNOWN),
    ("Not licensed under the MIT License", UNKNOWN),
    ("The program was never released under the MIT License", UNKNOWN),
    ("Licensed under the Eclipse Public License, version 1.0", UNKNOWN),
    ("Licensed under the European Space Agency Public License", UNKNOWN),
    ("Licensed under CC BY 2.5", UNKNOWN),
]


def test_held_out_wordings(spark):
    rows = [(str(i), t) for i, (t, _) in enumerate(HELD_OUT)]
    got = {r.key: r.family for r in classify(spark.createDataFrame(rows, "key string, paragraph string")).collect()}
    wrong = {t: got[str(i)] for i, (t, f) in enumerate(HELD_OUT) if got[str(i)] not in (f, UNKNOWN)}
    assert not wrong  # never another licence
    missed = [t for i, (t, f) in enumerate(HELD_OUT) if got[str(i)] != f]
    assert len(missed) <= 2, missed


def test_every_template_is_known_and_passes_the_gate(spark):
    rows = [(f"{f}{i}", t, f) for f, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    paragraphs = spark.createDataFrame(rows, "key string, paragraph string, of string")
    got = {r["key"]: r.family for r in classify(paragraphs).collect()}
    wrong = [(t, got[k]) for k, t, f in rows if got[k] != f]
    assert len(wrong) <= 3, wrong
    words = set(gate_words())
    assert all(len(words & set(words_of(t))) >= 2 for _, t, _ in rows)


WRAPPED_MIT = """The MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

# THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
# IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
# FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
# AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
# LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
# OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
# SOFTWARE.
"""


def test_wrapped_text_is_judged_as_a_whole(spark, make_docs):
    rows = scan_licences(make_docs([(1, WRAPPED_MIT)])).collect()
    assert sum(r.family == "MIT" for r in rows) >= 3
    assert all(r.family in ("MIT", UNKNOWN) for r in rows)
    split = spark.createDataFrame([(WRAPPED_MIT,)], "t string").select(paragraphs_of(F.col("t")).alias("p")).first().p
    wanted = [p for p in split if p.strip()]
    assert any(p.startswith("Permission") and p.endswith("conditions:") for p in wanted)
    assert any("EXPRESS OR IMPLIED" in p for p in wanted)
    bsd = "1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer."
    assert [r.family for r in scan_licences(make_docs([(1, bsd)])).collect()] == ["BSD"]


def plain(text, least=0.5, overlap=0.6):
    vocabulary, weights, bias, temperature = trained()
    grams = grams_of(text)
    number = {g: i for i, g in enumerate(vocabulary)}
    scores = (np.round(weights, 5)[[number[g] for g in grams if g in number]].sum(axis=0) + bias) / temperature
    shares = np.exp(scores - scores.max())
    shares /= shares.sum()
    best = FAMILIES[int(shares.argmax())]
    share = max(
        (
            len(set(grams) & set(grams_of(t))) / min(len(grams), len(grams_of(t)))
            for t in TEMPLATES.get(best, [])
            if variants_of(t) == variants_of(text) and set(denials_of(text)) <= set(denials_of(t))
            and set(grams) & set(grams_of(t))
        ),
        default=0.0,
    )
    family = best if best != UNKNOWN and shares.max() >= least and share >= overlap else UNKNOWN
    return family, float(shares.max()), share


def test_equals_a_plain_version(spark):
    texts = [t for t, _ in HELD_OUT] + [t for _, t in CALIBRATION] + [t for x in TEMPLATES.values() for t in x]
    texts += [f"{sentence(12, 3)} license {sentence(9, 4)} software", "License", "copyright license " * 300]
    rows = [(str(i), t) for i, t in enumerate(texts)]
    for r in classify(spark.createDataFrame(rows, "key string, paragraph string")).collect():
        family, probability, share = plain(texts[int(r.key)])
        assert r.family == family and r.overlap == pytest.approx(share)
        assert r.probability == pytest.approx(probability, abs=1e-6)


def test_edges(make_docs, clashing):
    text = "intro\n\nReleased under the MIT License.\nend"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "no terms"),
            (5, sentence(60_000, 1)), (6, "LICENSED UNDER CC BY-NC 4.0.\nReleased under the MIT License.")]
    got = sorted(((r.doc_id, r.paragraph, r.family) for r in scan_licences(clashing(make_docs(rows))).collect()), key=str)
    assert got == sorted(
        [(1, 2, "MIT")] * 2 + [(None, 2, "MIT"), (6, 0, "CC-BY-NC-4.0"), (6, 1, "MIT")], key=str
    )
    assert scan_licences(make_docs([])).count() == 0


def test_talk_of_licences_is_not_reported(make_docs):
    talk = ["The fishing license costs ten dollars", "Copyright law of the software trade", "free copy of the public notice"]
    assert scan_licences(make_docs(list(enumerate(talk)))).count() <= 1


def test_plan_has_no_python_and_words_agree(make_docs, spark):
    df = scan_licences(make_docs([(1, "Released under the MIT License.")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    for text in ("Version 2.0, v. 3 CC-BY v2.1.0 10.0", "one", "", "a a a", "(a) 1. first", " * 2) Second v2"):
        row = spark.createDataFrame([(text,)], "t string").select(_grams(F.col("t")).alias("g"), _words(F.col("t")).alias("w")).first()
        assert sorted(row.g) == grams_of(text) and list(row.w) == words_of(text)
    assert not set(DENIALS) & {"mit"}
