"""Licence families of paragraphs: n-gram logistic regression, confirmed by templates."""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dosegrid.llm.common import small_side
from dosegrid.session import durable

UNKNOWN = "unknown"

# Words of well-known licences and notices, by family. Version and variant are part
# of a family.
TEMPLATES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software",
        "The software is provided as is, without warranty of any kind, express or implied, including "
        "but not limited to the warranties of merchantability, fitness for a particular purpose and "
        "noninfringement. In no event shall the authors or copyright holders be liable for any claim, "
        "damages or other liability, whether in an action of contract, tort or otherwise, arising "
        "from, out of or in connection with the software or the use or other dealings in the software",
        "Released under the MIT License",
        "Licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under "
        "the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or any later version",
        "This work is licensed under the GNU General Public License, version 2",
        "Released under the GNU GPL v2",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or any later version",
        "This work is licensed under the GNU General Public License, version 3",
        "Released under the GNU GPL v3",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or any later version",
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or any later version",
        "Licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3",
        "redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission",
        "Released under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution",
        "Licensed under the BSD License",
    ],
    "MPL-1.1": [
        "The contents of this file are subject to the Mozilla Public License Version 1.1",
        "Licensed under the Mozilla Public License, version 1.1",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0",
    ],
    "CC-BY-3.0": [
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
        "Licensed under CC BY 3.0",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "CC-BY-SA-3.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
        "Licensed under CC BY-SA 3.0",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License",
        "Licensed under CC BY-SA 4.0",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License",
        "Licensed under CC BY-NC 4.0",
    ],
    "CC-BY-ND-4.0": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
        "International License",
        "Licensed under CC BY-ND 4.0",
    ],
    "CC-BY-NC-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
        "International License",
        "Licensed under CC BY-NC-SA 4.0",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related rights "
        "to this work under CC0 1.0 Universal, the public domain dedication licence",
        "Licensed under CC0 1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose",
    ],
}
#: Paragraphs for the unknown class: of licences without a template, denials, and talk of licences.
OTHERS = [
    "A driving licence is required for this position and the fee must be paid by the applicant",
    "The fishing license costs ten dollars a year and is sold at the public office",
    "Copyright law is taught in the second year of the course",
    "All rights reserved. No part of this publication may be reproduced without permission",
    "Copyright 2019 the authors",
    "The licence was withdrawn after the general inspection by the public health foundation",
    "The warranty covers any defect of the product within two years after purchase",
    "The notice was released under pressure from the public and the terms were changed",
    "The software is licensed, not sold, and may be used on one computer only",
    "He lost his license after the accident and could not use the car in any form",
    "The apache helicopter landed near the mit campus",
    "Licensed under terms that are not stated in this copy",
    "Redistribution of wealth is the subject of the public debate",
    "Please read the license agreement of the supplier before you open the package",
    "The work is distributed to the public by the foundation, version by version",
    "Licensed under a private agreement between the parties",
    "This file is not licensed under the MIT License",
    "The code was never released under the Apache License",
    "It is no longer licensed under the GNU General Public License",
    "Not licensed under the BSD License, ask the owner",
    "Licensed under the Artistic License, version 2.0",
    "Released under the ISC License",
    "Licensed under the Academic Free License",
    "Licensed under the Microsoft Public License",
    "Licensed under the Open Software License, version 3.0",
    "Released under the zlib License",
    "The authors compare the MIT License with the GNU General Public License",
]
# Wordings that are in neither list above, on which probabilities are calibrated.
CALIBRATION = [
    ("MIT", "This project is MIT licensed, released under the MIT License"),
    ("MIT", "You may use the code, which is licensed under the MIT license"),
    ("Apache-2.0", "All files are licensed under the Apache License, Version 2.0, unless stated"),
    ("GPL-2.0", "This driver is licensed under the GNU General Public License version 2"),
    ("GPL-3.0", "These tools are licensed under the GNU General Public License version 3"),
    ("LGPL-2.1", "The library is licensed under the GNU Lesser General Public License version 2.1"),
    ("AGPL-3.0", "The server is licensed under the GNU Affero General Public License version 3"),
    ("BSD-3-Clause", "The package is released under the BSD 3-Clause license"),
    ("MPL-2.0", "The browser is licensed under the Mozilla Public License version 2.0"),
    ("CC-BY-4.0", "All pictures are licensed under CC BY 4.0 unless noted"),
    ("CC-BY-SA-4.0", "The text of this article is licensed under CC BY-SA 4.0"),
    (UNKNOWN, "Licensed under the European Union Public Licence"),
    (UNKNOWN, "Released under the Boost Software License, version 1.0"),
    (UNKNOWN, "Licensed under the Common Public License"),
    (UNKNOWN, "Released under the Do What You Want Public License"),
    (UNKNOWN, "Licensed under the SIL Open Font License, version 1.1"),
    (UNKNOWN, "The library is not released under the MIT License any more"),
    (UNKNOWN, "We cannot say whether the text is licensed under CC BY 4.0 or not"),
    (UNKNOWN, "A hunting licence is issued by the state foundation to any person"),
    (UNKNOWN, "The general public may not use this road without permission"),
    (UNKNOWN, "Copyright 2020 by the publisher, all rights reserved"),
    (UNKNOWN, "The company was granted a license to sell software in the country"),
]
# Words that tell variants of a licence from each other, as short version numbers do; a paragraph
# has to have the same ones as the template that confirms it, and no other denials.
VARIANTS = (
    "affero", "derivs", "lesser", "library", "nc", "nd", "noderivatives", "noderivs", "noncommercial",
    "sa", "sharealike", "clause",
)
DENIALS = ("not", "never", "no", "cannot", "whether", "compare")
_ENUMERATION = r"^[\s#*/;-]*[(]?[0-9a-z]{1,2}[.)]\s+"
_VERSION = "^[0-9]{1,2}([.][0-9]+)*$"
_WORD = "[a-z0-9]+(?:[.][0-9]+)*"
# Common words, which say nothing of licences.
_COMMON = frozenset(
    "a all an and any are as at be been but by can do for from has have if in is it its made may nor not of on "
    "or other our out shall so such that the their these they this to under use used was were which who will "
    "with without you your".split()
)
FAMILIES = [*TEMPLATES, UNKNOWN]


def normal(text: str) -> str:
    """Lower case without a number before the first word; "v2" and "v. 2" as "2", "2.0" as "2"."""
    text = re.sub(_ENUMERATION, "", text.lower())
    text = re.sub(r"\bv[.]? ?(?=[0-9])", "", text)
    return re.sub(r"([0-9])[.]0(?![0-9.]*[0-9])", r"\1", text)


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, normal(text))


def grams_of(text: str) -> list[str]:
    """Distinct words and pairs of neighbouring words."""
    words = words_of(text)
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def variants_of(text: str) -> list[str]:
    """Version numbers and words of variants in a text."""
    return sorted({w for w in words_of(text) if w in VARIANTS or re.search(_VERSION, w)})


def denials_of(text: str) -> list[str]:
    """Words of denial in a text."""
    return sorted({w for w in words_of(text) if w in DENIALS})


def gate_words() -> list[str]:
    """Words of the templates that are not common ones; a paragraph with less than two is none."""
    return sorted({w for texts in TEMPLATES.values() for t in texts for w in words_of(t)} - _COMMON)


def _examples(rng: random.Random) -> list[tuple[str, str]]:
    """Templates, pieces of them and templates among other words; the unknown class likewise."""
    noise = " ".join(OTHERS).split()
    rows = []
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, OTHERS)]:
        for text in texts:
            words = text.split()
            rows += [(family, text)] * 3
            for _ in range(6):
                size = rng.randint(min(len(words), max(3, 4 * len(words) // 5)), len(words))
                extra = rng.sample(noise, rng.randint(0, 6))
                # The end of a short notice names the licence and its version.
                piece = words[-size:] if len(words) < 12 else words[(at := rng.randint(0, len(words) - size)) : at + size]
                rows.append((family, " ".join(piece + extra)))
    for text in [t for texts in TEMPLATES.values() for t in texts]:
        words = text.split()
        rng.shuffle(words)
        rows.append((UNKNOWN, " ".join(words[: max(2, len(words) // 3)])))
    return rows


@lru_cache(maxsize=1)
def trained(seed: int = 5) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(n-grams, weights, biases, temperature) of the softmax regression.

    It is trained on the templates and the texts beside them alone, a bounded
    set, so it does not depend on the corpus. Probabilities are calibrated, by a
    temperature and a lift of the unknown class, on wordings and licences that
    are in neither.
    """
    rng = random.Random(seed)
    rows = _examples(rng)
    vocabulary = sorted({g for _, text in rows for g in grams_of(text)})
    number = {g: i for i, g in enumerate(vocabulary)}

    def table(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(vocabulary)))
        for i, text in enumerate(texts):
            x[i, [number[g] for g in grams_of(text) if g in number]] = 1
        return x

    x, y = table([t for _, t in rows]), np.eye(len(FAMILIES))[[FAMILIES.index(f) for f, _ in rows]]
    weights, bias = np.zeros((len(vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES))
    squares, squares_bias = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(250):
        scores = x @ weights + bias
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = scores / scores.sum(axis=1, keepdims=True) - y
        slope, slope_bias = x.T @ error / len(error) + 1e-4 * weights, error.mean(axis=0)
        squares += slope**2
        squares_bias += slope_bias**2
        weights -= 0.3 * slope / np.sqrt(squares)
        bias -= 0.3 * slope_bias / np.sqrt(squares_bias)
    held, told = table([t for _, t in CALIBRATION]), [FAMILIES.index(f) for f, _ in CALIBRATION]
    raw = held @ weights + bias

    def loss(choice: tuple[float, float]) -> float:
        scores = raw / choice[0]
        scores[:, FAMILIES.index(UNKNOWN)] += choice[1]
        scores -= scores.max(axis=1, keepdims=True)
        return -(scores[range(len(told)), told] - np.log(np.exp(scores).sum(axis=1))).sum()

    options = [(0.5 * 1.15**i, 0.25 * j) for i in range(20) for j in range(-4, 9)]
    temperature, lift = min(options, key=loss)
    bias = bias.copy()
    bias[FAMILIES.index(UNKNOWN)] += lift * temperature
    return vocabulary, weights, bias, temperature


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from constants of the plan."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(parsed))


def _template_rows() -> list[dict]:
    texts = [(f, t) for f, group in TEMPLATES.items() for t in group]
    return [
        {
            "template": i, "of_family": f, "size": len(grams_of(t)), "grams": grams_of(t),
            "variants": variants_of(t), "denials": denials_of(t),
        }
        for i, (f, t) in enumerate(texts)
    ]


def _words(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), _ENUMERATION, "")
    shorter = F.regexp_replace(bare, r"\bv[.]? ?(?=[0-9])", "")
    plain = F.regexp_replace(shorter, r"([0-9])[.]0(?![0-9.]*[0-9])", "$1")
    return F.regexp_extract_all(plain, F.lit(f"({_WORD})"), F.lit(1))


def _grams(text: Column) -> Column:
    words = _words(text)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.array_compact(F.concat(words, pairs)))


def _variants(words: Column) -> Column:
    own = F.filter(words, lambda w: w.isin(*VARIANTS) | w.rlike(_VERSION))
    return F.array_sort(F.array_distinct(own))


def paragraphs_of(text: Column) -> Column:
    """Paragraphs of a text: lines, where a line that does not end a sentence goes on in the next.

    Marks of comments before the line that goes on are left out. A blank line
    always ends a paragraph.
    """
    joined = F.regexp_replace(text, r"(?<=[^\s.!?:;])[ \t\r]*\n[ \t]*(?:[#*/;]+[ \t]*)?(?=[^\s#*/;])", " ")
    return F.split(joined, "\n")


def classify(paragraphs: DataFrame, least: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """Family of each distinct paragraph of (key, paragraph); see :func:`scan_licences`."""
    spark = paragraphs.sparkSession
    vocabulary, weights, bias, temperature = trained()
    rows = [
        {"gram": g, "w": [round(float(v), 5) for v in w]} for g, w in zip(vocabulary, weights)
    ]
    model = F.broadcast(_literal(spark, rows, "gram string, w array<double>"))
    kinds = (
        "template int, of_family string, size int, grams array<string>, variants array<string>, "
        "denials array<string>"
    )
    places = _literal(spark, _template_rows(), kinds)
    held = F.broadcast(
        places.select("template", "of_family", "size", F.explode("grams").alias("gram"))
    )
    known = F.broadcast(places.select("template", "variants", "denials"))

    split = paragraphs.select("key", "paragraph", _words(F.col("paragraph")).alias("words"))
    told = split.select(
        "key",
        _variants(F.col("words")).alias("has"),
        F.array_intersect("words", F.array(*map(F.lit, DENIALS))).alias("denied"),
    )
    grams = paragraphs.select("key", _grams(F.col("paragraph")).alias("grams"))
    single = durable(grams.select("key", F.size("grams").alias("n"), F.explode_outer("grams").alias("gram")))
    sums = [F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(len(FAMILIES))]
    scored = single.join(model, "gram", "left").groupBy("key").agg(*sums)
    powers = [
        F.exp((F.col(f"s{i}") + float(b)) / float(temperature)) for i, b in enumerate(bias)
    ]
    total = powers[0]
    for p in powers[1:]:
        total = total + p
    shares = F.array(
        *(F.struct((p / total).alias("p"), F.lit(f).alias("family")) for p, f in zip(powers, FAMILIES))
    )
    best = scored.select("key", F.array_max(shares).alias("best"))
    shared = (
        single.join(held, "gram")
        .groupBy("key", "n", "template", "of_family", "size")
        .agg(F.count(F.lit(1)).alias("both"))
        .join(known, "template")
        .join(told, "key")
        .where((F.col("has") == F.col("variants")) & (F.size(F.array_except("denied", "denials")) == 0))
        .select("key", "of_family", (F.col("both") / F.least("size", F.col("n"))).alias("overlap"))
        .groupBy("key", "of_family")
        .agg(F.max("overlap").alias("overlap"))
    )
    joined = best.join(
        shared.withColumnRenamed("of_family", "family"),
        (best.key == shared.key) & (F.col("best.family") == F.col("family")),
        "left",
    ).select(best.key, "best.p", F.col("best.family").alias("guess"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
    confirmed = (F.col("guess") != UNKNOWN) & (F.col("p") >= least) & (F.col("overlap") >= overlap)
    return joined.select(
        "key",
        F.when(confirmed, F.col("guess")).otherwise(UNKNOWN).alias("family"),
        F.col("p").alias("probability"),
        "overlap",
        # Nothing speaks for a licence.
        ((F.col("guess") == UNKNOWN) & (F.col("p") >= least)).alias("plain"),
    )


def scan_licences(docs: DataFrame, least: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """Licence family of every paragraph that may be a licence.

    Wrapped lines are joined to paragraphs first. A softmax regression over
    words and word pairs gives the probability of each family and of the
    unknown class. A family counts if its probability is at least ``least`` and
    a template of it confirms it: of the n-grams of the template, or of the
    paragraph if it has fewer, the share ``overlap`` is in both, the paragraph
    has the version and variant of the template, and it denies nothing. What is
    not confirmed is "unknown". Paragraphs with less than two of the words that
    templates are made of, common ones apart, are no licences; they are not
    returned, nor are unknown ones that the regression takes for nothing else
    and no template resembles.

    Equal paragraphs are classified once, whatever number of documents they
    stand in. All steps are DataFrame functions.

    Returns doc_id, paragraph (its number in the text, from 0), family,
    probability (of the likeliest class), overlap (with a template of it). A
    null or empty text has no paragraphs. Repeated rows give repeated results.
    Other columns are not read.
    """
    words = F.array(*map(F.lit, gate_words()))
    split = docs.select(
        F.col("doc_id").cast("long"),
        F.posexplode(paragraphs_of(F.col("text"))).alias("place", "paragraph"),
    ).where(F.size(F.array_intersect(_words(F.col("paragraph")), words)) >= 2)
    found = durable(split.withColumn("key", F.md5("paragraph")))
    distinct = found.groupBy("key").agg(F.first("paragraph").alias("paragraph"))
    verdicts = small_side(durable(classify(distinct, least, overlap)))
    return (
        found.join(verdicts, "key")
        .where(~((F.col("family") == UNKNOWN) & F.col("plain")))
        .select("doc_id", F.col("place").alias("paragraph"), "family", "probability", "overlap")
    )
