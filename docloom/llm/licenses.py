"""License scan by a trained paragraph classifier.

Native: DataFrame functions and the DataFrame machine-learning API only. A paragraph is what blank lines, or line ends that
close a sentence, part from the rest; hard-wrapped lines are joined. Paragraphs become sparse word 1- and 2-grams, and a multinomial
logistic regression gives their class. A paragraph whose words, by a bound on their weights, cannot lift any class above ``none`` is ``none``;
the others are the candidates, which are scored. The bound loses none.

It is fitted on made-up uses of the names and notices below, on names of other licences as class ``unknown``, and as class ``none`` on
sentences with licence words that license nothing and on paragraphs of the corpus that are like no notice: at most ``MAX_FIT`` that hold one of
``STEMS``, and at most ``MAX_PLAIN`` others, of as many documents. A temperature
calibrates its probabilities on other wordings, and a cut is set so that licences it was not fitted on stay ``unknown``.
A family is confirmed by a comparison with its templates: weighted by how few families use a gram, half of a template's grams are in
the paragraph, or half of the paragraph's grams (words outside the vocabulary weigh most) are in the template. Else it is ``unknown``.

Texts are scanned for what the fit needs, for candidates, which are stored, and for counts.

Defined results: a null text has no paragraphs; empty paragraphs are none, and an empty text has none; rows equal in doc_id and text share one
result; a null doc_id is a key like any other; an empty table gives an empty result (and is fitted without corpus
paragraphs). Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, hashed_sample, let, stored

# Names of licence families.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT", "The MIT License (MIT)", "Expat License"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0", "Apache 2", "Apache Software License, Version 2.0", "ASL 2.0"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 2", "GNU General Public License version 3", "GNU GPL", "GPLv2", "GPLv3", "GPL", "GPL-2.0-or-later", "GPL-3.0-only", "GNU General Public License v3 or later"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPL", "LGPLv3", "LGPL-2.1-or-later", "GNU Library General Public License"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPLv3", "AGPL", "AGPL-3.0-only"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD license", "simplified BSD license", "BSD-style license", "New BSD License"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "MPL"],
    "CC-BY": ["Creative Commons Attribution 4.0 International", "CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution License", "CC BY 3.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution Share Alike License", "CC BY-SA 3.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution Non-Commercial License", "CC BY-NC 3.0"],
    "CC0": ["CC0", "CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero", "CC0 public domain dedication"],
    "ISC": ["ISC License", "ISC", "ISC licence", "Internet Systems Consortium License"],
}
# The notices by which families are granted, paragraph by paragraph.
NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}
# Other licences, those of the fit and those that set the cut, and statements of rights.
OTHERS = ["Artistic License 2.0", "Common Development and Distribution License", "CDDL-1.0", "Boost Software License, Version 1.0", "BSL-1.0", "zlib License", "SIL Open Font License, Version 1.1", "OFL-1.1", "Microsoft Public License", "Elastic License 2.0", "Server Side Public License", "Academic Free License 3.0", "Community Public License 1.4", "Open Software License 3.0", "Python Software Foundation License", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives License", "Acme Software License, version 2"]
HELD_OUT_OTHERS = ["European Union Public Licence 1.2", "EUPL-1.2", "IBM Public License 1.0", "PostgreSQL License", "Business Source License 1.1", "Q Public License", "Ruby License", "Sleepycat License", "Sun Public License", "W3C Software Notice and License"]
RIGHTS = [
    "Copyright (c) the author, all rights reserved worldwide", "No part of this publication may be reproduced without prior written permission of the copyright holder", "Use of this software is subject to the terms of the license agreement",
    "Distributed under a proprietary license", "See the LICENSE file for the terms of use", "Licensed to the customer under a commercial licence", "Released under its own license, version 1", "Licensed under a custom license",
    "All rights are reserved by the publisher", "Copyright 2018 Example Press, all rights reserved", "The author reserves all rights", "All rights in this text are reserved",
]
# Sentences with words of licences that license nothing.
PLAIN = [
    "He lost his driver's license on the way to the airport", "The license of the pub was not renewed by the city", "She was granted permission to enter the building free of charge", "Copyright law protects authors and their heirs",
    "The warranty of the car ended in May", "A licensed engineer must sign the drawings", "The new version was released under pressure from users", "Students at MIT published a study on public transport", "The Apache people lived in the south west",
    "The museum redistributed the tickets without any fee", "Permission to land was denied", "The court held that the copyright had expired", "The general public may visit the library in the afternoon", "The fishing licence costs ten pounds a year",
    "Please bring your license and registration", "The restaurant lost its liquor license", "The creative commons of the village was a meadow", "They issued a warrant for his arrest", "The company sells licences for its patents", "Under the license the firm paid a fee for each copy sold",
    "The song is in the public domain since last year", "Any person who endorses a cheque must sign it", "Use of the garden is subject to permission", "The film was licensed to a distributor in Japan",
]
FAMILIES = [*NAMES, "unknown", "none"]
#: Paragraphs with one of these are the harder examples of ``none``.
STEMS = ("licen", "copyright", "redistribut", "warrant", "permi", "spdx", "gpl", "mpl", "cc0", "cc by", "cc-by", "creative commons", "public domain", "rights reserved", "endorse", "waived")
BREAK = r"(?<=[.!?]\r?)\n\s*|\n\s*\n\s*"
MAX_FIT = 4_000
MAX_PLAIN = 1_000
#: Bounds of words are rounded up to these.
TIERS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0)
CONFIRM = 0.5


def paragraphs_of(text: Column) -> Column:
    """A text's paragraphs, without blank ones."""
    return F.filter(F.split(text, BREAK), lambda p: F.trim(p) != "")


def has_stem(text: Column) -> Column:
    def any_stem(low: Column) -> Column:
        out = low.contains(STEMS[0])
        for s in STEMS[1:]:
            out = out | low.contains(s)
        return out

    return let(F.lower(text), any_stem)


def words_of(paragraph: Column) -> Column:
    """A paragraph's lower-cased words of letters and digits."""
    return F.array_remove(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), "")


def grams_of(paragraph: Column) -> Column:
    """The distinct 1- and 2-grams of a paragraph's words."""
    words = words_of(paragraph)
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return let(words, lambda w: F.array_distinct(F.concat(w, pairs(w))))


# How a name is used, in the fit and in what calibrates it.
USES = ["Licensed under {}", "This file is under the {}", "License: {}", "SPDX-License-Identifier: {}", "The code is distributed under the terms of the {}", "{} applies to these data", "Released under the {}, see LICENSE", "{} license", "covered by {} licence terms", "dual licensed: {}"]
HELD_OUT_USES = ["We publish everything under the {} license", "The package is licensed {}", "Our work is available under {} licence", "Use is permitted by the {}", "Licence of the data set: {}"]


def _shortened(text: str, step: int, at: int) -> str:
    w = text.split()
    return " ".join(x for i, x in enumerate(w) if i % step != at)


def examples(held_out: bool) -> list[tuple[str, float]]:
    """Made-up paragraphs and their classes; those of the calibration share no wording with those of the fit."""
    uses, out = HELD_OUT_USES if held_out else USES, []
    for i, f in enumerate(NAMES):
        out += [(u.replace("{}", n), float(i)) for n in NAMES[f] for u in uses]
        for text in NOTICES[f]:
            parts = re.split(r"(?<=[.;]) ", text)
            out += [(_shortened(text, 7, 3), float(i)), (_shortened(text, 5, 1), float(i))] if held_out else [(text, float(i)), (text.upper(), float(i)), *[(x, float(i)) for x in parts], (_shortened(text, 6, 2), float(i)), ("Copyright (c) 2019 " + text, float(i))] * 2
    u, none = float(FAMILIES.index("unknown")), float(FAMILIES.index("none"))
    out += [(x.replace("{}", n), u) for n in (HELD_OUT_OTHERS if held_out else OTHERS) for x in uses]
    if not held_out:
        out += [(x, u) for x in RIGHTS for _ in range(3)] + [(x, none) for x in PLAIN for _ in range(3)] + [(_shortened(x, 4, j), none) for x in PLAIN for j in range(4)]
        out += [(w, none) for w in ("the", "of", "and", "version", "work", "software", "license", "copyright", "permission", "warranty", "licensed")] + [("", none)] * 40
    return out


@dataclass(frozen=True)
class Classifier:
    """Weights of the vocabulary, intercepts, temperature and the least probability of a family."""

    weights: list[tuple[str, list[float]]]
    intercepts: list[float]
    temperature: float
    cut: float


def _softmax(raw: list[float], temperature: float) -> list[float]:
    top = max(raw)
    e = [math.exp((r - top) / temperature) for r in raw]
    return [x / sum(e) for x in e]


def paragraphs(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, h, at, p): all paragraphs; h is the text's hash."""
    return documents.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(paragraphs_of(F.col("text"))).alias("at", "p"))


def stemmed(documents: DataFrame) -> DataFrame:
    """The paragraphs with a stem, as rows of ``paragraphs``."""
    return paragraphs(documents.filter(has_stem(F.col("text")))).filter(has_stem(F.col("p")))


def plain(documents: DataFrame, n: int = MAX_PLAIN) -> DataFrame:
    """At most ``n`` paragraphs (p) without a stem, of at most ``n`` documents: those with the smallest hashes."""
    return paragraphs(hashed_sample(documents.select(F.lit(0).alias("doc_id"), "text"), n, "text")).filter(~has_stem(F.col("p"))).select("p").distinct().orderBy(F.xxhash64("p"), "p").limit(n)


def word_bounds(classifier: Classifier) -> dict[str, float] | None:
    """By word: a share of how far ``none`` is ahead without words that it makes up at most, for any class; None where ``none`` is not ahead.

    A 2-gram counts for that of its words which is in fewer 2-grams, as it needs both. Words whose shares add up to less than 1 leave every class behind ``none``.
    """
    none = FAMILIES.index("none")
    lead = [classifier.intercepts[none] - b for b in classifier.intercepts]
    lead[none] = 1.0
    if min(lead) <= 0:
        return None
    used = Counter(w for x, _ in classifier.weights for w in x.split(" ") if " " in x)
    gains: dict[str, list[float]] = {}
    for x, w in classifier.weights:
        of = gains.setdefault(min(x.split(" "), key=lambda p: (used[p], p)), [0.0] * len(FAMILIES))
        for c, v in enumerate(w):
            of[c] += max(v - w[none], 0.0)
    return {w: max(g / a for g, a in zip(of, lead, strict=True)) for w, of in gains.items() if max(of) > 0}


def may_license(paragraph: Column, classifier: Classifier) -> Column:
    """Whether the words of a paragraph may lift a class above ``none``."""
    bounds = word_bounds(classifier)
    if bounds is None:
        return F.lit(True)
    tiers = {t: [w for w, v in bounds.items() if low < v <= t or (t == TIERS[-1] and v > t)] for low, t in zip((0.0, *TIERS), TIERS, strict=False)}

    def share(w: Column) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        for t in reversed(TIERS):
            out = out.when(w.isin(tiers[t]), F.lit(t)) if tiers[t] else out
        return out.otherwise(F.lit(0.0))

    known = F.array_distinct(F.filter(words_of(paragraph), lambda w: w.isin(list(bounds))))
    return F.aggregate(known, F.lit(0.0), lambda s, w: s + share(w)) >= 1 - 1e-6  # scores are rounded


def candidates(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """Those of all paragraphs that may be of another class than ``none``."""
    return paragraphs(documents).filter(may_license(F.col("p"), classifier))


def _templates() -> list[tuple[int, str]]:
    return [(i, t) for i, f in enumerate(NAMES) for t in (*NAMES[f], *NOTICES[f])]


def template_grams(spark: SparkSession) -> tuple[list[tuple[int, str, list[str]]], dict[str, float]]:
    """(family, template, grams) of each template, and each gram's weight by the families that use it; small fixed tables."""
    rows = spark.createDataFrame(_templates(), "c int, t string").select("c", "t", grams_of(F.col("t")).alias("g")).collect()
    users: dict[str, set[int]] = {}
    for r in rows:
        for g in r["g"]:
            users.setdefault(g, set()).add(r["c"])
    return [(r["c"], r["t"], r["g"]) for r in rows], {g: math.log((len(NAMES) + 1) / len(c)) for g, c in users.items()}


def likeness(met: DataFrame, spark: SparkSession, of_class: bool) -> DataFrame:
    """``met`` (g: grams; c: a family, if ``of_class``) with ``best``, a struct (similarity, template): the likest template, of that family or of all."""
    templates, weight = template_grams(spark)
    most = math.log(len(NAMES) + 1)
    by: dict[int, list] = {}
    for c, t, g in templates:
        by.setdefault(c if of_class else 0, []).append((t, g, [weight[x] for x in g]))
    schema = "t_class int, ts array<struct<template:string,g:array<string>,w:array<double>>>"
    known = F.broadcast(spark.createDataFrame(sorted(by.items()), schema))  # the templates fix its size
    met = met.join(known, F.col("c") == F.col("t_class"), "left") if of_class else met.crossJoin(known)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    shared = lambda t: total(F.zip_with(t["g"], t["w"], lambda x, w: F.when(F.array_contains("g", x), w).otherwise(0.0)))
    both = lambda t: F.size(F.array_intersect("g", t["g"]))
    # Of the paragraph: shared weight over it and the greatest weight for each gram that the template lacks.
    score = lambda t: let(shared(t), lambda s: F.greatest(s / total(t["w"]), F.when(both(t) >= 8, s / (s + most * (F.size("g") - both(t)))).otherwise(0.0)))
    return met.withColumn("best", F.array_max(F.transform("ts", lambda t: F.struct(score(t).alias("similarity"), t["template"].alias("template"))))).drop("ts", "t_class")


def _regression(vectors: CountVectorizerModel, data: DataFrame):
    data = vectors.transform(data).select("features", "y").coalesce(2).cache()
    model = LogisticRegression(labelCol="y", family="multinomial", regParam=1e-3, maxIter=40, standardization=False).fit(data)
    data.unpersist()
    return model


def fit(found: DataFrame, max_fit: int = MAX_FIT, more: DataFrame | None = None) -> Classifier:
    """Fit on the examples, then again with a bounded sample of paragraphs (p): those with the smallest hashes, and all of ``more``.

    Of these only what is like no template and what the first fit takes for ``none`` becomes an example of it, so that licences of
    the corpus, which nobody has labelled, are not learnt as none.
    """
    spark = found.sparkSession
    none = F.lit(float(FAMILIES.index("none")))
    train = spark.createDataFrame(examples(False), "p string, y double").select(grams_of(F.col("p")).alias("g"), "y")
    vocabulary = sorted(r["x"] for r in train.select(F.explode("g").alias("x")).distinct().collect())  # the examples fix its size
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="g", outputCol="features", minTF=1.0)
    vectors.setBinary(True)
    model = _regression(vectors, train)
    sample = found.select("p").distinct().orderBy(F.xxhash64("p"), "p").limit(max_fit)
    sample = sample if more is None else sample.unionByName(more.select("p"))
    sample = sample.repartition(spark.sparkContext.defaultParallelism, "p").select(grams_of(F.col("p")).alias("g"))
    plain = model.transform(vectors.transform(sample)).filter(F.col("prediction") == none).select("g")
    plain = likeness(plain, spark, False).filter(F.coalesce(F.col("best.similarity"), F.lit(0.0)) < 0.3).select("g", none.alias("y"))
    plain = stored(plain, "license-negatives")
    if not plain.isEmpty():
        model = _regression(vectors, train.unionByName(plain))
    forget(plain)
    held = vectors.transform(spark.createDataFrame(examples(True), "p string, y double").select(grams_of(F.col("p")).alias("g"), "y"))
    raw = [(r["raw"], int(r["y"])) for r in model.transform(held).select(vector_to_array("rawPrediction").alias("raw"), "y").collect()]
    loss = lambda t: -sum(math.log(max(_softmax(r, t)[y], 1e-12)) for r, y in raw)
    temperature = min((0.25 * 1.25**i for i in range(16)), key=loss)
    unknown = FAMILIES.index("unknown")
    top = [(max(_softmax(r, temperature)[:unknown]), r.index(max(r)), y) for r, y in raw]
    wrong = lambda cut: sum((c == y and y != unknown and p < cut) + 3 * (c != y and c < unknown and p >= cut) for p, c, y in top)
    cut = min((i / 50 for i in range(15, 48)), key=lambda c: (wrong(c), c))  # an unfitted licence named as a family costs three misses
    rows = model.coefficientMatrix.numRows
    flat = model.coefficientMatrix.toArray().tolist()
    assert rows == len(FAMILIES) and model.coefficientMatrix.numCols == len(vocabulary)
    return Classifier([(x, [flat[c][i] for c in range(rows)]) for i, x in enumerate(vocabulary)], model.interceptVector.toArray().tolist(), temperature, cut)


def classified(found: DataFrame, classifier: Classifier) -> DataFrame:
    """Rows (doc_id, h, at, p, family, probability, similarity, template) for each candidate that is no ``none``."""
    spark, n = found.sparkSession, len(FAMILIES)
    unknown, none = FAMILIES.index("unknown"), FAMILIES.index("none")
    weights = spark.createDataFrame(classifier.weights, "word string, w array<double>")  # the examples fix its size
    # Copies of one paragraph are scored once; only its hashes and its grams of the vocabulary are shuffled.
    digest = [F.xxhash64("p").alias("h1"), F.xxhash64(F.lit("second"), "p").alias("h2")]
    known = F.filter(grams_of(F.col("p")), lambda g: g.isin([w for w, _ in classifier.weights]))
    each = found.select(*digest, known.alias("g")).dropDuplicates(["h1", "h2"]).select("h1", "h2", F.explode("g").alias("gram"))
    sums = each.join(F.broadcast(weights), F.col("gram") == F.col("word")).groupBy("h1", "h2").agg(*[F.sum(F.col("w")[c]).alias(f"s{c}") for c in range(n)])
    raw = F.array(*[F.round((F.col(f"s{c}") + classifier.intercepts[c]) / classifier.temperature, 9) for c in range(n)])
    scored = sums.select("h1", "h2", raw.alias("raw")).withColumn("top", F.array_max("raw")).filter(F.col("top") > F.get("raw", F.lit(none)))
    odds = F.aggregate(F.transform("raw", lambda r: F.exp(r - F.col("top"))), F.lit(0.0), lambda s, x: s + x)
    scored = scored.select("h1", "h2", (F.array_position("raw", F.col("top")) - 1).cast("int").alias("c"), (1 / odds).alias("probability"))
    scored = stored(scored, "license-scores")  # stored, so that few of them are sent to the texts and not these to them
    texts = found.select(*digest, "p").join(scored, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("h1", "h2", grams_of(F.col("p")).alias("g"))
    met = likeness(scored.join(texts, ["h1", "h2"]), spark, True)
    sure = (F.col("c") < unknown) & (F.col("probability") >= classifier.cut) & (F.col("best.similarity") >= CONFIRM)
    names = F.array(*[F.lit(f) for f in FAMILIES])
    met = met.select("h1", "h2", F.when(sure, F.get(names, F.col("c"))).otherwise("unknown").alias("family"), F.round("probability", 6).alias("probability"), F.round("best.similarity", 6).alias("similarity"), "best.template")
    met = stored(met, "license-paragraphs")  # stored, so that the places of one notice can be split between tasks
    forget(scored)
    return found.select("doc_id", "h", "at", "p", *digest).join(met, ["h1", "h2"]).drop("h1", "h2").dropDuplicates(["doc_id", "h", "at"])


def licenses(documents: DataFrame, max_fit: int = MAX_FIT, classifier: Classifier | None = None) -> DataFrame:
    """A row per document: doc_id, n_paragraphs, n_license, n_unknown, families (sorted, comma-joined)."""
    if classifier is None:
        pool = stored(stemmed(documents), "license-pool")
        classifier = fit(pool, max_fit, plain(documents, min(max_fit, MAX_PLAIN)))
        forget(pool)
    found = stored(candidates(documents, classifier), "license-candidates")
    per = classified(found, classifier).groupBy("doc_id", "h").agg(
        F.count_if(F.col("family") != "unknown").alias("n_license"), F.count_if(F.col("family") == "unknown").alias("n_unknown"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("family") != "unknown", F.col("family")))), ",").alias("families"),
    )
    per = stored(per, "license-counts")
    forget(found)
    base = documents.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.when(F.col("text").isNotNull(), F.size(paragraphs_of(F.col("text")))), F.lit(0)).cast("long").alias("n_paragraphs"))
    met = base.join(per, base["doc_id"].eqNullSafe(per["doc_id"]) & (base["h"] == per["h"]), "left")
    return met.select(base["doc_id"], "n_paragraphs", F.coalesce("n_license", F.lit(0)).cast("long").alias("n_license"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"), F.coalesce("families", F.lit("")).alias("families"))
