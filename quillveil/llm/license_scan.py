"""Licence families of paragraphs, by a trained n-gram classifier and template comparison.

A paragraph is a run of neighbouring lines that each hold a telling word, a word
of the vocabulary; so a notice wrapped over lines is one paragraph, and a notice
on a line of its own amid other text is one as well. Its features are the word
n-grams (up to three words) that occur in licence templates and hold a word that
says something; multinomial logistic regression over them gives a probability
for each family and for `unknown`. The model is trained when the query runs,
unless one is given: on the templates, on shortened, mixed and embedded variants
of them, on fixed hard negatives, and on at most `NEGATIVES` paragraphs of the
corpus, taken in hash order. A part is held out, and a temperature fitted on it
calibrates the probabilities. A prediction needs half of the probability, and is
confirmed if enough of its word shingles are in one of the family's templates.
The lines of a paragraph of several are judged by themselves, too, and count if
they hold a whole template of another family than the paragraph's.

The main path is DataFrame and SQL functions throughout. Documents are read
once: their paragraphs are written, and training, scoring and comparison take
them from there. A line without a telling word has no feature, so its prediction
would be the model's intercept, `unknown`. Features of paragraphs are exploded
and joined with the weights (a table as large as the templates, hence broadcast;
more than `MAX_FEATURES` of them is an error), and summed per paragraph with
partial aggregation.

Defined results: a null or empty text has no paragraph and no licence; rows that
repeat an id or text are scanned each; equal paragraphs of a document count
each; of families of equal probability the first in the order of `TEMPLATES` is
predicted; of confirmed notices of equal probability the one with the greater
similarity, then the family that sorts last, is the document's licence; long
texts are scanned in whole; an empty table gives no row; further columns are
ignored.
"""

from __future__ import annotations

import functools
import json
import random

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.session import materialize

UNKNOWN = "unknown"
NEGATIVES = 2000
VARIANTS = 14
MAX_FEATURES = 8000
MAX_WORDS = 3
CONFIRM = 0.5
WHOLE = 0.9
SEED = 7

# Notices of the families as their publishers word them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT license",
        "This project is licensed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "MIT License",
        "License: MIT",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "Apache License, Version 2.0",
        "License: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GPL v3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "Released under the BSD License",
        "Licensed under the BSD 3-Clause License",
        "Licensed under the 2-clause BSD license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "BSD 3-Clause License",
        "License: BSD-3-Clause",
    ],
    "ISC": [
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "ISC License",
        "License: ISC",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "Available under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
        "Available under CC BY-NC 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-ND": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
        "Licensed under CC BY-ND 4.0",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "Released under CC0 1.0 Universal Public Domain Dedication",
        "Licensed under CC0",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Released under the Unlicense",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Proprietary": [
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited",
        "Proprietary and confidential",
        "This software is proprietary and may not be copied or distributed without written permission",
    ],
}
# Sentences that share words with notices and license nothing.
HARD_NEGATIVES = [
    "He renewed his driving license last week",
    "The doctor was licensed to practice medicine in this state",
    "A new version of the software was released on Monday",
    "The software is used by many people around the world",
    "The public library opened a new building",
    "She works under the terms of a general agreement with the union",
    "The general asked the public for permission to continue",
    "The source of the river is in the mountains",
    "The file could not be found on this computer",
    "You can obtain a copy at the front desk free of charge",
    "All rights of way were closed during the storm",
    "The company sells software products and services",
    "Copyright law was discussed at the conference",
    "The terms and conditions of the contract were changed",
    "This program was shown on public television",
    "The clause in the contract was not clear",
    "The foundation gave free books to the school",
    "The author of this work lives in Paris",
    "Any person may use the public road without limitation",
    "The creative team met at the commons for lunch",
    "The domain of the function is the set of real numbers",
    "A fishing license costs twenty dollars",
]
# Words that say nothing about licences on their own.
STOP_WORDS = "a an the of and or to in on is are be been by for from with without this that these those it its as at not you your may can any all if one no nor we i he she they his her their will shall has have had was were so do does must should provided but mit v".split()
_FILLER = "today report market people river music table garden winter letter answer window teacher village story number system group result morning".split()


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _grams(words: Column, n: int) -> Column:
    parts = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), parts)).otherwise(F.array().cast("array<string>"))


def features_of(words: Column) -> Column:
    """All n-grams of one to MAX_WORDS words, each once."""
    return F.array_distinct(F.concat(words, *[_grams(words, n) for n in range(2, MAX_WORDS + 1)]))


def _shingles(words: Column) -> Column:
    """Three-word shingles; of one or two words, the whole."""
    return F.array_distinct(F.when(F.size(words) >= 3, _grams(words, 3)).otherwise(F.array(F.array_join(words, " "))))


def _template_table(spark: SparkSession) -> DataFrame:
    """(family, templates): shingles of one, two and three words of each notice."""
    rows = _table(spark, [(f, t) for f, texts in TEMPLATES.items() for t in texts], "family string, text string")
    words = words_of(F.col("text"))
    sets = F.struct(F.array_distinct(words).alias("one"), F.array_distinct(_grams(words, 2)).alias("two"), _shingles(words).alias("three"))
    return rows.groupBy("family").agg(F.collect_list(sets).alias("templates"))


def _plain(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def vocabulary() -> list[str]:
    """N-grams of the templates that hold a telling word, in order."""
    stop, count = set(STOP_WORDS), {}
    for texts in TEMPLATES.values():
        for t in texts:
            w = _plain(t)
            for n in range(1, MAX_WORDS + 1):
                for i in range(len(w) - n + 1):
                    if any(x not in stop and not x.isdigit() for x in w[i : i + n]):
                        gram = " ".join(w[i : i + n])
                        count[gram] = count.get(gram, 0) + 1
    if len(count) > MAX_FEATURES:
        raise ValueError(f"the templates have {len(count)} features; MAX_FEATURES is {MAX_FEATURES}, and weights are broadcast")
    return sorted(count)


def _word_grams(words: list[str]) -> set[str]:
    """N-grams with a telling word."""
    stop = set(STOP_WORDS)
    return {" ".join(words[i : i + n]) for n in range(1, MAX_WORDS + 1) for i in range(len(words) - n + 1) if any(x not in stop and not x.isdigit() for x in words[i : i + n])}


@functools.cache
def _owners() -> dict[str, set[str]]:
    """Families by the n-grams of their templates."""
    owners: dict[str, set[str]] = {}
    for family, texts in TEMPLATES.items():
        for t in texts:
            for g in _word_grams(_plain(t)):
                owners.setdefault(g, set()).add(family)
    return owners


def families_told(text: str) -> set[str]:
    """Families that this text holds an n-gram of no other family's templates."""
    owners = _owners()
    return {f for g in _word_grams(_plain(text)) if len(found := owners.get(g, ())) == 1 for f in found}


def training_rows(variants: int = VARIANTS, seed: int = SEED) -> list[tuple[str, str]]:
    """(family, text) from the templates and their variants, and the fixed negatives.

    Part of a notice that its family shares with others in every n-gram is an
    example of `unknown`.
    """
    rng, rows = random.Random(seed), []
    for family, texts in TEMPLATES.items():
        for t in texts:
            rows += [(family, t)] * 3
            w = t.split()
            for _ in range(variants // 2):
                size = min(len(w), rng.randint(3, 9))
                at = rng.randint(0, len(w) - size)
                part = " ".join(w[at : at + size])
                rows.append((family if family in families_told(part) else UNKNOWN, part))
            for _ in range(variants):
                x = list(w)
                if len(x) > 12:
                    size = rng.randint(10, len(x))
                    at = rng.randint(0, len(x) - size)
                    x = x[at : at + size]
                x = [y for y in x if len(x) < 6 or rng.random() > 0.06]
                before, after = ([rng.choice(_FILLER) for _ in range(rng.choice((0, 0, 2, 5)))] for _ in range(2))
                made = " ".join([*before, *x, *after])
                rows.append((family if family in families_told(made) else UNKNOWN, made))
    for t in HARD_NEGATIVES:
        rows.append((UNKNOWN, t))
        for _ in range(variants // 2):
            w = t.split()
            rng.shuffle(w)
            rows.append((UNKNOWN, " ".join([*w[: rng.randint(3, len(w))], *[rng.choice(_FILLER) for _ in range(4)]])))
    rows += [(UNKNOWN, " ".join(rng.choice(_FILLER + STOP_WORDS) for _ in range(rng.randint(3, 40)))) for _ in range(300)]
    return rows


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from values, without an RDD."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ", "))))


def _fill(names: list[str]) -> list[str]:
    return [f"w{i}" for i in range(len(names))]


class LicenseModel:
    """Weights by feature, intercepts and temperature; plain numbers of bounded size."""

    def __init__(self, families: list[str], features: list[str], weights: list[list[float]], intercepts: list[float], temperature: float = 1.0):
        self.families, self.features, self.weights, self.intercepts, self.temperature = families, features, weights, intercepts, temperature

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(f, [round(x, 6) for x in w]) for f, w in zip(self.features, self.weights, strict=True) if any(abs(x) > 1e-6 for x in w)]
        return _table(spark, rows, "feature string, weights array<double>")

    def telling_words(self) -> list[str]:
        """Words that are features; each feature holds one of them."""
        return [f for f in self.features if " " not in f]

    def logits(self, candidates: DataFrame, keys: list[str], temperature: float | None = None) -> DataFrame:
        """keys and `logits`, from keys and `features`."""
        t = temperature or self.temperature
        names = _fill(self.families)
        exploded = candidates.select(*keys, F.explode_outer("features").alias("feature"))
        weighted = exploded.join(F.broadcast(self.table(candidates.sparkSession)), "feature", "left")
        sums = weighted.groupBy(*keys).agg(*[F.coalesce(F.sum(F.get("weights", F.lit(i))), F.lit(0.0)).alias(n) for i, n in enumerate(names)])
        return sums.select(*keys, F.array(*[(F.col(n) + F.lit(float(b))) / F.lit(float(t)) for n, b in zip(names, self.intercepts, strict=True)]).alias("logits"))

    def probabilities(self, candidates: DataFrame, keys: list[str]) -> DataFrame:
        """keys, family of the highest probability, and that probability."""
        scored = self.logits(candidates, keys).withColumn("top", F.array_max("logits"))
        z = F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
        best = F.get(F.array(*[F.lit(f) for f in self.families]), F.array_position("logits", F.col("top")).cast("int") - 1)
        return scored.select(*keys, best.alias("family"), (F.lit(1.0) / z).alias("probability"))


def train(spark: SparkSession, corpus: DataFrame | None = None, negatives: int = NEGATIVES, seed: int = SEED) -> LicenseModel:
    """Fit weights on four fifths of the labelled rows and the temperature on the rest.

    corpus: (words) of paragraphs; at most `negatives` of those with one telling
    word serve as examples of `unknown`.
    """
    features = vocabulary()
    families = [UNKNOWN, *TEMPLATES]
    number = {f: i for i, f in enumerate(families)}
    telling = [f for f in features if " " not in f]
    rows = _table(spark, [(i, number[f], t) for i, (f, t) in enumerate(training_rows(seed=seed))], "row bigint, label int, text string")
    rows = rows.select("row", "label", words_of(F.col("text")).alias("words"))
    if corpus is not None:
        plain = corpus.filter(F.size(F.filter("words", lambda w: w.isin(telling))) == 1)
        # Equal words have equal hashes, so the hash alone orders; each task keeps its first few.
        picked = plain.select("words", F.xxhash64("words").alias("h")).orderBy("h").limit(negatives)
        rows = rows.unionByName(picked.select(F.col("h").bitwiseOR(F.lit(1 << 40)).alias("row"), F.lit(0).alias("label"), "words"))
    ready = rows.select("row", F.col("label").cast("double").alias("label"), features_of(F.col("words")).alias("features"), (F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(5)) == 0).alias("held"))
    ready = materialize(ready.coalesce(1), "license-train")
    counted = CountVectorizerModel.from_vocabulary(features, inputCol="features", outputCol="vector")
    counted = counted.setBinary(True) if hasattr(counted, "setBinary") else counted
    fitted = LogisticRegression(featuresCol="vector", labelCol="label", family="multinomial", maxIter=40, tol=1e-4, regParam=2e-4, standardization=False).fit(counted.transform(ready.filter("NOT held")))
    matrix, intercepts = fitted.coefficientMatrix.toArray(), [float(x) for x in fitted.interceptVector]
    used = len(intercepts)
    model = LicenseModel(families[:used], features, matrix.T.tolist(), intercepts)
    held = ready.filter("held").select("row", "label", "features")
    logits = model.logits(held, ["row", "label"], 1.0).collect()  # a fifth of a bounded set

    def loss(t: float) -> float:
        import math

        total = 0.0
        for r in logits:
            top = max(r.logits)
            total += (top - r.logits[int(r.label)]) / t + math.log(sum(math.exp((x - top) / t) for x in r.logits))
        return total

    model.temperature = min((0.5 * 1.25**i for i in range(12)), key=loss)
    return model


def paragraphs_of(text: Column, telling: list[str]) -> Column:
    """Array of (at, n_lines, inside, words): runs of lines with telling words, and after each run of several its lines, which are `inside`.

    `at` counts all lines from 0.
    """
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), words_of(x).alias("w")))
    told = F.filter(lines, lambda x: F.exists(x["w"], lambda w: w.isin(telling)))

    def runs(t: Column) -> Column:
        opens = F.filter(F.transform(t, lambda x, k: F.when(F.coalesce(F.get(t, k - 1)["i"], F.lit(-2)) + 1 != x["i"], k)), lambda k: k.isNotNull())

        def run(s: Column, k: Column, j: Column) -> Column:
            part = F.slice(t, k + 1, F.coalesce(F.get(s, j + 1), F.size(t)) - k)
            whole = F.struct(F.get(t, k)["i"].alias("at"), F.size(part).alias("n_lines"), F.lit(False).alias("inside"), F.flatten(F.transform(part, lambda x: x["w"])).alias("words"))
            single = F.transform(part, lambda x: F.struct(x["i"].alias("at"), F.lit(1).alias("n_lines"), F.lit(True).alias("inside"), x["w"].alias("words")))
            return F.when(F.size(part) == 1, F.array(whole)).otherwise(F.concat(F.array(whole), single))

        return _let(opens, lambda s: F.flatten(F.transform(s, lambda k, j: run(s, k, j))))

    return _let(told, runs)


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan_paragraphs(paragraphs: DataFrame, model: LicenseModel, keys: list[str], confirm: float = CONFIRM) -> DataFrame:
    """keys, family, probability, template_similarity, whole, confirmed: for those of the paragraphs (keys, words) predicted to be a licence notice.

    template_similarity is the share of common shingles of the shorter side, for
    the family's best template; whole is the share of a template's shingles.
    """
    known = sorted(model.features)
    ready = paragraphs.select(*keys, F.filter(features_of(F.col("words")), lambda f: f.isin(known)).alias("features"))
    scored = model.probabilities(ready, keys).filter((F.col("family") != UNKNOWN) & (F.col("probability") >= 0.5))
    # Written, so that its size is known: only the words of predicted paragraphs need to move, or none if it is small.
    scored = materialize(scored, "license-scored")
    own = F.col("own")
    mine = lambda t: F.when(F.size("words") >= 3, t["three"]).when(F.size("words") == 2, t["two"]).otherwise(t["one"])
    common = lambda t: F.size(F.array_intersect(mine(t), own))
    share = F.array_max(F.transform("templates", lambda t: common(t) / F.greatest(F.least(F.size(mine(t)), F.size(own)), F.lit(1))))
    whole = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t["three"], own)) / F.size(t["three"])))
    joined = scored.join(paragraphs.select(*keys, "words"), keys).withColumn("own", _shingles(F.col("words"))).join(F.broadcast(_template_table(paragraphs.sparkSession)), "family")
    joined = joined.select(*keys, "family", "probability", share.alias("template_similarity"), whole.alias("whole"))
    return joined.withColumn("confirmed", F.col("template_similarity") >= confirm)


def scan_licenses(docs: DataFrame, confirm: float = CONFIRM, id_col: str = "doc_id", text_col: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """One row per document: id, n_lines (not blank), n_notices, families (confirmed, sorted), license (of the likeliest confirmed notice), probability, template_similarity, notices."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    telling = model.telling_words() if model else [f for f in vocabulary() if " " not in f]
    n_lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)).cast("long")
    # Rows get numbers that are written with them, so rows that repeat an id or have none are told apart.
    base = materialize(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), n_lines.alias("n_lines"), paragraphs_of(text, telling).alias("paragraphs")), "license-paragraphs")
    key = ["row", "at", "inside"]
    paragraphs = base.select("row", F.inline("paragraphs"))
    model = model or train(spark, paragraphs.filter("NOT inside").select("words"))
    found = scan_paragraphs(paragraphs.select(*key, "words"), model, key, confirm).filter(F.expr("NOT inside") | (F.col("whole") >= WHOLE))
    # A line inside a paragraph adds what the paragraph does not say already.
    sizes = paragraphs.select(*key, "n_lines").filter("n_lines > 1 OR inside")
    found = materialize(found.join(sizes, key, "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(1))), "license-notices")
    said = F.struct("at", "n_lines", "inside", "family", F.round("probability", 6).alias("probability"), F.round("template_similarity", 6).alias("template_similarity"), "confirmed")
    gathered = found.groupBy("row").agg(F.array_sort(F.collect_list(said)).alias("all"))
    covers = lambda b, n: ~b["inside"] & b["confirmed"] & (b["family"] == n["family"]) & (b["at"] <= n["at"]) & (n["at"] < b["at"] + b["n_lines"])
    kept = F.filter("all", lambda n: ~n["inside"] | ~F.exists("all", lambda b: covers(b, n)))
    per_doc = gathered.select("row", kept.alias("notices"))
    sure = F.filter("notices", lambda n: n["confirmed"])
    best = F.array_max(F.transform(sure, lambda n: F.struct(n["probability"].alias("probability"), n["template_similarity"].alias("template_similarity"), n["family"].alias("family"))))
    none = F.array()
    per_doc = per_doc.select("row", F.size("notices").cast("long").alias("n_notices"), F.array_sort(F.array_distinct(F.transform(sure, lambda n: n["family"]))).alias("families"), best.alias("best"), F.transform("notices", lambda n: n.dropFields("inside")).alias("notices"))
    out = base.select("row", "id", "n_lines").join(per_doc, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_lines",
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("families", none.cast("array<string>")).alias("families"),
        F.col("best.family").alias("license"),
        F.col("best.probability").alias("probability"),
        F.col("best.template_similarity").alias("template_similarity"),
        "notices",
    )
