"""Operator 2: licence scan by a trained paragraph classifier, with DataFrame and SQL functions only."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"
FEATURES = 1 << 13
#: Documents, chosen by hash, and paragraphs of them that the class `none` is fitted on: documented bounds.
NONE_DOCS = 400
MAX_NONE_ROWS = 2000
#: Share of held-out licence paragraphs that may fall below the probability from which a family is believed.
MISSED_SHARE = 0.02
#: One template of so many is held out, to calibrate the probability from which a family is believed.
HELD_TEMPLATES = 4
#: Share of a paragraph's word pairs that its family's templates must hold, or of one template's that the paragraph must.
MIN_TEMPLATE_SHARE = 0.5
#: Words that, like numbers, name no licence.
GENERIC = frozenset("a an and any at for in later licence license licenses of only or the this to under v version".split())
#: Notices of licence families and grants of whole licences, as their publishers word them.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "Available under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "License: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "This library is free software under the terms of the GNU Lesser General Public License, version 2.1 or later.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Licensed under GPLv3 or later.",
        "Distributed under the GNU GPL v2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "License: GPL-3.0",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Released under the 3-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "License: BSD-2-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
        "License: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Content is available under CC-BY-SA-3.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    # Licence talk of no listed family: what the classifier must call unknown.
    UNKNOWN: [
        "Licensed under the terms of the accompanying license agreement.",
        "All rights reserved. No part of this work may be reproduced without written permission.",
        "This work is licensed under terms that are set out in a separate document.",
        "Copyright of the respective owners. Use is subject to license terms.",
        "Copyright (c) the authors. All rights reserved.",
    ],
}
#: Prose with words that licences use too, for the class `none`.
PROSE = [
    "She asked for permission to leave the room before the lesson was over.",
    "The driver lost his license after the accident and walked to work for a year.",
    "The copyright of the book went to the children of the author when he died.",
    "The new software was free of charge for all visitors of the fair.",
    "The Apache people lived in the mountains and on the plains of the south.",
    "He studied at MIT for four years and wrote a paper on engines.",
    "You may copy the recipe and give it to all of your friends.",
    "The house was sold as it was, without warranty by the former owner.",
    "The library holds the rights to the letters and lends them to the public.",
    "The general public was not admitted, but a version of the speech was printed.",
    "Creative people from the commons of the town met to share their work.",
    "The source of the river lies in a binary system of two lakes.",
    "The terms of the contract were set out by the two foundations.",
    "All the seats were reserved, and no part of the hall was left to the public.",
    "The notice on the door said that the distribution of food had ended.",
]


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pairs(parts: Column) -> Column:
    """Neighbouring words, joined."""
    n = F.size(parts)
    return F.when(
        n > 1, F.zip_with(F.slice(parts, 1, n - 1), F.slice(parts, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))
    ).otherwise(F.array().cast("array<string>"))


def grams(parts: Column) -> Column:
    """Words and word pairs."""
    return F.concat(parts, pairs(parts))


def examples(spark: SparkSession) -> DataFrame:
    """family, text: windows of 4 words or more of every template and prose, and these whole; with its part: 0 to fit, 1 to calibrate.

    Parts are dealt by hash of the whole template, so windows that calibrate lie in no template that the calibrated model was fitted on.
    """
    rows = [(family, text) for family, texts in (TEMPLATES | {NONE: PROSE}).items() for text in texts]
    base = spark.createDataFrame(rows, "family string, template string").coalesce(1)
    parts = F.split("template", " ")
    n = F.size(parts)
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 4, F.lit(0)), F.when(n > 24, 2).otherwise(1)),
            lambda a: F.transform(
                F.array_distinct(F.array(*[F.least(a + k, n) for k in (4, 5, 6, 8, 12, 16, 32)], n)),
                lambda b: F.array_join(F.slice(parts, a + 1, b - a), " "),
            ),
        )
    )
    held = F.pmod(F.xxhash64("template"), F.lit(HELD_TEMPLATES)).eqNullSafe(0).cast("int")
    windows = base.select("family", held.alias("part"), F.explode(F.array_distinct(F.concat(F.array("template"), spans))).alias("text"))
    # A window that several families share says nothing about any of them.
    shared = windows.groupBy("text").agg(F.count_distinct("family").alias("n"), F.min("family").alias("family"), F.min("part").alias("part")).where("n = 1")
    return shared.select("family", "text", "part")


def paragraphs(docs: DataFrame) -> DataFrame:
    """row_key, line_no, text of every line of every text."""
    return docs.select(
        F.xxhash64("doc_id", "text").alias("row_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    )


def template_share(parts: Column, family: Column) -> Column:
    """The share of a paragraph's word pairs that the templates of the family hold, or that the paragraph holds of one of them, if larger."""
    own = F.array_distinct(pairs(parts))
    cut = {f: [F.array_distinct(pairs(words(F.lit(t)))) for t in texts] for f, texts in TEMPLATES.items()}
    all_ = F.create_map(*[x for f, lists in cut.items() for x in (F.lit(f), F.array_distinct(F.concat(*lists)))])
    each = F.create_map(*[x for f, lists in cut.items() for x in (F.lit(f), F.array(*lists))])
    held = F.size(F.array_intersect(own, F.element_at(all_, family))) / F.greatest(F.size(own), F.lit(1))
    most = F.array_max(F.transform(F.element_at(each, family), lambda t: F.size(F.array_intersect(own, t)) / F.size(t)))
    return F.greatest(held, most)


def distinctive(parts: Column, family: Column) -> Column:
    """Whether a paragraph holds a word pair that templates of this family hold and those of no other one do, and that is more than a version."""
    held = {f: {p for t in texts for p in _pairs_of(t) if not all(w in GENERIC or w.isdigit() for w in p.split())} for f, texts in TEMPLATES.items()}
    only = {f: sorted(own - set().union(*[x for g, x in held.items() if g != f])) for f, own in held.items() if f != UNKNOWN}
    table = F.create_map(*[x for f, own in only.items() for x in (F.lit(f), F.array(*[F.lit(p) for p in own]))])
    return F.coalesce(F.arrays_overlap(pairs(parts), F.element_at(table, family)), F.lit(False))


def _pairs_of(template: str) -> list[str]:
    """`pairs` of the words of a template, which are plain letters and digits."""
    parts = [w for w in re.split(r"[^a-z0-9]+", template.lower()) if w]
    return [f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)]


class LicenseModel:
    """Multinomial logistic regression on hashed words and pairs, with the probability from which a family is believed."""

    def __init__(self, stages: PipelineModel, families: list[str], believed: float):
        self.stages, self.families, self.believed = stages, families, believed

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (with text) and family, probability: none, unknown or a family."""
        parts = rows.withColumn("__parts", words(F.col("text")))
        scored = self.stages.transform(parts.withColumn("grams", grams(F.col("__parts"))))
        found = F.array_max(F.transform(vector_to_array("probability"), lambda p, i: F.struct(p.alias("p"), i.alias("i"))))
        names = F.array(*[F.lit(x) for x in self.families])
        out = scored.withColumn("__best", found).drop("__parts", "grams", "features", "rawPrediction", "probability", "prediction")
        family = F.element_at(names, F.col("__best.i") + 1)
        sure = F.col("__best.p") >= self.believed
        return out.select(
            *rows.columns,
            F.when(family == NONE, family).when(sure, family).otherwise(F.lit(UNKNOWN)).alias("family"),
            F.col("__best.p").alias("probability"),
        )


def train(spark: SparkSession, docs: DataFrame, max_none_rows: int = MAX_NONE_ROWS, none_docs: int = NONE_DOCS) -> LicenseModel:
    """Fits on windows of templates and prose and on max_none_rows paragraphs of about none_docs documents; calibrates on whole templates held back.

    A first model, of the other templates, tells the probability from which a family is believed; the one that is returned is fitted on all.

    Paragraphs of which templates hold half of the word pairs are no examples of none.
    """
    labelled = examples(spark)
    n = max(1, docs.count())
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) < none_docs)
    lines = paragraphs(some).where(F.trim("text") != "").select("text").distinct().withColumn("parts", words(F.col("text")))
    held = F.array_distinct(F.concat(*[pairs(words(F.lit(t))) for texts in TEMPLATES.values() for t in texts]))
    own = F.array_distinct(pairs(F.col("parts")))
    known = F.size(F.array_intersect(own, held)) / F.greatest(F.size(own), F.lit(1))
    plain = (
        lines.where(known < MIN_TEMPLATE_SHARE)
        .select(F.xxhash64("text").alias("h"), "text")
        .orderBy("h", "text")
        .limit(max_none_rows)
        .select(F.lit(NONE).alias("family"), "text", F.lit(0).alias("part"))
    )
    families = [NONE, *TEMPLATES]
    number = F.array_position(F.array(*[F.lit(x) for x in families]), F.col("family")) - 1
    rows = labelled.unionByName(plain).withColumn("parts", words(F.col("text")))
    rows = rows.select("text", "part", number.cast("double").alias("label"), grams(F.col("parts")).alias("grams"))
    rows = rows.coalesce(1).persist()
    try:
        pipeline = Pipeline(
            stages=[
                HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True),
                LogisticRegression(family="multinomial", regParam=1e-4, maxIter=30, standardization=False),
            ]
        )
        # The class number is fixed by the training rows: the model has max(label) + 1 classes.
        held = pipeline.fit(rows.where("part = 0")).transform(rows.where("part = 1"))
        right = F.get(vector_to_array("probability"), F.col("label").cast("int"))
        low = held.agg(F.percentile(right, MISSED_SHARE)).first()[0]
        stages = pipeline.fit(rows)
    finally:
        rows.unpersist()
    return LicenseModel(stages, families, min(0.9, max(0.3, low if low is not None else 0.5)))


def scan(spark: SparkSession, docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_paragraphs, families, n_licensed, n_unknown, probability, license.

    Every line of every text that is not blank is a paragraph, and every paragraph is classified. A predicted family is confirmed
    when its templates hold at least MIN_TEMPLATE_SHARE of the paragraph's word pairs, or the paragraph of one template's, and one of these pairs stands in
    no other family's templates; one that isn't counts as unknown. Of equal probabilities the alphabetically last family leads. families: confirmed ones in alphabetical order; license: the one of the likeliest paragraph, or
    unknown, or none; probability: of that paragraph, null for none. Null and empty texts have no paragraphs; very long ones
    are classified line by line like others. Rows equal in doc_id and text are one document and get the same result each; an empty
    table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = model or train(spark, docs)
    seen = model.predict(paragraphs(docs).where(F.trim("text") != "")).where(F.col("family") != NONE)
    parts = words(F.col("text"))
    confirmed = (F.col("family") != UNKNOWN) & (template_share(parts, F.col("family")) >= MIN_TEMPLATE_SHARE) & distinctive(parts, F.col("family"))
    judged = seen.withColumn("family", F.when(confirmed, F.col("family")).otherwise(F.lit(UNKNOWN)))
    sure = F.col("family") != UNKNOWN
    found = (
        judged.groupBy("row_key", "line_no")
        .agg(F.first("family").alias("family"), F.first("probability").alias("probability"))
        .groupBy("row_key")
        .agg(
            F.array_sort(F.collect_set(F.when(sure, F.col("family")))).alias("families"),
            F.sum(F.when(sure, 1).otherwise(0)).alias("n_licensed"),
            F.sum(F.when(sure, 0).otherwise(1)).alias("n_unknown"),
            F.max(F.struct(sure.alias("sure"), "probability", "family")).alias("best"),
        )
    )
    count = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    every = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce(count, F.lit(0)).cast("long").alias("n_paragraphs"))
    return every.join(found, "row_key", "left").select(
        "doc_id",
        "n_paragraphs",
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("n_licensed", F.lit(0)).cast("long").alias("n_licensed"),
        F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
        F.round("best.probability", 4).alias("probability"),
        F.coalesce("best.family", F.lit(NONE)).alias("license"),
    )


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
