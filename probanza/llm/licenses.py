"""License scans: a trained paragraph classifier, with a calibrated unknown class and template comparison.

**Training.** Positive rows are the notices of ``TEMPLATES``, each whole, without its first or
last words, and amid words of other texts. Negative rows are paragraphs of a bounded sample of
documents (about ``SAMPLE_DOCS``, by hash) that hold less than ``STRANGE`` of any notice. Words
and word pairs are counted into a vocabulary of fixed size, and a multinomial logistic regression
with an L1 share learns sparse weights for every licence family and for "none".

**Unknown.** On a fold of rows kept from training, the lowest probability is sought from which on
predicted families are right often enough, and in the same way the lowest probability of any licence
(one less that of "none"). A paragraph that reaches the second but not the first is reported as
family ``unknown``, with its likeliest family's probability and template share, never confirmed.

**Confirmation.** A predicted paragraph is compared with the notices of its family: the largest
share of a notice's distinct words that it holds. From ``CONFIRMED`` on the prediction is
confirmed; others are reported as not confirmed.

A paragraph is a line with a word, numbered from 0 among all lines of the whole text. Null and
empty texts have none. Repeated rows and null ids are scanned like others; other columns are not
read; an empty table gives no rows. Only DataFrame functions and spark.ml are used.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probanza.llm.texts import stored

#: Wordings of public licence notices by family.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
NONE = "none"
UNKNOWN = "unknown"
SAMPLE_DOCS = 400
#: Most negative paragraphs; those with the smallest hashes are taken.
SAMPLE_PARAGRAPHS = 2000
VOCABULARY = 1 << 13
STRANGE = 0.6
CONFIRMED = 0.7
PRECISION = 0.995

_WORDS = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORDS), F.lit(0))


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of fixed rows."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def templates(spark: SparkSession) -> DataFrame:
    """family and the distinct words of each notice."""
    rows = [{"family": f, "notice": t} for f, texts in TEMPLATES.items() for t in texts]
    return _literal(spark, rows, "family:string,notice:string").select("family", "notice", F.array_distinct(_words(F.col("notice"))).alias("own"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, words of every line with a word."""
    lines = F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("paragraph", "line")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines)
    return found.withColumn("words", _words(F.col("line"))).filter(F.size("words") > 0).select("doc_id", "paragraph", "words")


def training_rows(docs: DataFrame) -> DataFrame:
    """words, label (family or none) and fold of all positive and sampled negative paragraphs."""
    spark = docs.sparkSession
    total = docs.count()
    chance = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = paragraphs(docs.filter(chance * max(1, total) < SAMPLE_DOCS))
    known = templates(spark).select(F.collect_list("own").alias("all"))
    near = F.exists("all", lambda own: F.size(F.array_intersect(own, F.col("words"))) / F.size(own) >= STRANGE)
    negative = sample.join(F.broadcast(known), F.lit(True)).filter(~near).select("words").distinct().orderBy(F.xxhash64("words")).limit(SAMPLE_PARAGRAPHS)
    negative = negative.select("words", F.lit(NONE).alias("label"))
    notices = templates(spark).select("family", _words(F.col("notice")).alias("words"))
    size = F.size("words")
    cut = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(3) for b in range(3)])).alias("c")
    shorter = notices.select("family", "words", cut).withColumn("left", size - F.col("c.a") - F.col("c.b"))
    shorter = shorter.filter((F.col("left") >= 3) & (F.col("left") >= 0.6 * size))
    shorter = shorter.select("family", F.slice("words", F.col("c.a") + 1, F.col("left")).alias("words"))
    around = negative.filter(F.size("words") >= 6).orderBy(F.xxhash64(F.lit(2), "words")).limit(12)
    around = around.select(F.slice("words", 1, 3).alias("before"), F.slice("words", 4, 8).alias("after"))
    amid = notices.join(F.broadcast(around), F.lit(True)).select(
        "family", F.explode(F.array(F.concat("before", "words", "after"), F.concat("words", "after"), F.concat("before", "words"))).alias("words")
    )
    positive = shorter.unionByName(amid).select("words", F.col("family").alias("label"))
    return positive.unionByName(negative).withColumn("fold", F.pmod(F.xxhash64("words"), F.lit(4)) == 0)


class Classifier:
    """The fitted pipeline, its labels, and the lowest probabilities of a known family and of any licence."""

    def __init__(self, model: PipelineModel, labels: list[str], least: float, any_least: float):
        self.model, self.labels, self.least, self.any_least = model, labels, least, any_least

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with words) with the most probable licence family, its probability, and that of any licence."""
        chances = vector_to_array("probability")
        scored = self.model.transform(rows).withColumn("chances", chances)
        best = F.array_max(F.arrays_zip(F.slice("chances", 2, len(self.labels) - 1).alias("p"), F.lit(self.labels[1:]).alias("f")))
        return scored.withColumn("best", best).select(
            *rows.columns, F.col("best.f").alias("family"), F.col("best.p").alias("probability"),
            (1 - F.get("chances", F.lit(0))).alias("any_probability"),
        )


def _lowest(chances: list[tuple[float, bool]], low: float, high: float) -> float | None:
    """The lowest probability from which on enough predictions are right, within bounds; None if there is none."""
    least, right = None, 0
    for total, (chance, good) in enumerate(sorted(chances, reverse=True), start=1):
        right += good
        if right / total >= PRECISION:
            least = min(max(chance, low), high)
    return least


def train(docs: DataFrame) -> Classifier:
    """Fit the classifier on all folds but one and calibrate it on that one."""
    labels = [NONE, *TEMPLATES]
    number = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(labels) for x in (n, float(k))]), F.col("label"))
    rows = training_rows(docs.select("doc_id", "text")).withColumn("y", number)
    rows = stored(rows, "licence-training")
    stages = [
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
        CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, binary=True),
        LogisticRegression(
            featuresCol="features", labelCol="y", family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=40, standardization=False,
        ),
    ]
    model = Classifier(Pipeline(stages=stages).fit(rows.filter("NOT fold").coalesce(4)), labels, 0.5, 0.5)
    held = model.probabilities(rows.filter("fold").select("words", "label")).drop("words").collect()  # a bounded sample
    model.least = _lowest([(r["probability"], r["label"] == r["family"]) for r in held], 0.2, 0.9) or model.least
    model.any_least = _lowest([(r["any_probability"], r["label"] != NONE) for r in held], 0.5, 0.9) or model.any_least
    return model


def scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """doc_id, paragraph, family, probability, template_share, confirmed of every paragraph of a known family or ``unknown``."""
    model = model or train(docs)
    found = model.probabilities(paragraphs(docs.select("doc_id", "text")))
    known = F.col("probability") >= model.least
    found = found.filter(known | (F.col("any_probability") >= model.any_least))
    own = F.broadcast(templates(docs.sparkSession).groupBy(F.col("family").alias("f")).agg(F.collect_list("own").alias("notices")))
    share = F.array_max(F.transform("notices", lambda n: F.size(F.array_intersect(n, F.col("words"))) / F.size(n)))
    found = found.join(own, F.col("family") == F.col("f")).withColumn("template_share", share)
    return found.select(
        "doc_id", "paragraph", F.when(known, F.col("family")).otherwise(UNKNOWN).alias("family"), "probability", "template_share",
        (known & (F.col("template_share") >= CONFIRMED)).alias("confirmed"),
    )
