"""The corpus pipeline: quality, language, near duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from probanza.llm import language_id, mixing, near_duplicates, packing, quality
from probanza.llm.queries import END_ID
from probanza.llm.texts import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds of their language and source."""
    return quality.judged(docs).filter("kept").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: ``und`` and texts without any known n-gram go."""
    return language_id.identify(docs, language_id.learn(docs)).filter("lang_pred <> 'und' AND score > 0").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word Jaccard of 0.8 or more, directly or through others."""
    return near_duplicates.one_per_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture of their sources."""
    return mixing.in_order(mixing.mixed(docs)).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of all documents as pieces of sequences."""
    return packing.packing_report(packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Language identification is a trained model, which SQL does not express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
