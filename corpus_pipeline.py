"""From documents to packed training sequences: language, near duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.llm import decontam, langid, packing, pii, simhash
from attestry.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the smallest doc_id
    of each component stays; rows without doc_id stay, and so do repeated rows of one doc_id.

    The ids that go grow with the corpus, so they are never broadcast: the plan is a merge join at every size.
    """
    found = simhash.similar_documents(docs)
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two items go, passages of a single item are cut out, however short the rest is."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"), most=2.0)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its personal data replaced."""
    return pii.without_personal_data(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing_stage),
]

#: Two stages are learned models and one is a tokenizer; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over all documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
