"""The corpus pipeline: quality classifier, quality rules, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paneloom.llm.classifier import HELD_OUT, keep_by_classifier
from paneloom.llm.common import staged, table
from paneloom.llm.near_copies import keep_one_of_each
from paneloom.llm.packing import pack_documents
from paneloom.llm.quality_rules import keep_by_rules


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    return keep_by_classifier(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and the risk-controlled rules, whose holdout is the fold that the classifier hasn't
    learned from."""
    return keep_by_rules(docs, table(spark, sf_dir, "labels").where(HELD_OUT))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: similarity of 0.8 or more on shingles of five words."""
    return keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("classifier", classify), ("rules", rules), ("near_dedup", near_dedup), ("packing", packing)]

#: Trained trees, exact bounds found on labels and packing cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's table is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
