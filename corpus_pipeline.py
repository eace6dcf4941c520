"""From raw documents to a mixed training corpus, in five stages.

Every stage takes (spark, docs, sf_dir) and gives the documents that go on, with
the columns of ``documents``; the last gives the mix, with a further column
``copy``. Null and empty texts go through like any other; a stage that gets no
documents gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stocktake.llm.common import materialise, table
from stocktake.llm.decontamination import drop_leaks
from stocktake.llm.jaccard_join import keep_one_of_each
from stocktake.llm.mixing import mixed_documents
from stocktake.llm.pii import redact
from stocktake.llm.quality_classifier import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until each source has its share."""
    return mixed_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("mixing", mixture),
]

#: The classifier and the search for personal data have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
