"""Corpus preparation in five stages, each a function (spark, docs, sf_dir) -> DataFrame.

``run`` writes every stage's result to the folder that all executors share and reads it again as the next one's input,
so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import neardup, packing, pii, quality, toxicity
from terrafold.llm.common import drop, lasting, table, temporary

#: No SQL: the toxicity verdicts come from a fitted machine. The tests hold the other stages against brute force.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine, fitted on the labelled documents of the input, scores under 0.5."""
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the ordered rule cascade, which has no rule on length: a short document may be clean."""
    return quality.keep(docs, quality.CLEANING)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return neardup.keep(docs, size=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by their kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in bins of the permitted lengths."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents and return what the last one gives; what lies between is deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary(spark):
            docs, path = lasting(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            drop(spark, last)
        last = path
    return docs
