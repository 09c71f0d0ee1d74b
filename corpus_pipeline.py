"""A training corpus from raw documents, in five stages; each works on all that the one before kept.

Language identification and the quality classifier drop what they reject, of each
near-duplicate class one document stays (the least doc_id), documents that hold a
benchmark item go, and the rest is packed into sequences.

Defined results, stage by stage: a document whose text is null or has no letter is
of no language and goes with the first stage; every other row is judged by its
text alone, whatever its other columns hold.  Of equal and near-equal rows one
stays: the one with the least doc_id (null last; then by a hash of the row), so
rows that share a doc_id but not their texts are all kept.  Very long texts are
judged and packed whole, texts beyond a sequence in pieces.  An empty table gives
an empty result, and further columns go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import decontaminate, langid, neardup, packing, quality
from netloom.llm.common import written
from netloom.llm.queries import table, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.kept(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", judge_quality),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("best_fit_packing", pack),
]

#: The classifiers and the packing are no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again, so a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
