"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

STAGES lists (name, function) pairs; a function takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last give the columns of docs, whatever their names.

Odd inputs are the same for every stage: nulls in any column and further columns pass through; rows with null or equal
doc_id are documents of their own; an empty table gives an empty one. What null, empty and very long texts, ties and
repeated rows give is said with each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm import _docs, near_duplicates, packing, quality_model, quality_rules, substrings
from kinspan.llm.queries import WORD_BPE


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents, keeps.

    Texts that are null or have no word go. Long ones are read whole. Equal texts get equal scores: all stay, or none.
    """
    return quality_model.keep(docs)


def quality_rule_cascade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects.

    Texts that are null, empty or of under 20 words go. Long ones are read whole. Equal texts are judged alike.
    """
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least doc_id, null before all; of ties by a hash of the text.

    Of wholly equal rows one stays. Texts that are null or have no word are classes of their own and stay.
    """
    return near_duplicates.keep(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that start earlier elsewhere.

    A text may be left empty, but no row goes; null texts stay null. Rows of equal doc_id come in the order of a hash of
    their texts; of wholly equal rows all but one lose every window.
    """
    return substrings.cut(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, as the packing query gives them.

    A null or empty text is its closing id alone; long ones are cut into several pieces. Repeated rows are packed each.
    """
    pieces = packing.pack(docs, WORD_BPE)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rule_cascade),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: No SQL can express the classifier, sampling and tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. A stage's table lies in the session's shared folder until the next one is written."""
    folder = f"{_docs.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = _docs.read(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _docs.delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
