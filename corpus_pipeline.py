"""The corpus pipeline: five stages over documents, each written and read again by the next.

Language ID drops texts without a language; line dedup removes lines that repeat earlier ones and
texts that consist of nothing else; near-dedup leaves one document of each group; decontamination
drops documents that hold benchmark passages; packing places what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parapet.llm.common import keep, table
from parapet.llm.decontaminate import drop_contaminated
from parapet.llm.language import keep_identified
from parapet.llm.line_dedup import drop_repeated_lines
from parapet.llm.minhash import drop_near_duplicates
from parapet.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: The learnt and hashed stages cannot be written in SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
