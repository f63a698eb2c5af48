"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Quality rules, near-deduplication by five-word similarity, benchmark decontamination, mixing of sources and token
ids. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from episodica.llm import decontaminate, mixing, near_copies, quality, token_ids
from episodica.llm.shared import fresh_path, remove, scratch, written
from episodica.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    return quality.filter_documents(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near copies, that with the smallest id."""
    return near_copies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per epoch of the mix, cut where the mix ends inside them."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in the token-id files."""
    return token_ids.token_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-deduplication", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token ids", token_output),
]

#: The tokenizer is not in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one.

    A stage's intermediate tables are deleted once its output is written, and its input with them.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES[:-1]):
        path = fresh_path(spark, f"stage-{n}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{n}", path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
