"""The corpus pipeline: each stage applies one training-data operator to what the one before kept.

Each stage takes the columns of ``documents``, and others beside them, in any order, and all but the last
hand them on as they are. Nulls, empty texts: a null text counts as empty (it stays null until it is
packed), is no one's near copy, and of several null or empty texts one row stays; rows with a null id
take part, are never a reason to drop another, and are told apart by their texts. Ties: of equal texts
the largest id stays, of near copies the smallest. Repeated rows: of an id that stays under one text all
rows stay (they are one document that is there several times). Very long texts are read whole. Empty
tables: no stage has rows; without labels of both kinds nothing is toxic. Columns whose names clash with
those that stages work with keep their values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common, exactdedup, minhash, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; trained on the labelled ones among ``docs``."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exactdedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return minhash.deduplicate(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by ``[KIND]`` and ``n_chars`` counted anew."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 words."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact_pii),
    ("packing", pack),
]

#: The toxicity model is trained, so no SQL gives the rows; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
