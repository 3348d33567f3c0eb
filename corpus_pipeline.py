"""A training-data pipeline: language, recurring lines, near copies, benchmark passages, packing.

Every stage works on all rows its predecessor kept and, but for the last, returns the columns of its input, whatever
their names. A stage's rows are written to the shared folder and read again; the folder of the stage before it goes then.

Edge cases, stage by stage in what follows: a null text is rejected as having no language; an empty or very long text,
equal rows, rows that share an id and null ids pass through every stage as rows of their own, and of equal or nearly
equal ones the near-dup stage keeps one; ties always go to the smaller id; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import decontaminate, langid, lines, neardup, packing
from corpusflow.session import shared_dir, table
from corpusflow.sources.files import delete

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text or a letter, or whose language the network cannot tell, go."""
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line templates that recur across documents are cut after their first occurrence; a document of nothing else goes."""
    return lines.keep_with_text(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles) stays: that with the smallest id, of equal ids any one."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents with passages of two items, or mostly made of them, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]

#: The first stage is a trained network and the last a heuristic packing: SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's rows are written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
