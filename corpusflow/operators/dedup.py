"""Exact dedup by a key, first in order wins; keys are hashed, so windows sort short rows only.

A key that makes up a third of all rows would fill one window task, so survivors are found by an aggregate with
partial sums (the smallest order value of each key) and joined back; no window sees a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.session import cut


def first_wins(df: DataFrame, key: Column | list[Column], order: str = "ord") -> DataFrame:
    """Rows with the smallest order value of their key. The order column must be unique."""
    keys = key if isinstance(key, list) else [key]
    picked = df.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.col(order).alias("_o"))
    firsts = picked.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_o").alias("_first")).select("_first")
    return df.join(firsts, df[order] == firsts["_first"], "left_semi")


def exact(df: DataFrame, order: str = "ord") -> DataFrame:
    return first_wins(df, T.content_hash(F.coalesce("text", F.lit(""))), order)


def per_source(df: DataFrame, order: str = "ord") -> DataFrame:
    return first_wins(df, [F.coalesce("source", F.lit("unknown")), T.content_hash(F.coalesce("text", F.lit("")))], order)


def by_prefix(df: DataFrame, size: int, drop_empty: bool = True, order: str = "ord") -> DataFrame:
    key = T.prefix_key(F.coalesce("text", F.lit("")), size)
    return first_wins(df.where(key != "") if drop_empty else df, F.sha2(key, 256), order)


def by_norm_key(df: DataFrame, drop_empty: bool = True, script: tuple[int, int] = T.TAMIL, order: str = "ord") -> DataFrame:
    key = T.norm_key(F.coalesce("text", F.lit("")), script)
    return first_wins(df.where(key != "") if drop_empty else df, F.sha2(key, 256), order)


def by_id(df: DataFrame, column: str = "id", order: str = "ord") -> DataFrame:
    return first_wins(df, F.col(column), order)


def best_quality(df: DataFrame, order: str = "ord", default: float = 1.0) -> DataFrame:
    """The best row of each text (the earlier of equals), at the place where the text first stood (`first_ord`)."""
    rows = df.withColumn("_k", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("_q", F.coalesce("quality_score", F.lit(default)))
    best = rows.groupBy("_k").agg(F.expr(f"min_by({order}, struct(-_q, {order}))").alias("_best"), F.min(order).alias("first_ord")).drop("_k")
    return df.join(best, df[order] == best["_best"]).drop("_best")


def exact_flags(df: DataFrame, order: str = "ord") -> DataFrame:
    """(ord, source, dup_of): dup_of is the order value of the row that it copies, null for kept rows."""
    rows = cut(df.select(order, F.coalesce("source", F.lit("unknown")).alias("source"), T.content_hash(F.coalesce("text", F.lit(""))).alias("_k")))  # texts are read and hashed once
    firsts = rows.groupBy("_k").agg(F.min(order).alias("_first"))
    return rows.join(firsts, "_k").select(order, "source", F.when(F.col("_first") < F.col(order), F.col("_first")).alias("dup_of"))


def source_stats(flags: DataFrame) -> DataFrame:
    """seen, duplicates and kept of each source."""
    return flags.groupBy("source").agg(F.count("*").alias("seen"), F.count("dup_of").alias("duplicates"), F.count(F.when(F.col("dup_of").isNull(), 1)).alias("kept"))
