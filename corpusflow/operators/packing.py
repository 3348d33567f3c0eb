"""Concatenate-and-cut packing: bos ... eos of all documents in order, cut every `size` tokens, the tail dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.operators.select import starts_of
from corpusflow.session import cut


def offsets(docs: DataFrame, length: Column, order: str = "ord") -> DataFrame:
    """(ord, length, offset): where each document starts in the stream.

    Two-level prefix sum: range partitions are summed, the partition sums (one number each) are added up on the
    driver, and windows run within a partition. A partition is cut further at 2^18 rows of its order.
    """
    placed = docs.select(order, length.cast("long").alias("length")).repartitionByRange(F.col(order)).sortWithinPartitions(order)
    placed = placed.withColumn("_p", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_p", F.shiftright("_p", 18)))
    starts = starts_of(placed, F.sum("length"), "long")
    before = F.coalesce(F.sum("length").over(W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = placed.withColumn("_before", before).join(starts, "_p")  # a row for each 2^18 documents
    return met.select(order, "length", (F.col("_start") + F.col("_before")).alias("offset"))


def pack(docs: DataFrame, tokens: str, size: int, bos: int = 1, eos: int = 2, order: str = "ord") -> DataFrame:
    """(seq_id, tokens) of exactly `size` tokens each.

    A document is cut into its share of each sequence before it is shuffled: a row for each piece, not for each token.
    """
    if size < 2:
        raise ValueError("sequences need two tokens at least")
    rows = cut(docs.select(order, F.concat(F.array(F.lit(bos)), F.col(tokens), F.array(F.lit(eos))).alias("_ids")))  # tokens are told once
    at = offsets(rows, F.size("_ids"), order)
    met = rows.join(at, order)
    first, last = F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.col("length") - 1) / size)
    parts = met.select("_ids", "offset", F.explode(F.sequence(first, last)).alias("seq_id"))
    begin = F.greatest(F.col("seq_id") * size - F.col("offset"), F.lit(0))
    end = F.least((F.col("seq_id") + 1) * size - F.col("offset"), F.size("_ids"))
    pieces = parts.select("seq_id", (F.col("offset") + begin).alias("_at"), F.slice("_ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("_part"))
    whole = pieces.groupBy("seq_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda x: x["_part"])).alias("tokens"))
    return whole.where(F.size("tokens") == size)


def token_width(vocab_size: int) -> str:
    return "uint16" if vocab_size <= 65_535 else "uint32"


def manifest(packed: DataFrame, size: int, vocab_size: int) -> DataFrame:
    return packed.agg(F.count("*").alias("n_sequences")).select(
        F.lit(size).alias("seq_len"), "n_sequences", (F.col("n_sequences") * size).alias("n_tokens"), F.lit(vocab_size).alias("vocab_size"), F.lit(token_width(vocab_size)).alias("dtype"))
