"""Weights, top-k, stratified and weighted selection, splits and batches. Ties always go to the smaller order value.

Python-style sorts of whole lists become ranks: where a global rank is needed, `ranked` numbers range partitions by
partition counts, so that no single task sorts or counts all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.session import cut

BALANCED = {"social": 1.0, "news": 1.0, "wikipedia": 1.0, "local": 1.0, "literature": 1.0, "modern_conversational": 1.0}
MODERN, CLASSICAL = ["news", "social", "modern_conversational"], ["wikipedia", "local", "literature"]


def source_weights(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """_weight: the source's (1 if not listed), times 1 + 0.1 modern_score where that is positive."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    base = F.coalesce(F.try_element_at(table, "source"), F.lit(1.0)) if table is not None else F.lit(1.0)
    score = F.coalesce(F.col("modern_score"), F.lit(0)) if "modern_score" in df.columns else F.lit(0)
    return df.withColumn("_weight", base * F.when(score > 0, 1 + 0.1 * score).otherwise(1.0))


def export_weights(df: DataFrame, strategy: str = "modern") -> DataFrame:
    quality = F.coalesce("quality_score", F.lit(0.5))
    factor = F.when(F.col("source").isin("social", "news", "modern_conversational"), 2.5).when(F.col("source") == "wikipedia", 1.5).otherwise(0.8)
    return df.withColumn("_weight", quality * factor if strategy == "modern" else quality)


def drop_transient(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """A gapless rank from 0 in the given order, without bringing all rows to one task.

    Rows are range-partitioned and sorted; partition sizes are summed on the driver (a number for each partition).
    """
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % F.lit(1 << 33)))
    return sorted_.join(starts_of(sorted_, F.count("*"), "long"), "_p").withColumn(name, (F.col("_i") + F.col("_start")).cast("long")).drop("_p", "_i", "_start")


def starts_of(rows: DataFrame, amount: Column, kind: str) -> DataFrame:
    """(_p, _start): what all partitions before _p amount to; a row for each partition, summed on the driver."""
    total, out = 0, []
    for p, n in sorted((r._p, r.n) for r in rows.groupBy("_p").agg(amount.alias("n")).collect()):
        out.append((p, float(total) if kind == "double" else total))
        total += n
    return rows.sparkSession.createDataFrame(out, f"_p {dict(rows.dtypes)['_p']}, _start {kind}")


def seeded(seed: int, key: str | Column) -> Column:
    """A hash of the seed and a key that other engines have too; its order is a shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def uniform(digest: Column) -> Column:
    """A number above 0 and below 1 from the first 13 hex digits of a hash."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def top(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """The first n rows in order, all if n is falsy; per-task tops are merged, nothing else is sorted."""
    return df.orderBy(*order).limit(n) if n else df


def best_and_longest(df: DataFrame, n: int | None = None) -> DataFrame:
    """By quality, then by length."""
    return top(df, n, F.coalesce("quality_score", F.lit(0.0)).desc(), F.length("text").desc(), F.col("ord").asc())


def select_top(df: DataFrame, n: int | None = None) -> DataFrame:
    quality = F.coalesce("quality_score", F.lit(0.5))
    weight = F.coalesce("_weight", F.lit(1.0))
    return top(df, n, (weight * quality).desc(), quality.desc(), F.col("ord").asc())


def stratified(df: DataFrame, n: int, modern_ratio: float = 0.7) -> DataFrame:
    """int(n r) of the modern sources and the rest of the classical ones, by weight, then source, then order.

    Sources outside both lists are dropped, and a pool that is short is not filled up.
    """
    n_modern = int(n * modern_ratio)
    parts = []
    for sources, quota in ((MODERN, n_modern), (CLASSICAL, n - n_modern)):
        place = F.coalesce(*[F.when(F.col("source") == s, i) for i, s in enumerate(sources)])
        pool = df.where(F.col("source").isin(*sources)).withColumn("_place", place)
        parts.append(pool.orderBy(F.col("_weight").desc(), "_place", "ord").limit(quota).drop("_place"))
    return parts[0].unionByName(parts[1])


def colloquial_quota(df: DataFrame, n: int, ratio: float) -> DataFrame:
    """Up to int(n ratio) colloquial rows, then others, then topped up with what is left, colloquial first."""
    by_quality = (F.coalesce("quality_score", F.lit(0.5)).desc(), F.col("ord").asc())
    casual, plain = df.where("is_colloquial"), df.where("not is_colloquial")
    first = casual.orderBy(*by_quality).limit(int(n * ratio)).withColumn("_pool", F.lit(0))
    have = first.count()
    second = plain.orderBy(*by_quality).limit(n - have).withColumn("_pool", F.lit(1))
    taken = first.unionByName(second)
    left = df.join(taken.select("ord"), "ord", "left_anti").withColumn("_pool", F.lit(2))
    short = n - have - second.count()
    more = left.orderBy(F.col("is_colloquial").desc(), *by_quality).limit(max(0, short))
    return taken.unionByName(more)


def weighted_sample(df: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """Everything if there are no more than target rows, else target independent draws with replacement, p ~ max(quality weight, 1e-9).

    Draw i falls on the row whose stretch of the running weight holds a seeded uniform number. Draws and rows meet in
    range partitions of the order, as one sorted stream in each.
    """
    if df.count() <= target:
        return df
    weight = F.greatest(F.coalesce("quality_score", F.lit(1.0)) * F.coalesce("weight", F.lit(1.0)), F.lit(1e-9))
    rows = cut(df.select("ord", weight.alias("_w")).repartitionByRange("ord").sortWithinPartitions("ord").withColumn("_p", F.spark_partition_id()))
    starts = cut(starts_of(rows, F.sum("_w"), "double"))
    total = rows.agg(F.sum("_w")).first()[0]
    # a row's stretch ends at _at; a draw lies in the partition that starts last before it
    ends = rows.join(starts, "_p").select("_p", "ord", (F.col("_start") + F.sum("_w").over(W.partitionBy("_p").orderBy("ord"))).alias("_at"))
    draws = df.sparkSession.range(target).select((uniform(seeded(seed, "id")) * F.lit(float(total))).alias("_at"))
    table = starts.orderBy("_p").collect()  # two numbers for each partition
    parts, edges = np.array([r._p for r in table]), np.array([r._start for r in table])

    @F.pandas_udf("int")
    def place(at: pd.Series) -> pd.Series:
        return pd.Series(parts[np.maximum(0, np.searchsorted(edges, at, "right") - 1)])

    both = ends.unionByName(draws.select(place("_at").alias("_p"), F.lit(None).cast("long").alias("ord"), "_at"))
    # going down, the row seen last is the first one that ends at or after a draw
    down = W.partitionBy("_p").orderBy(F.desc("_at"), F.col("ord").isNull()).rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("_row", F.last("ord", ignorenulls=True).over(down)).where("ord is null")
    times = met.groupBy(F.col("_row").alias("ord")).agg(F.count("*").cast("int").alias("_n"))
    return df.join(times, "ord").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def sample_without_replacement(df: DataFrame, n: int, weight: Column, seed: int = 42) -> DataFrame:
    """n rows, p ~ weight: the smallest -ln(u) / w, with u from a hash of the seed and the order value."""
    return df.orderBy(-F.log(uniform(seeded(seed, "ord"))) / F.greatest(weight, F.lit(1e-12)), "ord").limit(n)


def random_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded(seed, "ord"), "ord").limit(n)


def split(df: DataFrame, seed: int = 42, train: float = 0.8, validation: float = 0.1, key: str = "id") -> DataFrame:
    """split: the first int(train n) rows of a seeded hash order train, the next int(validation n) validate, the rest test."""
    n = df.count()
    placed = ranked(df, seeded(seed, key), F.col(key), name="_rank")
    a, b = int(n * train), int(n * train) + int(n * validation)
    return placed.withColumn("split", F.when(F.col("_rank") < a, "train").when(F.col("_rank") < b, "validation").otherwise("test")).drop("_rank")


def split_by_id(df: DataFrame, train: float = 0.8, validation: float = 0.1, key: str = "id") -> DataFrame:
    """The same cut on rows sorted by id."""
    n = df.count()
    a, b = int(n * train), int(n * train) + int(n * validation)
    return ranked(df, F.col(key), name="_rank").withColumn("split", F.when(F.col("_rank") < a, "train").when(F.col("_rank") < b, "validation").otherwise("test")).drop("_rank")


def head_split(df: DataFrame, fraction: float = 0.01) -> DataFrame:
    """The first max(1, int(n fraction)) rows validate."""
    n_val = max(1, int(df.count() * fraction))
    return ranked(df, F.col("ord"), name="_rank").withColumn("split", F.when(F.col("_rank") < n_val, "val").otherwise("train")).drop("_rank")


def batches(df: DataFrame, batch: int, seed: int = 0, epochs: int = 1, drop_last: bool = True, shuffle: bool = True, key: str = "seq_id") -> DataFrame:
    """epoch, batch_id and place of each sequence; each epoch has its own seeded order."""
    n = df.count()
    if batch < 1 or (drop_last and n < batch):
        raise ValueError("fewer sequences than one batch")
    out = None
    for epoch in range(epochs):
        order = (seeded(seed + epoch, key), F.col(key)) if shuffle else (F.col(key),)
        one = ranked(df, *order, name="_rank").withColumn("epoch", F.lit(epoch))
        one = one.where(F.col("_rank") < n - n % batch) if drop_last else one
        out = one if out is None else out.unionByName(one)
    return out.withColumn("batch_id", F.floor(F.col("_rank") / batch).cast("long")).withColumn("place", F.pmod("_rank", F.lit(batch)).cast("long")).drop("_rank")
