"""Structured Streaming: the same filters on streams, dedup within a watermark, windows over events.

Beyond what a batch curation needs, but the stateless operators run on a stream without change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import filters, neardup
from corpusflow.session import cut
from corpusflow.sources.files import exists, is_folder


def curated_stream(records: DataFrame, min_fraction: float = 0.0, script: tuple[int, int] = T.TAMIL) -> DataFrame:
    """Quality, language and scrubbing on a stream of records."""
    return filters.apply_all(records, script, min_fraction)


def timed(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event times as timestamps of the session's zone, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def exact_dedup_stream(records: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first of equal texts within the watermark; state is dropped behind it."""
    keyed = records.withColumn("_k", T.content_hash(F.coalesce("text", F.lit(""))))
    return timed(keyed, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def near_dedup_stream(records: DataFrame, store: str, least: float = 0.85, perms: int = 128, mode: str = "fast"):
    """A writer of a stream of (ord, text, ...): each batch is compared with all rows kept so far, in order of ord within it.

    Signatures and rows that are kept go to `<store>/signatures` and `<store>/kept`, a folder for each batch, so that a
    batch that runs again replaces its own. Call start() on what is returned.
    """
    spark = records.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        rows = cut(batch)
        if rows.isEmpty():
            return
        new = cut(rows.select("ord", neardup.signature(F.coalesce("text", F.lit("")), perms, mode=mode).alias("sig")))
        old = spark.read.schema("ord long, sig array<bigint>, batch long").parquet(f"{store}/signatures") if exists(spark, f"{store}/signatures/*") else None
        if old is not None:
            old = old.where(F.col("batch") < number).select("ord", "sig")
            # every kept row comes before the batch; what is close to one goes whatever its order value
            met = neardup.pairs_between(old, new, perms, least).select(F.col("b").alias("ord")).distinct()
            new = cut(new.join(met, "ord", "left_anti"))
        kept = cut(neardup.settled(new, perms, least).where("dup_of is null").select("ord"))
        new.join(kept, "ord", "left_semi").write.mode("overwrite").parquet(f"{store}/signatures/batch={number}")
        rows.join(kept, "ord", "left_semi").write.mode("overwrite").parquet(f"{store}/kept/batch={number}")

    return records.writeStream.foreachBatch(take)


def tumbling(events: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return timed(events).withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return timed(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def read_parquet_stream(spark: SparkSession, folder: str, schema, name: str) -> DataFrame:
    """A stream of the files of a folder that a name or pattern fits; a folder of that name gives its files."""
    reader = spark.readStream.schema(schema)
    if is_folder(spark, f"{folder}/{name}"):
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)
