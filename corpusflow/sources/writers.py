"""Writers: JSON lines, text, splits, nested export, manifests, shards, reports."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from corpusflow.operators.packing import manifest, token_width
from corpusflow.operators.select import drop_transient, split_by_id


def file_name(name: str) -> str:
    if not re.match(r"^[\w\-. ]+$", name):
        raise ValueError(f"not a plain file name: {name}")
    return name


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def text(df: DataFrame, path: str) -> None:
    """Texts with a blank line between, empty ones skipped."""
    df.where("trim(text) <> ''").select("text").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def splits(df: DataFrame, path: str) -> None:
    """A folder for each split, columns that begin with _ left out."""
    drop_transient(df).write.mode("overwrite").partitionBy("split").json(path)


def nested_export(df: DataFrame, min_quality: float = 0.0) -> DataFrame:
    """Rows with a text and enough quality, split 80/10/10 by id, with nested meta."""
    kept = df.where((F.coalesce("text", F.lit("")) != "") & (F.coalesce("quality_score", F.lit(0.0)) >= min_quality))
    topics = F.col("topics") if "topics" in df.columns else F.array().cast("array<string>")
    url = F.col("url") if "url" in df.columns else F.lit(None).cast("string")
    return split_by_id(kept).select("id", "text", F.struct("source", url.alias("url"), topics.alias("topics"), "quality_score").alias("meta"), "split")


def grouped(df: DataFrame, path: str, key: str = "work_id", folders: int | None = 256) -> None:
    """A line for each group, the key in it, in order in folders by the key's hash; None: a folder for each group.

    A folder for each group costs some ms to write and to list again, so it is for corpora of few works.
    """
    if folders is None:
        df.write.mode("overwrite").partitionBy(key).json(path)
    else:
        dealt = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(folders)))
        dealt.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").json(path)


def readme(stats: DataFrame) -> str:
    """A table of the sources (one row each)."""
    rows = stats.orderBy(F.desc("n"), "source").collect()
    return "\n".join(["| source | records |", "|-|-|", *[f"| {r.source} | {r.n} |" for r in rows]])


def binary_shard(packed: DataFrame, path: str, size: int, vocab_size: int) -> None:
    """Little-endian sequences as binary columns by partition, u16 where the vocabulary allows, and a manifest.

    Rows of another length raise.
    """
    kind = token_width(vocab_size)

    @F.arrow_udf(BinaryType())
    def raw(a: pa.Array) -> pa.Array:
        if not pc.all(pc.equal(pc.list_value_length(a), size), min_count=0).as_py():
            raise ValueError("a sequence has another length")
        ids = a.flatten().to_numpy(zero_copy_only=False).astype(np.dtype(kind).newbyteorder("<")).reshape(-1, size)
        return pa.array([x.tobytes() for x in ids], pa.binary())

    packed.select("seq_id", raw("tokens").alias("raw")).write.mode("overwrite").parquet(f"{path}/sequences")
    manifest(packed, size, vocab_size).write.mode("overwrite").json(f"{path}/manifest")


def read_binary_shard(spark, path: str) -> DataFrame:
    m = spark.read.json(f"{path}/manifest").first()

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(a: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b, np.dtype(m["dtype"]).newbyteorder("<")).astype(np.int32) for b in a.to_pylist()], pa.list_(pa.int32()))

    return spark.read.parquet(f"{path}/sequences").select("seq_id", ids("raw").alias("tokens"))


def one_row(df: DataFrame, path: str) -> None:
    """A report, datasheet or statistics row."""
    df.coalesce(1).write.mode("overwrite").json(path)
