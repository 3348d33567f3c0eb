"""Whole plans: curation, the weighted unified corpus, and preparation for training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import dedup, filters, neardup, packing, select, tokenizer
from corpusflow.session import cut


@dataclass(frozen=True)
class Curation:
    near: bool = True
    similarity: float = 0.85
    mode: str = "fast"
    script: tuple[int, int] = T.TAMIL
    min_fraction: float = 0.7
    skip_pii: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.similarity <= 1 or not 0 <= self.min_fraction <= 1 or self.mode not in ("fast", "md5"):
            raise ValueError("settings out of range")


def curate(records: DataFrame, c: Curation) -> tuple[DataFrame, DataFrame]:
    """Dedup, then quality, language and scrubbing; the kept records, and counts at each stage."""
    if c.near:
        flags = cut(neardup.near_dedup(records, c.similarity, mode=c.mode))
        unique = records.join(flags.where("dup_of is null").select("ord"), "ord", "left_semi")
    else:
        unique = dedup.exact(records)
    # one stored copy; its stage is told once and serves the report and the result
    left = F.when(filters.quality_reason().isNotNull(), 0).when(T.script_fraction(F.coalesce("text", F.lit("")), c.script) < c.min_fraction, 1).otherwise(2)
    flagged = cut(unique.withColumn("_left", left))
    kept = flagged.where("_left = 2").drop("_left")
    final = kept if c.skip_pii else filters.scrub_pii(kept)
    seen = records.agg(F.count("*").alias("n")).select(F.lit("ingested").alias("stage"), "n")
    at = flagged.agg(F.count("*").alias("deduplicated"), F.count_if(F.col("_left") > 0).alias("quality"), F.count_if(F.col("_left") > 1).alias("language"))
    report = seen.unionByName(at.unpivot([], ["deduplicated", "quality", "language"], "stage", "n"))
    return final, report


def unify(modern: list[DataFrame], existing: DataFrame, weights: dict[str, float], max_count: int | None = None) -> DataFrame:
    """Modern sources deduplicated, the existing corpus added, weighted, deduplicated again, and the best kept."""
    from corpusflow.sources.readers import union_in_order

    first = dedup.by_prefix(union_in_order(modern), 256)
    everything = union_in_order([first, existing])
    weighted = select.source_weights(everything, weights)
    return select.select_top(dedup.by_prefix(weighted, 256), max_count)


def export(unified: DataFrame, n: int, strategy: str = "modern", modern_ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """Weighted, stratified, deduplicated and split."""
    picked = select.stratified(select.export_weights(unified, strategy), n, modern_ratio)
    unique = dedup.by_prefix(picked, 256, drop_empty=False)
    key = F.coalesce("id", F.substring("text", 1, 50)) if "id" in unique.columns else F.substring("text", 1, 50)
    return select.split(unique.withColumn("_key", key), seed, key="_key")


def prepare(docs: DataFrame, vocab_size: int, seq_len: int, val_fraction: float = 0.01, script: str = "tamil", min_freq: int = 2) -> dict:
    """Head split, tokenizer trained on the training rows, fertility on the others, both packed; and a datasheet row."""
    parts = cut(select.head_split(docs, val_fraction))
    train_docs, val_docs = parts.where("split = 'train'"), parts.where("split = 'val'")
    tok = tokenizer.train(train_docs, vocab_size, min_freq, script)
    packed = {}
    for name, part in (("train", train_docs), ("val", val_docs)):
        ids = part.select("ord", tokenizer.encode(F.col("text"), tok).alias("ids"))
        packed[name] = packing.pack(cut(ids), "ids", seq_len, tok.vocab["<bos>"], tok.vocab["<eos>"])
    sheet = docs.sparkSession.createDataFrame([(len(tok.vocab), len(tok.merges), seq_len, tokenizer.fertility(val_docs, tok))], "vocab_size int, merges int, seq_len int, fertility double")
    return {"tokenizer": tok, "datasheet": sheet, **packed}
