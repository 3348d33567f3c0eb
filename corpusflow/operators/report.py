"""Reports: source counts, histograms, corpus statistics, comparisons, manifests, windows over metrics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.functions import text as T


def source_distribution(df: DataFrame) -> DataFrame:
    """count and share (of 100) of each source; null is `unknown`. Few rows: one for each source."""
    counts = df.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("source", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))  # total: one row


def top_sources(df: DataFrame, n: int = 5) -> DataFrame:
    counts = df.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    return counts.orderBy(F.desc("n"), "first_ord").limit(n)


def quality_stats(df: DataFrame) -> DataFrame:
    q = F.col("quality_score")
    return df.agg(F.coalesce(F.avg(q), F.lit(0.0)).alias("avg_quality"), F.coalesce(F.min(q), F.lit(0.0)).alias("min_quality"), F.coalesce(F.max(q), F.lit(0.0)).alias("max_quality"))


def language_mix(df: DataFrame, script: tuple[int, int] = T.TAMIL) -> DataFrame:
    f = df.where("text <> ''").select(T.script_fraction(F.col("text"), script).alias("f"))
    return f.agg(F.coalesce(F.avg("f"), F.lit(0.0)).alias("avg_fraction"), F.coalesce(F.min("f"), F.lit(0.0)).alias("min_fraction"), F.coalesce(F.max("f"), F.lit(0.0)).alias("max_fraction"))


def histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """(bin, n) of equal-width bins between the least and the greatest value; one bin if they are equal."""
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width)))
    return v.join(F.broadcast(ends)).select(place.cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))  # ends: one row


def pii_check(df: DataFrame) -> DataFrame:
    """Records with each kind of personal data, with any, and their rate."""
    c = df.select(T.pii_counts(F.coalesce("text", F.lit(""))).alias("c")).select("c.*")
    n = lambda cond: F.count(F.when(cond, 1))
    some = (F.col("emails") > 0) | (F.col("phones") > 0) | (F.col("urls") > 0)
    got = c.agg(F.count("*").alias("checked"), n(F.col("emails") > 0).alias("with_email"), n(F.col("phones") > 0).alias("with_phone"), n(F.col("urls") > 0).alias("with_url"), n(some).alias("with_any"))
    return got.withColumn("rate", F.when(F.col("checked") > 0, F.col("with_any") / F.col("checked")).otherwise(0.0))


def corpus_report(df: DataFrame) -> DataFrame:
    """One pass: documents, sources, characters, average length and token estimate."""
    n = F.length(F.coalesce("text", F.lit("")))
    got = df.agg(F.count("*").alias("documents"), F.count_distinct(F.coalesce("source", F.lit("unknown"))).alias("sources"), F.coalesce(F.sum(n), F.lit(0)).alias("chars"))
    return got.select("documents", "sources", "chars", F.when(F.col("documents") > 0, F.col("chars") / F.col("documents")).otherwise(0.0).alias("avg_length"), T.token_estimate(F.col("chars")).cast("long").alias("tokens_estimated"))


def sample_check(df: DataFrame, samples: int = 20) -> DataFrame:
    """Mean and median length, colloquial share, and the first samples."""
    n = F.length("text")
    got = df.agg(F.avg(n).alias("mean"), F.median(n).alias("median"), F.avg(F.col("is_colloquial").cast("int")).alias("colloquial"))
    first = df.orderBy("ord").limit(samples).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("samples"))
    return got.join(F.broadcast(first))  # one row each


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts by source of two corpora, 0 where one lacks it, and the difference."""
    a = old.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n_old"))
    b = new.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n_new"))
    got = a.join(b, "source", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return got.select("source", zero("n_old").alias("n_old"), zero("n_new").alias("n_new"), (zero("n_new") - zero("n_old")).alias("delta"))


def split_shares(old: DataFrame, new: DataFrame, modern: list[str]) -> DataFrame:
    """For both corpora: rows, rows of modern sources and of others, and the modern share in percent, to one place."""
    out = None
    for name, df in (("old", old), ("new", new)):
        n, m = F.count("*"), F.count_if(F.coalesce(F.col("source").isin(modern), F.lit(False)))
        got = df.agg(n.alias("n"), m.alias("modern")).select(F.lit(name).alias("corpus"), "n", "modern", (F.col("n") - F.col("modern")).alias("classical"), F.when(F.col("n") > 0, F.round(100 * F.col("modern") / F.col("n"), 1)).otherwise(0.0).alias("modern_percent"))
        out = got if out is None else out.unionByName(got)
    return out


def quality_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Average quality by source in both corpora, 0 where one lacks the source, and the difference."""
    mean = lambda df, name: df.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.avg(F.coalesce("quality_score", F.lit(0.0))).alias(name))
    got = mean(old, "q_old").join(mean(new, "q_new"), "source", "full_outer")
    q = lambda c: F.coalesce(c, F.lit(0.0))
    return got.select("source", q("q_old").alias("q_old"), q("q_new").alias("q_new"), (q("q_new") - q("q_old")).alias("delta"))


def casual_share(df: DataFrame, signs: Column) -> DataFrame:
    """Rows, rows with signs of casual speech and their percentage to one place, average quality and fraction."""
    n, casual = F.count("*"), F.count_if(F.coalesce(signs, F.lit(False)))
    got = df.agg(n.alias("n"), casual.alias("casual"), F.avg(F.coalesce("quality_score", F.lit(0.0))).alias("avg_quality"), F.avg(F.coalesce("tamil_fraction", F.lit(0.0))).alias("avg_fraction"))
    return got.select("n", "casual", F.when(F.col("n") > 0, F.round(100 * F.col("casual") / F.col("n"), 1)).otherwise(0.0).alias("casual_percent"), "avg_quality", "avg_fraction")


def validate_all(df: DataFrame, script: tuple[int, int] = T.TAMIL) -> DataFrame:
    """One row: totals, sources, quality, language mix, length histogram and personal data, as structs."""
    one = lambda d, name: d.select(F.struct(*d.columns).alias(name))
    top = top_sources(df).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "first_ord", "source")))["source"].alias("sources"))  # five rows
    bins = histogram(df, F.length(F.coalesce("text", F.lit("")))).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "n")))).alias("lengths"))  # ten rows
    out = one(corpus_report(df), "totals")
    for part in (top, one(quality_stats(df), "quality"), one(language_mix(df, script), "language"), bins, one(pii_check(df), "pii")):
        out = out.join(F.broadcast(part))  # one row each
    return out


def boundary_agreement(df: DataFrame, stem: Callable[[str], str], cut: Callable[[str], list[str]]) -> DataFrame:
    """Share of words whose stem ends at a token boundary; stem and cut are the caller's, for a row of words each."""

    @F.pandas_udf("boolean")
    def agrees(words: pd.Series) -> pd.Series:
        def one(word: str) -> bool:
            ends, at = set(), 0
            for token in cut(word):
                at += len(token)
                ends.add(at)
            return len(stem(word)) in ends

        return words.map(one)

    return df.select(agrees("word").alias("a")).agg(F.count("*").alias("n"), F.avg(F.col("a").cast("int")).alias("agreement"))


def source_quality(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.sum(F.coalesce("quality_score", F.lit(0.5))).alias("quality_sum"))


def style_counts(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    return df.groupBy(T.style_class(F.coalesce("text", F.lit("")), old, new).alias("style")).agg(F.count("*").alias("n"))


def modern_metrics(df: DataFrame) -> DataFrame:
    score = F.coalesce("modern_score", F.lit(0))
    return df.agg(F.avg("quality_score").alias("avg_quality"), F.avg(score).alias("avg_modern"), F.avg((score > 0).cast("double")).alias("modern_share"))


def work_id(url: Column, source: Column) -> Column:
    """Letters and digits that begin the URL's stem, else the stem, else the source."""
    stem = F.regexp_extract(F.coalesce(url, F.lit("")), r"([^/]*?)(?:\.[^./]*)?$", 1)
    code = F.regexp_extract(stem, r"^[a-zA-Z]+\d+", 0)
    return F.when(code != "", code).when(stem != "", stem).otherwise(source)


def manifests(df: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """Groups with counts, distinct topics and texts joined in order. A group's texts meet in one row: for works of
    bounded size (pages of a book); use `manifest_counts` for groups that grow with the corpus."""
    rows = df.withColumn("_g", key).withColumn("_t", F.coalesce("text", F.lit("")))
    topics = F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))) if "topics" in df.columns else F.array().cast("array<string>")
    return rows.groupBy(F.col("_g").alias("work_id")).agg(
        F.count("*").alias("n_pages"), F.sum(F.length("_t")).alias("char_count"), F.sum(T.word_count(F.col("_t"))).alias("word_count"), topics.alias("topics"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"]), "\n\n").alias("text"),
    )


def manifest_counts(df: DataFrame, key: Column) -> DataFrame:
    rows = df.withColumn("_t", F.coalesce("text", F.lit("")))
    return rows.groupBy(key.alias("work_id")).agg(F.count("*").alias("n_pages"), F.sum(F.length("_t")).alias("char_count"), F.sum(T.word_count(F.col("_t"))).alias("word_count"))


def rolling(df: DataFrame, value: str, size: int, by: list[str], order: str = "ord") -> DataFrame:
    """Mean and maximum of the last `size` values of each host, run or whatever `by` names."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(1 - size, 0)
    return df.withColumn(f"{value}_mean", F.avg(value).over(w)).withColumn(f"{value}_max", F.max(value).over(w))


def percentile(df: DataFrame, value: str, percent: float) -> float | None:
    """The value at place int(n percent / 100) of the sorted ones."""
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return None
    from corpusflow.operators.select import ranked

    place = min(n - 1, int(n * percent / 100))
    return ranked(df.where(F.col(value).isNotNull()).select(value), F.col(value)).where(F.col("rank") == place).first()[0]


def perplexity(df: DataFrame, nll: str = "nll", tokens: str = "tokens") -> DataFrame:
    """exp of the mean negative log likelihood of a token, the exponent at most 20."""
    return df.agg(F.exp(F.least(F.sum(nll) / F.sum(tokens), F.lit(20.0))).alias("perplexity"))
