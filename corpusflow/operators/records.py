"""Record constructors: cleaned text, ids by hash, counts and fractions, for pages, posts, works and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import html
from corpusflow.functions import text as T
from corpusflow.operators import dedup, filters


def full_id(c: Column) -> Column:
    return F.sha2(c, 256)


def short_id(c: Column) -> Column:
    """The first 16 hex digits."""
    return F.substring(F.sha2(c, 256), 1, 16)


def sentence_id(c: Column, url: Column) -> Column:
    return F.sha2(F.concat(c, F.coalesce(url, F.lit(""))), 256)


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def page_records(df: DataFrame, script: tuple[int, int] = T.TAMIL, language: str = "ta", at: Column | None = None) -> DataFrame:
    """Cleaned text, its id, source, url, crawl time, language by script, characters and words."""
    rows = df.withColumn("text", T.clean_for_script(F.col("text"), script))
    spoken = F.when(filters.any_script(F.col("text"), script), language).otherwise("unknown")
    return rows.select(
        full_id(F.col("text")).alias("id"), "text", F.coalesce(optional(df, "source"), F.lit("unknown")).alias("source"), optional(df, "url").alias("url"),
        (F.current_timestamp() if at is None else at).alias("crawl_date"),
        spoken.alias("lang"), F.length("text").alias("char_count"), T.word_count(F.col("text")).alias("word_count"))


def measured_records(df: DataFrame, script: tuple[int, int] = T.TAMIL, metadata: tuple[str, ...] = ()) -> DataFrame:
    """The text as it is, a short id of it, its length, its share of the script without white space, and what metadata there is."""
    return df.select(
        short_id(F.col("text")).alias("id"), "text", "source", optional(df, "url").alias("url"), F.current_timestamp().alias("timestamp"),
        F.length("text").alias("char_count"), T.script_fraction_nonspace(F.col("text"), script).alias("tamil_fraction"), *metadata)


def plain_records(df: DataFrame, quality: Column) -> DataFrame:
    """Text, source, url, a quality by source, and a short id."""
    return df.select("text", "source", optional(df, "url").alias("url"), quality.alias("quality_score"), short_id(F.col("text")).alias("id"))


#: Quality of landed pages by their kind of source.
SOURCE_QUALITY = {"tn_govt_schemes": 0.9, "tamil_news_headlines": 0.7, "wikipedia_trending": 0.8}


def landed_pages(pages: DataFrame, qualities: dict[str, float] = SOURCE_QUALITY, min_length: int = 40, least: float = 0.5, script: tuple[int, int] = T.TAMIL, per_page: int | None = None) -> DataFrame:
    """Records of the paragraphs of stored pages (url, source, html) that are long and in the script; first of each id stays."""
    found = html.paragraphs(pages, "html", max(1, min_length), least, script, per_page)
    table = F.create_map(*[F.lit(x) for pair in qualities.items() for x in pair])
    first = dedup.by_id(found.withColumn("ord", F.struct("url", "paragraph")).withColumn("id", short_id(F.col("text"))))
    return plain_records(first, F.coalesce(F.try_element_at(table, "source"), F.lit(0.5)))


def post_records(posts: DataFrame, comments: DataFrame | None = None, script: tuple[int, int] = T.TAMIL, least: int = 20, most: int = 2000, fraction: float = 0.3) -> DataFrame:
    """Records of posts (ord, post_id, subreddit, title, selftext, permalink, score) and comments (ord, post_id, subreddit, body, score).

    Acceptable texts only, deleted ones dropped, the first of equal texts stays: posts before comments, title before text.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(f"post_{c}").alias("record_type"), F.col(c).alias("raw")) for k, c in enumerate(("title", "selftext"))]))
    link = F.concat(F.lit("https://reddit.com"), F.coalesce("permalink", F.lit("")))
    rows = posts.select(F.lit(0).alias("part"), "ord", "post_id", "subreddit", link.alias("url"), F.coalesce("score", F.lit(0)).cast("long").alias("upvotes"), kinds.alias("k")).select("part", "ord", "post_id", "subreddit", "url", "upvotes", "k.*")
    if comments is not None:
        said = filters.drop_deleted(comments)
        rows = rows.unionByName(said.select(
            F.lit(1).alias("part"), "ord", "post_id", "subreddit", F.lit(None).cast("string").alias("url"), F.coalesce("score", F.lit(0)).cast("long").alias("upvotes"),
            F.lit(0).alias("place"), F.lit("comment").alias("record_type"), F.col("body").alias("raw")))
    rows = rows.withColumn("text", T.clean_social(F.coalesce("raw", F.lit("")))).where(filters.acceptable(least, most, fraction, script))
    rows = rows.withColumn("ord", F.struct("part", "ord", "place")).withColumn("id", full_id(F.col("text")))
    unique = dedup.by_id(rows)
    return unique.select("id", "text", F.lit("reddit").alias("source"), "subreddit", "post_id", "url", T.fraction3(F.col("text"), script).alias("tamil_fraction"), "upvotes", "record_type")


def tweet_records(pages: DataFrame, keyword: Column, script: tuple[int, int] = T.TAMIL, least: int = 15, most: int = 1000, fraction: float = 0.25) -> DataFrame:
    """Records of the posts on stored pages (ord, url, html): acceptable ones, the first of equal texts."""
    found = pages.select("ord", "url", keyword.alias("keyword"), F.posexplode(html.posts(F.col("html"))).alias("place", "text"))
    rows = found.where(filters.acceptable(least, most, fraction, script)).withColumn("ord", F.struct("ord", "place")).withColumn("id", full_id(F.col("text")))
    return dedup.by_id(rows).select("id", "text", F.lit("twitter").alias("source"), "keyword", "url", T.fraction3(F.col("text"), script).alias("tamil_fraction"))
