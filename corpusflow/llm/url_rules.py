"""URL filter: path rules first, then association rules that FP-growth mines from labelled URLs.

Each URL becomes a small set of tokens, and a label: bad where a path rule blocks it, or where no path rule decides it
and a word of its host, path or query keys is one of `SEEDS` (a caller can give another label column). FP-growth mines
the item sets over all URLs, and rules `tokens => bad` that reach the support and confidence limits judge the URLs that
no path rule decides. Rules that hold whenever a shorter one holds are pruned. A rule is indexed under its first token,
met by an equi-join on the tokens of each distinct set, and holds when all its tokens are there. URLs without a label
count against a rule, so that a token combination is only blocked when nearly all URLs that have it are bad: a word
that is a seed and stands mostly in URLs that a path rule allows is in no rule.

A URL's tokens are all its host labels, path segments and query keys and the words inside them, at any place; and its
top, second and leading host labels, first two path segments, file ending and whole query keys as such. Digits are
folded to 0. Support bounds the mining: an item in fewer bad URLs than the support asks for is in no rule and is
left out before FP-growth, and of items that stand in the very same URLs one is mined for all. Neither changes a
verdict. Equal token sets are judged once.

Scale: counts are partial aggregates. Rules and blocked sets are broadcast while their counts are under a limit;
beyond it they are met by shuffles, pages in salted ones, so that a host with a third of all pages is dealt out.

Edge cases: a null URL or one without `://` has an empty host and path, no tokens, and is allowed; a very long URL has
more tokens and is judged like any other; rules of equal length that fit (a tie) cannot differ in their text, so one of
them is named; repeated pages and null ids each give their own row; other columns, whatever their names, are not read;
an empty table, or one without bad URLs, is judged without mining.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.session import cut

RULES: list[tuple[str, str, str]] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
LABEL = "label=block"
#: Words of gambling, advertising, adult and piracy hosts and paths: the labels to learn from where no path rule speaks.
SEEDS = ["adserver", "ads", "bet", "bets", "betting", "casino", "jackpot", "lottery", "poker", "porn", "slots", "torrent", "tracker", "viagra", "warez", "xxx"]


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def decide(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Every host label, path segment and query key, the words of those that have several, and some by their place."""
    fold = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    full = lambda c: F.filter(c, lambda x: x != "")
    labels = full(F.split(host, r"\."))
    end = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = full(F.transform(F.split(query, "&"), lambda kv: F.regexp_extract(kv, "^[^=]*", 0)))
    parts = full(F.split(path, "/"))

    def items(kind: str, c: Column) -> list[Column]:
        words = F.flatten(F.transform(F.filter(F.transform(c, lambda x: full(F.split(fold(x), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), lambda w: F.size(w) > 1), lambda w: w))
        return [F.transform(c, lambda x: F.concat(F.lit(kind + "="), fold(x))), F.transform(words, lambda w: F.concat(F.lit(kind + "~"), w))]

    item = lambda name, c, when: F.when(when, F.concat(F.lit(name + "="), c))
    placed = F.array(
        item("top", F.try_element_at(labels, F.lit(-1)), F.size(labels) > 0),
        item("site", F.try_element_at(labels, F.lit(-2)), F.size(labels) > 1),
        item("lead", fold(F.try_element_at(labels, F.lit(1))), F.size(labels) > 2),
        item("dir1", fold(F.try_element_at(parts, F.lit(1))), F.size(parts) > 0),
        item("dir2", fold(F.try_element_at(parts, F.lit(2))), F.size(parts) > 1),
        item("end", end, end != ""),
        item("keys", F.array_join(F.array_sort(F.array_distinct(keys)), "&"), F.size(keys) > 0),
    )
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(placed), *items("host", F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))), *items("dir", parts), *items("key", keys))))


def mine(sets: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Association rules `antecedent => block` over (tokens, label) rows."""
    least = math.ceil(min_support * sets.where("label or size(tokens) > 0").count())
    each = sets.select(F.explode("tokens").alias("token"), "label", F.xxhash64("tokens").cast("decimal(38,0)").alias("h"))
    counted = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("label").alias("blocked"), F.sum("h").alias("h"))
    # the first of the items that stand in the same URLs
    able = counted.where(F.col("blocked") >= least).groupBy("n", "h").agg(F.min("token").alias("token")).agg(F.sort_array(F.collect_list("token")).alias("able"))
    held = sets.crossJoin(F.broadcast(able)).select("label", F.array_intersect("tokens", "able").alias("few"), (F.col("label") | (F.size("tokens") > 0)).alias("counts"))
    # rows without such an item stay, as one item that is in no rule, so that support keeps its base
    items = held.where("counts").select(F.when(F.col("label"), F.array_append("few", F.lit(LABEL))).when(F.size("few") > 0, F.col("few")).otherwise(F.array(F.lit("none"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0] == LABEL).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    rules = cut(rules)
    # without rules that contain another one
    one = rules.select("antecedent", F.explode("antecedent").alias("token"))
    shorter = rules.select(F.col("antecedent").alias("short"), F.col("antecedent")[0].alias("token"))
    longer = one.join(shorter, "token").where((F.size("short") < F.size("antecedent")) & (F.size(F.array_except("short", "antecedent")) == 0)).select("antecedent").distinct()
    return rules.join(longer, "antecedent", "left_anti")


def seeded(tokens: Column, seeds: list[str]) -> Column:
    """Whether a host label, path segment, query key or a word of one is a seed."""
    return F.exists(tokens, lambda t: F.regexp_extract(t, r"^(?:host|dir|key)[=~](.*)$", 1).isin(seeds))


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, min_support: float = 0.001, min_confidence: float = 0.9,
    bad: Column | None = None, seeds: list[str] = SEEDS, most_broadcast: int = 100_000, salts: int = 16,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and what decided it (`rule`, `mined` or `default`).

    bad: a boolean column of pages that labels URLs, in place of the seeds.
    """
    url = F.col("url").cast("string")
    label = (F.coalesce(bad, F.lit(False)) if bad is not None else F.lit(False)).alias("bad")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), label)
    host, path = host_path(F.col("url"))
    base = base.select("page_id", "url", "bad", host.alias("host"), path.alias("path"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    base = base.select(
        "page_id", "host", "path", "bad", rule.alias("rule"), verdict.alias("said"),
        F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(tokens(F.col("url"), F.col("host"), F.col("path"))).alias("tokens"),
    )
    label = F.coalesce(F.col("said") == "block", F.col("bad") if bad is not None else seeded(F.col("tokens"), seeds))
    base = cut(base.withColumn("label", label).withColumn("set", F.xxhash64("tokens")))
    blocked = None
    if not base.where("label").isEmpty():
        mined = cut(mine(base.select("tokens", "label"), min_support, min_confidence).select(F.col("antecedent")[0].alias("token"), "antecedent"))
        sets = base.where("said is null and size(tokens) > 0").groupBy("set", "tokens").count()
        met = sets.select("set", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(mined) if mined.count() <= most_broadcast else mined, "token")
        blocked = cut(met.where(F.size(F.array_except("antecedent", "tokens")) == 0).select("set", "tokens").distinct().withColumn("mined", F.lit(True)))
    if blocked is None:
        judged = base.withColumn("mined", F.lit(None).cast("boolean"))
    elif blocked.count() <= most_broadcast:
        judged = base.join(F.broadcast(blocked), ["set", "tokens"], "left")
    else:
        dealt = blocked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        judged = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(salts)).cast("int")).join(dealt, ["set", "tokens", "salt"], "left")
    by_method = F.when(F.col("mined"), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("said", by_method).alias("verdict"),
        F.when(F.col("said").isNotNull(), "rule").when(F.col("mined"), "mined").otherwise("default").alias("decided_by"),
    )
