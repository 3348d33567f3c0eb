"""Registered queries over the driver's tables, and the SQL that tells the same.

Records are `documents` with a quality score from `labels`: 1 is 0.9, 0 is 0.4, none is null. The tables hold no Tamil, so
script operators run with Latin bounds (and marker operators with Latin markers); literal tables cover Tamil in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import html, markers
from corpusflow.functions import text as T
from corpusflow.operators import dedup, filters, neardup, packing, report, select, tokenizer
from corpusflow.plans import pipelines
from corpusflow.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LATIN = T.LATIN
LAT = T.span(LATIN)
WS, PYW = T.WS, T.PYW
# SQL fragments
NORM = f"trim(regexp_replace(lower(text), '{WS}+', ' ', 'g'), ' ')"
STRIP = f"regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '')"
REC = """WITH rec AS (SELECT d.doc_id AS ord, CAST(d.doc_id AS VARCHAR) AS id, d.text, d.source, d.lang, CASE l.quality WHEN 1 THEN 0.9::DOUBLE WHEN 0 THEN 0.4::DOUBLE END AS quality_score
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
FRAC = f"CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^{LAT}]', '', 'g')) / length(text) ELSE 0.0 END"
WORDS = f"CASE WHEN trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' '), ' ')) END"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), "text", "source", "lang",
        F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.4).alias("quality_score"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


text = "text"


@query(f"SELECT doc_id, sha256({NORM}) AS k, {NORM} = text AS unchanged FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(text).alias("k"), (T.normal(text) == F.col(text)).alias("unchanged"))


@query(f"SELECT doc_id, left(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\x{{b80}}-\\x{{bff}}]', '', 'g'), 512) AS k FROM documents")
def norm_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.norm_key(text).alias("k"))


@query(f"SELECT min(doc_id) AS ord FROM documents GROUP BY sha256({NORM})")
def exact_dedup(spark, d):
    return dedup.exact(records(spark, d)).select("ord")


@query(f"SELECT min(doc_id) AS ord FROM documents GROUP BY source, sha256({NORM})")
def exact_dedup_per_source(spark, d):
    return dedup.per_source(records(spark, d)).select("ord")


@query(f"SELECT min(doc_id) AS ord FROM documents WHERE {STRIP} <> '' GROUP BY left({STRIP}, 256)")
def prefix_dedup_256(spark, d):
    return dedup.by_prefix(records(spark, d), 256).select("ord")


@query(f"SELECT min(doc_id) AS ord FROM documents WHERE {STRIP} <> '' GROUP BY left({STRIP}, 512)")
def prefix_dedup_512(spark, d):
    return dedup.by_prefix(records(spark, d), 512).select("ord")


HEADERS = ["The", "Das", "La"]
_CLEAN = "text"
for _h in HEADERS:
    _CLEAN = f"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '^(?:{_h})', ''), '^{WS}+', ''), '{WS}+$', '')"
_CLEAN = f"trim(regexp_replace({_CLEAN}, '{WS}+', ' ', 'g'), ' ')"


@query(f"WITH c AS (SELECT doc_id, {_CLEAN} AS t FROM documents) SELECT min(doc_id) AS ord, any_value(left(t, 200)) AS prefix FROM c WHERE length(t) >= 20 GROUP BY left(t, 200)")
def header_strip_dedup_200(spark, d):
    rows = records(spark, d).withColumn("text", T.strip_prefixes(text, HEADERS)).where("length(text) >= 20")
    return dedup.by_prefix(rows, 200).select("ord", F.substring("text", 1, 200).alias("prefix"))


@query(f"SELECT min(doc_id) AS ord FROM documents WHERE regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\x{{b80}}-\\x{{bff}}]', '', 'g') <> '' GROUP BY left(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\x{{b80}}-\\x{{bff}}]', '', 'g'), 512)")
def norm_key_dedup(spark, d):
    return dedup.by_norm_key(records(spark, d)).select("ord")


@query(f"{REC} SELECT ord, first_ord, quality_score FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY coalesce(quality_score, 1.0) DESC, ord) r, min(ord) OVER (PARTITION BY text) first_ord FROM rec) WHERE r = 1")
def best_quality_dedup(spark, d):
    return dedup.best_quality(records(spark, d)).select("ord", "first_ord", "quality_score")


@query(f"SELECT source, count(*) AS seen, count(*) FILTER (WHERE ord > f) AS duplicates, count(*) FILTER (WHERE ord = f) AS kept FROM (SELECT source, doc_id AS ord, min(doc_id) OVER (PARTITION BY sha256({NORM})) f FROM documents) GROUP BY source")
def dedup_source_stats(spark, d):
    return dedup.source_stats(dedup.exact_flags(table(spark, d, "documents").withColumnRenamed("doc_id", "ord")))


REASON = """CASE WHEN length(text) < 20 THEN 'too_short' WHEN length(text) > 10000 THEN 'too_long' WHEN coalesce(quality_score, 0.5) < 0.5 THEN 'low_quality_score'
WHEN length(regexp_replace(text, '[^!?.,;:-]', '', 'g')) / greatest(length(text), 1) > 0.3 THEN 'excessive_punctuation' END"""


@query(f"{REC} SELECT ord, text FROM rec WHERE ({REASON}) IS NULL")
def filter_quality(spark, d):
    return filters.filter_quality(records(spark, d)).select("ord", "text")


@query(f"{REC} SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS n FROM rec GROUP BY 1")
def filter_quality_reasons(spark, d):
    return filters.reason_counts(records(spark, d), filters.quality_reason())


@query(f"{REC}, f AS (SELECT {REASON} AS r FROM rec) SELECT count(*) AS total, count(*) FILTER (WHERE r IS NULL) AS kept, count(r) AS removed, count(r) / count(*) AS removal_rate FROM f")
def filter_quality_stats(spark, d):
    return filters.removal_stats(records(spark, d), filters.quality_reason())


@query(f"SELECT doc_id, {FRAC} AS fraction FROM documents")
def script_fraction(spark, d):
    return table(spark, d, "documents").select("doc_id", T.script_fraction(text, LATIN).alias("fraction"))


@query(f"SELECT doc_id, CASE WHEN length(regexp_replace(text, '{WS}', '', 'g')) > 0 THEN length(regexp_replace(text, '[^{LAT}]', '', 'g')) / length(regexp_replace(text, '{WS}', '', 'g')) ELSE 0.0 END AS fraction FROM documents")
def script_fraction_nonspace(spark, d):
    return table(spark, d, "documents").select("doc_id", T.script_fraction_nonspace(text, LATIN).alias("fraction"))


@query(f"SELECT doc_id AS ord FROM documents WHERE {FRAC} >= 0.7")
def filter_language(spark, d):
    return filters.filter_language(records(spark, d), 0.7, LATIN).select("ord")


@query("SELECT doc_id AS ord FROM documents WHERE regexp_matches(text, '[\\x{b80}-\\x{bff}]')")
def filter_language_tamil(spark, d):
    return records(spark, d).where(filters.any_script(F.col("text"))).select("ord")


SQL_MAIL = "(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}"
SQL_PHONE = f"(?:(?:\\+?91(?:[-.]|{WS})?)|\\b)(?:\\p{{Nd}}{{4,5}}(?:[-.]|{WS})?)?\\p{{Nd}}{{3,4}}(?:[-.]|{WS})?\\p{{Nd}}{{4}}\\b"
SQL_LINK = f"(?i)https?://[^{WS[1:]}+|www\\.[^{WS[1:]}+"
SCRUB = f"regexp_replace(regexp_replace(regexp_replace(text, '{SQL_MAIL}', '[EMAIL]', 'g'), '{SQL_PHONE}', '[PHONE]', 'g'), '{SQL_LINK}', '[URL]', 'g')"


@query(f"SELECT doc_id AS ord, sha256({SCRUB}) AS h, {SCRUB} <> text AS had_pii FROM documents")
def pii_scrub(spark, d):
    return filters.scrub_pii(records(spark, d)).select("ord", F.sha2("text", 256).alias("h"), "had_pii")


@query(f"""WITH c AS (SELECT len(regexp_extract_all(text, '{SQL_MAIL}')) e, len(regexp_extract_all(regexp_replace(text, '{SQL_MAIL}', '[EMAIL]', 'g'), '{SQL_PHONE}')) p,
len(regexp_extract_all(regexp_replace(regexp_replace(text, '{SQL_MAIL}', '[EMAIL]', 'g'), '{SQL_PHONE}', '[PHONE]', 'g'), '{SQL_LINK}|\\[URL\\]')) u FROM documents)
SELECT count(*) AS checked, count(*) FILTER (WHERE e > 0) AS with_email, count(*) FILTER (WHERE p > 0) AS with_phone, count(*) FILTER (WHERE u > 0) AS with_url,
count(*) FILTER (WHERE e + p + u > 0) AS with_any, count(*) FILTER (WHERE e + p + u > 0) / count(*) AS rate FROM c""")
def pii_check(spark, d):
    return report.pii_check(records(spark, d))


@query(f"SELECT doc_id, round((0.6 * least(1.0::DOUBLE, ({WORDS}) / 50) + 0.4 * (CASE WHEN {FRAC} > 0.6 THEN 1.0::DOUBLE ELSE {FRAC} END)) * 1e9) AS score_e9, ({WORDS}) < 5 AS too_short, ({FRAC}) > 0.5 AS in_script FROM documents")
def quality_score(spark, d):
    got = table(spark, d, "documents").select("doc_id", F.round(T.quality_score(text, LATIN) * 1e9).alias("score_e9"), T.quality_flags(text, LATIN).alias("f"))
    return got.select("doc_id", "score_e9", "f.too_short", "f.in_script")


TOPICS = {"law": ["licen", "rights"], "web": ["http", "www"], "common": ["the ", " und "]}


@query("SELECT doc_id, CASE WHEN len(t) > 0 THEN array_to_string(t, ',') ELSE 'none' END AS topics FROM (SELECT doc_id, list_filter(["
       + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{t}' END" for t, ws in TOPICS.items())
       + "], lambda x: x IS NOT NULL) t FROM documents)")
def topic_classify(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.topics(text, TOPICS, "none"), ",").alias("topics"))


@query("SELECT doc_id, CAST(least(5, CASE WHEN regexp_matches(text, '(^|[^\\p{L}\\p{N}_])(?:that|they)($|[^\\p{L}\\p{N}_])') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '(?:tion|ung)') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '(?:eux)') THEN 2 ELSE 0 END) AS INTEGER) AS modern_score FROM documents")
def modern_score(spark, d):
    groups = [(3, T.any_word(["that", "they"])), (2, T.any_word(["tion", "ung"], False)), (2, "eux")]
    return table(spark, d, "documents").select("doc_id", T.marker_score(F.col("text"), groups).alias("modern_score"))


@query("SELECT 0::BIGINT AS zero, count(*) AS n FROM documents")
def modern_score_tamil(spark, d):
    groups = [(3, T.any_word(markers.PRONOUNS)), (2, T.any_word(markers.VERBS, False)), (2, T.any_word(markers.CASUAL, False)), (1, T.any_word(markers.NEWS, False))]
    return table(spark, d, "documents").agg(F.sum(T.marker_score(F.col("text"), groups)).cast("long").alias("zero"), F.count("*").alias("n"))


COLLOQUIAL = "text <> '' AND (source IN ('src1', 'src2') OR regexp_matches(text, '(^|[^\\p{L}\\p{N}_])(?:was|pas)($|[^\\p{L}\\p{N}_])') OR (length(text) < 60 AND regexp_matches(text, '[!?]+$')))"


def _casual(c, source):
    return T.colloquial(c, source, T.any_word(["was", "pas"]), ("src1", "src2"))


@query(f"SELECT doc_id, {COLLOQUIAL} AS is_colloquial FROM documents")
def colloquial_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", _casual(F.col("text"), F.col("source")).alias("is_colloquial"))


LINES = r"list_filter(list_transform(regexp_split_to_array({t}, '\r\n|[\n-\r\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')".format(t=STRIP)
BOILER = " OR ".join(f"contains(lower({STRIP}), '{p}')" for p in filters.BOILERPLATE)


@query(rf"""SELECT doc_id AS ord, CASE WHEN {STRIP} = '' THEN 'empty' WHEN length({STRIP}) < 100 THEN 'too_short' WHEN {BOILER} THEN 'boilerplate'
WHEN len(list_filter(regexp_split_to_array({STRIP}, '[.|?!\n]+'), lambda x: regexp_matches(x, '[^{WS[1:]}'))) < 3 THEN 'few_sentences'
WHEN len({LINES}) > 0 AND len(list_distinct({LINES})) < 0.5 * len({LINES}) THEN 'repetitive'
WHEN length(regexp_replace({STRIP}, '[^\p{{L}}\p{{N}}_{LAT}]', '', 'g')) > 0 AND length(regexp_replace({STRIP}, '[\p{{L}}\p{{N}}_]|{WS}', '', 'g')) > 0.5 * length(regexp_replace({STRIP}, '[^\p{{L}}\p{{N}}_{LAT}]', '', 'g')) THEN 'noisy' END AS reason FROM documents""")
def record_filter(spark, d):
    rules = filters.RecordRules(min_chars=100, fineweb=True, script=LATIN)
    return records(spark, d).select("ord", filters.record_reason(rules).alias("reason"))


SENT = f"list_filter(list_transform(regexp_split_to_array(text, '[\\x{{964}}!?.\\n]+'), lambda x: regexp_replace(regexp_replace(x, '^{WS}+', ''), '{WS}+$', '')), lambda x: length(x) > 10)"


@query(f"SELECT doc_id, len(s) AS n, sha256(array_to_string(s, chr(10))) AS h FROM (SELECT doc_id, {SENT} s FROM documents)")
def sentence_split(spark, d):
    s = T.sentences(text)
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.sha2(F.array_join(s, "\n"), 256).alias("h"))


SENT2 = f"list_filter(list_transform(regexp_split_to_array(text, '[\\x{{964}}!?.\\n]+'), lambda x: trim(regexp_replace(x, '{WS}+', ' ', 'g'), ' ')), lambda x: length(x) > 9 AND length(x) <= 1000)"


@query(f"""WITH s AS (SELECT doc_id, unnest({SENT2}) AS t, unnest(range(1, len({SENT2}) + 1)) AS p FROM documents),
k AS (SELECT *, left(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_\\x{{b80}}-\\x{{bff}}]', '', 'g'), 512) AS k FROM s)
SELECT doc_id, p AS place, t AS text, sha256(t) AS id FROM k WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) = 1""")
def sentence_dedup(spark, d):
    rows = records(spark, d).select("ord", F.posexplode(T.sentences(text, 9, 1000, True)).alias("p", "text"))
    rows = rows.withColumn("doc_id", F.col("ord")).withColumn("ord", F.struct("ord", "p"))
    return dedup.by_norm_key(rows).select("doc_id", (F.col("p") + 1).cast("long").alias("place"), "text", F.sha2("text", 256).alias("id"))


@query(f"SELECT doc_id, sha256(text) AS full_id, left(sha256(text), 16) AS short_id, sha256(text || source) AS with_url, length(text) AS char_count, CAST({WORDS} AS INTEGER) AS word_count FROM documents")
def record_id(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.sha2("text", 256).alias("full_id"), F.substring(F.sha2("text", 256), 1, 16).alias("short_id"),
        F.sha2(F.concat("text", F.coalesce("source", F.lit(""))), 256).alias("with_url"), F.length("text").cast("long").alias("char_count"), T.word_count(text).alias("word_count"))


WEIGHTS = {"src0": 0.5, "src1": 2.0, "src2": 1.5}
W_SQL = "CASE source WHEN 'src0' THEN 0.5::DOUBLE WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 1.5 ELSE 1.0 END"


@query(f"SELECT doc_id AS ord, {W_SQL} AS weight FROM documents")
def source_weights(spark, d):
    return select.source_weights(records(spark, d), WEIGHTS).select("ord", F.col("_weight").alias("weight"))


RENAMED = {"src0": "wikipedia", "src1": "news", "src2": "social", "src3": "local", "src4": "literature", "src5": "modern_conversational"}
NAMED = REC + ", n AS (SELECT ord, id, text, quality_score, CASE source " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RENAMED.items()) + " ELSE source END AS source FROM rec), w AS (SELECT *, coalesce(quality_score, 0.5) * (CASE WHEN source IN ('social', 'news', 'modern_conversational') THEN 2.5::DOUBLE WHEN source = 'wikipedia' THEN 1.5 ELSE 0.8 END) AS weight FROM n)"


def _named(spark, d):
    table_ = F.create_map(*[F.lit(x) for p in RENAMED.items() for x in p])
    return records(spark, d).withColumn("source", F.coalesce(F.try_element_at(table_, "source"), F.col("source")))


@query(f"{NAMED} SELECT ord, source, weight FROM w")
def export_weights(spark, d):
    return select.export_weights(_named(spark, d)).select("ord", "source", F.col("_weight").alias("weight"))


@query(f"{NAMED} SELECT ord FROM w ORDER BY weight * coalesce(quality_score, 0.5) DESC, coalesce(quality_score, 0.5) DESC, ord LIMIT 100")
def topk_weighted(spark, d):
    return select.select_top(select.export_weights(_named(spark, d)), 100).select("ord")


@query(f"""{NAMED}, m AS (SELECT ord, source, list_position(['news', 'social', 'modern_conversational'], source) p, weight FROM w WHERE source IN ('news', 'social', 'modern_conversational')),
c AS (SELECT ord, source, list_position(['wikipedia', 'local', 'literature'], source) p, weight FROM w WHERE source IN ('wikipedia', 'local', 'literature'))
SELECT ord, source FROM (SELECT * FROM m ORDER BY weight DESC, p, ord LIMIT 70) UNION ALL SELECT ord, source FROM (SELECT * FROM c ORDER BY weight DESC, p, ord LIMIT 30)""")
def stratified_selection(spark, d):
    return select.stratified(select.export_weights(_named(spark, d)), 100, 0.7).select("ord", "source")


@query(f"""{REC}, f AS (SELECT *, {COLLOQUIAL} AS is_colloquial FROM rec),
a AS (SELECT ord FROM f WHERE is_colloquial ORDER BY coalesce(quality_score, 0.5) DESC, ord LIMIT 60),
b AS (SELECT ord FROM f WHERE NOT is_colloquial ORDER BY coalesce(quality_score, 0.5) DESC, ord LIMIT (SELECT 200 - count(*) FROM a)),
t AS (SELECT ord, 0 AS pool FROM a UNION ALL SELECT ord, 1 FROM b),
r AS (SELECT ord, 2 AS pool FROM f WHERE ord NOT IN (SELECT ord FROM t) ORDER BY is_colloquial DESC, coalesce(quality_score, 0.5) DESC, ord LIMIT (SELECT 200 - count(*) FROM t))
SELECT ord, pool FROM t UNION ALL SELECT ord, pool FROM r""")
def colloquial_quota(spark, d):
    rows = records(spark, d).withColumn("is_colloquial", _casual(F.col("text"), F.col("source")))
    return select.colloquial_quota(rows, 200, 0.3).select("ord", F.col("_pool").alias("pool"))


@query(f"{REC}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM rec) SELECT id, CASE WHEN k < floor(n * 0.8) THEN 'train' WHEN k < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM r")
def train_val_test_by_id(spark, d):
    return select.split_by_id(records(spark, d)).select("id", "split")


@query("SELECT doc_id AS ord, CASE WHEN row_number() OVER (ORDER BY doc_id) <= greatest(1, floor(count(*) OVER () * 0.05)) THEN 'val' ELSE 'train' END AS split FROM documents")
def head_split(spark, d):
    return select.head_split(records(spark, d), 0.05).select("ord", "split")


@query("SELECT source, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents) AS percent FROM documents GROUP BY source")
def source_distribution(spark, d):
    return report.source_distribution(records(spark, d))


@query("SELECT source, count(*) AS n, min(doc_id) AS first_ord FROM documents GROUP BY source ORDER BY n DESC, first_ord LIMIT 5")
def top_sources(spark, d):
    return report.top_sources(records(spark, d))


@query("WITH e AS (SELECT min(length(text))::DOUBLE lo, max(length(text))::DOUBLE hi FROM documents) SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(9, floor((length(text) - lo) / ((hi - lo) / 10))) END AS BIGINT) AS bin, count(*) AS n FROM documents, e GROUP BY 1")
def length_histogram(spark, d):
    return report.histogram(records(spark, d), F.length("text"), 10)


@query("SELECT count(*) AS documents, count(DISTINCT source) AS sources, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) / count(*) AS avg_length, CAST(floor(sum(length(text)) / 4.5::DOUBLE) AS BIGINT) AS tokens_estimated FROM documents")
def corpus_report(spark, d):
    return report.corpus_report(records(spark, d))


@query(f"{REC} SELECT coalesce(min(quality_score), 0.0) AS min_quality, coalesce(max(quality_score), 0.0) AS max_quality, round(coalesce(avg(quality_score), 0.0), 9) AS avg_quality FROM rec")
def quality_stats(spark, d):
    return report.quality_stats(records(spark, d)).withColumn("avg_quality", F.round("avg_quality", 9))


@query(f"SELECT min({FRAC}) AS min_fraction, max({FRAC}) AS max_fraction, round(avg({FRAC}), 9) AS avg_fraction FROM documents WHERE text <> ''")
def language_mix(spark, d):
    return report.language_mix(records(spark, d), LATIN).withColumn("avg_fraction", F.round("avg_fraction", 9))


@query("""WITH a AS (SELECT source, count(*) n FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT source, count(*) n FROM documents WHERE lang <> 'en' GROUP BY 1)
SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.source = b.source""")
def compare_corpora(spark, d):
    r = records(spark, d)
    return report.compare(r.where("lang = 'en'"), r.where("lang <> 'en'"))


@query("SELECT CASE WHEN o AND m THEN 'mixed' WHEN o THEN 'old' WHEN m THEN 'modern' ELSE 'neutral' END AS style, count(*) AS n FROM (SELECT regexp_matches(text, 'heit|eaux') o, regexp_matches(text, 'tion|ción') m FROM documents) GROUP BY 1")
def style_classes(spark, d):
    return report.style_counts(records(spark, d), ["heit", "eaux"], ["tion", "ción"])


TOKENS = f"list_filter(string_split(trim(regexp_replace(lower(text), '{WS}+', ' ', 'g'), ' '), ' '), lambda x: x <> '')"


def _tokens(c):
    return F.filter(F.split(T.normal(c), " "), lambda w: w != "")


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY 1")
def vocab_counts(spark, d):
    return tokenizer.unigram(records(spark, d), _tokens(text))


@query(f"WITH c AS (SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY 1) SELECT token, n, (n + 1) / ((SELECT sum(n) FROM c) + (SELECT count(*) FROM c)) AS p FROM c")
def unigram_prob(spark, d):
    return tokenizer.unigram_probability(tokenizer.unigram(records(spark, d), _tokens(text)))


@query(f"""WITH c AS (SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM documents WHERE lang = 'en') GROUP BY 1),
p AS (SELECT token, (n + 1) / ((SELECT sum(n) FROM c) + (SELECT count(*) FROM c)) AS p FROM c),
t AS (SELECT unnest({TOKENS}) AS token FROM documents WHERE lang <> 'en')
SELECT count(*) AS scored, round(exp(-avg(ln(p))), 4) AS perplexity FROM t JOIN p USING (token)""")
def unigram_perplexity(spark, d):
    r = records(spark, d)
    counts = tokenizer.unigram(r.where("lang = 'en'"), _tokens(text))
    return tokenizer.unigram_perplexity(r.where("lang <> 'en'"), counts, _tokens(text)).withColumn("perplexity", F.round("perplexity", 4))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?s).[\x{bbe}-\x{bcd}]*')) AS n FROM documents")
def akshara_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.aksharas(text)).cast("long").alias("n"))


@query(f"""WITH n AS (SELECT doc_id, {NORM} AS t FROM documents), c AS (SELECT doc_id, length(t) AS n, unnest(string_split(t, '')) AS x, unnest(range(1, greatest(1, length(t)) + 1)) AS i FROM n),
g AS (SELECT doc_id, n, i, concat(x, lead(x) OVER w, lead(x, 2) OVER w, lead(x, 3) OVER w, lead(x, 4) OVER w) AS g FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(DISTINCT g) AS n FROM g WHERE i <= greatest(1, n - 4) GROUP BY 1""")
def shingle_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.shingles(text)).cast("long").alias("n"))


@query()
def minhash_signature(spark, d):
    return records(spark, d).select("ord", neardup.signature(text, 128, mode="fast").alias("sig"))


@query()
def near_dup_pairs(spark, d):
    signed = records(spark, d).select("ord", neardup.signature(text, 128, mode="fast").alias("sig"))
    from corpusflow.session import cut

    return neardup.pairs(cut(signed), 128, 0.85)


@query()
def near_dup_keep(spark, d):
    return neardup.near_dedup(records(spark, d), 0.85, mode="fast")


@query()
def near_dup_stats(spark, d):
    return neardup.dedup_stats(neardup.near_dedup(records(spark, d), 0.85, mode="fast"))


@query(f"SELECT doc_id AS ord, CAST(len({TOKENS}) + 2 AS BIGINT) AS length, CAST(coalesce(sum(len({TOKENS}) + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents")
def pack_offsets(spark, d):
    return packing.offsets(records(spark, d), F.size(_tokens(text)) + 2)


@query(f"""WITH t AS (SELECT doc_id, [1] || list_transform({TOKENS}, lambda x: CAST(length(x) AS INTEGER)) || [2] AS ids FROM documents),
s AS (SELECT row_number() OVER (ORDER BY doc_id, p) - 1 AS k, id FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS p FROM t))
SELECT CAST(k // 512 AS BIGINT) AS seq_id, CAST(sum(id * (k % 512 + 1)) AS BIGINT) AS checksum FROM s GROUP BY 1 HAVING count(*) = 512""")
def pack_sequences(spark, d):
    ids = records(spark, d).select("ord", F.transform(_tokens(text), lambda w: F.length(w)).alias("ids"))
    total = F.aggregate(F.transform("tokens", lambda x, i: (x * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return packing.pack(ids, "ids", 512).select("seq_id", total.alias("checksum"))


@query(f"SELECT source AS work_id, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS char_count, CAST(sum({WORDS}) AS BIGINT) AS word_count FROM documents GROUP BY 1")
def manifest_counts(spark, d):
    return report.manifest_counts(records(spark, d), F.col("source"))


@query("SELECT conv_id AS work_id, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS char_count, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1")
def manifest_groups(spark, d):
    got = report.manifests(table(spark, d, "conversations"), F.col("conv_id"), "turn")
    return got.select("work_id", "n_pages", "char_count", F.sha2("text", 256).alias("h"))


@query("SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS h FROM pages")
def html_strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("h"))


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS link FROM pages")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(T.page_links(F.col("html"))).alias("link"))


@query()
def html_blocks(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_blocks("html").alias("blocks"))


PAGE = "html"
for _tag in ("script", "style", "nav", "footer", "header"):
    PAGE = f"regexp_replace({PAGE}, '(?is)<{_tag}[ >].*?</{_tag}>', ' ', 'g')"
PAGE = f"regexp_replace(regexp_replace({PAGE}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _char in (("&copy;", "\xa9"), ("&middot;", "\xb7"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", chr(34)), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    PAGE = f"replace({PAGE}, '{_name}', '{_char}')"


@query(f"SELECT page_id, trim(regexp_replace({PAGE}, '{WS}+', ' ', 'g'), ' ') AS text FROM pages")
def html_page_text(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_text("html").alias("text"))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://([^/?#]*\\.)?example\\.org([/?#:]|$)')")
def domain_whitelist(spark, d):
    return filters.on_domains(table(spark, d, "pages"), ["example.org"]).select("page_id")


@query("SELECT u.conv_id, u.turn, u.text || ' ' || a.text AS text FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def qa_concat(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.concat("text", F.lit(" "), "answer").alias("text"))


@query(f"SELECT doc_id FROM documents WHERE sha256({NORM}) NOT IN (SELECT sha256({NORM}) FROM benchmark)")
def benchmark_anti_join(spark, d):
    known = table(spark, d, "benchmark").select(T.content_hash(text).alias("k")).distinct()
    return table(spark, d, "documents").withColumn("k", T.content_hash(text)).join(known, "k", "left_anti").select("doc_id")


@query("SELECT doc_id, length(text) > 200 AND length(regexp_replace(text, '[^\\x{80}-\\x{ff}]', '', 'g')) > 0.02 * length(text) AS legacy FROM documents")
def legacy_encoding(spark, d):
    return table(spark, d, "documents").select("doc_id", T.looks_legacy(F.col("text")).alias("legacy"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_hour(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


@query(f"""{REC}, u AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY sha256({NORM}) ORDER BY ord) = 1),
k AS (SELECT source, text FROM u WHERE ({REASON}) IS NULL AND {FRAC} >= 0.5)
SELECT source, count(*) AS n, CAST(sum(length({SCRUB})) AS BIGINT) AS chars FROM k GROUP BY 1""")
def pipeline_curate(spark, d):
    final, _ = pipelines.curate(records(spark, d), pipelines.Curation(near=False, script=LATIN, min_fraction=0.5))
    return final.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query()
def pipeline_curate_near(spark, d):
    """The whole curation; near copies are what SQL can't express."""
    final, _ = pipelines.curate(records(spark, d), pipelines.Curation(script=LATIN, min_fraction=0.5))
    return final.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""{REC}, u AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY sha256({NORM}) ORDER BY ord) = 1)
SELECT source, count(*) AS kept, CAST(sum(length(text)) AS BIGINT) AS chars FROM u WHERE ({REASON}) IS NULL GROUP BY 1""")
def flagship(spark, d):
    """Exact dedup, quality rules, survivors of each source."""
    good = filters.filter_quality(dedup.exact(records(spark, d)))
    return good.groupBy("source").agg(F.count("*").alias("kept"), F.sum(F.length("text")).alias("chars"))
