"""Registered queries over text functions, records, reports, sampling and the tokenizer, beside those of `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import markers
from corpusflow.functions import text as T
from corpusflow.functions.register import register
from corpusflow.operators import dedup, filters, neardup, packing, records, report, select, tokenizer
from corpusflow.plans import pipelines
from corpusflow.plans.queries import COLLOQUIAL, FRAC, LATIN, NORM, PYW, REASON, REC, SCRUB, STRIP, WORDS, WS, _casual, _named, query, text
from corpusflow.plans.queries import NAMED as NAMED_SQL
from corpusflow.plans.queries import records as base_records
from corpusflow.plans.queries_io import SOCIAL, clean4, clean5, cleaned, landing, three
from corpusflow.session import cut, table

#: Sentences of our own; joined to the documents' texts, they give the script's operators something to find.
TAMIL = [
    "நீ எங்கே போகிறாய் என்று கேட்டேன்.", "அரசு புதிய செய்தி வெளியிட்டது.", "என் தம்பி பந்து விளையாடினான்!", "கடந்த வாரம் மழை பெய்தது.",
    "மொபைல் வாங்க சின்ன கடை போதும்.", "சோலை நிழல் குளிர்ச்சி தரும்.", "சினிமா செய்திகள் தமிழ்நாடு செய்திகள் இன்று வந்தவை பல.", "plain words without the script",
]
VALUES = ", ".join(f"({k}, '{t}')" for k, t in enumerate(TAMIL))
MIXED = f"WITH s(k, s) AS (VALUES {VALUES}), m AS (SELECT doc_id, s || ' ' || text AS text FROM documents JOIN s ON doc_id % {len(TAMIL)} = k)"
TFRAC = "CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\x{b80}-\\x{bff}]', '', 'g')) / length(text) ELSE 0.0 END"
NONSPACE = f"length(regexp_replace(text, '{WS}', '', 'g'))"


def tamil(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TAMIL * 3)), "ord long, text string")


def mixed(spark: SparkSession, d: str) -> DataFrame:
    s = F.element_at(F.array(*map(F.lit, TAMIL)), (F.pmod("doc_id", F.lit(len(TAMIL))) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(s, F.lit(" "), "text").alias("text"))


def any_sql(words: list[str], whole: bool = True) -> str:
    """Words as a pattern for SQL; whole words end where word characters (letters, digits, _) begin or end."""
    if not whole:
        return f"regexp_matches(text, '(?:{'|'.join(words)})')"
    edge = lambda c, at: f"({at}|[^{PYW[1:]})" if c.isalnum() or c == "_" else PYW
    return "(" + " OR ".join(f"regexp_matches(text, '{edge(w[0], '^')}{w}{edge(w[-1], '$')}')" for w in words) + ")"


# the script's operators on texts that hold it


@query(f"{MIXED} SELECT doc_id, CAST(least(5, CASE WHEN {any_sql(markers.PRONOUNS)} THEN 3 ELSE 0 END + CASE WHEN {any_sql(markers.VERBS, False)} THEN 2 ELSE 0 END + CASE WHEN {any_sql(markers.CASUAL, False)} THEN 2 ELSE 0 END + CASE WHEN {any_sql(markers.NEWS, False)} THEN 1 ELSE 0 END) AS INTEGER) AS score FROM m")
def tamil_modern_score(spark, d):
    groups = [(3, T.any_word(markers.PRONOUNS)), (2, T.any_word(markers.VERBS, False)), (2, T.any_word(markers.CASUAL, False)), (1, T.any_word(markers.NEWS, False))]
    return mixed(spark, d).select("doc_id", T.marker_score(F.col("text"), groups).alias("score"))


@query(f"{MIXED} SELECT doc_id, {any_sql(markers.DIALOGUE + markers.INFORMAL + markers.CONVERSATION, False)} AS casual, {any_sql(markers.COLLOQUIAL)} AS colloquial FROM m")
def tamil_casual_signs(spark, d):
    c = F.col("text")
    return mixed(spark, d).select("doc_id", T.casual_signs(c, markers.DIALOGUE, markers.INFORMAL, markers.CONVERSATION).alias("casual"), c.rlike(T.any_word(markers.COLLOQUIAL)).alias("colloquial"))


@query(f"{MIXED}, t AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(text, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{t}' END" for t, ws in markers.TOPICS.items()) + f"], lambda x: x IS NOT NULL) t FROM m) SELECT doc_id, CASE WHEN len(t) > 0 THEN t ELSE ['{markers.NO_TOPIC}'] END AS topics FROM t")
def tamil_topics(spark, d):
    return mixed(spark, d).select("doc_id", T.topics(F.col("text"), markers.TOPICS, markers.NO_TOPIC).alias("topics"))


@query(f"{MIXED}, g AS (SELECT {any_sql(markers.OLD, False)} AS o, {any_sql(markers.NEW, False)} AS n FROM m) SELECT CASE WHEN o AND n THEN 'mixed' WHEN o THEN 'old' WHEN n THEN 'modern' ELSE 'neutral' END AS style, count(*) AS n FROM g GROUP BY 1")
def tamil_style(spark, d):
    return report.style_counts(mixed(spark, d), markers.OLD, markers.NEW)


HEADED = "text"
for _h in markers.STICKY_HEADERS:
    HEADED = f"regexp_replace(regexp_replace(regexp_replace({HEADED}, '^(?:{_h})', ''), '^{WS}+', ''), '{WS}+$', '')"


@query(f"{MIXED}, c AS (SELECT doc_id, trim(regexp_replace({HEADED}, '{WS}+', ' ', 'g'), ' ') AS text FROM m) SELECT doc_id AS ord, sha256(text) AS h FROM c WHERE length(text) >= 20 QUALIFY row_number() OVER (PARTITION BY left(text, 200) ORDER BY doc_id) = 1")
def tamil_sticky_headers(spark, d):
    # told once of each text; a squeezed text's first 201 characters give its key of 200
    one = T.let(T.strip_prefixes(F.col("text"), markers.STICKY_HEADERS), lambda t: F.struct(F.length(t).alias("n"), F.sha2(t, 256).alias("h"), F.substring(t, 1, 201).alias("text")))
    rows = cut(mixed(spark, d).select(F.col("doc_id").alias("ord"), one.alias("x")).select("ord", "x.*")).where("n >= 20")
    return dedup.by_prefix(rows, 200).select("ord", "h")


@query(f"{MIXED} SELECT doc_id AS ord, {three(TFRAC)} AS fraction FROM m WHERE {TFRAC} >= 0.02")
def tamil_language(spark, d):
    rows = mixed(spark, d).withColumnRenamed("doc_id", "ord")
    return filters.filter_language(rows, 0.02).where(filters.any_script(F.col("text"))).select("ord", T.fraction3(F.col("text")).alias("fraction"))


@query(f"{MIXED} SELECT doc_id, len(regexp_extract_all(nfc_normalize(text), '(?s).[\\x{{bbe}}-\\x{{bcd}}]*')) AS n, sha256(array_to_string(regexp_extract_all(nfc_normalize(text), '(?s).[\\x{{bbe}}-\\x{{bcd}}]*'), '|')) AS h FROM m")
def tamil_aksharas(spark, d):
    a = T.aksharas(T.nfc("text"))
    return mixed(spark, d).select("doc_id", a.alias("a")).select("doc_id", F.size("a").cast("long").alias("n"), F.sha2(F.array_join("a", "|"), 256).alias("h"))


NAGARI = ["पक्षी आकाश में उड़ा।", "विद्यालय बड़ा है", "क्या हुआ", "no script"]


@query("WITH s(k, s) AS (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(NAGARI)) + "), m AS (SELECT doc_id, s || ' ' || text AS text FROM documents JOIN s ON doc_id % 4 = k) SELECT doc_id, sha256(array_to_string(regexp_extract_all(nfc_normalize(text), '(?s).(?:[\\x{93e}-\\x{94c}\\x{93c}\\x{900}-\\x{903}]|\\x{94d}[\\x{915}-\\x{939}]?)*'), '|')) AS h FROM m")
def devanagari_clusters(spark, d):
    s = F.element_at(F.array(*map(F.lit, NAGARI)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    t = T.nfc(F.concat(s, F.lit(" "), "text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.array_join(T.devanagari_clusters(t), "|"), 256).alias("h"))


# texts and records


@query(f"SELECT doc_id, {cleaned('text')} AS nfc, {clean4('text')} AS script, {clean5('text')} AS controls, trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') AS social, trim(regexp_replace(regexp_replace(text, 'https?://[^{WS[1:]}+', '', 'g'), '{WS}+', ' ', 'g'), ' ') AS no_links FROM documents")
def clean_variants(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.clean_nfc(c).alias("nfc"), T.clean_for_script(c, LATIN).alias("script"), T.clean_controls(c).alias("controls"), T.clean_social(c).alias("social"), T.clean_social(c, True).alias("no_links"))


SENT6 = f"list_filter(list_transform(regexp_split_to_array(text, '[\\x{{964}}!?.\\n]+'), lambda x: trim(regexp_replace(x, '{WS}+', ' ', 'g'), ' ')), lambda x: length(x) >= 6 AND length(x) <= 1000)"


@query(f"SELECT doc_id, len({SENT6}) AS n, sha256(array_to_string({SENT6}, chr(10))) AS h FROM documents")
def sentence_split_6_1000(spark, d):
    s = T.sentences(text, 5, 1000, True)
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.sha2(F.array_join(s, "\n"), 256).alias("h"))


@query(f"SELECT doc_id, {three(FRAC)} AS fraction, {NONSPACE} > 0 AND length(regexp_replace(text, '[^\\x{{41}}-\\x{{7a}}]', '', 'g')) >= 0.9 * {NONSPACE} AS mostly, length(text) > 0 AND {FRAC} >= 0.8 AS content, {FRAC} > 0.7 AS some FROM documents")
def fraction_predicates(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.fraction3(c, LATIN).alias("fraction"), T.mostly_script(c, 0.9, LATIN).alias("mostly"), T.script_content(c, 0.8, LATIN).alias("content"), T.some_script(c, 0.7, LATIN).alias("some"))


SENTENCES = f"SELECT unnest({SENT6}) AS text, doc_id FROM documents"


@query(f"WITH s AS ({SENTENCES}) SELECT doc_id, count(*) FILTER (WHERE {FRAC} >= 0.8) AS exact, count(*) FILTER (WHERE {three(FRAC)} >= 0.8) AS rounded FROM s GROUP BY 1")
def sentence_fraction_filters(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(T.sentences(text, 5, 1000, True)).alias("text"))
    c = F.col("text")
    flags = s.select("doc_id", T.script_fraction(c, LATIN).alias("f"), T.fraction3(c, LATIN).alias("r"))
    return flags.groupBy("doc_id").agg(F.count_if(F.col("f") >= 0.8).alias("exact"), F.count_if(F.col("r") >= 0.8).alias("rounded"))


@query(f"SELECT doc_id, {three('0.6::DOUBLE * least(1.0::DOUBLE, (' + WORDS + ') / 50) + 0.4::DOUBLE * (CASE WHEN ' + FRAC + ' > 0.6 THEN 1.0::DOUBLE ELSE ' + FRAC + ' END)')} AS quality_score, ({WORDS}) < 5 AS too_short, ({FRAC}) > 0.5 AS in_script FROM documents")
def score_quality(spark, d):
    got = table(spark, d, "documents").select("doc_id", T.score_quality(F.col("text"), LATIN).alias("s"))
    return got.select("doc_id", "s.quality_score", F.col("s.flags.too_short").alias("too_short"), F.col("s.flags.in_script").alias("in_script"))


@query(f"WITH c AS (SELECT doc_id, source, {clean4('text')} AS text FROM documents) SELECT doc_id AS url, sha256(text) AS id, coalesce(source, 'unknown') AS source, CASE WHEN regexp_matches(text, '[\\x{{41}}-\\x{{7a}}]') THEN 'la' ELSE 'unknown' END AS lang, CAST(length(text) AS INTEGER) AS char_count, CAST({WORDS} AS INTEGER) AS word_count FROM c")
def page_records(spark, d):
    docs = table(spark, d, "documents").select("text", "source", F.col("doc_id").alias("url"))
    return records.page_records(docs, LATIN, "la").drop("crawl_date", "text")


@query(f"SELECT doc_id AS url, left(sha256(text), 16) AS id, source, lang, CAST(length(text) AS INTEGER) AS char_count, CASE WHEN {NONSPACE} > 0 THEN length(regexp_replace(text, '[^\\x{{41}}-\\x{{7a}}]', '', 'g')) / {NONSPACE} ELSE 0.0 END AS tamil_fraction FROM documents")
def measured_records(spark, d):
    docs = table(spark, d, "documents").select("text", "source", "lang", F.col("doc_id").alias("url"))
    return records.measured_records(docs, LATIN, ("lang",)).drop("timestamp", "text")


@query("SELECT left(sha256(text), 16) AS id, source, doc_id AS url, CASE source WHEN 'src0' THEN 0.9::DOUBLE ELSE 0.8 END AS quality_score, sha256(text || doc_id) AS sentence_id FROM documents")
def plain_records(spark, d):
    docs = table(spark, d, "documents").select("text", "source", F.col("doc_id").cast("string").alias("url"))
    got = records.plain_records(docs, F.when(F.col("source") == "src0", 0.9).otherwise(0.8))
    return got.select("id", "source", F.col("url").cast("long").alias("url"), "quality_score", records.sentence_id(F.col("text"), F.col("url")).alias("sentence_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'x-user-defined' WHEN doc_id % 3 = 1 THEN 'iso-8859-1' ELSE 'utf-8' END AS charset, text FROM documents WHERE NOT regexp_matches(text, '[^\\x{0}-\\x{ff}]')")
def decoded_pages(spark, d):
    """Bytes of pages: UTF-8, Latin-1 that isn't UTF-8 (or is plain), and a declared font encoding."""
    docs = table(spark, d, "documents").where(~F.col("text").rlike(r"[^\x{0}-\x{ff}]"))
    kind = F.pmod("doc_id", F.lit(3))
    name = F.when(kind == 2, "x-user-defined").when(kind == 1, "ISO-8859-1").otherwise("utf-8")
    page = F.concat(F.lit('<meta charset = "'), name, F.lit('">'), "text", F.lit("\xe9"))
    content = F.when(kind == 0, F.encode(page, "UTF-8")).otherwise(F.encode(page, "ISO-8859-1"))
    got = docs.select("doc_id", content.alias("content"))
    body = F.regexp_extract(T.decoded(F.col("content")), r"(?s)^<meta[^>]*>(.*)\xe9$", 1)
    return got.select("doc_id", T.declared_charset(F.col("content")).alias("charset"), body.alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 AND length(regexp_replace(text, '[^\\x{80}-\\x{ff}]', '', 'g')) > 0.02 * length(text) THEN replace(text, 'e', 'E') ELSE text END AS text FROM documents")
def converted_legacy(spark, d):
    return table(spark, d, "documents").select("doc_id", T.convert_legacy(F.col("text"), lambda t: t.replace("e", "E")).alias("text"))


@query(f"{REC}, k AS (SELECT ord, text FROM rec WHERE ({REASON}) IS NULL AND {FRAC} >= 0.8) SELECT ord, sha256({SCRUB}) AS h, {SCRUB} <> text AS had_pii FROM k")
def apply_all_filters(spark, d):
    return filters.apply_all(base_records(spark, d), LATIN, 0.8).select("ord", F.sha2("text", 256).alias("h"), "had_pii")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE {FRAC} >= 0.8) AS kept, count(*) FILTER (WHERE {FRAC} < 0.8) AS removed, count(*) FILTER (WHERE {FRAC} < 0.8) / count(*) AS removal_rate, round(avg({FRAC}), 9) AS avg_fraction FROM documents")
def language_stats(spark, d):
    return filters.language_stats(base_records(spark, d), 0.8, LATIN).withColumn("avg_fraction", F.round("avg_fraction", 9))


@query(f"SELECT doc_id, length(text) BETWEEN 20 AND 2000 AND {FRAC} >= 0.7 AS post, length(text) BETWEEN 15 AND 1000 AND {FRAC} >= 0.75 AS tweet FROM documents")
def acceptable_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", filters.acceptable(20, 2000, 0.7, LATIN).alias("post"), filters.acceptable(15, 1000, 0.75, LATIN).alias("tweet"))


@query("SELECT conv_id, turn FROM conversations WHERE NOT (turn % 3 = 1 OR turn % 5 = 4)")
def drop_deleted(spark, d):
    body = F.when(F.col("turn") % 3 == 1, "[deleted]").when(F.col("turn") % 5 == 4, "[removed]").otherwise(F.col("text"))
    return filters.drop_deleted(table(spark, d, "conversations").withColumn("body", body)).select("conv_id", "turn")


@query("SELECT min(doc_id) AS ord FROM documents GROUP BY left(sha256(text), 16)")
def id_dedup(spark, d):
    return dedup.by_id(base_records(spark, d).withColumn("id", records.short_id(F.col("text")))).select("ord")


@query(f"WITH c AS (SELECT doc_id, {SOCIAL.replace('raw', 'text')} AS text FROM documents) SELECT min(doc_id) AS ord FROM c GROUP BY sha256(text)")
def social_dedup(spark, d):
    rows = base_records(spark, d).withColumn("text", T.clean_social(F.col("text")))
    return dedup.by_id(rows.withColumn("id", records.full_id(F.col("text")))).select("ord")


@query(f"{REC}, u AS (SELECT *, row_number() OVER (PARTITION BY left({STRIP}, 512) ORDER BY ord) r FROM rec WHERE {STRIP} <> '') SELECT row_number() OVER (ORDER BY coalesce(quality_score, 0) DESC, ord) - 1 AS place, ord FROM u WHERE r = 1")
def merge_dedup_by_quality(spark, d):
    rows = dedup.by_prefix(base_records(spark, d), 512)
    return select.ranked(rows, F.coalesce("quality_score", F.lit(0.0)).desc(), F.col("ord"), name="place").select("place", "ord")


# near-dup by md5 over the conversations, which SQL can tell

MD5 = f"""WITH RECURSIVE n AS (SELECT ord, {NORM} AS t FROM (SELECT conv_id * 1000 + turn * 2 AS ord, text FROM conversations UNION ALL SELECT conv_id * 1000 + turn * 2 + 1, CASE conv_id % 3 WHEN 0 THEN '  ' || text ELSE text || ' and some more words' END FROM conversations WHERE turn % 2 = 0)),
f AS (SELECT ord, t FROM n QUALIFY row_number() OVER (PARTITION BY t ORDER BY ord) = 1),
g AS (SELECT DISTINCT ord, substr(t, i, 5) AS s FROM (SELECT ord, t, unnest(range(1, greatest(1, length(t) - 4) + 1)) AS i FROM f)),
h AS (SELECT ord, i, min(md5((42 + i) || s)) AS m FROM g, range(32) r(i) GROUP BY 1, 2),
sig AS (SELECT ord, list(CAST(('0x' || right(m, 8)) AS BIGINT) ORDER BY i) AS sig FROM h GROUP BY 1),
p AS (SELECT a.ord AS a, b.ord AS b, len(list_filter(range(1, 33), lambda i: a.sig[i] = b.sig[i])) / 32 AS sim FROM sig a JOIN sig b ON a.ord < b.ord WHERE len(list_filter(range(1, 33), lambda i: a.sig[i] = b.sig[i])) >= 0.5 * 32)"""


def talks(spark: SparkSession, d: str) -> DataFrame:
    """The conversations, every second turn with a copy (after blanks) or a near copy after it."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") * 2).alias("ord"), "text", F.col("role").alias("source"), "conv_id", "turn")
    again = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("  "), "text")).otherwise(F.concat("text", F.lit(" and some more words")))
    return c.unionByName(c.where("turn % 2 = 0").withColumns({"ord": F.col("ord") + 1, "text": again})).select("ord", "text", "source")


def talk_signatures(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact(talks(spark, d)).select("ord", neardup.signature(F.col("text"), 32).alias("sig"))


@query(f"{MD5} SELECT ord, sig FROM sig")
def minhash_md5_signature(spark, d):
    return talk_signatures(spark, d)


@query(f"{MD5} SELECT a, b, sim FROM p")
def near_dup_pairs_md5(spark, d):
    return neardup.pairs(cut(talk_signatures(spark, d)), 32, 0.5)


KEPT = f"""{MD5}, o AS (SELECT b, list(a) AS near, row_number() OVER (ORDER BY b) AS k FROM p GROUP BY b),
w(k, gone) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT w.k + 1, CASE WHEN len(list_filter(o.near, lambda a: NOT list_contains(w.gone, a))) > 0 THEN list_append(w.gone, o.b) ELSE w.gone END FROM w JOIN o ON o.k = w.k + 1),
x AS (SELECT gone FROM w ORDER BY k DESC LIMIT 1),
dup AS (SELECT o.b AS ord, list_min(list_filter(o.near, lambda a: NOT list_contains(x.gone, a))) AS dup_of FROM o, x WHERE list_contains(x.gone, o.b))"""
KEEP = "SELECT n.ord AS ord, coalesce(dup.dup_of, CASE WHEN f.ord < n.ord THEN f.ord END) AS dup_of, CASE WHEN dup.dup_of IS NOT NULL THEN 'near' WHEN f.ord < n.ord THEN 'exact' END AS kind FROM n JOIN f USING (t) LEFT JOIN dup ON dup.ord = f.ord"


@query(f"{KEPT} {KEEP}")
def near_dup_keep_md5(spark, d):
    return neardup.near_dedup(talks(spark, d), 0.5, 32).select("ord", "dup_of", "kind")


@query(f"""{KEPT}, s AS ({KEEP}) SELECT count(*) AS total_seen, count(*) FILTER (WHERE kind = 'exact') AS exact, count(*) FILTER (WHERE kind = 'near') AS near, count(*) FILTER (WHERE kind IS NULL) AS kept, count(kind) AS removed, count(kind) / count(*) AS removal_rate FROM s""")
def near_dup_stats_md5(spark, d):
    return neardup.dedup_stats(neardup.near_dedup(talks(spark, d), 0.5, 32))


@query(f"{MD5} SELECT a.ord AS a, b.ord AS b, len(list_filter(range(1, 33), lambda i: a.sig[i] = b.sig[i])) / 32 AS sim FROM sig a JOIN sig b ON b.ord = a.ord + 1")
def signature_similarity(spark, d):
    s = cut(talk_signatures(spark, d))
    met = s.select(F.col("ord").alias("a"), F.col("sig").alias("s1")).join(s.select(F.col("ord").alias("b"), F.col("sig").alias("s2")), F.col("b") == F.col("a") + 1)
    return met.select("a", "b", T.similarity(F.col("s1"), F.col("s2")).alias("sim"))


# reports


@query(f"""{REC}, e AS (SELECT min(length(text))::DOUBLE lo, max(length(text))::DOUBLE hi FROM documents),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(9, floor((length(text) - lo) / ((hi - lo) / 10))) END AS BIGINT) AS bin, count(*) AS n FROM documents, e GROUP BY 1),
s AS (SELECT source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 5)
SELECT (SELECT count(*) FROM rec) AS documents, (SELECT CAST(sum(length(text)) AS BIGINT) FROM rec) AS chars, (SELECT string_agg(source, ',' ORDER BY n DESC, f) FROM s) AS sources, (SELECT round(avg(quality_score), 9) FROM rec) AS avg_quality,
(SELECT round(avg({FRAC}), 9) FROM rec WHERE text <> '') AS avg_fraction, (SELECT string_agg(bin || ':' || n, ',' ORDER BY bin) FROM b) AS lengths, (SELECT count(*) FROM rec WHERE {SCRUB} <> text OR contains(text, '[URL]')) AS with_any""")
def validate_all(spark, d):
    got = report.validate_all(base_records(spark, d), LATIN)
    bins = F.array_join(F.transform(F.map_entries("lengths"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return got.select("totals.documents", "totals.chars", F.array_join("sources", ",").alias("sources"), F.round("quality.avg_quality", 9).alias("avg_quality"), F.round("language.avg_fraction", 9).alias("avg_fraction"), bins.alias("lengths"), "pii.with_any")


@query(f"SELECT avg(length(text)) AS mean, median(length(text)) AS median, round(avg(CASE WHEN {COLLOQUIAL} THEN 1 ELSE 0 END), 9) AS colloquial, (SELECT sha256(string_agg(text, '|' ORDER BY doc_id)) FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 20)) AS h FROM documents")
def sample_check(spark, d):
    rows = base_records(spark, d).withColumn("is_colloquial", _casual(F.col("text"), F.col("source")))
    return report.sample_check(rows).select("mean", "median", F.round("colloquial", 9).alias("colloquial"), F.sha2(F.array_join("samples", "|"), 256).alias("h"))


@query(f"{REC}, a AS (SELECT source, avg(coalesce(quality_score, 0)) q FROM rec WHERE lang = 'en' GROUP BY 1), b AS (SELECT source, avg(coalesce(quality_score, 0)) q FROM rec WHERE lang <> 'en' GROUP BY 1) SELECT coalesce(a.source, b.source) AS source, round(coalesce(a.q, 0), 9) AS q_old, round(coalesce(b.q, 0), 9) AS q_new, round(coalesce(b.q, 0) - coalesce(a.q, 0), 9) AS delta FROM a FULL JOIN b ON a.source = b.source")
def quality_deltas(spark, d):
    r = base_records(spark, d)
    return report.quality_deltas(r.where("lang = 'en'"), r.where("lang <> 'en'")).select("source", *[F.round(c, 9).alias(c) for c in ("q_old", "q_new", "delta")])


@query("SELECT CASE WHEN lang = 'en' THEN 'old' ELSE 'new' END AS corpus, count(*) AS n, count(*) FILTER (WHERE source IN ('src0', 'src2')) AS modern, count(*) FILTER (WHERE source NOT IN ('src0', 'src2')) AS classical, round(100 * count(*) FILTER (WHERE source IN ('src0', 'src2')) / count(*), 1) AS modern_percent FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def split_shares(spark, d):
    r = base_records(spark, d)
    return report.split_shares(r.where("lang = 'en'"), r.where("lang <> 'en'"), ["src0", "src2"])


@query(f"{MIXED} SELECT count(*) AS n, count(*) FILTER (WHERE {any_sql(markers.CONVERSATION, False)}) AS casual, round(100 * count(*) FILTER (WHERE {any_sql(markers.CONVERSATION, False)}) / count(*), 1) AS casual_percent, round(avg({TFRAC}), 9) AS avg_fraction, 0.5::DOUBLE AS avg_quality FROM m")
def casual_share(spark, d):
    rows = mixed(spark, d).withColumn("quality_score", F.lit(0.5)).withColumn("tamil_fraction", T.script_fraction(F.col("text")))
    return report.casual_share(rows, T.casual_signs(F.col("text"), markers.CONVERSATION)).withColumn("avg_fraction", F.round("avg_fraction", 9))


@query(f"{REC}, m AS (SELECT quality_score, CASE WHEN contains(text, 'tion') THEN 2 ELSE 0 END AS s FROM rec) SELECT round(avg(quality_score), 9) AS avg_quality, round(avg(s), 9) AS avg_modern, round(avg(CASE WHEN s > 0 THEN 1 ELSE 0 END), 9) AS modern_share FROM m")
def modern_metrics(spark, d):
    rows = base_records(spark, d).withColumn("modern_score", F.when(F.col("text").contains("tion"), 2).otherwise(0))
    return report.modern_metrics(rows).select(*[F.round(c, 9).alias(c) for c in ("avg_quality", "avg_modern", "modern_share")])


@query(f"""{MIXED}, a AS (SELECT doc_id, unnest(regexp_extract_all(nfc_normalize(text), '(?s).[\\x{{bbe}}-\\x{{bcd}}]*')) AS token FROM m), c AS (SELECT token, count(*) AS n FROM a WHERE doc_id % 10 <> 0 GROUP BY 1),
p AS (SELECT token, (n + 1) / ((SELECT sum(n) FROM c) + (SELECT count(*) FROM c)) AS p FROM c) SELECT count(*) AS scored, round(exp(-avg(ln(p))), 4) AS perplexity FROM a JOIN p USING (token) WHERE doc_id % 10 = 0""")
def akshara_perplexity(spark, d):
    rows, clusters = mixed(spark, d), T.aksharas(T.nfc("text"))
    counts = tokenizer.unigram(rows.where("doc_id % 10 <> 0"), clusters)
    return tokenizer.unigram_perplexity(rows.where("doc_id % 10 = 0"), counts, clusters).withColumn("perplexity", F.round("perplexity", 4))


@query("SELECT round(exp(least(sum(l_extendedprice / 1e4) / sum(l_quantity), 20)), 6) AS perplexity FROM lineitem")
def model_perplexity(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1e4).alias("nll"), F.col("l_quantity").alias("tokens"))
    return report.perplexity(rows).withColumn("perplexity", F.round("perplexity", 6))


@query(f"""{REC}, u AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY sha256({NORM}) ORDER BY ord) = 1), q AS (SELECT * FROM u WHERE ({REASON}) IS NULL)
SELECT 'ingested' AS stage, count(*) AS n FROM rec UNION ALL SELECT 'deduplicated', count(*) FROM u UNION ALL SELECT 'quality', count(*) FROM q UNION ALL SELECT 'language', count(*) FROM q WHERE {FRAC} >= 0.5""")
def curation_report(spark, d):
    return pipelines.curate(base_records(spark, d), pipelines.Curation(near=False, script=LATIN, min_fraction=0.5))[1]


@query("SELECT event_id, round(avg(value) OVER w, 6) AS value_mean, max(value) OVER w AS value_max FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS 9 PRECEDING)")
def rolling_metrics(spark, d):
    rows = table(spark, d, "events").withColumn("ord", F.struct("ts", "event_id"))
    return report.rolling(rows, "value", 10, ["event_type", "user_id"]).select("event_id", F.round("value_mean", 6).alias("value_mean"), "value_max")


@query("SELECT p, list_sort((SELECT list(value) FROM events WHERE value IS NOT NULL))[least(len((SELECT list(value) FROM events WHERE value IS NOT NULL)) - 1, CAST(floor(len((SELECT list(value) FROM events WHERE value IS NOT NULL)) * p / 100) AS BIGINT)) + 1] AS value FROM (VALUES (50), (95), (99)) t(p)")
def latency_percentiles(spark, d):
    events = table(spark, d, "events")
    return spark.createDataFrame([(p, report.percentile(events, "value", p)) for p in (50, 95, 99)], "p int, value double")


# selection


@query(f"{REC} SELECT ord FROM rec ORDER BY coalesce(quality_score, 0) DESC, length(text) DESC, ord LIMIT 150")
def best_and_longest(spark, d):
    return select.best_and_longest(base_records(spark, d), 150).select("ord")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN k < floor(n * 0.8) THEN 'train' WHEN k < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)")
def seeded_split(spark, d):
    return select.split(base_records(spark, d), 42).select("id", "split")


@query("SELECT doc_id AS ord FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def random_rows(spark, d):
    return select.random_rows(base_records(spark, d), 50).select("ord")


U = "(CAST(('0x' || left(md5('42:' || {}), 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0"


@query(f"SELECT doc_id AS ord FROM documents ORDER BY -ln({U.format('doc_id')}) / greatest(length(text), 1e-12), doc_id LIMIT 60")
def sample_without_replacement(spark, d):
    return select.sample_without_replacement(base_records(spark, d), 60, F.length("text")).select("ord")


@query(f"""{REC}, w AS (SELECT ord, greatest(coalesce(quality_score, 1.0) * (1 + ord % 3), 1e-9)::DOUBLE AS w FROM rec), c AS (SELECT ord, sum(w) OVER (ORDER BY ord) AS e, w FROM w),
u AS (SELECT {U.format('i')} * (SELECT sum(w) FROM w) AS u FROM range(300) r(i)) SELECT ord, count(*) AS n FROM c JOIN u ON u > e - w AND u <= e GROUP BY 1""")
def weighted_sample(spark, d):
    rows = base_records(spark, d).withColumn("weight", (1 + F.col("ord") % 3).cast("double"))
    return select.weighted_sample(rows, 300).groupBy("ord").agg(F.count("*").alias("n"))


@query("SELECT e AS epoch, (k // 16)::BIGINT AS batch_id, (k % 16)::BIGINT AS place, doc_id AS seq_id FROM (SELECT e, doc_id, row_number() OVER (PARTITION BY e ORDER BY md5((7 + e) || ':' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY e) AS n FROM documents, (VALUES (0), (1)) v(e)) WHERE k < n - n % 16")
def batch_assign(spark, d):
    seqs = base_records(spark, d).select(F.col("ord").alias("seq_id"))
    return select.batches(seqs, 16, seed=7, epochs=2).select("epoch", "batch_id", "place", "seq_id")


UNI = f"""{NAMED_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY left({STRIP}, 256) ORDER BY ord) r FROM n WHERE ord % 2 = 0 AND {STRIP} <> ''),
a AS (SELECT 0 part, ord, text, source, quality_score FROM m WHERE r = 1 UNION ALL SELECT 1, ord, text, source, quality_score FROM n WHERE ord % 2 = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY left({STRIP}, 256) ORDER BY part, ord) r2 FROM a WHERE {STRIP} <> '')"""


@query(f"{UNI} SELECT id FROM (SELECT ord AS id, part, coalesce(quality_score, 0.5) q, CASE source WHEN 'news' THEN 2.0::DOUBLE ELSE 1.0 END w FROM o WHERE r2 = 1) ORDER BY w * q DESC, q DESC, part, id LIMIT 200")
def unified_corpus(spark, d):
    """Modern rows deduplicated, the others added, weighted, deduplicated again, the best kept."""
    rows = _named(spark, d).withColumn("own", F.col("ord"))
    got = pipelines.unify([rows.where("ord % 2 = 0")], rows.where("ord % 2 = 1"), {"news": 2.0}, 200)
    return got.select(F.col("own").alias("id"))


# tokenizer


@query(r"""WITH c AS (SELECT doc_id, string_split(nfc_normalize(text), '') AS x FROM documents WHERE text <> '') SELECT doc_id, CAST(len(x) AS BIGINT) AS n, sha256(array_to_string(list_transform(x, lambda c: CASE WHEN c = ' ' THEN '5' ELSE '3' END), ',')) AS h FROM c""")
def encode_base(spark, d):
    """Ids of the untrained tokenizer: the word mark for blanks, unknown for what is outside its script."""
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", tokenizer.encode(F.col("text"), tokenizer.Tokenizer.base()).alias("ids"))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("h"))


@query("SELECT doc_id, ids, mask, list_transform(ids, lambda i: CASE WHEN i <> 0 THEN 1 ELSE 0 END) AS not_pad FROM (SELECT doc_id, list_transform(range(1, 9), lambda i: CASE WHEN i <= doc_id % 11 THEN CAST(i % 3 AS INTEGER) ELSE 0 END) AS ids, list_transform(range(1, 9), lambda i: CASE WHEN i <= doc_id % 11 THEN 1 ELSE 0 END) AS mask FROM documents)")
def padded_ids(spark, d):
    n = F.pmod("doc_id", F.lit(11)).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: i % 3)).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "documents").select("doc_id", tokenizer.pad(ids, 8).alias("p")).select("doc_id", "p.ids", "p.mask", "p.not_pad")


@query(r"""WITH c AS (SELECT doc_id, string_split(nfc_normalize(text), '') AS x FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 500) WHERE text <> ''),
f AS (SELECT CASE WHEN b > 0 THEN t / b ELSE 0 END AS f FROM (SELECT len(list_filter(x, lambda c: c <> ' ')) AS t, len(list_filter(x, lambda c: NOT regexp_matches(c, '[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'))) AS b FROM c)) SELECT round(avg(f), 9) AS fertility FROM f WHERE f > 0""")
def base_fertility(spark, d):
    value = tokenizer.fertility(base_records(spark, d), tokenizer.Tokenizer.base())
    return spark.createDataFrame([(round(value, 9),)], "fertility double")


@query()
def trained_tokenizer(spark, d):
    """Merges learned from the Tamil table, in order, and the pieces of its sentences."""
    tok = tokenizer.train(tamil(spark), 460)
    rows = tamil(spark).where(f"ord < {len(TAMIL)}").select("ord", tokenizer.encode(F.col("text"), tok).alias("ids"))
    return rows.select("ord", F.size("ids").alias("n"), F.lit(len(tok.merges)).alias("merges"), F.array_join("ids", ",").alias("ids"))


@query("SELECT CAST(doc_id AS BIGINT) AS ord, CAST(2 + doc_id % 50 AS BIGINT) AS length, CAST(coalesce(sum(2 + doc_id % 50) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents")
def stream_offsets(spark, d):
    return packing.offsets(base_records(spark, d), (2 + F.col("ord") % 50))


SIGNS = "list_transform(range({}, {}), lambda i: chr(CAST(i AS INTEGER)))"


def inventory_sql(script: str, vowels: list[str], consonants: list[str], extra: str, killer: str, signs: str) -> str:
    return f"SELECT '{script}' AS script, row_number() OVER () - 1 AS place, x AS piece FROM (SELECT unnest(list_concat({vowels}, {extra}, flatten(list_transform({consonants}, lambda c: list_concat([c, c || '{killer}'], list_transform({signs}, lambda s: c || s)))))) AS x)"


@query(inventory_sql("tamil", tokenizer.TAMIL_VOWELS, tokenizer.TAMIL_CONSONANTS, "['\u0b83']", "\u0bcd", SIGNS.format(0xBBE, 0xBCD)) + " UNION ALL " + inventory_sql("devanagari", tokenizer.DEVANAGARI_VOWELS, tokenizer.DEVANAGARI_CONSONANTS, SIGNS.format(0x966, 0x970), "\u094d", SIGNS.format(0x93E, 0x94D)))
def tokenizer_inventory(spark, d):
    rows = [(script, k, piece) for script in ("tamil", "devanagari") for k, piece in enumerate(tokenizer.inventory(script))]
    return spark.createDataFrame(rows, "script string, place long, piece string")


BASE_VOCAB = inventory_sql("tamil", tokenizer.TAMIL_VOWELS, tokenizer.TAMIL_CONSONANTS, "['\u0b83']", "\u0bcd", SIGNS.format(0xBBE, 0xBCD))


@query(f"SELECT token, CAST(id AS INTEGER) AS id, false AS merged FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {k})' for k, t in enumerate([*tokenizer.SPECIALS, tokenizer.MARK]))}) v(token, id) UNION ALL SELECT piece, CAST(place + {len(tokenizer.SPECIALS) + 1} AS INTEGER), false FROM ({BASE_VOCAB})")
def tokenizer_files(spark, d):
    """vocab.json and merges of a tokenizer, written and read back."""
    path = landing(spark)
    tokenizer.Tokenizer.base().to_files(spark, f"{path}/vocab.json", f"{path}/merges.txt")
    tok = tokenizer.Tokenizer.from_files(spark, f"{path}/vocab.json", f"{path}/merges.txt")
    made = {a + b for a, b in tok.merges}
    return spark.createDataFrame([(t, i, t in made) for t, i in tok.vocab.items()], "token string, id int, merged boolean")


@query(f"{MIXED} SELECT doc_id, round({TFRAC}, 9) AS fraction, sha256({NORM}) AS k, sha256({SCRUB}) AS scrubbed, len(regexp_extract_all(nfc_normalize(text), '(?s).[\\x{{bbe}}-\\x{{bcd}}]*')) AS clusters, round(0.6 * least(1.0::DOUBLE, ({WORDS}) / 50) + 0.4 * (CASE WHEN {TFRAC} > 0.6 THEN 1.0::DOUBLE ELSE {TFRAC} END), 9) AS score FROM m")
def registered_functions(spark, d):
    """The SQL functions that `register` gives."""
    register(spark)
    mixed(spark, d).createOrReplaceTempView("_mixed")
    return spark.sql("SELECT doc_id, round(target_fraction(text), 9) AS fraction, content_hash(text) AS k, sha2(scrub_pii(text), 256) AS scrubbed, CAST(size(aksharas(text)) AS BIGINT) AS clusters, round(quality_score(text), 9) AS score FROM _mixed")
