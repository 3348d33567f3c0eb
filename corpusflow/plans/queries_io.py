"""Registered queries over sources, sinks and streams: the driver's tables are landed in the shared folder in each format and read back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import html
from corpusflow.functions import text as T
from corpusflow.operators import packing, records, report, select
from corpusflow.plans.queries import FRAC, LAT, LATIN, REASON, REC, SCRUB, SENT, STRIP, TOKENS, WS, _tokens, query, text
from corpusflow.plans.queries import records as base_records
from corpusflow.session import shared_dir, table
from corpusflow.sources import readers, writers
from corpusflow.sources.files import exists, put_text
from corpusflow.streaming import streams


def landing(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def three(x: str) -> str:
    """Three places, rounded on the exact binary value."""
    return f"CAST(format('{{:.3f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def counted(df: DataFrame) -> DataFrame:
    return df.groupBy("text").agg(F.count("*").alias("n"))


def cleaned(x: str) -> str:
    return strip_sql(f"nfc_normalize({x})")


@query(f"SELECT t AS text, count(*) AS n FROM (SELECT {cleaned('l')} AS t FROM (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS l FROM documents)) WHERE t <> '' GROUP BY 1")
def read_text_lines(spark, d):
    path = landing(spark)
    table(spark, d, "documents").select("text").write.text(path)
    return counted(readers.documents(spark, path))


@query(f"SELECT t AS text, count(*) AS n FROM (SELECT {cleaned('text')} AS t FROM documents) WHERE t <> '' GROUP BY 1")
def read_json_texts(spark, d):
    """Texts under different keys, some behind a number or a blank that is not a text."""
    path, docs = landing(spark), table(spark, d, "documents")
    for k, columns in enumerate(([text], [F.col(text).alias("content")], [F.lit(5).alias("text"), F.col(text).alias("body")], [F.array(F.lit("x")).alias("content"), F.col(text).alias("tamil"), F.lit("y").alias("other")])):
        docs.where(F.pmod("doc_id", F.lit(4)) == k).select(*columns).write.json(f"{path}/{k}")
    return counted(readers.documents(spark, path))


@query(f"SELECT t AS text, count(*) AS n FROM (SELECT {cleaned('text')} AS t FROM conversations) WHERE t <> '' GROUP BY 1")
def read_json_whole_documents(spark, d):
    """line_documents off: JSON lines stay lines, text files are one document each (here one file of one JSON line each row)."""
    path = landing(spark)
    table(spark, d, "conversations").select(text).write.json(path)
    return counted(readers.documents(spark, path, line_documents=False))


@query(f"{REC} SELECT ord, source, quality_score, sha256(text) AS h FROM rec")
def read_records(spark, d):
    path = landing(spark)
    base_records(spark, d).write.option("ignoreNullFields", "false").json(path)
    return readers.records(spark, path, "ord long, text string, source string, quality_score double").select("ord", "source", "quality_score", F.sha2(text, 256).alias("h"))


@query(f"{REC} SELECT 'corpus_' || coalesce(source, CASE ord % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END) AS source, coalesce(quality_score, 1.0::DOUBLE) AS quality_score, 1.0::DOUBLE AS weight, sha256(text) AS h FROM rec WHERE text <> ''")
def read_split_corpus(spark, d):
    path = landing(spark)
    for k, split in enumerate(("train", "validation", "test")):
        base_records(spark, d).where(F.pmod("ord", F.lit(3)) == k).select("text", "source", "quality_score").write.json(f"{path}/{split}.jsonl")
    return readers.split_corpus(spark, path).select("source", "quality_score", "weight", F.sha2(text, 256).alias("h"))


PACKS = ["security", "culture", "legal", "misc", "education"]


@query("""WITH p AS (SELECT n_nationkey k, ['security', 'culture', 'legal', 'misc', 'education'][n_regionkey + 1] AS domain, CASE n_regionkey WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 2.5 WHEN 3 THEN 1.0 ELSE 2.0 END AS w, 'one ' || n_name AS ta, CASE WHEN n_nationkey % 2 = 0 THEN 'two ' || n_name END AS en FROM nation),
u AS (SELECT k, domain, ta AS text, w FROM p UNION ALL SELECT k, domain, en, w * 0.3 FROM p WHERE en IS NOT NULL)
SELECT text, 'pack_' || domain AS source, CASE WHEN k % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0 END AS quality_score, round(w, 6) AS weight FROM u""")
def read_knowledge_packs(spark, d):
    path, packs = landing(spark), {}
    for r in table(spark, d, "nation").collect():  # a constant table
        one = {"ta": f"one {r.n_name}", "en": f"two {r.n_name}" if r.n_nationkey % 2 == 0 else None} | ({"quality_score": 0.5} if r.n_nationkey % 3 == 0 else {})
        packs.setdefault(PACKS[r.n_regionkey], []).append(one)
    for k, (domain, rows) in enumerate(sorted(packs.items())):
        put_text(spark, f"{path}/{domain}_pack.json", json.dumps(rows if k % 2 else {"conversations": rows}))
    return readers.knowledge_packs(spark, path).withColumn("weight", F.round("weight", 6))


QA = "SELECT trim(u.text || ' ' || a.text, ' ') AS text, 'http://c/' || u.conv_id AS url, 'qa' AS source, 0.75::DOUBLE AS quality_score FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"


@query(QA)
def read_question_answers(spark, d):
    c, path = table(spark, d, "conversations"), landing(spark)
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = c.where("role = 'user'").join(a, ["conv_id", "turn"])
    url = F.concat(F.lit("http://c/"), "conv_id")
    for k, (q, answer, link) in enumerate((("question", "response", "url"), ("q", "a", "source_url"))):
        both.where(F.pmod("conv_id", F.lit(2)) == k).select(F.col("text").alias(q), F.col("answer").alias(answer), url.alias(link)).write.json(f"{path}/{k}")
    return readers.question_answers(spark, [path], by_line=True).select("text", "url", "source", "quality_score")


@query(f"""{REC}, c AS (SELECT unnest(string_split(string_agg(text, chr(10) || chr(10)), chr(10) || chr(10))) AS text FROM conversations GROUP BY conv_id, turn),
u AS (SELECT {STRIP} AS text, 'collection-' || source AS source, coalesce(quality_score, 0.85::DOUBLE) AS quality_score FROM rec UNION ALL SELECT {STRIP}, 'collection', 0.85 FROM c)
SELECT source, quality_score, count(*) AS n, count(DISTINCT text) AS texts FROM u WHERE text <> '' GROUP BY 1, 2""")
def read_text_collection(spark, d):
    path = landing(spark)
    base_records(spark, d).select(F.col("text").alias("content"), F.col("source").alias("category"), F.col("quality_score").cast("string")).write.json(f"{path}/json")
    table(spark, d, "conversations").select("text").write.option("lineSep", "\n\n").text(f"{path}/plain")
    got = readers.text_collection(spark, [f"{path}/json", f"{path}/plain/*.txt"], by_line=True)
    return got.groupBy("source", "quality_score").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"))


@query("""SELECT CASE r WHEN 0 THEN 'lyric-a-' || k WHEN 1 THEN 'own-b-' || k WHEN 2 THEN 'works-classical-txt-c' || n WHEN 3 THEN 'works-classical-d' || n ELSE 'works-classical-e-' || k END AS id, 'text of ' || name AS text,
CASE r WHEN 0 THEN 'works-lyric' WHEN 1 THEN 'own' ELSE 'works-classical' END AS source, CASE WHEN r = 0 THEN 'http://w/' || n END AS url, CASE WHEN r = 1 THEN 0.4::DOUBLE ELSE 0.9 END AS quality_score
FROM (SELECT n_nationkey n, n_regionkey r, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)""".replace("'lyric-a-'", "'works-lyric-a-'"))
def read_works(spark, d):
    """JSON, JSON lines, plain texts and XML in subfolders; a file of one JSON object; a bad line."""
    path, by = landing(spark), {}
    for r in sorted(table(spark, d, "nation").collect()):  # a constant table
        by.setdefault(r.n_regionkey, []).append(r)
    put_text(spark, f"{path}/x/a.json", json.dumps([{"text": f" text of {r.n_name}", "category": "lyric", "source_url": f"http://w/{r.n_nationkey}"} for r in by[0]]))
    put_text(spark, f"{path}/x/y/b.jsonl", "\n".join(json.dumps({"content": f"text of {r.n_name} ", "source": "own", "quality_score": 0.4}) for r in by[1]) + "\nno json\n")
    for r in by[2]:
        put_text(spark, f"{path}/c{r.n_nationkey}.txt", f"\n text of {r.n_name}\n")
    for r in by[3]:
        put_text(spark, f"{path}/z/d{r.n_nationkey}.xml", f"<w><t>text <i>of</i></t> <n> {r.n_name} </n><e/></w>")
    put_text(spark, f"{path}/e.jsonl", "\n".join(json.dumps({"text": "", "body": f"text of {r.n_name}"}) for r in by[4]))
    return readers.works(spark, path)


@query("SELECT 'n' || n_nationkey AS id, n_name AS text, 'service' AS source, CASE WHEN n_nationkey % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5 END AS quality_score FROM nation")
def read_api_records(spark, d):
    rows = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("text"), F.when(F.col("n_nationkey") % 2 == 1, 0.5).alias("quality_score"))
    return readers.api_records(rows, "service").select("id", "text", "source", "quality_score")


@query(f"SELECT 'social' AS source, 0.6::DOUBLE AS quality_score, {strip_sql(chr(39) + 'A' + chr(39) + ' || text')} AS text FROM conversations WHERE length({strip_sql(chr(39) + 'A' + chr(39) + ' || text')}) > 15")
def read_social(spark, d):
    path = landing(spark)
    table(spark, d, "conversations").select(F.concat(F.lit(" tamil Atamil "), "text").alias("text"), F.lit("x").alias("source")).write.json(path)
    return readers.social(spark, path).select("source", "quality_score", "text")


@query(f"SELECT text, count(*) AS n FROM (SELECT unnest({SENT}) AS text FROM documents) WHERE length(text) > 20 AND length(text) < 400 GROUP BY 1")
def read_news(spark, d):
    path = landing(spark)
    table(spark, d, "documents").select("text").write.option("lineSep", "\n\n").text(path)
    return counted(readers.news(spark, path))


@query("SELECT 'say ' || n_name AS text, 'modern_conversational' AS source, 0.7::DOUBLE AS quality_score, 1.0::DOUBLE AS tamil_fraction FROM nation WHERE length('say ' || n_name) > 10")
def read_phrases(spark, d):
    path = f"{landing(spark)}/phrases.yaml"
    names = [r.n_name for r in sorted(table(spark, d, "nation").collect())]  # a constant table
    put_text(spark, path, "phrases:\n" + "".join(f'  - "say {n}"\n' if k % 2 else f"  - say {n}\n" for k, n in enumerate(names)) + "  - 'short'\n")
    return readers.phrase_table(spark, path)


@query("SELECT row_number() OVER (ORDER BY part, a, b) - 1 AS ord, text FROM (SELECT 0 part, doc_id a, 0 b, text FROM documents WHERE length(text) > 50 UNION ALL SELECT 1, conv_id, turn, text FROM conversations WHERE length(text) > 40) ORDER BY 1 LIMIT 700")
def read_candidates(spark, d):
    first = table(spark, d, "documents").select(F.struct(F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b")).alias("ord"), "text")
    second = table(spark, d, "conversations").select(F.struct(F.col("conv_id").alias("a"), F.col("turn").alias("b")).alias("ord"), "text")
    return readers.candidates([(first, 50), (second, 40)], 700)


@query("SELECT row_number() OVER (ORDER BY part, k) - 1 AS ord, text, lang, url FROM (SELECT 0 part, doc_id k, text, lang, NULL url FROM documents UNION ALL SELECT 1, page_id, NULL, NULL, url FROM pages)")
def union_with_missing_columns(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text", "lang")
    b = table(spark, d, "pages").select(F.col("page_id").alias("ord"), "url")
    return readers.union_in_order([a, b]).select("ord", "text", "lang", "url")


@query("SELECT 's ' || n_name AS text FROM nation WHERE n_nationkey % 5 <> 4 ORDER BY n_nationkey LIMIT 12")
def read_calibration(spark, d):
    path, rows = f"{landing(spark)}/c.jsonl", []
    for r in sorted(table(spark, d, "nation").collect()):  # a constant table
        rows.append("{bad" if r.n_nationkey % 5 == 4 else json.dumps({"text": "", "sentence": f"s {r.n_name}"} if r.n_nationkey % 2 else {"text": f"s {r.n_name}"}))
    put_text(spark, path, "\n".join(rows))
    return readers.calibration(spark, path, 12)


@query("SELECT page_id, unnest([url, 'http://other/' || page_id]) AS url FROM pages WHERE url IS NOT NULL")
def sitemap_locations(spark, d):
    xml = F.concat(F.lit("<urlset><url><loc> "), "url", F.lit("\n</loc></url><url><loc>http://other/"), "page_id", F.lit("</loc></url><loc>"), "url", F.lit("</loc></urlset>"))
    return table(spark, d, "pages").where("url is not null").select("page_id", F.explode(T.sitemap_urls(xml)).alias("url"))


SOCIAL = f"trim(regexp_replace(raw, '{WS}+', ' ', 'g'), ' ')"
CONV = "conv_id * 1000 + turn"


@query(f"""WITH r AS (SELECT 0 part, {CONV} ord, 0 place, 'post_title' record_type, left(text, 60) raw FROM conversations WHERE role = 'user' UNION ALL SELECT 0, {CONV}, 1, 'post_selftext', text FROM conversations WHERE role = 'user'
UNION ALL SELECT 1, {CONV}, 0, 'comment', text FROM conversations WHERE role <> 'user' AND turn % 4 <> 3),
c AS (SELECT part, ord, place, record_type, {SOCIAL} AS text FROM r)
SELECT sha256(text) AS id, text, record_type, ord AS post_id, {three(FRAC)} AS tamil_fraction FROM c WHERE length(text) BETWEEN 20 AND 2000 AND {FRAC} >= 0.3 QUALIFY row_number() OVER (PARTITION BY text ORDER BY part, ord, place) = 1""")
def post_records(spark, d):
    c = table(spark, d, "conversations").withColumn("ord", F.col("conv_id") * 1000 + F.col("turn")).withColumn("post_id", F.col("ord")).withColumn("subreddit", F.lit("r")).withColumn("score", F.lit(1))
    posts = c.where("role = 'user'").select("ord", "post_id", "subreddit", F.substring("text", 1, 60).alias("title"), F.col("text").alias("selftext"), F.lit("/p").alias("permalink"), "score")
    said = c.where("role <> 'user'").select("ord", "post_id", "subreddit", F.when(F.col("turn") % 4 == 3, "[deleted]").otherwise(F.col("text")).alias("body"), "score")
    return records.post_records(posts, said, LATIN).select("id", "text", "record_type", "post_id", "tamil_fraction")


ESC = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
NAMED_SOURCE = "CASE source WHEN 'src0' THEN 0.9::DOUBLE WHEN 'src1' THEN 0.7 ELSE 0.5 END"


def built(spark, d) -> DataFrame:
    """Pages made of the documents' texts, of which the parts are known."""
    docs = table(spark, d, "documents")
    page = F.concat(F.lit("<html><head><style>p{}</style></head><nav><p>menu</p></nav><p>"), ESC(F.col("text")), F.lit("</p><script>var x='</p>';</script><div class='a b'>note <b>"), "doc_id", F.lit("</b></div><footer>end</footer></html>"))
    return docs.select("doc_id", "source", F.concat(F.lit("http://x/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("url"), page.alias("html"))


@query(f"WITH p AS (SELECT doc_id, source, {STRIP} AS text FROM documents) SELECT left(sha256(text), 16) AS id, source, {NAMED_SOURCE} AS quality_score, doc_id FROM p WHERE length(text) >= 40 AND {FRAC} >= 0.5 QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def landed_page_records(spark, d):
    got = records.landed_pages(built(spark, d), {"src0": 0.9, "src1": 0.7}, script=LATIN)
    return got.select("id", "source", "quality_score", F.substring("url", 10, 12).cast("long").alias("doc_id"))


def clean4(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_{LAT}.,!? ]', '', 'g'), ' ')"


def clean5(x: str) -> str:
    return strip_sql(f"nfc_normalize(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '[\\x{{0}}-\\x{{1f}}]', '', 'g'))")


@query(f"SELECT doc_id, {clean4('text || chr(10) || ' + repr('note ') + ' || doc_id')} AS text FROM documents")
def html_article_text(spark, d):
    return built(spark, d).select("doc_id", html.article_text(F.col("html"), LATIN).alias("text"))


@query(f"SELECT doc_id, {clean5(strip_sql('text'))} AS p, 'note ' || doc_id AS b FROM documents")
def html_selected_text(spark, d):
    return built(spark, d).select("doc_id", html.selected_text(F.col("html"), "p").alias("p"), html.selected_text(F.col("html"), "div", "b").alias("b"))


@query(f"SELECT doc_id, {STRIP} AS text FROM documents WHERE length({STRIP}) >= 6 UNION ALL SELECT doc_id, 'note ' || doc_id FROM documents WHERE length({STRIP}) < 6")
def html_first_paragraph(spark, d):
    return html.paragraphs(built(spark, d), "html", 6, 0.0, LATIN, 1).select("doc_id", "text")


TWEET = f"trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), 'https?://[^{WS[1:]}+', '', 'g'), '{WS}+', ' ', 'g'), ' ')"


@query(f"WITH t AS (SELECT conv_id, turn, {TWEET} AS text FROM conversations) SELECT sha256(text) AS id, conv_id, turn, {three(FRAC)} AS tamil_fraction FROM t WHERE length(text) BETWEEN 15 AND 1000 AND {FRAC} >= 0.25 QUALIFY row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) = 1")
def tweet_records(spark, d):
    page = F.concat(F.lit('<div class="head">no</div><div id="1" class="x tweet-content media">'), "text", F.lit(" <i></i>http://t.co/x</div>"))
    pages = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("ord"), F.concat_ws("/", "conv_id", "turn").alias("url"), page.alias("html"))
    got = records.tweet_records(pages, F.lit("k"), LATIN)
    at = lambda k: F.split_part(F.col("url"), F.lit("/"), F.lit(k)).cast("long")
    return got.select("id", at(1).alias("conv_id"), at(2).alias("turn"), "tamil_fraction")


@query("SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) AS work_no, n_name AS title, 'by ' || n_regionkey AS author, 'g' AS genre, ['/p' || n_nationkey || '.pdf'] AS pdf_links, ['/h' || n_nationkey || '.html'] AS html_links FROM nation")
def work_table_rows(spark, d):
    cell = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    link = lambda kind, end: cell(F.lit(f'<a href="/{kind}'), F.col("n_nationkey"), F.lit(f'.{end}">{kind}</a>'))
    row = F.concat(F.lit("<tr>"), cell(F.col("n_nationkey")), cell(F.lit(" "), F.col("n_name")), cell(F.lit("by "), F.col("n_regionkey")), cell(F.lit("g")), link("p", "pdf"), link("h", "html"), F.lit("</tr>"))
    page = F.concat(F.lit("<table><tr><td>no</td></tr></table><table id='works'><tr><th>no</th></tr><tr><td>1</td><td>short</td></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>"))
    pages = table(spark, d, "nation").groupBy("n_regionkey").agg(page.alias("html"))  # five pages of five rows
    pages.createOrReplaceTempView("_work_pages")
    spark.udtf.register("_work_rows", html.TableRows)
    return spark.sql("SELECT n_regionkey, w.* FROM _work_pages, LATERAL _work_rows(html, 'works') w")


@query("SELECT page_id, page_id % 14 < 7 AND page_id % 3 > 0 AS cached FROM pages")
def url_cache_lookup(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("u"), "page_id").alias("url"))
    cache = pages.where("page_id % 3 > 0").select(F.sha2("url", 256).alias("key"), F.lit("b").alias("body"), (F.current_timestamp() - F.make_interval(days=(F.col("page_id") % 14).cast("int"))).alias("stored_at"))
    return readers.cached_pages(pages, cache).select("page_id", F.col("body").isNotNull().alias("cached"))


# sinks


@query(f"{REC} SELECT ord, text, source, quality_score, quality_score IS NULL AS written_null FROM rec")
def write_json_lines(spark, d):
    path = landing(spark)
    writers.json_lines(base_records(spark, d), path)
    raw = spark.read.text(path).select(F.from_json("value", "ord long, text string, source string, quality_score double").alias("r"), F.col("value").contains('"quality_score":null').alias("written_null"))
    return raw.select("r.ord", "r.text", "r.source", "r.quality_score", "written_null")


@query("SELECT p AS text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10) || chr(10))) AS p FROM conversations WHERE trim(text) <> '') WHERE trim(p) <> '' GROUP BY 1")
def write_text(spark, d):
    path = landing(spark)
    writers.text(table(spark, d, "conversations"), path)
    return counted(readers.lines(spark, path, sep="\n\n").select(F.col("value").alias("text")).where("trim(text) <> ''"))


@query(f"{REC}, r AS (SELECT id, text, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM rec) SELECT id, CASE WHEN k < floor(n * 0.8) THEN 'train' WHEN k < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split, sha256(text) AS h, false AS transient FROM r")
def write_splits(spark, d):
    path = landing(spark)
    writers.splits(select.split_by_id(base_records(spark, d).withColumn("_weight", F.lit(1))), path)
    got = spark.read.json(path)
    return got.select("id", "split", F.sha2("text", 256).alias("h"), F.lit("_weight" in got.columns).alias("transient"))


@query(f"{REC}, r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM rec WHERE text <> '' AND coalesce(quality_score, 0) >= 0.3) SELECT id, source, quality_score, CASE WHEN k < floor(n * 0.8) THEN 'train' WHEN k < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM r")
def write_nested_export(spark, d):
    path = landing(spark)
    writers.json_lines(writers.nested_export(base_records(spark, d), 0.3), path)
    return spark.read.json(path).select("id", "meta.source", "meta.quality_score", "split")


@query("SELECT conv_id AS work_id, count(*) AS n_pages, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1")
def write_grouped_manifests(spark, d):
    path = landing(spark)
    writers.grouped(report.manifests(table(spark, d, "conversations"), F.col("conv_id"), "turn").drop("topics"), path)
    return spark.read.schema("work_id long, n_pages long, text string").json(path).select("work_id", "n_pages", F.sha2("text", 256).alias("h"))


@query("SELECT line FROM (SELECT '| source | records |' AS line UNION ALL SELECT '|-|-|' UNION ALL SELECT '| ' || source || ' | ' || n || ' |' FROM (SELECT source, count(*) n FROM documents GROUP BY 1))")
def write_readme(spark, d):
    path = f"{landing(spark)}/README.md"
    put_text(spark, path, writers.readme(report.source_distribution(base_records(spark, d))))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM documents")
def write_report(spark, d):
    path = landing(spark)
    writers.one_row(report.corpus_report(base_records(spark, d)), path)
    return spark.read.json(path).select("documents", "chars", "sources")


@query(f"""WITH t AS (SELECT doc_id, [1] || list_transform({TOKENS}, lambda x: CAST(length(x) AS INTEGER)) || [2] AS ids FROM documents),
s AS (SELECT row_number() OVER (ORDER BY doc_id, p) - 1 AS k, id FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS p FROM t)),
q AS (SELECT CAST(k // 128 AS BIGINT) AS seq_id, CAST(sum(id * (k % 128 + 1)) AS BIGINT) AS checksum FROM s GROUP BY 1 HAVING count(*) = 128)
SELECT *, 'uint16' AS dtype, (SELECT count(*) FROM q) * 128 AS n_tokens FROM q""")
def write_binary_shard(spark, d):
    """Packed sequences through the binary sink, its manifest, and back."""
    path = landing(spark)
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.transform(_tokens(text), lambda w: F.length(w)).alias("ids"))
    writers.binary_shard(packing.pack(ids, "ids", 128), path, 128, 40_000)
    manifest = spark.read.json(f"{path}/manifest").first()
    total = F.aggregate(F.transform("tokens", lambda x, i: (x * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return writers.read_binary_shard(spark, path).select("seq_id", total.alias("checksum"), F.lit(manifest["dtype"]).alias("dtype"), F.lit(manifest["n_tokens"]).alias("n_tokens"))


# streams


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a bounded stream gives, by way of the shared folder."""
    path = landing(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start().awaitTermination()
    if not exists(spark, f"{path}/out/*"):  # a stream without rows may give no batch
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/out").drop("batch")


def streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    return streams.read_parquet_stream(spark, d, table(spark, d, name).schema, f"{name}.parquet")


@query(f"{REC}, u AS (SELECT ord, text, NULL::DOUBLE AS quality_score FROM rec) SELECT ord, text <> scrubbed AS had_pii, sha256(scrubbed) AS h FROM (SELECT *, {SCRUB} AS scrubbed FROM u WHERE ({REASON}) IS NULL AND {FRAC} >= 0.5)")
def stream_curated(spark, d):
    rows = streamed(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text", F.lit(None).cast("double").alias("quality_score"))
    return drained(spark, streams.curated_stream(rows, 0.5, LATIN)).select("ord", "had_pii", F.sha2("text", 256).alias("h"))


@query("SELECT event_type || user_id AS text FROM events GROUP BY 1")
def stream_exact_dedup(spark, d):
    rows = streamed(spark, d, "events").select("ts", F.concat("event_type", "user_id").alias("text"))
    return drained(spark, streams.exact_dedup_stream(rows)).select("text")


@query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    got = drained(spark, streams.tumbling(streamed(spark, d, "events")).select(F.col("window.start").alias("hour"), "event_type", "n", "total"), "complete")
    return got.withColumn("total", F.round("total", 4))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    return drained(spark, streams.sessions(streamed(spark, d, "events")).select("user_id", F.col("session_window.start").alias("began"), "n"), "complete")


@query()
def stream_near_dedup(spark, d):
    """Near-dup of a stream by batches against all kept rows."""
    path = landing(spark)
    rows = streamed(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text")
    writer = streams.near_dedup_stream(rows, path).trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
    writer.start().awaitTermination()
    if not exists(spark, f"{path}/kept/*"):
        return spark.createDataFrame([], "ord long")
    return spark.read.schema("ord long, text string, batch long").parquet(f"{path}/kept").select("ord")

