"""One query for each operator of this subpackage, with its production parameters, and the SQL that tells the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate, langid, licenses, lines, lm, neardup, packing, substrings, url_rules, vectors
from corpusflow.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), size=2)


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.groups(table(spark, sf_dir, "embeddings"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_recurring(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = langid.predict(docs, langid.fit(docs, ~langid.held_out()))
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ngram_trie, op2_packing, op3_substrings, op4_decontaminate, op5_licenses, op6_minhash, op7_hnsw, op8_line_templates, op9_langid, op10_url_rules)}

OP3 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
x AS (SELECT k, p, md5(array_to_string(w[p:p + 34], ' ')) s FROM (SELECT k, w, unnest(range(1, len(w) - 33)) p FROM d WHERE len(w) >= 35)),
r AS (SELECT k, p FROM x WHERE s IN (SELECT s FROM x GROUP BY s HAVING count(*) > 1)),
g AS (SELECT DISTINCT k, unnest(range(p, p + 35)) p FROM r),
u AS (SELECT k, doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p FROM d)
SELECT any_value(d.doc_id) doc_id, CAST(count(u.p) AS BIGINT) n_words, CAST(count(g.p) AS BIGINT) n_removed,
       sha256(coalesce(string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY u.p), '')) kept_sha256
FROM d LEFT JOIN u ON u.k = d.k LEFT JOIN g ON g.k = u.k AND g.p = u.p GROUP BY d.k
"""

OP4 = r"""
WITH i0 AS (
  SELECT CAST(item_id AS VARCHAR) item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, w, least(8, len(w)) m FROM i0 WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) p FROM i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
dw AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') s
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) p FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)),
met AS (SELECT doc_id, dw.m, p, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.s = iw.s),
h AS (SELECT doc_id, count(DISTINCT q) n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) q FROM met) GROUP BY 1),
n AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

def _op5() -> str:
    """Every statement against every template, without the size bounds and anchor words."""
    known = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{g}'" for g in licenses.grams_of(text))) for name, text in licenses.TEMPLATES)
    return rf"""
WITH t AS (SELECT * FROM (VALUES {known}) v(name, g)),
s AS (SELECT doc_id, row_number() OVER () k, u FROM (
  SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(regexp_replace(text, '([.!?])[ \t-\r]+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), '\n')) u FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, k, regexp_extract_all(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM s),
b AS (SELECT doc_id, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) g FROM w WHERE len(w) BETWEEN 2 AND 200),
m AS (SELECT doc_id, k, name, 2.0::DOUBLE * len(list_intersect(b.g, t.g)) / (len(b.g) + len(t.g)) dice FROM b, t WHERE list_has_any(b.g, t.g)),
top AS (SELECT doc_id, k, name, dice FROM m WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY k ORDER BY dice DESC, name) = 1),
d AS (SELECT doc_id, count(*) n, string_agg(DISTINCT name, ',' ORDER BY name) names, first(name ORDER BY dice DESC, name) best, max(dice) dice FROM top GROUP BY 1)
SELECT x.doc_id, CAST(coalesce(n, 0) AS BIGINT) n_statements, names licenses, best best_license, dice best_dice FROM documents x LEFT JOIN d ON x.doc_id = d.doc_id
"""


OP7 = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
t AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
p AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT t.b, p.c FROM p JOIN t ON t.a = p.id AND p.c < t.b),
m AS (SELECT id, min(c) c FROM p GROUP BY 1),
n AS (SELECT a, count(*) k FROM t GROUP BY 1)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) n_links, c component_id, vec_id = c kept FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP8 = r"""
WITH l0 AS (SELECT doc_id, k, dkey, a, unnest(range(1, len(a) + 1)) n FROM (SELECT doc_id, row_number() OVER () k, md5(text) dkey, string_split(text, chr(10)) a FROM documents WHERE text IS NOT NULL)),
l1 AS (SELECT doc_id, k, dkey, n, trim(regexp_replace(a[n], '[\x20\x09-\x0D]+', ' ', 'g'), ' ') f FROM l0),
l2 AS (SELECT doc_id, k, dkey, n, list_transform(string_split(f, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) w FROM l1 WHERE f <> ''),
l AS (SELECT doc_id, k, dkey, n, w, array_to_string(w, ' ') m, len(w) || '|' || array_to_string(w[1:3], ' ') leaf FROM l2 WHERE regexp_matches(replace(array_to_string(w, ' '), '<*>', ''), '\p{L}')),
leaves AS (SELECT leaf, count(DISTINCT dkey) docs FROM l GROUP BY 1 HAVING count(DISTINCT dkey) >= 10),
inl AS (SELECT l.* FROM l JOIN leaves USING (leaf)),
kinds AS (SELECT leaf, m, any_value(w) w, count(DISTINCT dkey) times FROM inl GROUP BY 1, 2),
fields AS (SELECT leaf, m, times, len(w) size, unnest(w) token, unnest(range(1, len(w) + 1)) p FROM kinds),
constants AS (SELECT leaf, p, token FROM (SELECT leaf, p, token, sum(times) s FROM fields WHERE p > 3 GROUP BY 1, 2, 3) JOIN leaves USING (leaf) WHERE s >= greatest(10, 0.05::DOUBLE * docs)),
met AS (SELECT f.leaf, m, size, f.p, f.token, f.p <= 3 OR c.token IS NOT NULL con FROM fields f LEFT JOIN constants c ON f.leaf = c.leaf AND f.p = c.p AND f.token = c.token),
named AS (SELECT leaf, m, CASE WHEN count_if(con) >= 0.75 * size AND 2 * count_if(con AND p > 3) >= size - 3
               THEN 'general|' || leaf || '|' || string_agg(CASE WHEN con THEN token ELSE '<*>' END, ' ' ORDER BY p) ELSE 'own|' || leaf || '|' || m END tpl FROM met GROUP BY leaf, m, size),
t AS (SELECT doc_id, k, dkey, n, tpl FROM inl JOIN named USING (leaf, m)),
rec AS (SELECT tpl FROM t GROUP BY 1 HAVING count(DISTINCT dkey) >= 10),
gone AS (SELECT k, n FROM (SELECT k, n, row_number() OVER (PARTITION BY tpl ORDER BY doc_id, n) r FROM t JOIN rec USING (tpl)) WHERE r > 1),
per AS (SELECT doc_id, k, count(*) n_lines, count(g.n) n_dropped, string_agg(CASE WHEN g.n IS NULL THEN x END, chr(10) ORDER BY n) kept
        FROM (SELECT doc_id, k, n, a[n] x FROM l0) l LEFT JOIN gone g USING (k, n) GROUP BY 1, 2)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) kept_sha256 FROM per
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""

OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END g FROM d),
e AS (SELECT doc_id, len(g) n, unnest(g) x FROM s),
f AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) r FROM (SELECT doc_id, n, x, count(*) OVER (PARTITION BY x) df FROM e)),
c AS (SELECT DISTINCT a.doc_id a, b.doc_id b FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id
      AND a.r <= a.n - ceil(0.8 * a.n) + 1 AND b.r <= b.n - ceil(0.8 * b.n) + 1 AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM c JOIN s x ON c.a = x.doc_id JOIN s y ON c.b = y.doc_id
      WHERE 100 * len(list_intersect(x.g, y.g)) >= 80 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))),
t AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
p AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT t.b, p.c FROM p JOIN t ON t.a = p.id AND p.c < t.b),
m AS (SELECT id, min(c) c FROM p GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) n_shingles, c component_id, doc_id = c kept FROM s JOIN m ON m.id = s.doc_id
"""

ORACLES: dict[str, str] = {"op3_substrings": OP3, "op4_decontaminate": OP4, "op5_licenses": _op5(), "op6_minhash": OP6, "op7_hnsw": OP7, "op8_line_templates": OP8}
