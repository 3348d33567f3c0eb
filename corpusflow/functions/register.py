"""SQL names for the functions that queries use most."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.functions.html import TableRows, html_text
from corpusflow.operators.neardup import signer


def register(spark: SparkSession, tokenizer=None) -> None:
    """nfc, html_text, minhash_sig (of a normal text), work_rows; pure-SQL target_fraction, norm_key, content_hash, quality_score, aksharas, scrub_pii; encode_text with a tokenizer."""
    spark.udf.register("html_text", html_text)
    spark.udtf.register("work_rows", TableRows)
    lo, hi = T.TAMIL
    quoted = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    script = "".join(map(chr, range(lo, hi + 1)))
    inside = f"(length(t) - length(translate(t, '{script}', '')))"
    runs = quoted(T.RUNS)
    make = lambda name, args, kind, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    make("target_fraction", "t STRING", "DOUBLE", f"CASE WHEN length(t) > 0 THEN {inside} / length(t) ELSE 0D END")
    make("content_hash", "t STRING", "STRING", f"sha2(trim(regexp_replace(lower(t), '{runs}', ' ')), 256)")
    make("norm_key", "t STRING", "STRING", "substring(regexp_replace(t, '" + quoted(rf"[^\p{{L}}\p{{N}}_{T.span(T.TAMIL)}]") + "', ''), 1, 512)")
    scrubbed = "t"
    for pattern, name in ((T.EMAIL, "[EMAIL]"), (T.PHONE, "[PHONE]"), (T.LINK, "[URL]")):
        scrubbed = f"regexp_replace({scrubbed}, '{quoted(pattern)}', '{name}')"
    make("scrub_pii", "t STRING", "STRING", scrubbed)
    bare = f"element_at(transform(array(trim(regexp_replace(t, '{runs}', ' '))), x -> CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, ' ', '')) + 1 END), 1)"
    fraction = f"{inside} / greatest(1, length(t))"
    make("quality_score", "t STRING", "DOUBLE", f"element_at(transform(array(struct({bare} AS w, {fraction} AS f)), x -> 0.6D * least(1D, x.w / 50D) + 0.4D * CASE WHEN x.f > 0.6 THEN 1D ELSE x.f END), 1)")
    make("nfc", "t STRING", "STRING", "CASE WHEN t IS NOT NULL THEN reflect('com.ibm.icu.text.Normalizer', 'compose', coalesce(t, ''), false) END")
    make("aksharas", "t STRING", "ARRAY<STRING>", "regexp_extract_all(nfc(t), '" + quoted(r"(?s)(.[\x{bbe}-\x{bcd}]*)") + "', 1)")
    spark.udf.register("minhash_sig", signer(128, 42, 5, "md5"))
    if tokenizer is not None:

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: tokenizer.encode(t or ""))

        spark.udf.register("encode_text", encode)
