"""Text functions as column expressions.

White space, word characters and word edges follow Python's Unicode rules, which neither Java's nor RE2's shorthand
classes match. Every script-specific function takes its code-point range; the default is the Tamil block.
Lengths and substrings count code points. Expressions stay inside the JVM, Unicode normalisation by Spark's own ICU;
only callers' own functions of a text take Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: What Python's str.isspace and str.strip take for white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same; most characters are ruled out by one comparison.
_WS = rf"[[^!-~]&&{WS}]"
#: A run of white space that is not one blank, so what squeezing would leave as it is isn't matched.
RUNS = rf" {_WS}+|[[^ -~]&&{WS}]{_WS}*"
PYW = r"[\p{L}\p{N}_]"
PYB = rf"(?:(?<={PYW})(?!{PYW})|(?<!{PYW})(?={PYW}))"
TAMIL = (0x0B80, 0x0BFF)
LATIN = (0x41, 0x7A)


def span(script: tuple[int, int]) -> str:
    return rf"\x{{{script[0]:x}}}-\x{{{script[1]:x}}}"


def strip(c: Column) -> Column:
    """Without white space at either end (all Unicode white space, not only blanks)."""
    return F.trim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, RUNS, " ")


def normal(c: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(squeeze(F.lower(c)))


def content_hash(c: Column) -> Column:
    return F.sha2(normal(c), 256)


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is told once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def texts(f: Callable[[str], object], kind: str = "string", at_once: int = 256, nulls: bool = False):
    """A function of a text as an Arrow function: few texts of a batch are Python objects at a time. Null stays null, or goes to f."""
    to, type_ = {"string": (pa.string(), StringType()), "array<string>": (pa.list_(pa.string()), ArrayType(StringType())), "array<int>": (pa.list_(pa.int32()), ArrayType(IntegerType()))}[kind]

    @F.arrow_udf(type_)
    def run(a: pa.Array) -> pa.Array:
        parts = [pa.array([None if x is None and not nulls else f(x) for x in a.slice(k, at_once).to_pylist()], to) for k in range(0, len(a), at_once)]
        return pa.concat_arrays(parts) if parts else pa.array([], to)

    return run


def nfc(c: Column | str) -> Column:
    """Normalisation form C, by the ICU that comes with Spark."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False)))


def clean_nfc(c: Column) -> Column:
    return strip(nfc(c))


def norm_key(c: Column, script: tuple[int, int] = TAMIL, size: int = 512) -> Column:
    """Word characters and the script's only, cut to `size`: the key of sentence-level dedup."""
    return F.substring(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_{span(script)}]", ""), 1, size)


def prefix_key(c: Column, size: int) -> Column:
    return F.substring(strip(c), 1, size)


def clean_for_script(c: Column, script: tuple[int, int] = TAMIL) -> Column:
    """One blank for white space; then only word characters, the script and . , ! ? stay."""
    return F.trim(F.regexp_replace(squeeze(c), rf"[^\p{{L}}\p{{N}}_{span(script)}.,!? ]", ""))


def clean_controls(c: Column) -> Column:
    return strip(nfc(F.regexp_replace(squeeze(c), r"[\x{0}-\x{1f}]", "")))


def clean_social(c: Column, drop_links: bool = False) -> Column:
    c = F.regexp_replace(c, rf"https?://(?:(?!{WS}).)+", "") if drop_links else c
    return F.trim(squeeze(c))


def strip_prefixes(c: Column, prefixes: list[str]) -> Column:
    """Anchored deletions one after another (each may expose the next), then white space squeezed."""
    # none of the parts can fail, so what each takes is what it would take alone
    return F.trim(squeeze(F.regexp_replace(c, r"\A" + "".join(rf"(?:{p})?+{_WS}*+" for p in prefixes), "")))


def length_without(c: Column, chars: str) -> Column:
    return F.length(F.translate(c, chars, ""))


def script_chars(c: Column, script: tuple[int, int] = TAMIL) -> Column:
    if script[1] < 0xD800 and script[1] - script[0] < 4096:  # a pattern would stop at each run
        return F.length(c) - length_without(c, "".join(map(chr, range(script[0], script[1] + 1))))
    return F.length(F.regexp_replace(c, f"[^{span(script)}]+", ""))


def script_fraction(c: Column, script: tuple[int, int] = TAMIL) -> Column:
    """In-script characters over all characters; 0 for an empty text."""
    n = F.length(c)
    return F.when(n > 0, script_chars(c, script) / n).otherwise(0.0)


def script_fraction_nonspace(c: Column, script: tuple[int, int] = TAMIL) -> Column:
    n = length_without(c, SPACES)
    return F.when(n > 0, script_chars(c, script) / n).otherwise(0.0)


def word_count(c: Column) -> Column:
    return let(F.trim(squeeze(c)), lambda t: F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1))


def round3(c: Column) -> Column:
    """To 3 places, half-even on the exact binary value, as no built-in does; of values below 2 ** 40 in size.

    Doubled thousandths are told exactly: the rounded product and its error, by splitting the value in two halves.
    """

    def near(v: Column) -> Column:
        high = 134217729.0 * v - (134217729.0 * v - v)
        product = v * 2000.0
        error = (high * 2000.0 - product) + (v - high) * 2000.0
        down = F.floor(product / 2)
        over = (product - (2 * down + 1).cast("double")) + error  # from the middle between two thousandths
        up = F.when(over > 0, 1).when(over == 0, F.pmod(down, F.lit(2))).otherwise(0)
        return (down + up).cast("double") / 1000.0

    return let(c, lambda v: let(F.abs(v), near) * F.signum(v))


def measures(c: Column, script: tuple[int, int]) -> Column:
    """(words, fraction) of a text."""
    return F.struct(word_count(c).alias("words"), (script_chars(c, script) / F.greatest(F.lit(1), F.length(c))).alias("fraction"))


def _score(m: Column) -> Column:
    return 0.6 * F.least(F.lit(1.0), m["words"] / F.lit(50)) + 0.4 * F.when(m["fraction"] > 0.6, 1.0).otherwise(m["fraction"])


def _flags(m: Column) -> Column:
    return F.struct((m["words"] < 5).alias("too_short"), (m["fraction"] > 0.5).alias("in_script"))


def quality_score(c: Column, script: tuple[int, int] = TAMIL) -> Column:
    """0.6 for length (full from 50 words) and 0.4 for script (full above 0.6), not rounded; `score_quality` rounds it."""
    return let(measures(c, script), _score)


def score_quality(c: Column, script: tuple[int, int] = TAMIL) -> Column:
    """The score rounded to 3 places, with the flags."""
    return let(measures(c, script), lambda m: F.struct(round3(_score(m)).alias("quality_score"), _flags(m).alias("flags")))


def fraction3(c: Column, script: tuple[int, int] = TAMIL) -> Column:
    """In-script characters over all characters, rounded to 3 places."""
    return round3(script_fraction(c, script))


def mostly_script(c: Column, least: float = 0.5, script: tuple[int, int] = TAMIL) -> Column:
    """Whether that share or more of what is not white space is in the script; an empty text is not."""
    return script_fraction_nonspace(c, script) >= least


def script_content(c: Column, least: float = 0.5, script: tuple[int, int] = TAMIL) -> Column:
    """Whether that share or more of all characters is in the script; an empty text is not."""
    return (F.length(c) > 0) & (script_fraction(c, script) >= least)


def some_script(c: Column, more_than: float = 0.3, script: tuple[int, int] = TAMIL) -> Column:
    """Whether more than that share of all characters is in the script."""
    return script_fraction(c, script) > more_than


def quality_flags(c: Column, script: tuple[int, int] = TAMIL) -> Column:
    return let(measures(c, script), _flags)


def sentences(c: Column, more_than: int = 10, at_most: int | None = None, squeezed: bool = False) -> Column:
    """Sentences between danda, ! ? . and line ends, stripped, by length."""
    parts = F.transform(F.split(c, r"[\x{964}!?.\n]+"), lambda s: F.trim(squeeze(s)) if squeezed else strip(s))
    good = lambda s: (F.length(s) > more_than) & (F.length(s) <= at_most if at_most else F.lit(True))
    return F.filter(parts, good)


def any_word(words: list[str], whole: bool = True, strict: bool = True) -> str:
    """A pattern for any of the words, between word edges if whole. strict: Python's edges, which see combining marks
    as outside words; else edges at the ends of letter-and-mark runs."""
    body = "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"
    plain = words and all(w and w == re.escape(w) for w in words)
    first = f"(?=[{''.join(sorted({w[0] for w in words}))}])" if plain else ""  # passes over places where none begins
    if not whole:
        return first + body
    return first + PYB + body + PYB if strict else rf"{first}(?<![\p{{L}}\p{{M}}\p{{N}}_]){body}(?![\p{{L}}\p{{M}}\p{{N}}_])"


def marker_score(c: Column, groups: list[tuple[int, str]], cap: int = 5) -> Column:
    """Sum of the weights of the patterns found, capped."""
    total = F.lit(0)
    for weight, pattern in groups:
        total = total + F.when(c.rlike(pattern), weight).otherwise(0)
    return F.least(total, F.lit(cap))


def colloquial(c: Column, source: Column, pattern: str, informal: tuple[str, ...] = ("social", "telegram", "tweet")) -> Column:
    short = (F.length(c) < 60) & c.rlike(r"[!?]+\z")
    return F.coalesce((c != "") & (F.coalesce(F.lower(source).isin(*informal), F.lit(False)) | c.rlike(pattern) | short), F.lit(False))


def casual_signs(c: Column, *words: list[str]) -> Column:
    """Whether a word of any of the lists occurs, also inside other words."""
    return c.rlike("|".join(any_word(w, False) for w in words))


def topics(c: Column, keywords: dict[str, list[str]], default: str) -> Column:
    """Labels whose keywords occur, in the table's order; [default] if none."""
    low = F.lower(c)
    hit = lambda words: reduce(or_, [low.contains(w) for w in words])
    found = F.filter(F.array(*[F.when(hit(words), label) for label, words in keywords.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def style_class(c: Column, old: list[str], new: list[str]) -> Column:
    is_old, is_new = c.rlike(any_word(old, False)), c.rlike(any_word(new, False))
    return F.when(is_old & is_new, "mixed").when(is_old, "old").when(is_new, "modern").otherwise("neutral")


#: A match begins where a run of its characters does, or where the match before it ends.
EMAIL = r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++@[a-z0-9.-]+\.[a-z]{2,}"
LINK = rf"(?i)https?://(?:(?!{WS})[\s\S])+|www\.(?:(?!{WS})[\s\S])+"
_SEP = rf"(?:[-.]|{WS})?"
PHONE = rf"(?=[+\p{{Nd}}])(?:(?:\+?91{_SEP})|{PYB})(?:\p{{Nd}}{{4,5}}{_SEP})?\p{{Nd}}{{3,4}}{_SEP}\p{{Nd}}{{4}}{PYB}"


def scrub(c: Column) -> Column:
    """E-mail addresses, phone numbers and links replaced by [EMAIL], [PHONE], [URL], in this order."""
    for pattern, name in ((EMAIL, "[EMAIL]"), (PHONE, "[PHONE]"), (LINK, "[URL]")):
        c = F.regexp_replace(c, pattern, name)
    return c


def pii_counts(c: Column) -> Column:
    """How many of each kind are replaced; a literal [URL] counts as a link."""
    mail, phone = F.regexp_count(c, F.lit(EMAIL)), F.regexp_replace(c, EMAIL, "[EMAIL]")
    link = F.regexp_replace(phone, PHONE, "[PHONE]")
    return F.struct(mail.alias("emails"), F.regexp_count(phone, F.lit(PHONE)).alias("phones"), F.regexp_count(link, F.lit(LINK + r"|\[URL\]")).alias("urls"))


def looks_legacy(c: Column, marker: str = "charset=x-user-defined", glyphs: str = "") -> Column:
    """Text that may be in a legacy font encoding: a marker near the start, or over 2 % of characters in U+0080-U+00FF."""
    dense = (F.length(c) > 200) & (F.length(F.regexp_replace(c, r"[^\x{80}-\x{ff}]+", "")) > 0.02 * F.length(c))
    found = F.lower(F.substring(c, 1, 4096)).contains(marker) | dense
    return found | c.rlike(f"[{glyphs}]") if glyphs else found


def convert_legacy(c: Column, convert: Callable[[str], str] | None = None, marker: str = "charset=x-user-defined", glyphs: str = "") -> Column:
    """Texts that look like a legacy font encoding passed through a converter; unchanged where there is none."""
    if convert is None:
        return c

    # only texts that look so are sent to Python
    legacy = looks_legacy(c, marker, glyphs)
    return F.when(legacy, texts(convert)(F.when(legacy, c))).otherwise(c)


def declared_charset(content: Column) -> Column:
    """The charset named in the first 4096 bytes of a page, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), r"(?i)charset\s*=\s*\"?([^\"' >]+)", 1))


def decoded(content: Column) -> Column:
    """A page's bytes as text: Latin-1 where a legacy font charset is declared or the bytes aren't UTF-8."""
    latin, plain = F.decode(content, "ISO-8859-1"), content.cast("string")
    return F.when(declared_charset(content).rlike("x-user-defined|tscii"), latin).when(F.is_valid_utf8(plain), plain).otherwise(latin)


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / 4.5)


def aksharas(c: Column) -> Column:
    """Grapheme clusters of a Tamil text: vowel signs and pulli join what stands before them. The text must be NFC."""
    return F.regexp_extract_all(c, F.lit(r"(?s)(.[\x{bbe}-\x{bcd}]*)"), 1)


def devanagari_clusters(c: Column) -> Column:
    """Clusters of a Devanagari text: signs join, and a virama takes the consonant after it. The text must be NFC."""
    return F.regexp_extract_all(c, F.lit(r"(?s)(.(?:[\x{900}-\x{903}\x{93c}\x{93e}-\x{94c}]|\x{94d}[\x{915}-\x{939}]?)*)"), 1)


def shingles(c: Column, size: int = 5) -> Column:
    """Distinct character shingles of the normal text; a shorter text is its own. One pass over the text."""
    t = normal(c)
    found = F.regexp_extract_all(t, F.lit(rf"(?s)(?=(.{{{size}}}))."), 1)
    return F.when(F.length(t) < size, F.array(t)).otherwise(F.array_distinct(found))


def similarity(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), same / F.size(a)).otherwise(0.0)


def page_links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1))


def sitemap_urls(xml: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(xml, F.lit(r"<loc>([^<]*)</loc>"), 1), strip))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")
