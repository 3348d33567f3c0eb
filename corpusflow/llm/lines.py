"""Line dedup by a log-template tree: recurring line templates are dropped after their first occurrence.

The tree has a fixed depth: a line goes down by its number of tokens and its leading tokens, fields with a digit
masked as <*>. In a leaf, a field is constant where its token stands at that place in many of the leaf's lines (in
`documents` at least, and in `share` of the leaf's documents), else it is variable. A line whose constant fields,
leading ones included, are `similarity` of all and half of those after the leading ones generalises to its constants;
any other line is its own template. So a leaf holds as many templates as its lines make, and a template is a function
of the whole corpus and not of the order in which lines arrive.

A template recurs when it stands in at least `documents` different documents; documents with equal texts count once.
Of a recurring template the first occurrence (lowest doc_id, then line) stays, every other goes. Lines without a letter
outside their masked fields stay.

Scale: everything is counted by partial aggregation on 64-bit hashes, in two steps (distinct pairs, then pairs per key),
so a line or leaf that makes up a third of all lines is summed before it is shuffled. Fields are counted on the
distinct masked lines of leaves that reach `documents`; only those lines carry text on. Tables that are met by a hash of
few rows are broadcast while their count is under a limit and joined by a shuffle beyond it, which adaptive execution
splits where a key is hot. Texts are shuffled once, to meet their dropped line numbers.

Edge cases: a null text stays null with no lines; an empty text has one blank line; a very long text or line is one row
like any other; ties between occurrences go to the lower line, then to the smaller text hash; a null id comes after
all others; rows that share both id and text are treated alike (all keep a first occurrence), rows that share only the
id are told apart by their texts; columns keep their values whatever their names, but for `_n_lines` and `_n_dropped`,
which `drop_recurring` sets; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm._text import free
from corpusflow.session import cut

BLANK = r"[\x20\x09-\x0D]+"
LAST_ID = 2**63 - 1


def one_spaced(line: Column) -> Column:
    """The line's tokens joined by one space; a regular expression only where a line needs one."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.when(odd, F.trim(F.regexp_replace(line, BLANK, " "))).otherwise(line)


def mask(flat: Column) -> Column:
    """Tokens with a digit masked."""
    return F.when(flat.rlike("[0-9]"), F.array_join(F.transform(F.split(flat, " "), lambda w: F.when(w.rlike("[0-9]"), "<*>").otherwise(w)), " ")).otherwise(flat)


def placed(docs: DataFrame, lead: int) -> DataFrame:
    """Lines with tokens and their leaf: id, key, n, flat, leaf."""
    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("key"), F.split(text, "\n").alias("all"))
    lines = rows.select("id", "key", F.posexplode("all").alias("n", "line")).select("id", "key", "n", one_spaced(F.col("line")).alias("flat")).where("flat <> ''")
    size = F.length("flat") - F.length(F.replace("flat", F.lit(" "), F.lit("")))
    return lines.select("id", "key", "n", "flat", F.xxhash64(size, mask(F.substring_index("flat", " ", lead))).alias("leaf"))


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Marked for broadcast if it has few rows (of some numbers each); it must be cheap to count."""
    return F.broadcast(df) if df.count() <= most else df


def templates(kinds: DataFrame, leaves: DataFrame, lead: int, documents: int, similarity: float, share: float) -> DataFrame:
    """(leaf, m, template) of the distinct masked lines (leaf, m, masked, times); leaves: (leaf, docs)."""
    fields = kinds.select("leaf", "m", "times", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    counted = fields.where(F.col("at") >= lead).groupBy("leaf", "at", "token").agg(F.sum("times").alias("times")).where(F.col("times") >= documents)
    constant = counted.join(small(leaves), "leaf").where(F.col("times") >= F.col("docs") * share).select("leaf", "at", "token", F.lit(True).alias("constant"))
    met = fields.join(constant, ["leaf", "at", "token"], "left")
    is_constant = (F.col("at") < lead) | F.coalesce("constant", F.lit(False))
    one = F.struct("at", F.when(is_constant, F.col("token")).otherwise("<*>").alias("token"))
    after = F.count_if(is_constant & (F.col("at") >= lead))
    lines = met.groupBy("leaf", "m").agg(F.array_sort(F.collect_list(one))["token"].alias("tokens"), F.count_if(is_constant).alias("same"), after.alias("same_after"))  # a line's fields
    size = F.size("tokens")
    general = (F.col("same") >= similarity * size) & (2 * F.col("same_after") >= size - lead)
    return lines.select("leaf", "m", F.when(general, F.xxhash64("leaf", "tokens")).otherwise(F.xxhash64("leaf", "m")).alias("template"))


def dropped(docs: DataFrame, lead: int, documents: int, similarity: float, share: float) -> DataFrame:
    """(id, key, n) of the lines to drop."""
    lines = placed(docs, lead)
    hot = cut(lines.select("leaf", "key").distinct().groupBy("leaf").count().where(F.col("count") >= documents).select("leaf"))
    inside = lines.join(small(hot), "leaf").select("id", "key", "n", "leaf", mask(F.col("flat")).alias("masked"))
    inside = inside.where(F.replace("masked", F.lit("<*>"), F.lit("")).rlike(r"\p{L}"))
    inside = cut(inside.withColumn("m", F.xxhash64("masked")))
    pairs = inside.groupBy("leaf", "m", "key").agg(F.first("masked").alias("masked"))
    kinds = cut(pairs.groupBy("leaf", "m").agg(F.first("masked").alias("masked"), F.count("*").alias("times")))
    leaves = cut(inside.select("leaf", "key").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= documents))
    named = cut(templates(kinds.join(small(leaves).select("leaf"), "leaf"), leaves, lead, documents, similarity, share))
    near = cut(inside.drop("masked").join(small(named), ["leaf", "m"]).select("id", "key", "n", "template"))
    recurring = near.select("template", "key").distinct().groupBy("template").count().where(F.col("count") >= documents).select("template")
    firsts = near.groupBy("template").agg(F.min(F.struct("id", "n", "key")).alias("first"))
    known = cut(recurring.join(firsts, "template"))
    return near.join(small(known), "template").where(F.col("first") != F.struct("id", "n", "key")).select("id", "key", "n")


def drop_recurring(docs: DataFrame, lead: int = 3, documents: int = 10, similarity: float = 0.75, share: float = 0.05) -> DataFrame:
    """All input columns with text cleaned, and the columns _n_lines and _n_dropped."""
    text = F.col("text").cast("string")
    names = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    id_, key, gone = (free(docs.columns, c) for c in ("_id", "_key", "_gone"))
    lines = dropped(docs, lead, documents, similarity, share).groupBy("id", "key").agg(F.collect_set("n").alias(gone))  # a text's lines
    rows = docs.select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias(id_), F.xxhash64(text).alias(key))
    met = rows.join(lines.withColumnsRenamed({"id": id_, "key": key}), [id_, key], "left")
    stays = F.array_join(F.filter(F.split(text, "\n"), lambda s, i: ~F.array_contains(gone, i)), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    n_dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    new = F.when(F.col(gone).isNull(), text).otherwise(stays)
    return met.select(*[new.alias("text") if c == "text" else F.col(f"`{c}`") for c in names], n_lines.alias("_n_lines"), n_dropped.alias("_n_dropped"))


def keep_with_text(docs: DataFrame) -> DataFrame:
    """The documents without recurring lines, with their columns; one of which nothing but white space is left goes."""
    renamed = {c: free(docs.columns, f"_own{c}") for c in ("_n_lines", "_n_dropped") if c in docs.columns}
    cleaned = drop_recurring(docs.withColumnsRenamed(renamed))
    some = cleaned.where(r"_n_dropped = 0 or text rlike '[^\\x20\\x09-\\x0D]'").drop("_n_lines", "_n_dropped")
    back = some.withColumnsRenamed({new: old for old, new in renamed.items()})
    return back.select(*[f"`{c}`" for c in docs.columns])
