"""Exact substring dedup over a De Bruijn graph of word k-mers, compacted through joins.

Edges are k-mers (k = `window` words), nodes are runs of k-1 words. Consecutive k-mers of a text that share their
minimizer (the least hash of `seed` consecutive words in the k-mer, leftmost of equals) are a path from a head node to a
tail node; equal paths of different places are one bundle of edges.

1. A path's content is its minimizer and its words. Paths are counted by content; a content at two places or more is
   repeated, and all its k-mers repeat.
2. A minimizer that occurs once cannot hold a repeated k-mer, since equal k-mers have equal minimizers.
3. Repeated contents are compacted: nodes have degrees, the numbers of contents that end and begin there, and two
   contents are joined where one's tail is the other's head, both degrees are one and both occur equally often. What
   hangs together by such joins is one nonbranching path; its stretches in texts are the repeated spans.
4. What remains branches: a minimizer with several contents, where one content occurs once. Only these are expanded
   into k-mers, one representative of each content, and k-mers met by another path repeat.
5. The words at the source coordinates of every repeated path are compared, by a digest of the words themselves, across
   all its places; should two places differ, their hashes collided, and all is done again with other hashes.

Source coordinates (document, first k-mer, number) are carried along, so the spans to remove are exact places, judged
on the input: every word of every occurrence of a repeated k-mer goes, overlaps and the same document included.
k-mers that branch are compared by two independent 64-bit hashes.

Scale: a text gives about 2 / (window - seed + 2) rows a word; all groups are counted by partial aggregation and
joined back, so a passage in a third of all texts is a sum and not a gathered list. The tables joined back are broadcast
while they are small and else met by shuffles that adaptive execution splits. Texts are shuffled once, to meet
their paths; only texts with a branching path that occurs once are kept for a second look.

Edge cases: a null or empty text has no words; texts shorter than the window lose nothing; a very long text is a slice
of its own, and its paths are rows like any other; repeated rows lose all words when they have a window's worth; rows
that share an id and a text are treated alike, rows that share only the id are told apart by their texts; a null id is
an id like any other; there are no ties, since every occurrence goes; other columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm._text import PLAIN, Words, hash_words, mix, sliced, split_words
from corpusflow.operators.components import components
from corpusflow.session import cut, release, stored
from corpusflow.sources.files import delete

STEP = np.uint64(0x9E3779B97F4A7C15)
STEP2 = np.uint64(0xD1B54A32D192ED03)


def rolled(h: np.ndarray, size: int, step: np.uint64) -> np.ndarray:
    """Hash of each `size` consecutive words, by doubling: the hash of 2m words from two of m."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done = None, 0
    part, width, power = h, 1, np.full(1, step)  # arrays wrap around without a warning
    rest = size
    while rest:
        if rest & 1:
            here = part[done : done + n] if total is not None else part[:n]
            total = here.copy() if total is None else total * power + here
            done += width
        rest >>= 1
        if rest:
            part = part[:-width] * power + part[width:] if width < len(part) else part[:0]
            power, width = power * power, 2 * width
    return mix(total)


def word_hashes(w: Words, salt: int) -> np.ndarray:
    return hash_words(w.vocab, f"substrings-{salt}")[w.ids] if len(w.ids) else np.zeros(0, np.uint64)


def paths(w: Words, window: int, seed: int, salt: int) -> tuple[np.ndarray, ...]:
    """(text, first k-mer, k-mers, minimizer, content, head, tail) of each path of a slice."""
    h = word_hashes(w, salt)
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, *[none.view(np.uint64)] * 4
    small = rolled(h, seed, STEP)
    span = window - seed + 1
    # leftmost minimum of each `span` seeds, by doubling
    best, at, width = small, np.arange(len(small)), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at, width = np.where(take, right, left), np.where(take, at[step:], at[:-step]), width + step
    best, at = best[:n], at[:n]
    text = np.repeat(np.arange(len(w.starts) - 1), np.diff(w.starts))
    valid = text[:n] == text[window - 1 : window - 1 + n]
    place = np.flatnonzero(valid)
    if not len(place):
        return none, none, none, *[none.view(np.uint64)] * 4
    new = np.concatenate([[True], (at[place[1:]] != at[place[:-1]]) | (place[1:] != place[:-1] + 1)])
    first = place[new]
    count = np.diff(np.append(np.flatnonzero(new), len(place)))
    full, other = rolled(h, window, STEP), rolled(h, window, STEP2)
    last = first + count - 1
    # first and last k-mer and their distance tell all words when the path is no longer than a k-mer
    content = mix(mix(full[first] * STEP + other[last]) ^ mix(other[first] * STEP2 + full[last]) + count.astype(np.uint64))
    node = rolled(h, window - 1, STEP)
    return text[first], first - w.starts[text[first]], count, best[first], content, node[first], node[last + 1]


FULL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def digest(w: Words, rows: np.ndarray, first: np.ndarray, n: np.ndarray, window: int) -> tuple[list[int], list[str], list[str]]:
    """Removed words, hash and text of what stays, of each text; rows, first, n: the repeated stretches."""
    gone = np.zeros(len(w.ids) + 1, np.int64)
    a = w.starts[rows] + first
    np.add.at(gone, a, 1)
    np.add.at(gone, a + n + window - 1, -1)
    stays = np.cumsum(gone[:-1]) == 0
    words = w.vocab.to_numpy(zero_copy_only=False)[w.ids] if len(w.ids) else np.zeros(0, object)
    kept = [" ".join(words[x:y][stays[x:y]]) for x, y in zip(w.starts[:-1], w.starts[1:], strict=True)]
    left = np.append(0, np.cumsum(~stays))
    return (left[w.starts[1:]] - left[w.starts[:-1]]).tolist(), [hashlib.sha256(t.encode()).hexdigest() for t in kept], kept


def lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct of a list column, and the struct's fields."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), size), [flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)]


def compacted(counted: DataFrame) -> DataFrame:
    """(content, unitig) of the repeated contents (content, head, tail, times) that are part of a longer nonbranching path."""
    degree = lambda node, name: counted.groupBy(node).agg(F.count("*").alias(name)).where(f"{name} = 1").select(F.col(node).alias("node"))
    lone = degree("tail", "ins").join(degree("head", "outs"), "node")
    repeated = counted.where("times > 1")
    before = repeated.select(F.col("content").alias("a"), F.col("tail").alias("node"), "times")
    after = repeated.select(F.col("content").alias("b"), F.col("head").alias("node"), F.col("times").alias("times_b"))
    links = before.join(after, "node").join(lone, "node", "left_semi").where("times = times_b and a <> b")
    return components(links.select("a", "b")).select(F.col("id").alias("content"), F.col("component").alias("unitig"))


def merged(row: np.ndarray, first: np.ndarray, n: np.ndarray, unitig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Repeated paths that follow one another in a text on one nonbranching path, as spans."""
    order = np.lexsort((first, row))
    row, first, n, unitig = row[order], first[order], n[order], unitig[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (unitig[1:] != unitig[:-1]) | (first[1:] != first[:-1] + n[:-1])
    start = np.flatnonzero(new)
    return row[start], first[start], np.add.reduceat(n, start) if len(start) else n, unitig[start]


def by_slice(make: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = 3 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """make over every slice; a slice and all that was made of it go before the next one comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most):
            yield make(batch)
            del batch

    return run


def few(df: DataFrame, most: int) -> DataFrame:
    """A stored table, marked for broadcast if it has no more than `most` rows of a few numbers each."""
    return F.broadcast(df) if df.count() <= most else df


def removed(docs: DataFrame, window: int = 35, seed: int = 16, with_text: bool = False, most_broadcast: int = 500_000, salt: int = 0) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept, the words that stay, if asked)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("key", F.hash("text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, first, count, *hashes = paths(split_words(batch.column("text"), PLAIN), window, seed, salt)
        pick = pa.array(text)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pick), batch.column("key").take(pick), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int16)), *(pa.array(x.view(np.int64)) for x in hashes)],
            names=["doc_id", "key", "first", "n", "least", "content", "head", "tail"],
        )

    every = base.mapInArrow(by_slice(make), "doc_id long, key int, first int, n short, least long, content long, head long, tail long")
    # stored tables, so that joins with them can be broadcast, or split where a passage is in very many texts
    twice = cut(every.groupBy("least").agg(F.count("*").alias("total")).where("total > 1").select("least"))
    met, met_path = stored(every.join(few(twice, 3 * most_broadcast), "least"))  # a number a row
    release(docs.sparkSession)
    counted, counted_path = stored(met.groupBy("least", "content").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "key", "first")).alias("one"), F.min("head").alias("head"), F.min("tail").alias("tail")))
    unitigs = few(cut(compacted(counted)), most_broadcast)
    release(docs.sparkSession)
    kinds = counted.groupBy("least").agg((F.count("*") > 1).alias("branches"), F.min("times").alias("fewest"))
    open_ = few(cut(kinds.where("branches and fewest = 1").select("least", F.lit(True).alias("open"))), most_broadcast)
    counted = counted.join(open_, "least", "left").select("least", "content", "times", "one", F.coalesce("open", F.lit(False)).alias("open")).where("times > 1 or open")
    counted = counted.join(unitigs, "content", "left").withColumn("unitig", F.coalesce("unitig", "content"))
    named = met.join(few(cut(counted), most_broadcast), ["least", "content"])
    rep = F.col("one").eqNullSafe(F.struct("doc_id", "key", "first"))
    place = F.struct(F.col("first"), F.col("n"), (F.col("times") > 1).alias("whole"), (F.col("open") & rep).alias("expand"), F.hash("unitig").alias("unitig"), F.col("content"))
    of_text = named.groupBy("doc_id", "key").agg(F.collect_list(place).alias("paths"))
    of_text, of_path = stored(of_text.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "paths"))
    del met, counted, named
    release(docs.sparkSession)
    for path in (met_path, counted_path):
        delete(docs.sparkSession, path)
    joined = base.join(of_text, base["doc_id"].eqNullSafe(of_text["id"]) & (base["key"] == of_text["k"]), "left").select("doc_id", "key", "text", "paths")

    def first_pass(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = split_words(batch.column("text"), PLAIN)
        row, (first, n, whole, expand, unitig, content) = lists(batch.column("paths"))
        first, n, whole, expand = first.astype(np.int64), n.astype(np.int64), whole.astype(bool), expand.astype(bool)
        s_row, s_first, s_n, s_unitig = merged(row[whole], first[whole], n[whole], unitig[whole])
        cut_, shas, kept = digest(w, s_row, s_first, s_n, window)
        # the words at each place of a repeated path
        words = w.vocab.to_numpy(zero_copy_only=False)[w.ids] if len(w.ids) else np.zeros(0, object)
        at = np.flatnonzero(whole)
        begin = w.starts[row[at]] + first[at]
        digests = [hashlib.md5(" ".join(words[a:b]).encode(), usedforsecurity=False).digest() for a, b in zip(begin.tolist(), (begin + n[at] + window - 1).tolist(), strict=True)]
        checks = pa.StructArray.from_arrays([pa.array(content[at], pa.int64()), pa.array(digests, pa.binary())], names=["content", "words"])
        check_at = np.append(0, np.cumsum(np.bincount(row[at], minlength=batch.num_rows))).astype(np.int32)
        unsure = np.zeros(batch.num_rows, bool)
        unsure[row[~whole]] = True
        h = word_hashes(w, salt)
        full, other = rolled(h, window, STEP), rolled(h, window, STEP2)
        e_row, e_n, once = np.repeat(row[expand], n[expand]), n[expand], np.repeat(~whole[expand], n[expand])
        at = np.repeat(first[expand], e_n) + np.arange(int(e_n.sum())) - np.repeat(np.cumsum(e_n) - e_n, e_n)
        place = w.starts[e_row] + at
        order = np.argsort(e_row, kind="stable")
        kmers = pa.StructArray.from_arrays(
            [pa.array(at[order].astype(np.int32)), pa.array(once[order]), pa.array(full[place][order].view(np.int64)), pa.array(other[place][order].view(np.int64))], names=["at", "once", "h1", "h2"])
        offsets = np.append(0, np.cumsum(np.bincount(e_row, minlength=batch.num_rows))).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(s_first.astype(np.int32)), pa.array(s_n.astype(np.int32)), pa.array(s_unitig, pa.int32())], names=["first", "n", "unitig"])
        span_at = np.append(0, np.cumsum(np.bincount(s_row, minlength=batch.num_rows))).astype(np.int32)
        again = batch.column("text").take(pa.array(np.arange(batch.num_rows), mask=~unsure))  # null where all is known
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(w.counts), pa.array(cut_, pa.int64()), pa.array(shas, pa.string()), pa.array(kept if with_text else [None] * len(kept), pa.string()),
             again, pa.ListArray.from_arrays(pa.array(span_at), spans), pa.ListArray.from_arrays(pa.array(offsets), kmers), pa.ListArray.from_arrays(pa.array(check_at), checks)],
            names=["doc_id", "key", "n_words", "n_removed", "kept_sha256", "kept", "text", "spans", "kmers", "checks"],
        )

    middle = "spans array<struct<first:int,n:int,unitig:int>>, kmers array<struct<at:int,once:boolean,h1:long,h2:long>>, checks array<struct<content:long,words:binary>>"
    half, _ = stored(joined.mapInArrow(by_slice(first_pass), f"doc_id long, key int, n_words long, n_removed long, kept_sha256 string, kept string, text string, {middle}"))
    del of_text, joined
    release(docs.sparkSession)
    delete(docs.sparkSession, of_path)
    same = half.select(F.explode("checks").alias("c")).groupBy("c.content").agg((F.min("c.words") != F.max("c.words")).alias("differ"))
    if not same.where("differ").isEmpty():
        return removed(docs, window, seed, with_text, most_broadcast, salt + 1)
    kmers = half.select("doc_id", "key", F.explode("kmers").alias("x")).select("doc_id", "key", "x.*")
    # a k-mer of two contents repeats; each content is here once
    again = kmers.groupBy("h1", "h2").agg(F.count("*").alias("total")).where("total > 1").select("h1", "h2")
    single = kmers.where("once").join(again, ["h1", "h2"]).groupBy("doc_id", "key").agg(F.collect_list(F.struct(F.col("at").alias("first"), F.lit(1).alias("n"), F.lit(0).alias("unitig"))).alias("more"))
    single = single.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "more")
    unsure = half.where("text is not null")
    unsure = unsure.join(single, unsure["doc_id"].eqNullSafe(single["id"]) & (unsure["key"] == single["k"]), "left")
    unsure = unsure.select("doc_id", "text", F.concat("spans", F.coalesce("more", F.array().cast("array<struct<first:int,n:int,unitig:int>>"))).alias("spans"))

    def second_pass(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = split_words(batch.column("text"), PLAIN)
        row, (first, n, _) = lists(batch.column("spans"))
        cut_, shas, kept = digest(w, row, first.astype(np.int64), n.astype(np.int64), window)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.counts), pa.array(cut_, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = half.where("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").union(unsure.mapInArrow(by_slice(second_pass), FULL))
    return out if with_text else out.drop("kept")
