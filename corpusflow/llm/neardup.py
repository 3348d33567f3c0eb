"""MinHash near-dedup by a multi-index Hamming join, confirmed on whole shingle sets.

A document's set is its distinct shingles of `size` words, five by default (a shorter text is one shingle). Its signature is
`chunks * width` b-bit minima. Two sets of Jaccard similarity 0.8 differ in 0.2 of the positions on average; of 95
positions they differ in more than 37 with a probability under 1e-5 (binomial tail), and in fewer when they are
closer. With at most 37 differing positions in 19 chunks of five, pigeonhole leaves a chunk with at most one
error. Each chunk is therefore indexed with each of its positions left out: every pair of signatures
within distance 37 shares such a key.

Equal sets are one node. In every key's bucket all members meet one leader only, drawn by the key, so a large group of
copies costs its size and not its square. A 64-bit sketch of the signature and the sizes prune pairs before sets are
compared (Hamming distance over 20 of 64 has a probability under 1e-5 at similarity 0.8). Each node is confirmed
against its closest bucket leaders and components are formed, again with other leaders for nodes that lie in another
component than their leader's; then the nodes of a bucket that still lie in
different components, and pass the sketch with a node of another one, are compared by an exact prefix filter over
their whole sets. Pairs within a component cannot change it, so no pair under the signature distance is lost, and a
group of near copies that are just too far apart is not compared pair by pair.

Scale: one shuffle of 95 keys a distinct set, one of the candidates' texts; buckets are windows that spill, star
shaped; no list of links, ids or components reaches the driver.

Edge cases: null or empty texts have an empty set, are their own component and are kept; equal rows are linked;
rows that share an id count as one document; a null id has a null component and is kept; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm._text import LOWER, free, hash_words, mix, sliced, split_words
from corpusflow.operators.components import components
from corpusflow.session import cut, release, stored
from corpusflow.sources.files import delete

STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = split_words(texts, LOWER)
    h = hash_words(w.vocab)[w.ids] if len(w.ids) else np.zeros(0, np.uint64)
    out = []
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        rolled = rolled * STEP + h[j : len(h) - size + 1 + j] if len(rolled) else rolled
    rolled = mix(rolled)
    for a, b in zip(w.starts[:-1], w.starts[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                short = short * STEP + x
            out.append(mix(short ^ np.uint64(0xABCDEF)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """len(sets) x n minima; sets must not be empty."""
    rng = np.random.default_rng(20240607)
    odd = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 2**63, n, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((n, len(sets)), np.uint64)
    for k in range(n):
        out[k] = np.minimum.reduceat((flat ^ flip[k]) * odd[k], starts)
    return mix(np.ascontiguousarray(out.T))


def features(docs: DataFrame, size: int, chunks: int, width: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set), signature and sketch of every row."""
    n = chunks * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 6 << 20):
            sets = shingle_sets(batch.column("text"), size)
            full = [k for k, s in enumerate(sets) if len(s)]
            codes: list[bytes | None] = [None] * len(sets)
            hashes: list[bytes | None] = [None] * len(sets)
            sketch = np.zeros(len(sets), np.int64)
            if full:
                low = minima([sets[k] for k in full], n)
                sig = (low & np.uint64(0xFFFF)).astype("<u2")
                bits = ((low[:, :64] >> np.uint64(40)) & np.uint64(1)) << np.arange(min(64, n), dtype=np.uint64)
                sketch[full] = np.bitwise_or.reduce(bits, 1).view(np.int64)
                for i, k in enumerate(full):
                    codes[k] = sig[i].tobytes()
                    s = sets[k]
                    with np.errstate(over="ignore"):
                        hashes[k] = np.array([s.sum(), mix(s ^ STEP).sum()]).tobytes() + len(s).to_bytes(4, "little")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), pa.array(codes, pa.binary()), pa.array(sketch)],
                names=["doc_id", "n_shingles", "set_hash", "signature", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_hash binary, signature binary, sketch long"
    )


def keyed(nodes: DataFrame, chunks: int, width: int) -> DataFrame:
    """(key, doc_id, sketch, n): a row for each chunk and left-out position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, chunks, width).astype(np.uint64)
                keys = np.empty((len(sig), chunks, width), np.uint64)
                for out in range(width):
                    packed = np.zeros(sig.shape[:2], np.uint64)
                    for j in range(width):
                        if j != out:
                            packed = mix(packed * STEP + sig[:, :, j] + np.uint64(1))
                    keys[:, :, out] = mix(packed ^ (np.arange(chunks, dtype=np.uint64) * np.uint64(width) + np.uint64(out + 1)) * STEP)
                each = chunks * width
                again = np.repeat(np.arange(batch.num_rows), each)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)), *(batch.column(c).take(pa.array(again)) for c in ("doc_id", "sketch", "n"))],
                    names=["key", "doc_id", "sketch", "n"],
                )

    return nodes.select("doc_id", "sketch", F.col("n_shingles").cast("int").alias("n"), "signature").mapInArrow(run, "key long, doc_id long, sketch long, n int")


def passes(s1: Column, n1: Column, s2: Column, n2: Column, percent: int, most_bits: int) -> Column:
    sized = (100 * F.least(n1, n2)) >= (percent * F.greatest(n1, n2))
    return sized & (F.bit_count(s1.bitwiseXOR(s2)) <= most_bits)


def sets_of(docs: DataFrame, ids: DataFrame, size: int, most_broadcast: int = 200_000) -> DataFrame:
    """The rows of ids (id, ...) with the whole set of their document, as sorted hashes.

    Few ids (up to `most_broadcast`, with the lists' items) go to the texts; more meet them in a shuffle.
    """
    ids = cut(ids)
    items = F.sum(F.size("to")) if "to" in ids.columns else F.count("*")
    few = (ids.agg(items).first()[0] or 0) <= most_broadcast
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    names = [c for c in ids.columns if c != "id"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 6 << 20):
            sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in names), sets], names=["id", *names, "shingles"])

    kinds = ", ".join(f"{c} {k}" for c, k in ids.dtypes if c != "id")
    return base.join(F.broadcast(ids) if few else ids, "id").mapInArrow(make, f"id long{', ' * bool(kinds)}{kinds}, shingles binary")


def routes(pairs: DataFrame) -> DataFrame:
    """(id, to): where sets must go to be compared: a's and b's to b."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("to")).union(pairs.select(F.col("b").alias("id"), F.col("b").alias("to"))).distinct()
    return both.groupBy("id").agg(F.collect_list("to").alias("to"))


def confirmed(sent: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity; sent: id, to, shingles. Sets of a follow b's own."""
    sets = sent.select("id", F.explode("to").alias("to"), "shingles")
    # a hot leader is dealt to several tasks, and its own set to each of them
    salted = sets.withColumn("salt", F.when(F.col("id") == F.col("to"), F.sequence(F.lit(0), F.lit(7))).otherwise(F.array(F.pmod(F.xxhash64("id"), F.lit(8)).cast("int"))))
    salted = salted.select("id", "to", "shingles", F.explode("salt").alias("salt"))
    dealt = salted.repartition("to", "salt").sortWithinPartitions("to", "salt", F.col("id") != F.col("to"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for id_, to, raw in zip(batch.column("id").to_pylist(), batch.column("to").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if id_ == to:
                    at, own = to, s
                    continue
                if at != to or not len(s):
                    continue
                place = np.searchsorted(own, s)
                both = int((own[np.minimum(place, len(own) - 1)] == s).sum())
                if 100 * both >= percent * (len(own) + len(s) - both):
                    a.append(id_)
                    b.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.select("id", "to", "shingles").mapInArrow(compare, "a long, b long")


def sharing(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components that can reach the similarity, by an exact prefix filter over whole sets.

    In an order by rarity, two sets that are close enough share one of their rarest (100 - percent) % + 1 shingles, and
    the first one that they share stands so early in both that what follows can still make up the similarity: a
    near copy with too many shingles of its own meets nobody.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                each = [np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()]
                n = np.array([len(x) for x in each])
                rows = pa.array(np.repeat(np.arange(len(each)), n))
                yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("component").take(rows), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(np.concatenate(each))], names=["id", "component", "n", "h"])

    rows = sets.mapInArrow(spread, "id long, component long, n int, h long")
    common = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    met = rows.join(common, "h")
    by_rarity = W.partitionBy("id").orderBy("df", "h")
    met = met.withColumn("k", F.row_number().over(by_rarity)).withColumn("own", F.col("n") - F.count("*").over(W.partitionBy("id")))
    # what is left of a set from this shingle on
    met = met.select("h", "id", "n", "component", (F.col("n") - F.col("own") - F.col("k") + 1).cast("int").alias("left"))
    prefix = cut(met.where(100 * F.col("left") >= percent * F.col("n")))
    # of a shingle, the largest component is on one side only
    by_kind = prefix.groupBy("h", "component").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    main = by_kind.groupBy("h").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("kinds"), F.min("least").alias("least")).where("kinds > 1").select("h", "main", "least")
    enough = lambda left, n1, n2: ((100 + percent) * F.col(left)) >= (percent * (F.col(n1) + F.col(n2)))
    open_ = prefix.join(main, "h").where(enough("left", "n", "least"))
    few = open_.where("component <> main").select("h", F.col("id").alias("a"), F.col("n").alias("n1"), F.col("component").alias("c1"), F.col("left").alias("left1"))
    all_ = open_.select("h", F.col("id").alias("b"), F.col("n").alias("n2"), F.col("component").alias("c2"), "main", F.col("left").alias("left2"))
    sized = enough("left1", "n1", "n2") & enough("left2", "n1", "n2")
    pairs = few.join(all_, "h").where((F.col("c1") != F.col("c2")) & ((F.col("a") < F.col("b")) | (F.col("c2") == F.col("main"))) & sized)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def drawn(rows: DataFrame, salt: int, *more: str) -> DataFrame:
    """The rows of (key, doc_id, ...) with their bucket's leader, but the leaders' own. Drawn by the key, so that a node meets other leaders in other buckets."""
    order = W.partitionBy("key").orderBy(F.xxhash64("key", "doc_id", F.lit(salt)), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("lead", F.first(F.struct("doc_id", "sketch", "n", *more)).over(order)).where("doc_id <> lead.doc_id")


def closest(met: DataFrame, rivals: int) -> DataFrame:
    """(a, b): each node with the closest of its leaders by sketch, for each of `rivals` shares of the keys."""
    far = F.bit_count(F.col("sketch").bitwiseXOR(F.col("lead.sketch")))
    best = met.groupBy(F.col("doc_id").alias("a"), F.pmod("key", F.lit(rivals))).agg(F.min(F.struct(far.alias("far"), F.col("lead.doc_id").alias("b"))).alias("x"))
    return best.select("a", "x.b").distinct()


def groups(docs: DataFrame, size: int = 5, percent: int = 80, chunks: int = 19, width: int = 5, most_bits: int = 20, rivals: int = 2, again: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    made = cut(features(docs, size, chunks, width))
    some = made.where("set_hash is not null and doc_id is not null")
    nodes = some.groupBy("set_hash").agg(F.expr("min_by(struct(doc_id, n_shingles, sketch, signature), doc_id)").alias("x"))
    nodes = cut(nodes.select("set_hash", "x.*"))
    met = drawn(keyed(nodes, chunks, width), 0)
    ok = passes(F.col("sketch"), F.col("n"), F.col("lead.sketch"), F.col("lead.n"), percent, most_bits)
    met, met_path = stored(met.select("key", "doc_id", "sketch", "n", "lead", ok.alias("ok")))
    release(docs.sparkSession)
    links = cut(confirmed(sets_of(docs, routes(closest(met.where("ok"), rivals)), size), percent))
    one = cut(components(links))
    # again with other leaders, for those that lie in another component than their leader's
    rows = met.select("key", "doc_id", "sketch", "n").union(met.groupBy("key").agg(F.first("lead").alias("lead")).select("key", "lead.doc_id", "lead.sketch", "lead.n"))
    for salt in range(1, 1 + again):
        named = rows.join(one.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        apart = drawn(named, salt, "component").where(ok & (F.col("component") != F.col("lead.component")))
        links = cut(links.union(confirmed(sets_of(docs, routes(closest(apart, rivals)), size), percent)))
        one = cut(components(links))
        release(docs.sparkSession)
    met = met.select("key", "doc_id", "sketch", "n", "ok", F.col("lead.doc_id").alias("leader"))
    # what is left: pairs of a bucket that lie in different components by now
    def component(c: str) -> Column:
        return F.coalesce(F.col("component"), F.col(c))

    inside = met.join(one.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("mine", component("doc_id")).drop("component")
    inside = inside.join(one.withColumnRenamed("id", "leader"), "leader", "left").withColumn("main", component("leader")).drop("component")
    inside, inside_path = stored(inside.select("key", "doc_id", "sketch", "n", "leader", "ok", "mine", "main"))
    del met, rows, apart, named
    release(docs.sparkSession)
    delete(docs.sparkSession, met_path)
    apart = inside.where("mine <> main").select("key", F.col("doc_id").alias("id"), "sketch", "n", "mine", "main")
    others = inside.select("key", F.col("doc_id").alias("id2"), F.col("sketch").alias("s2"), F.col("n").alias("n2"), F.col("mine").alias("c2"))
    close = (F.col("mine") != F.col("c2")) & passes(F.col("sketch"), F.col("n"), F.col("s2"), F.col("n2"), percent, most_bits)
    same_key = apart["key"] == others["key"]
    # which nodes have such a partner at all: a row for each node and key, not for each pair
    left = apart.join(others, same_key & close, "left_semi").select("id", F.col("mine").alias("component"))
    right = others.join(apart, same_key & close, "left_semi").select(F.col("id2").alias("id"), F.col("c2").alias("component"))
    near = inside.where("ok and mine <> main")
    leaders = near.select(F.col("doc_id").alias("id"), F.col("mine").alias("component")).union(near.select(F.col("leader").alias("id"), F.col("main").alias("component")))
    rest = cut(left.union(right).union(leaders).distinct())
    delete(docs.sparkSession, inside_path)
    if not rest.isEmpty():
        sets = cut(sets_of(docs, rest, size))
        pairs = cut(sharing(sets, percent))
        more = confirmed(sets.select("id", "shingles").join(routes(pairs), "id").select("id", "to", "shingles"), percent)
        one = cut(components(links.union(more)))
    named = nodes.select("set_hash", F.col("doc_id").alias("node")).join(one.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("set_hash", F.coalesce("component", "node").alias("component_id"))
    out = made.join(named, "set_hash", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each group kept, that with the group's smallest id. All columns stay.

    Where rows share an id or have none, they are told apart: of equal rows one stays, a different text is never lost.
    """
    row = free(docs.columns, "_row")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = groups(docs, size, percent).where("not kept").select(F.col("doc_id").alias(row))
        return docs.join(gone, docs["doc_id"] == gone[row], "left_anti")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = groups(rows.select(F.col(row).alias("doc_id"), "text"), size, percent).select(F.col("doc_id").alias(row), "component_id")
    named = found.join(rows.select(row, F.col("doc_id").alias("own")), row)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", row))[row].alias(row))
    return rows.join(first.select(row), row, "left_semi").drop(row)
