"""Language-model scores from an Elias-Fano n-gram trie.

The model is a trigram one with absolute discounting, interpolated down to the unigram estimate
(c + 0.5) / (N + 0.5 (V + 1)), so it sums to one over the vocabulary and one unknown word. A text is its words (A-Z
lower-cased) and one end; two start marks stand before it.

1. Words are counted by partial sums, and their counts written as Elias-Fano shards by hash.
2. Bigrams of words so frequent that they would fill a good part of a trie's shard are dealt once, by both words, to bigram
   shards of their own.
3. Each slice of texts sums its trigrams and deals the distinct ones, packed, to shards by their middle word v (a frequent
   word is dealt further by the first word u), with the documents that they stand in and the lower-order
   probability that the slice can look up by itself. So n-grams go to their shard, and no slice opens a shard of the trie.
4. A shard's task makes its trie from the trigrams of training texts, writes it to the shared folder, maps it into memory,
   scores all trigrams that came to it, and gives each slice's documents their partial sums, which are added up. The shard
   has served its turn then and goes, unless the caller keeps it.

A shard's n-grams are taken in a few parts by their words, each a trie of its own, to keep memory low:

  level 1   the middle words v (hashes), pointers to their successors, weights of the lower order
  level 2   the successors w of each v as v * 2^32 + fingerprint, discounted probabilities
  level 3   the contexts (v, u) likewise, pointers, weights; their successors as ranks among v's successors
            (context-relative, so a few bits each), discounted probabilities

Key sequences and pointers are Elias-Fano coded, probabilities are quantised to 16 bits of a logarithm. A trigram is
found by the rank of w among v's successors, searched in the range of (v, u).

Scale: a task holds one slice or one shard (about `shard_tokens` tokens). What slices deal out is at most a row's
worth for each token. Words are told apart by 128 bits in the counts; in the trie by 48 bits (and the shard) for v and 32 for its neighbours,
where a collision takes an unseen successor for a seen one in about one of 10^9 comparisons. Slices are numbered
by partition and place, so the input's rows must come in the same order when a task runs again, as from files.

Edge cases: a null or empty text is its end alone; a very long text is a slice of its own; without training texts all
counts are zero; rows with a null id are scored and train (crc32 of null is null, so they are not held out); equal rows
and rows that share an id each count and get their own row; sums do not depend on ties; other columns, whatever their
names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm._text import LOWER, Words, hash_words, mix, sliced, split_words
from corpusflow.llm.eliasfano import EliasFano
from corpusflow.session import release, shared_dir

START, END = np.uint64(0x51A27D3C00000001), np.uint64(0x51A27D3C00000002)
FINGER, BITS = np.uint64((1 << 40) - 1), np.uint64(32)
DISCOUNT, SCALE = 0.75, 2048
SLICE, PARTS = 4 << 20, 4


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def log_code(x: np.ndarray) -> np.ndarray:
    return np.minimum(65535, np.round(-np.log10(np.maximum(x, 1e-31)) * SCALE)).astype(np.uint16)


def from_code(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-q.astype(np.float64) / SCALE)


def padded(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u, v, x of each token as places in the hashes that come last, and its text."""
    n, m = len(w.starts) - 1, len(w.vocab)
    flat = np.empty(len(w.ids) + 3 * n, np.int64)
    first = w.starts[:-1] + 3 * np.arange(n)
    flat[first] = flat[first + 1] = m
    flat[np.arange(len(w.ids)) + np.repeat(3 * np.arange(n) + 2, w.counts)] = w.ids
    flat[first + w.counts + 2] = m + 1
    token = np.ones(len(flat), bool)
    token[first] = token[first + 1] = False
    at = np.flatnonzero(token)
    hashes = np.concatenate([hash_words(w.vocab), [START, END]]).astype(np.uint64)
    return flat[at - 2], flat[at - 1], flat[at], hashes


class Heavy(NamedTuple):
    """Words that would fill a shard: sorted hashes, parts, counts, and weights of the lower order."""

    words: np.ndarray
    parts: np.ndarray
    totals: np.ndarray
    weights: np.ndarray

    def place(self, v: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for others."""
        if not len(self.words):
            return np.full(len(v), -1)
        at = np.minimum(np.searchsorted(self.words, v), len(self.words) - 1)
        return np.where(self.words[at] == v, at, -1)

    def shard(self, v: np.ndarray, u: np.ndarray, shards: int) -> np.ndarray:
        at = self.place(v)
        parts = np.where(at >= 0, self.parts[at], np.uint64(1)) if len(self.words) else np.ones(len(v), np.uint64)
        return ((mix(v) + mix(u ^ START) % parts) % np.uint64(shards)).astype(np.int64)


def store(root: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after another, 8-byte aligned, under a head of types, places and lengths; renamed into place when whole."""
    system, base = fs.FileSystem.from_uri(root)
    kinds = {"uint16": 0, "int64": 1, "uint64": 2, "int32": 3, "float64": 4}
    at, head = 8 + 24 * len(arrays), [len(arrays)]
    for x in arrays:
        head += [kinds[str(x.dtype)], at, len(x)]
        at += -(-x.nbytes // 8) * 8
    system.create_dir(base)
    temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(np.array(head, np.int64).tobytes())
        for x in arrays:
            out.write(x.tobytes() + bytes(-x.nbytes % 8))
    system.move(temporary, f"{base}/{name}")


def load(root: str, name: str) -> list[np.ndarray] | None:
    """The arrays, memory-mapped where the shared folder is mounted; None if there is no such shard."""
    system, base = fs.FileSystem.from_uri(root)
    path = f"{base}/{name}"
    if isinstance(system, fs.LocalFileSystem):
        if not os.path.exists(path):
            return None
        raw = np.memmap(path, np.uint8, "r")
    else:
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with system.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 + 24 * n].view(np.int64).reshape(n, 3)
    kinds = (np.uint16, np.int64, np.uint64, np.int32, np.float64)
    return [raw[at : at + length * np.dtype(kinds[kind]).itemsize].view(kinds[kind]) for kind, at, length in head]


def remove(root: str, name: str) -> None:
    system, base = fs.FileSystem.from_uri(root)
    system.delete_file(f"{base}/{name}")


def slim(x: np.ndarray) -> np.ndarray:
    """The numbers in the smallest type that holds them."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


KINDS = "u1 u2 u4 u8 f4 f8 i8 ?".split()


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays, byte by byte of their numbers, which compresses better."""
    head = np.array([len(arrays), *(x for a in arrays for x in (KINDS.index(a.dtype.str.lstrip("<|").replace("b1", "?")), len(a)))], np.int64)
    raw = head.tobytes() + b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def undump(payload: pa.Buffer) -> list[np.ndarray]:
    raw = pa.decompress(payload.slice(8), decompressed_size=int.from_bytes(payload.slice(0, 8).to_pybytes(), "little"), codec="zstd")
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2), 8 + 16 * n, []
    for kind, length in head.tolist():
        dtype = np.dtype(KINDS[kind])
        part = np.frombuffer(raw, np.uint8, dtype.itemsize * length, at).reshape(dtype.itemsize, length)
        out.append(np.ascontiguousarray(part.T).view(dtype).reshape(-1))
        at += dtype.itemsize * length
    return out


def short(hashes: np.ndarray) -> np.ndarray:
    """The low 48 bits of hashes as six bytes each, and back."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6].T).reshape(-1)


def from_short(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = raw.reshape(6, -1).T
    return wide.view(np.uint64).reshape(-1)


def starts(x: np.ndarray) -> np.ndarray:
    """1 where a sorted sequence goes on to another value, from 1 on."""
    return (np.diff(x, prepend=-1) != 0).astype(np.uint8)


def trie(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The levels of a shard from its distinct trigrams (v, fingerprints of u and w), sorted by them, and their counts.

    Of a heavy word only what its contexts hold is here: its second level gives ranks and no probabilities that are used.
    """
    nodes, at_v = np.unique(v, return_inverse=True)
    code, at = np.unique((at_v.astype(np.uint64) << BITS) | w, return_inverse=True)
    bc = np.bincount(at, weights=c, minlength=len(code)).astype(np.int64)
    rank_v = (code >> BITS).astype(np.int64)
    fan = np.bincount(rank_v, minlength=len(nodes))
    first = np.cumsum(fan) - fan
    total = np.bincount(rank_v, weights=bc, minlength=len(nodes)).astype(np.int64)
    two = log_code(np.maximum(bc - DISCOUNT, 1e-9) / total[rank_v])
    gamma1 = log_code(DISCOUNT * fan / total)
    # contexts come sorted by (v, fingerprint of u); their children by rank among v's successors
    context, child = (at_v.astype(np.uint64) << BITS) | u, at - first[at_v]
    new = np.ones(len(context), bool)
    new[1:] = context[1:] != context[:-1]
    start = np.flatnonzero(new)
    contexts, rank_c = context[start], np.cumsum(new) - 1
    width = np.diff(np.append(start, len(context)))
    sums = np.add.reduceat(c, start) if len(start) else np.zeros(0, np.int64)
    three = log_code(np.maximum(c - DISCOUNT, 1e-9) / sums[rank_c])
    gamma2 = log_code(DISCOUNT * width / sums)
    most = int(fan.max(initial=0)) + 1
    universe = max(1, len(nodes)) << 32
    coded = [
        EliasFano.build(nodes, 1 << 48), EliasFano.build(np.append(first, len(code)), len(code) + 1), EliasFano.build(code, universe),
        EliasFano.build(contexts, universe),
        EliasFano.build(rank_c.astype(np.uint64) * np.uint64(most) + child.astype(np.uint64), max(1, len(contexts)) * most),
    ]
    return [np.array([most], np.int64), gamma1, two, gamma2, three, *(x for e in coded for x in e.parts())]


class Shard:
    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.most, (self.gamma1, self.two, self.gamma2, self.three) = np.uint64(arrays[0][0]), arrays[1:5]
        self.nodes, self.pointers, self.successors, self.contexts, self.children = (EliasFano.of(arrays[5 + 4 * k : 9 + 4 * k]) for k in range(5))

    def probabilities(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, low: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """p(w | u, v) of distinct trigrams; low: the unigram estimate of w, or where v is heavy its bigram probability."""
        words, back = np.unique(v, return_inverse=True)
        node = self.nodes.find(words)
        known = node >= 0
        gamma1 = np.ones(len(words))
        gamma1[known] = from_code(self.gamma1[node[known]])
        first = np.zeros(len(words), np.int64)
        first[known] = self.pointers.get(node[known]).astype(np.int64)
        node, first = node[back], first[back]
        p = np.where(heavy, low, gamma1[back] * low)
        seen = np.flatnonzero(node >= 0)
        at = np.full(len(v), -1)
        at[seen] = self.successors.find((node[seen].astype(np.uint64) << BITS) | w[seen])
        met = (at >= 0) & ~heavy
        p[met] += from_code(self.two[at[met]])
        contexts, back = np.unique((node[seen].astype(np.uint64) << BITS) | u[seen], return_inverse=True)
        place = self.contexts.find(contexts)
        gamma2 = np.ones(len(contexts))
        gamma2[place >= 0] = from_code(self.gamma2[place[place >= 0]])
        place = place[back]
        p[seen] *= gamma2[back]
        deep = (place >= 0) & (at[seen] >= 0)
        rows = seen[deep]
        child = self.children.find(place[deep].astype(np.uint64) * self.most + (at[rows] - first[rows]).astype(np.uint64))
        p[rows[child >= 0]] += from_code(self.three[child[child >= 0]])
        return p

    def in_parts(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, low: np.ndarray, heavy: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
        """probabilities() of many trigrams, some at a time; low comes as codes."""
        parts = [self.probabilities(v[a : a + at_once], u[a : a + at_once], w[a : a + at_once], from_code(low[a : a + at_once]), heavy[a : a + at_once]) for a in range(0, len(v), at_once)]
        return np.concatenate(parts) if parts else np.zeros(0)


class Counts:
    """The counts of words, in shards that are mapped as they are asked for."""

    def __init__(self, root: str, files: int) -> None:
        self.files = files
        self.at = lru_cache(8)(lambda k: load(root, f"counts-{k}"))

    def of(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        part = part_of(h, self.files)
        order = np.lexsort((h, part))
        edges = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mine = order[a:b]
            if (arrays := self.at(int(part[mine[0]]))) is None:
                continue
            (c, checks), keys = arrays[:2], EliasFano.of(arrays[2:])
            at = keys.find(h[mine])
            mine, at = mine[at >= 0], at[at >= 0]
            while len(mine):  # equal hashes stand side by side
                same = checks[at] == check[mine]
                out[mine[same]] = c[at[same]]
                mine, at = mine[~same], at[~same] + 1
                if len(mine):
                    on = at < keys.n
                    on[on] = keys.get(at[on]) == h[mine[on]]
                    mine, at = mine[on], at[on]
        return out


def part_of(h: np.ndarray, files: int) -> np.ndarray:
    return ((h >> np.uint64(7)) % np.uint64(files)).astype(np.int64)


def check_of(vocab: pa.Array) -> np.ndarray:
    return hash_words(vocab, "corpusflow-check")


def word_counts(base: DataFrame, root: str) -> tuple[int, int, int, DataFrame]:
    """Count training words and write their shards; tokens, distinct words, shards, and the counts (h, c)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            batch = batch.filter(batch.column("train"))
            if not batch.num_rows:
                continue
            w = split_words(batch.column("text"), LOWER)
            c = np.append(np.bincount(w.ids, minlength=len(w.vocab)), batch.num_rows)
            h, check = np.append(hash_words(w.vocab), END).astype(np.uint64), np.append(check_of(w.vocab), END).astype(np.uint64)
            used = c > 0  # the vocabulary may hold an empty word that stands nowhere
            yield pa.RecordBatch.from_arrays([pa.array(x[used].view(np.int64)) for x in (h, check, c.astype(np.int64))], names=["h", "check", "c"])

    path = f"{root}/words"
    base.mapInArrow(count, "h long, check long, c long").groupBy("h", "check").agg(F.sum("c").alias("c")).write.parquet(path)
    counted = base.sparkSession.read.parquet(path)
    distinct, tokens = counted.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    files = max(1, math.ceil(distinct / 2_000_000))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            h, check = (batch.column(x).to_numpy().view(np.uint64) for x in ("h", "check"))
            part = batch.column("part").to_numpy()
            for k in np.unique(part):
                parts.setdefault(int(k), []).append((h[part == k], check[part == k], batch.column("c").to_numpy()[part == k]))
        for k, rows in parts.items():
            h, check, c = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(h)
            store(root, f"counts-{k}", [c[order], check[order], *EliasFano.build(h[order], 1 << 64).parts()])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32())], names=["part"])

    part = F.pmod(F.shiftrightunsigned("h", 7), F.lit(files)).cast("int")
    counted.select("h", "check", "c", part.alias("part")).repartition(files, "part").mapInArrow(write, "part int").write.format("noop").mode("overwrite").save()
    return int(tokens), int(distinct), files, counted.select("h", "c")


def heavy_words(base: DataFrame, root: str, counted: DataFrame, shard_tokens: int) -> tuple[Heavy, int]:
    """The words of more than a quarter of shard_tokens (four for each shard at most), their bigrams dealt to shards.

    The start mark, which stands before every text, is one of them when texts are as many.
    """
    most = max(1, shard_tokens // 4)
    found = {r.h & (2**64 - 1): int(r.c) for r in counted.where(F.col("c") > most).collect()}
    if int(END) in found:
        found[int(START)] = found[int(END)]
    rows = sorted(found.items())
    words, totals = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
    heavy = Heavy(words, (1 + totals // most).astype(np.uint64), totals, np.ones(len(rows)))
    if not rows:
        return heavy, 0
    shards = math.ceil(int(totals.sum()) / shard_tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            batch = batch.filter(batch.column("train"))
            if not batch.num_rows:
                continue
            _, v, w, hashes = padded(split_words(batch.column("text"), LOWER))
            place = heavy.place(hashes)
            mine = place[v] >= 0
            code, c = np.unique(place[v[mine]] * len(hashes) + w[mine], return_counts=True)
            v, w = code // len(hashes), hashes[code % len(hashes)]
            shard = bigram_shard(heavy.words[v], w, shards)
            order = np.lexsort((w, v, shard))
            edges = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
            parts = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            payloads = [dump(slim(v[x]), w[x], slim(c[x])) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[x[0]]) for x in parts], pa.int32()), pa.array(payloads, pa.binary())], names=["shard", "rows"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_shard(batches):
            v, w, c = (np.concatenate(x) for x in zip(*(undump(r) for r in rows), strict=True))
            code, at = np.unique((v.astype(np.uint64) << np.uint64(40)) | (w & FINGER), return_inverse=True)
            c = np.bincount(at, weights=c)
            v = (code >> np.uint64(40)).astype(np.int64)
            store(root, f"bigrams-{shard}", [log_code(np.maximum(c - DISCOUNT, 1e-9) / heavy.totals[v]), *EliasFano.build(code, max(1, len(heavy.words)) << 40).parts()])
            some, fan = np.unique(v, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(fan)], names=["v", "fan"])

    dealt = base.mapInArrow(count, "shard int, rows binary").repartition(shards, "shard").sortWithinPartitions("shard")
    fans = {r.v: r.fan for r in dealt.mapInArrow(build, "v long, fan long").groupBy("v").agg(F.sum("fan").alias("fan")).collect()}
    weights = np.array([DISCOUNT * fans.get(k, 0) / max(1, totals[k]) for k in range(len(rows))])
    return heavy._replace(weights=weights), shards


def bigram_shard(v: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(v) ^ mix(w ^ END)) % np.uint64(shards)).astype(np.int64)


class Bigrams:
    """p(w | v) of heavy words, from the bigram shards."""

    def __init__(self, root: str, heavy: Heavy, shards: int) -> None:
        self.heavy, self.shards = heavy, shards
        self.at = lru_cache(8)(lambda k: load(root, f"bigrams-{k}"))

    def probabilities(self, v: np.ndarray, w: np.ndarray, base: np.ndarray) -> np.ndarray:
        """v: places of heavy words; w: hashes."""
        p = self.heavy.weights[v] * base
        shard = bigram_shard(self.heavy.words[v], w, self.shards)
        code = (v.astype(np.uint64) << np.uint64(40)) | (w & FINGER)
        order = np.lexsort((code, shard))
        edges = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mine = order[a:b]
            if (arrays := self.at(int(shard[mine[0]]))) is not None:
                at = EliasFano.of(arrays[1:]).find(code[mine])
                p[mine[at >= 0]] += from_code(arrays[0][at[at >= 0]])
        return p


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Buffer]]]:
    """(shard, payloads) of batches that are sorted by shard."""
    now, have = None, []
    for batch in batches:
        for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("rows"), strict=True):
            if shard != now:
                if have:
                    yield now, have
                now, have = shard, []
            have.append(payload.as_buffer())
    if have:
        yield now, have


def scored(docs: DataFrame, held: Column | None = None, shard_tokens: int = 1_500_000, keep: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    keep: whether the shards of the trie stay in the shared folder, for other texts to be scored by.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    root = f"{folder if '://' in folder else 'file://' + os.path.abspath(folder)}/lm-{uuid.uuid4().hex}"
    held = held_out() if held is None else held
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("train", ~held)
    tokens, distinct, files, counted = word_counts(base, root)
    heavy, bigram_shards = heavy_words(base, root, counted, shard_tokens)
    shards = max(1, math.ceil(tokens / shard_tokens))
    release(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bigrams = Counts(root, files), Bigrams(root, heavy, bigram_shards)
        task, number = TaskContext.get().partitionId() << 24, 0
        for batch in sliced(batches, SLICE):
            words = split_words(batch.column("text"), LOWER)
            u, v, w, hashes = padded(words)
            m, train = len(hashes), batch.column("train").to_numpy(zero_copy_only=False)
            c = counts.of(np.append(hashes[:-2], END), np.append(check_of(words.vocab), END))
            c = np.concatenate([c[:-1], [0], c[-1:]])  # the start mark is no token
            p1 = (c + 0.5) / (tokens + 0.5 * (distinct + 1))
            n = words.counts + 1
            text = np.repeat(np.arange(batch.num_rows), n)
            total = lambda x: np.bincount(text, weights=x, minlength=batch.num_rows)
            known, base_score = total((c > 0)[w]).astype(np.int64), total(np.log10(p1)[w])
            pair, at = np.unique(v * m + u, return_inverse=True)
            code, back = np.unique(at * m + w, return_inverse=True)
            del u, v, at
            times = np.bincount(back[train[text]], minlength=len(code))
            of_pair = code // m
            tv, tu, tw = pair[of_pair] // m, pair[of_pair] % m, code % m
            places = np.argsort(back, kind="stable")
            docs_of, occurs = text[places], np.bincount(back, minlength=len(code))
            first = np.cumsum(occurs) - occurs
            at_heavy = heavy.place(hashes)[tv]
            low, finger = log_code(p1), hashes.astype(np.uint32)
            low_heavy = np.zeros(len(code), np.uint16)
            is_heavy = at_heavy >= 0
            at_start, own = is_heavy & (tv == m - 2), np.zeros(batch.num_rows)
            if is_heavy.any():
                two, twice = np.unique(at_heavy[is_heavy] * m + tw[is_heavy], return_inverse=True)
                p2 = bigrams.probabilities(two // m, hashes[two % m], p1[two % m])
                low_heavy[is_heavy] = log_code(p2)[twice]
            if at_start.any():
                # before a text stands the start mark alone, so the slice knows all of it: its trigrams are its bigrams
                logs = np.zeros(len(code))
                weight, p2 = heavy.weights[at_heavy[at_start]], p2[twice[at_start[is_heavy]]]
                logs[at_start] = np.log10(np.minimum(1.0, (1 + weight) * p2 - weight * p1[tw[at_start]]))
                own = total(logs[back])
            shard = heavy.shard(hashes[tv], hashes[tu], shards)
            key = 2 * shard + is_heavy
            order = np.argsort(key, kind="stable")
            order = order[~at_start[order]]
            edges = np.append(np.flatnonzero(np.diff(key[order], prepend=-1)), len(order))
            here = np.array([task | number], np.int64)
            to, payloads = [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                x = order[a:b]
                new_pair = starts(of_pair[x])
                pairs = pair[of_pair[x][new_pair == 1]]
                new_v = starts(pairs // m)
                many = int(occurs[x].sum())
                rows = np.repeat(first[x] - np.cumsum(occurs[x]) + occurs[x], occurs[x]) + np.arange(many)
                lows = low_heavy[x] if is_heavy[x[0]] else low[tw[x]]
                to.append(int(shard[x[0]]))
                vs = pairs[new_v == 1] // m
                payloads.append(dump(here, is_heavy[x[:1]], short(hashes[vs]), new_v, finger[pairs % m], new_pair, finger[tw[x]], slim(times[x]), lows, slim(occurs[x]), slim(docs_of[rows])))
            # the slice's own row goes along, and past the shards
            ids = batch.column("doc_id")
            to.append(-1 - (task | number) % max(shards, 1))
            payloads.append(dump(here, ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid()), train, slim(n), slim(known), base_score, own))
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(payloads, pa.binary())], names=["shard", "rows"])

    def of_part(name: str, v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray, low: np.ndarray, is_heavy: np.ndarray) -> np.ndarray:
        """Log probabilities of trigrams, by the trie that those of training texts make."""
        order = np.lexsort((w, u, v))
        v, u, w = v[order], u[order], w[order]
        new = np.ones(len(order), bool)
        new[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        start = np.flatnonzero(new)
        of_row = np.empty(len(order), np.int32)
        of_row[order] = np.cumsum(new, dtype=np.int32) - 1
        v, u, w, low, is_heavy = v[start], u[start].astype(np.uint64), w[start].astype(np.uint64), low[order[start]], is_heavy[order[start]]
        c = np.add.reduceat(c[order].astype(np.int64), start) if len(start) else c.astype(np.int64)
        seen = c > 0
        if seen.any():
            store(root, name, trie(v[seen], u[seen], w[seen], c[seen]))
            p = Shard(load(root, name)).in_parts(v, u, w, low, is_heavy)
            if not keep:
                remove(root, name)
        else:
            p = from_code(low)
        return np.log10(np.minimum(p, 1.0)).astype(np.float32)[of_row]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, payloads in by_shard(batches):
            slices, out = [], []
            if shard < 0:
                slices, out = [int(undump(x)[0][0]) for x in payloads], [x.to_pybytes() for x in payloads]
            else:
                rows = [undump(x) for x in payloads]
                payloads.clear()
                of_pair = [np.cumsum(r[5], dtype=np.int32) - 1 for r in rows]
                v = np.concatenate([from_short(r[2])[(np.cumsum(r[3], dtype=np.int32) - 1)[at]] for r, at in zip(rows, of_pair, strict=True)])
                u = np.concatenate([r[4][at] for r, at in zip(rows, of_pair, strict=True)])
                w, c, low = (np.concatenate([r[k] for r in rows]) for k in (6, 7, 8))
                del of_pair
                rows = [(r[0], r[1], len(r[7]), r[9], r[10]) for r in rows]
                is_heavy = np.repeat([bool(r[1][0]) for r in rows], [r[2] for r in rows])
                # some words at a time: all of a word's n-grams, or of a heavy word's contexts
                part = (mix(np.where(is_heavy, v ^ (u * START), v) ^ END) % np.uint64(PARTS)).astype(np.uint8)
                logs = np.zeros(len(v), np.float32)
                for k in range(PARTS):
                    mine = np.flatnonzero(part == k)
                    logs[mine] = of_part(f"trie-{shard}-{k}", v[mine], u[mine], w[mine], c[mine], low[mine], is_heavy[mine])
                del v, u, w, c, low, is_heavy, part
                at = 0
                for r in rows:
                    mine = np.repeat(logs[at : at + r[2]], r[3])
                    at += r[2]
                    sums = np.bincount(r[4], weights=mine)
                    some = np.flatnonzero(np.bincount(r[4]))
                    slices.append(int(r[0][0]))
                    out.append(dump(r[0], slim(some), sums[some].astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array([shard < 0] * len(out)), pa.array(out, pa.binary())], names=["slice", "whole", "rows"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, sums = None, None, np.zeros(0)

        def finish() -> pa.RecordBatch:
            _, ids, valid, train, n, known, base_score, _ = own
            arrays = [pa.array(ids, mask=~valid), pa.array(~train), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), tokens)), pa.array(base_score), pa.array(sums)]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            for number, whole, payload in zip(batch.column("slice").to_pylist(), batch.column("whole").to_pylist(), batch.column("rows"), strict=True):
                if number != now and own is not None:
                    yield finish()
                now, parts = number, undump(payload.as_buffer())
                if whole:  # a slice's own row comes first
                    own, sums = parts, parts[7].copy()
                else:
                    sums[parts[1]] += parts[2]
        if own is not None:
            yield finish()

    # rarely two shards to a task
    dealt = base.mapInArrow(deal, "shard int, rows binary").repartition(4 * shards, "shard").sortWithinPartitions("shard")
    parts = dealt.mapInArrow(score, "slice long, whole boolean, rows binary").repartition("slice").sortWithinPartitions("slice", F.desc("whole"))
    return parts.mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
