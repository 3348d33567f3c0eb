"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Every item is added to one
automaton over words; a document's words are streamed through it and the longest match that ends at each word is
tracked. A match as long as a window (`window` words, or all words of a shorter item) is a hit. Spans of hit words
are removed from texts, and documents over a coverage or item limit go.

Only stretches where a window's rolling hash is one of the items' hashes are streamed; the automaton then confirms
them word by word, so a hash collision costs time and never a wrong hit.

Scale: the driver builds one automaton for a share of at most about `max_words` words of the items, deals the items to
shares by hash, and broadcasts each share as flat arrays (some 60 MB at most, whatever the benchmark's size). Documents
pass the shares one after another in one map; nothing of them is shuffled.

Edge cases: a null text has no words; an empty item or document matches nothing; items with the same text all
count; an item without an id is ignored; items that share an id count as one; repeated documents and null ids each get
their own row; a very long text is a slice of its own; an empty table gives no rows, an empty benchmark leaves every
document clean; other columns, whatever their names, stay as they are in `clean` and are not read by `scan`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from corpusflow.llm._text import ALNUM, Words, free, hash_words, mix, sliced, split_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # words of unfolded texts
BASE = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """A generalised suffix automaton over words, and the windows that end at each state."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._add(last, word)
        found: dict[int, dict[int, set[str]]] = {}
        for item, words in items:
            size = min(window, len(words))
            state = matched = 0
            for k, word in enumerate(words):
                state, matched = self.next[state][word], matched + 1
                while self.length[self.link[state]] >= size and self.link[state] > 0:
                    state = self.link[state]
                matched = min(matched, self.length[state])
                if k + 1 >= size:
                    found.setdefault(state, {}).setdefault(size, set()).add(item)
        self.own = found  # by state, then size: the items whose windows end there

    def _add(self, last: int, word: str) -> int:
        at = self.next[last].get(word)
        if at is not None:
            return at if self.length[at] == self.length[last] + 1 else self._clone(last, word, at)
        new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            at = self.next[p][word]
            self.link[new] = at if self.length[at] == self.length[p] + 1 else self._clone(p, word, at)
        return new

    def _state(self, edges: dict[str, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, word: str, at: int) -> int:
        copy = self._state(dict(self.next[at]), self.length[p] + 1)
        self.link[copy], self.link[at] = self.link[at], copy
        while p >= 0 and self.next[p].get(word) == at:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def frozen(self) -> dict[str, np.ndarray | list[str]]:
        """Flat arrays: edges by state and word, links, lengths, windows by state and the next state up the links that has any."""
        names = {w: k for k, w in enumerate(sorted({w for edges in self.next for w in edges}))}
        keys = np.array([s << 32 | names[w] for s, edges in enumerate(self.next) for w in edges], np.int64)
        to = np.array([x for edges in self.next for x in edges.values()], np.int32)
        order = np.argsort(keys)
        jump = np.zeros(len(self.link), np.int32)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            jump[state] = state if state in self.own else jump[self.link[state]]
        items = sorted({x for sizes in self.own.values() for found in sizes.values() for x in found})
        place = {x: k for k, x in enumerate(items)}
        rows = sorted((s, m, place[x]) for s, sizes in self.own.items() for m, found in sizes.items() for x in found)
        return {
            "words": list(names), "keys": keys[order], "to": to[order], "link": np.array(self.link, np.int32), "length": np.array(self.length, np.int32),
            "jump": jump, "items": items, "outs": np.array(rows, np.int32).reshape(-1, 3),
        }


class Matcher:
    """A frozen automaton, and the rolling hashes that tell where streaming can find anything."""

    def __init__(self, parts: dict) -> None:
        self.parts = parts
        self.words = {w: k for k, w in enumerate(parts["words"])}
        self.keys, self.to, self.link, self.length, self.jump, self.outs = (parts[k] for k in ("keys", "to", "link", "length", "jump", "outs"))
        self.bits: dict[int, np.ndarray] = {}
        for size, known in parts["hashes"].items():
            self.bits[size] = np.zeros(1 << 22, bool)
            self.bits[size][known >> np.uint64(42)] = True

    @staticmethod
    def parts_of(items: list[tuple[str, list[str]]], window: int) -> dict:
        hashes: dict[int, list[np.ndarray]] = {}
        for _, w in items:
            size = min(window, len(w))
            hashes.setdefault(size, []).append(rolling(hash_words(pa.array(w, pa.large_string())), size))
        return SuffixAutomaton(items, window).frozen() | {"hashes": {size: np.unique(np.concatenate(x)) for size, x in hashes.items()}}

    def stream(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(place, state, longest match that ends there) of each word."""
        state = matched = 0
        for k, word in enumerate(words):
            code = self.words.get(word, -1)
            if code < 0:
                state = matched = 0
            while code >= 0:
                key = state << 32 | code
                at = int(np.searchsorted(self.keys, key))
                if at < len(self.keys) and self.keys[at] == key:
                    state, matched = int(self.to[at]), matched + 1
                    break
                if not state:
                    break
                state = int(self.link[state])
                matched = int(self.length[state])
            yield k, state, matched

    def found(self, state: int, matched: int) -> Iterator[tuple[int, int]]:
        """(size, item) of the windows that end at a state with a match that long."""
        state = int(self.jump[state])
        while state:
            a, b = np.searchsorted(self.outs[:, 0], (state, state + 1))
            for _, size, item in self.outs[a:b].tolist():
                if matched >= size:
                    yield size, item
            state = int(self.jump[self.link[state]])

    def hits(self, vocab: np.ndarray, ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> dict[int, tuple[np.ndarray, set[str]]]:
        """By text: a mask of hit words and the items found, for texts with any."""
        n = len(ids)
        near = np.zeros(n + 1, np.int32)
        text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for size, known in self.parts["hashes"].items():
            if n < size:
                continue
            rolled = rolling(hashes[ids], size)
            at = np.flatnonzero(self.bits[size][rolled >> np.uint64(42)])
            at = at[np.isin(rolled[at], known)]
            at = at[text_of[at] == text_of[at + size - 1]]
            np.add.at(near, at, 1)
            np.add.at(near, at + size, -1)
        inside = np.cumsum(near[:-1]) > 0
        out: dict[int, tuple[np.ndarray, set[str]]] = {}
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        for a, b in edges.reshape(-1, 2):
            while a < b:  # a stretch may run on into the next text
                text = int(text_of[a])
                end = min(int(b), int(starts[text + 1]))
                words = [vocab[i] for i in ids[a:end]]
                first = int(a - starts[text])
                for k, state, matched in self.stream(words):
                    for size, item in self.found(state, matched):
                        if text not in out:
                            out[text] = (np.zeros(int(starts[text + 1] - starts[text]), bool), set())
                        out[text][0][first + k + 1 - size : first + k + 1] = True
                        out[text][1].add(self.parts["items"][item])
                a = end
        return out


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for j in range(size):
        total = total * BASE + hashes[j : len(hashes) - size + 1 + j]
    return mix(total)


def matchers(benchmark: DataFrame, window: int, max_words: int) -> list[Broadcast]:
    """An automaton for every `max_words` words or so of the benchmark; the driver holds one share of items at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = max(1, -(-size // (6 * max_words)))
    out = []
    for k in range(shares):
        share = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shares)) == k).collect()
        words = [(r.item_id, [fold(w) for w in WORD.findall(r.text)]) for r in share]
        # plain arrays: executors need no copy of this package to read them
        out.append(benchmark.sparkSession.sparkContext.broadcast(Matcher.parts_of([x for x in words if x[1]], window)))
    return out


UPPER = {x: x + 32 for x in range(0x41, 0x5B)}


def fold(word: str) -> str:
    return word.translate(UPPER)


def streamed(rows: DataFrame, benchmark: DataFrame, window: int, max_words: int, finish: Callable, schema: str | StructType) -> DataFrame:
    """The rows (with a column text) through each automaton in turn; finish(batch, words, hits) makes the result."""
    automata = matchers(benchmark, window, max_words)
    names = rows.columns
    mask_, items_ = free(names, "_mask"), free(names, "_items")
    marks = StructType([*rows.schema.fields, StructField(mask_, BinaryType()), StructField(items_, ArrayType(StringType()))])

    def made(shared: Broadcast, first: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in sliced(batches):
                w = split_words(batch.column("text"), ALNUM)
                hits = matcher.hits(w.vocab.to_numpy(zero_copy_only=False), w.ids, w.starts, hash_words(w.vocab)) if matcher.words else {}
                if not first:
                    for k, (mask, items) in enumerate(zip(batch.column(mask_).to_pylist(), batch.column(items_).to_pylist(), strict=True)):
                        if mask is not None:
                            old = np.frombuffer(mask, bool)
                            hits[k] = (hits[k][0] | old, hits[k][1] | set(items)) if k in hits else (old, set(items))
                if last:
                    yield finish(batch.select(names), w, hits)
                else:
                    n = range(batch.num_rows)
                    masks = pa.array([hits[k][0].tobytes() if k in hits else None for k in n], pa.binary())
                    lists = pa.array([sorted(hits[k][1]) if k in hits else None for k in n], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*batch.select(names).columns, masks, lists], names=[*names, mask_, items_])

        return run

    for i, shared in enumerate(automata):
        last = i == len(automata) - 1
        rows = rows.mapInArrow(made(shared, i == 0, last), schema if last else marks)
    return rows


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, max_words: int = 200_000) -> DataFrame:
    """One row per document: its words, hit words and items.

    An automaton goes to the executors with at most about `max_words` words; a larger benchmark is dealt to several,
    which the documents pass one after another.
    """
    none = hashlib.sha256(b"").hexdigest()

    def finish(batch: pa.RecordBatch, w: Words, hits: dict[int, tuple[np.ndarray, set[str]]]) -> pa.RecordBatch:
        n = batch.num_rows
        n_hit, n_items, shas = np.zeros(n, np.int64), np.zeros(n, np.int64), [none] * n
        for k, (mask, names) in hits.items():
            n_hit[k], n_items[k] = mask.sum(), len(names)
            shas[k] = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(w.counts), pa.array(n_hit), pa.array(n_items), pa.array(shas), pa.array(n_items >= min_items)],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return streamed(rows, benchmark, window, max_words, finish, SCHEMA)


def without(text: str, mask: np.ndarray) -> str:
    """The text without its hit words; what stands between two words that stay is kept as it was."""
    parts, at, cut = [], 0, False
    for word, hit in zip(WORD.finditer(text), mask, strict=True):
        if hit:
            if not cut:
                parts.append(text[at : word.start()])
            cut = True
        elif cut:
            at, cut = word.start(), False
    if not cut:
        parts.append(text[at:])
    return "".join(parts)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, max_coverage: float = 0.5, max_words: int = 200_000) -> DataFrame:
    """The documents without benchmark spans; those with `min_items` items, or over `max_coverage` of their words hit, go.

    All columns of the input stay; a text changes only where a span was cut.
    """
    place = docs.columns.index("text")

    def finish(batch: pa.RecordBatch, w: Words, hits: dict[int, tuple[np.ndarray, set[str]]]) -> pa.RecordBatch:
        stays = np.ones(batch.num_rows, bool)
        texts = batch.column("text")
        if hits:
            new = texts.to_pylist()
            for k, (mask, names) in hits.items():
                stays[k] = len(names) < min_items and mask.sum() <= max_coverage * len(mask)
                new[k] = without(new[k], mask)
            texts = pa.array(new, pa.string())
        columns = [texts if i == place else x for i, x in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(stays))

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return streamed(rows, benchmark, window, max_words, finish, rows.schema)
