"""Sequence packing by minimum bin slack.

Documents become token ids and an end id. Each is cut into full windows, which are sequences by themselves, and a
remainder. Remainders of one task are pooled and packed window by window: the longest one left is taken, and a bitset
subset-sum dynamic programme over the lengths left picks the multiset that fills the window closest to its capacity;
counts are backtracked, and a pattern is used as often as the counts allow. Only where no multiset fills a window
exactly, a remainder is cut to fill the slack, so just the last window of a pool can be short; that one is cut into
powers of two, which need no padding.

A pool never leaves its task: nothing is shuffled, memory is bounded by `pool` remainders and `pool_ids` ids in them,
and a task that is run again packs its own rows again. Sequence ids are the partition's number and a running number.

Whole texts are tokenised. White space ends words for this tokenizer, so each distinct word is encoded once and known
from then on, up to a bound on what a worker keeps.

Edge cases: a null or empty text is its end id alone; a null id is packed under a null id; rows that share an id or are
equal are separate documents; remainders of equal length are taken last come first; a very long text is a slice of its
own and gives its full windows at once; other columns, whatever their names, are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm._text import LOWER, PLAIN, sliced, split_words

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (from counts) whose sum comes closest to the capacity from below."""
    reach, mask, full = 1, (1 << (capacity + 1)) - 1, 1 << capacity
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, k = left - take, 2 * k
        if reach & full:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return dict(used)


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length); every item's tokens are covered once."""
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (item, start)
    for item, length in enumerate(lengths):
        if length:
            by_length[length].append((item, 0))
    counts = {x: len(v) for x, v in by_length.items()}
    windows: list[list[tuple[int, int, int]]] = []

    def take(length: int) -> tuple[int, int, int]:
        item, start = by_length[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return item, start, length

    while counts:
        seed = max(counts)
        counts[seed] -= 1
        if not counts[seed]:
            del counts[seed]
        pattern = fill(counts, capacity - seed)
        counts[seed] = counts.get(seed, 0) + 1
        pattern[seed] = pattern.get(seed, 0) + 1
        slack = capacity - sum(x * n for x, n in pattern.items())
        times = min(counts[x] // n for x, n in pattern.items()) if not slack else 1
        for _ in range(times):
            windows.append([take(x) for x in sorted(pattern, reverse=True) for _ in range(pattern[x])])
        if slack and counts:  # every length left is over the slack
            item, start, length = take(max(counts))
            windows[-1].append((item, start, slack))
            by_length[length - slack].append((item, start + slack))
            counts[length - slack] = counts.get(length - slack, 0) + 1
    if windows and (total := sum(x[2] for x in windows[-1])) < capacity:
        windows[-1:] = in_powers_of_two(windows[-1], total)
    return windows


def in_powers_of_two(window: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    out = []
    rest = list(reversed(window))
    while total:
        size = room = 1 << (total.bit_length() - 1)
        part = []
        while room:
            item, start, length = rest.pop()
            part.append((item, start, min(length, room)))
            if length > room:
                rest.append((item, start + room, length - room))
            room -= min(length, room)
        out.append(part)
        total -= size
    return out


#: Symbols that the tokenizer splits from a letter or digit before them, without the apostrophe (it starts clitics).
SYMBOLS = '!"#$%&()*+,-./:;=?@[]^_`{|}~'
#: Without U+0130, which lower-cases to a letter and a mark; a mark joins the symbols after it.
LAST = r"[0-9a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]$"
#: A unit of its own to the tokenizer, written between units that are encoded at once.
BAR = "\N{SECTION SIGN}"


class Encoder:
    """Token ids of whole texts; each distinct word, less the symbols at its end, is encoded once.

    The tokenizer lower-cases, so A-Z are folded first, except where a text may hold a special token's name. A run of
    symbols after a letter or digit is a unit of its own to it, so the ids of a word are those of its stem and its end.
    What is known is bounded by `most_units`, and a worker process keeps it from task to task.
    """

    def __init__(self, path: str | None, most_units: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.most_units = Tokenizer.from_file(path), most_units
        self.bar = self.plain([BAR])[0]
        self.clear()

    @classmethod
    def of_worker(cls, path: str | None) -> Encoder:
        kept = sys.__dict__.setdefault("_corpusflow_encoders", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.size, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, units: list[str], at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units and how many each has; units without a bar go many to a text, with bars between."""
        lone = [k for k, x in enumerate(units) if BAR in x]
        if lone:
            others = [x for x in units if BAR not in x]
            parts = np.split(*self.split_sizes(others, at_once)) if others else []
            for k, ids in zip(lone, self.plain([units[k] for k in lone]), strict=True):
                parts.insert(k, ids)
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int32, len(parts))
        flat, ends = self.split_sizes(units, at_once)
        return flat, np.diff(ends, prepend=0, append=len(flat)).astype(np.int32) if units else np.zeros(0, np.int32)

    def split_sizes(self, units: list[str], at_once: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each unit but the last ends."""
        if not units:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        joined = [f" {BAR} ".join(units[a : a + at_once]) for a in range(0, len(units), at_once)]
        ids = np.concatenate([x for part in self.plain(joined) for x in (part, self.bar)])
        n = len(self.bar)
        hit = np.ones(len(ids) - n + 1, bool)
        for j, x in enumerate(self.bar):
            hit &= ids[j : len(ids) - n + 1 + j] == x
        at = np.flatnonzero(hit)
        gone = np.zeros(len(ids), bool)
        for j in range(n):
            gone[at + j] = True
        return ids[~gone], (at - n * np.arange(len(at)))[:-1]

    def known(self, units: list[str]) -> np.ndarray:
        """Each unit's place in `size`; new units are encoded."""
        new = [x for x in units if x not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            flat, size = self.encoded(new)
            self.size, self.flat = np.append(self.size, size), np.append(self.flat, flat)
        return np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text, and the first id's place of each text (one more than texts)."""
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        w = split_words(texts, PLAIN if special else LOWER)
        if len(self.place) > self.most_units:
            self.clear()
        stem = pc.utf8_rtrim(w.vocab, SYMBOLS)
        cut = pc.and_(pc.not_equal(stem, w.vocab), pc.match_substring_regex(stem, LAST))
        stem = pc.if_else(cut, stem, w.vocab)
        listed = lambda x: x.to_numpy(zero_copy_only=False).tolist()  # noqa: E731  faster than to_pylist
        end = pa.array([x[n:] if c else "" for x, n, c in zip(listed(w.vocab), listed(pc.utf8_length(stem)), listed(cut), strict=True)], pa.large_string())
        stems, ends = stem.dictionary_encode(), end.dictionary_encode()
        stem_at = self.known(listed(stems.dictionary))[stems.indices.to_numpy(zero_copy_only=False)]
        end_at = self.known(listed(ends.dictionary))[ends.indices.to_numpy(zero_copy_only=False)]
        first = np.cumsum(self.size, dtype=np.int64) - self.size
        # ids of the distinct words and of the end, then of all words
        flat, start = ragged(self.flat, np.stack([first[stem_at], first[end_at]], 1).reshape(-1), np.stack([self.size[stem_at], self.size[end_at]], 1).reshape(-1))
        size = np.append(self.size[stem_at] + self.size[end_at], 1).astype(np.int32)
        word = np.insert(w.ids, w.starts[1:], len(w.vocab))
        ids, places = ragged(np.append(flat, np.uint32(end_id)), start[::2][word], size[word])
        return ids, places[w.starts + np.arange(len(w.starts))]


def ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches (first, size) of flat one after another, and where each begins (one more than stretches)."""
    starts = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=starts[1:])
    at = np.arange(int(starts[-1]), dtype=np.int32)
    at += np.repeat((first - starts[:-1]).astype(np.int32), size)
    return flat[at], starts


def packed(docs: DataFrame, window: int = 2048, end_id: int = 1, path: str | None = None, pool: int = 50_000, pool_ids: int = 4_000_000, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the token ids themselves. path: the tokenizer's file on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of_worker(path)
        number = TaskContext.get().partitionId() << 36
        rest: list[tuple] = []  # remainders: doc_id, start, ids, doc_tokens
        waiting = 0

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, rest, waiting
            out = []
            for part in pack([len(x[2]) for x in rest], window):
                offset = 0
                for item, start, length in part:
                    doc_id, first, ids, tokens = rest[item]
                    ids = ids[start : start + length]
                    out.append((doc_id, first + start, length, zlib.crc32(ids), tokens, number, offset, ids if with_ids else None))
                    offset += length
                number += 1
            rest, waiting = [], 0
            if out:
                yield rows(out)

        def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """A slice's windows; its ids go with it, before the next one is encoded."""
            nonlocal number, waiting
            flat, starts = encode(batch.column("text"), end_id)
            flat = flat.astype("<u4", copy=False)
            out = []
            for doc_id, begin, end in zip(batch.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                tokens = end - begin
                for a in range(begin, end - window + 1, window):
                    part = flat[a : a + window]
                    out.append((doc_id, a - begin, window, zlib.crc32(part), tokens, number, 0, part if with_ids else None))
                    number += 1
                if left := tokens % window:
                    rest.append((doc_id, tokens - left, flat[end - left : end].copy(), tokens))
                    waiting += left
                if len(rest) >= pool or waiting >= pool_ids:
                    yield from flush()
            if out:
                yield rows(out)

        for batch in sliced(batches, 3 << 20):
            yield from pieces(batch)
            del batch
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
