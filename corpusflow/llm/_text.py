"""Arrow-vectorised words of whole texts, shared by the Python-side operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SPACES = bytes(range(0x09, 0x0E))
#: Byte tables: every separator becomes a space; the second also lower-cases A-Z; the third keeps ASCII letters, digits and non-ASCII bytes.
PLAIN = bytes.maketrans(SPACES, b" " * len(SPACES))
LOWER = bytes(x + 32 if 0x41 <= x <= 0x5A else x for x in PLAIN)
ALNUM = bytes(
    x + 32 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256)
)
SLICE_BYTES = 3 << 20


def free(columns: list[str], name: str) -> str:
    """The name, or a longer one where the columns hold it already in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class Words(NamedTuple):
    """Words of consecutive texts: ids into vocab, and the first word's place of each text (one more than texts)."""

    vocab: pa.Array
    ids: np.ndarray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def folded(texts: pa.Array, table: bytes) -> pa.LargeStringArray:
    """The texts with every byte passed through a table; null becomes empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.LargeStringArray.from_buffers(
        len(texts), offsets, pa.py_buffer(data.to_pybytes().translate(table)), None, 0, texts.offset
    )


def split_words(texts: pa.Array, table: bytes) -> Words:
    lists = pc.ascii_split_whitespace(folded(texts, table))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    ids, vocab = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    blank = pc.index(vocab, pa.scalar("", vocab.type)).as_py() if len(vocab) else -1
    if blank >= 0:
        full = ids != blank
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[full], minlength=len(counts))
        ids = ids[full]
    return Words(vocab, ids, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))


def trim() -> None:
    """Give back what this process holds and does not use; a worker is kept from task to task, so it would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, TypeError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about `most` bytes of text, one text at least; free memory goes back after each.

    A caller should let go of a slice, and of what was made of it, before it asks for the next one.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
            trim()
        del batch
    trim()


def hash_words(vocab: pa.Array, key: str = "corpusflow-words") -> np.ndarray:
    """A 64-bit hash of each distinct word; the same on every executor."""
    if not len(vocab):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(vocab.to_numpy(zero_copy_only=False), hash_key=key[:16].ljust(16, "0"), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's), for uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
