"""Language identification by a byte convolutional network, trained here in numpy.

A text's UTF-8 bytes (A-Z lower-cased) are cut into fixed-length windows. Bytes are embedded, filters of several
widths run over them, each filter's maximum over the window feeds a softmax. A document's score is the mean of its
windows' log-probabilities, weighted by their bytes, made a distribution again: every byte of a text counts.

Training uses a bounded sample: at most `per_language` labelled documents of each language, those with the smallest
hash of their id, and of each one stretch of `stretch` characters at a place that the hash picks. A language's distinct
ids are counted first, which gives a limit for their hashes, so a task sends on only what is about to be used; the
driver gets some two `per_language` stretches for each label value. Prediction reads whole texts in one map over the
input, a bounded number of windows at a time; nothing is shuffled.

Edge cases: a null text, or one without a letter, is `und` with score 0; without any labelled text everything is
`und`; labels that are null do not train; a tie between languages goes to the one that sorts first; rows that share an
id train once; equal rows get equal results; null ids train and are predicted; other columns, whatever their names, are
not read by `predict` and stay in `keep_known`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm._text import LOWER, folded, free, sliced

WIDTHS = (2, 3, 4)
WIDEST = max(WIDTHS)


class Model(NamedTuple):
    languages: list[str]
    embed: np.ndarray  # 256 x dims; byte 0 pads and stays zero
    filters: np.ndarray  # (WIDEST * dims) x all filters, zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    window: int


def window_blocks(texts: pa.Array, size: int, at_once: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Padded byte windows, the text of each, and the bytes that count in each; `at_once` windows at most together."""
    texts = folded(texts, LOWER)
    _, offsets, data = texts.buffers()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = np.append(raw, np.uint8(0))
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    length = np.diff(off)
    n = np.maximum(1, -(-length // size))
    before = np.cumsum(n) - n
    for a in range(0, int(n.sum()), at_once):
        window = np.arange(a, min(a + at_once, int(n.sum())))
        text = np.searchsorted(before, window, "right") - 1
        skip = (window - before[text]) * size
        real = np.minimum(size, length[text] - skip)
        place = (off[text] + skip)[:, None] + np.arange(size)
        yield np.where(np.arange(size) < real[:, None], raw[np.minimum(place, len(raw) - 1)], 0).astype(np.uint8), text, real


def windows_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows at once, for training stretches."""
    parts = list(window_blocks(texts, size))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def columns(model: Model, block: np.ndarray) -> np.ndarray:
    """The embedded bytes under each place of the widest filter: windows x places x (WIDEST * dims)."""
    e = model.embed[np.pad(block, ((0, 0), (0, WIDEST - 1)))]
    view = np.lib.stride_tricks.sliding_window_view(e, WIDEST, axis=1)  # windows, places, dims, WIDEST
    return np.ascontiguousarray(view.swapaxes(2, 3)).reshape(len(block), block.shape[1], -1)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def forward(model: Model, blocks: np.ndarray, at_once: int = 128) -> np.ndarray:
    """Log-probabilities of each window."""
    out = np.empty((len(blocks), len(model.languages)), np.float32)
    for a in range(0, len(blocks), at_once):
        x = columns(model, blocks[a : a + at_once])
        high = (x.reshape(-1, x.shape[2]) @ model.filters).reshape(x.shape[0], x.shape[1], -1).max(1)
        out[a : a + at_once] = log_softmax(np.maximum(high + model.bias, 0) @ model.out + model.out_bias)
    return out


def train(texts: list[str], labels: list[str], window: int = 256, dims: int = 8, each: int = 16, epochs: int = 6, seed: int = 7) -> Model:
    """Adam on the cross-entropy of windows; languages weigh the same."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    blocks, text, real = windows_of(pa.array(texts, pa.large_string()), window)
    y = np.array([languages.index(x) for x in labels])[text]
    use = real >= min(32, window)
    use = use if use.any() else np.ones(len(use), bool)
    blocks, y = blocks[use], y[use]
    weight = 1.0 / np.maximum(1, np.bincount(y, minlength=len(languages)))
    n_filters = each * len(WIDTHS)
    mask = np.zeros((WIDEST * dims, n_filters), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * dims, i * each : (i + 1) * each] = 1
    p = {
        "embed": rng.normal(0, 0.5, (256, dims)), "filters": rng.normal(0, 0.3, mask.shape) * mask, "bias": np.zeros(n_filters),
        "out": rng.normal(0, 0.2, (n_filters, len(languages))), "out_bias": np.zeros(len(languages)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embed"][0] = 0
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(blocks))
        for a in range(0, len(order), 64):
            pick = order[a : a + 64]
            model = Model(languages, p["embed"], p["filters"], p["bias"], p["out"], p["out_bias"], window)
            x = columns(model, blocks[pick])
            response = x @ p["filters"]
            at = response.argmax(1)
            high = np.take_along_axis(response, at[:, None, :], 1)[:, 0] + p["bias"]
            h = np.maximum(high, 0)
            g = np.exp(log_softmax(h @ p["out"] + p["out_bias"]))
            g[np.arange(len(pick)), y[pick]] -= 1
            g *= (weight[y[pick]] / weight[y[pick]].sum())[:, None]
            gh = (g @ p["out"].T) * (high > 0)
            rows = np.arange(len(pick))[:, None]
            best = x[rows, at]  # windows x filters x (WIDEST * dims)
            gx = gh[:, :, None] * p["filters"].T[None]
            ge = np.zeros((256, dims))
            padded = np.pad(blocks[pick], ((0, 0), (0, WIDEST - 1)))
            for j in range(WIDEST):
                np.add.at(ge, padded[rows, at + j], gx[:, :, j * dims : (j + 1) * dims])
            ge[0] = 0
            grads = {"embed": ge, "filters": np.einsum("bf,bfc->cf", gh, best) * mask, "bias": gh.sum(0), "out": h.T @ g, "out_bias": g.sum(0)}
            t += 1
            for k, d in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = (p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Model(languages, p["embed"], p["filters"], p["bias"], p["out"], p["out_bias"], window)


def fit(docs: DataFrame, may_train: Column, per_language: int = 500, stretch: int = 1024) -> Model | None:
    """A model from the bounded sample of rows with may_train and a language; None where there is none."""
    known = docs.where(may_train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    start = F.pmod(F.shiftright(h, 8), F.greatest(F.lit(1), F.length("text") - stretch + 1))
    rows = known.select(F.col("lang").cast("string").alias("lang"), h.alias("h"), start.alias("start"), "text")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n")).collect()  # a row for each label value
    if not counts:
        return None
    limits = [(r.lang, min(2**63 - 1, int((2 * per_language + 50) / max(1, r.n) * 2**63))) for r in counts]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, most long")
    few = rows.join(F.broadcast(limits), "lang").where("h <= most")
    few = few.groupBy("lang", "h").agg(F.min(F.substr("text", (F.col("start") + 1).cast("int"), F.lit(stretch))).alias("text"))
    got: dict[str, list[tuple[int, str]]] = {}
    for r in few.collect():
        got.setdefault(r.lang, []).append((r.h, r.text))
    sample = [(lang, text) for lang in sorted(got) for _, text in sorted(got[lang])[:per_language]]
    return train([x[1] for x in sample], [x[0] for x in sample])


def scored(model: Model | None, texts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predicted language and score of each text."""
    n = len(texts)
    said, score = np.full(n, "und", object), np.zeros(n)
    if model is not None and letters.any():
        total, sizes = np.zeros((n, len(model.languages))), np.zeros(n)
        for blocks, text, real in window_blocks(texts, model.window):
            weight = np.maximum(real, 1).astype(np.float64)
            np.add.at(total, text, forward(model, blocks) * weight[:, None])
            np.add.at(sizes, text, weight)
        p = np.exp(log_softmax(total / sizes[:, None]))
        best = p.argmax(1)
        said[letters] = np.array(model.languages, object)[best][letters]
        score[letters] = np.minimum(1.0, p[np.arange(n), best])[letters]
    return said, score


def with_letters(docs: DataFrame, name: str) -> DataFrame:
    return docs.withColumn(name, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3 << 20):
            said, score = scored(model, batch.column("text"), batch.column("letters").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(said, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    base = with_letters(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "letters")
    return base.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, per_language: int = 500, least: float = 0.35) -> DataFrame:
    """The documents whose language the model can tell, with all their columns; rejected are `und` and scores below `least`."""
    model = fit(docs, ~held_out(), per_language)
    names = docs.columns
    letters = free(names, "_letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3 << 20):
            said, score = scored(model, batch.column("text"), batch.column(letters).to_numpy(zero_copy_only=False))
            yield batch.select(names).filter(pa.array((said != "und") & (score >= least)))

    return with_letters(docs, letters).mapInArrow(run, docs.schema)
