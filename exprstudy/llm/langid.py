"""Language identification by a convolutional network over bytes.

Filters of several widths look at one-hot bytes of a window of fixed length; the maximum of
each filter over the window, cut at zero, goes into a softmax over the languages.  The
network is trained in numpy on a bounded sample of labelled documents and applied to all
windows of every whole text; a text's probabilities are those of its windows, weighted by
their letters.

The sample is the only bound: ``per_language`` documents of each language, those with the
smallest hashes of their id, and ``per_document`` windows of each, evenly spread.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text
if no labelled document is given; equal probabilities go to the first language in
alphabetical order; repeated rows are predicted alike; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprstudy.llm import textops as tx

RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double"
UNKNOWN = "und"
PAD = 32


@dataclass(frozen=True)
class Options:
    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    per_language: int = 400
    per_document: int = 4
    epochs: int = 12
    batch: int = 128
    rate: float = 0.01


@dataclass
class Network:
    """``tables[i][k, byte]`` is what a byte at place ``k`` adds to the filters of width ``widths[i]``."""

    languages: tuple[str, ...]
    window: int
    tables: list[np.ndarray]
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def responses(self, windows: np.ndarray) -> list[np.ndarray]:
        """The filters of each width at every place of each window."""
        out = []
        for table, shift in zip(self.tables, self.shifts):
            places = self.window - len(table) + 1
            total = table[0][windows[:, :places]] + shift
            for k in range(1, len(table)):
                total += table[k][windows[:, k : k + places]]
            out.append(total)
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([np.maximum(r.max(axis=1), 0) for r in self.responses(windows)], axis=1)
        return _softmax(pooled @ self.weights + self.bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], options: Options = Options()) -> Network:
    """Cross entropy, Adam, classes weighted to equal sums."""
    rng = np.random.default_rng(5)
    f, n = options.filters, len(languages)
    tables = [rng.normal(0, 0.3, (w, 256, f)).astype(np.float32) for w in options.widths]
    shifts = [np.zeros(f, np.float32) for _ in options.widths]
    net = Network(languages, options.window, tables, shifts, rng.normal(0, 0.1, (f * len(tables), n)).astype(np.float32), np.zeros(n, np.float32))
    parameters = [*net.tables, *net.shifts, net.weights, net.bias]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    class_weight = len(labels) / (n * np.maximum(np.bincount(labels, minlength=n), 1))
    step = 0
    for _ in range(options.epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), options.batch):
            rows = order[at : at + options.batch]
            x, y = windows[rows], labels[rows]
            responses = net.responses(x)
            best = [r.argmax(axis=1) for r in responses]
            pooled = np.concatenate([np.take_along_axis(r, b[:, None, :], axis=1)[:, 0] for r, b in zip(responses, best)], axis=1)
            active = np.maximum(pooled, 0)
            error = _softmax(active @ net.weights + net.bias)
            error[np.arange(len(y)), y] -= 1
            error *= class_weight[y][:, None] / len(y)
            back = (error @ net.weights.T) * (pooled > 0)
            slopes = [np.zeros_like(p) for p in net.tables]
            for i, b in enumerate(best):
                part = back[:, i * f : (i + 1) * f]
                for k in range(len(net.tables[i])):
                    np.add.at(slopes[i][k], (np.take_along_axis(x, b + k, axis=1), np.arange(f)[None, :]), part)
            slopes += [back[:, i * f : (i + 1) * f].sum(axis=0) for i in range(len(best))]
            slopes += [active.T @ error, error.sum(axis=0)]
            step += 1
            for p, m, v, g in zip(parameters, first, second, slopes):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (options.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each text, the last one padded with spaces, and offsets into them."""
    n = -(-np.diff(offsets) // window)
    at = tx.offsets_of(n)
    flat = np.full(at[-1] * window, PAD, np.uint8)
    flat[tx.ragged(at[:-1] * window, np.diff(offsets))] = data
    return flat.reshape(-1, window), at


def _letters(windows: np.ndarray) -> np.ndarray:
    low = windows | 0x20
    return ((low >= ord("a")) & (low <= ord("z")) | (windows >= 0xC0)).sum(axis=1)


def _lettered(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | 0x20
    out = tx.segment_sum((low >= ord("a")) & (low <= ord("z")) & (data < 0x80), offsets) > 0
    doubtful = np.flatnonzero(~out & (tx.segment_sum(data >= 0xC0, offsets) > 0))
    for i in doubtful:
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def sample(docs: DataFrame, learned: Column, options: Options = Options()) -> tuple[np.ndarray, np.ndarray, tuple[str, ...]]:
    """Windows and labels of a bounded number of documents of each language."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = docs.where(learned & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    chosen = chosen.withColumn("place", place).where(F.col("place") <= options.per_language).select("doc_id", "lang")
    # the chosen ids are bounded; their texts are cut into windows before anything is collected
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen.distinct()), ["doc_id", "lang"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text"):
            data, offsets = tx.buffer(batch.column("text"))
            windows, at = windows_of(data, offsets, options.window)
            n = np.diff(at)
            picks = [np.unique(np.linspace(a, a + k - 1, min(k, options.per_document)).astype(int)) for a, k in zip(at[:-1], n) if k]
            rows = np.concatenate(picks) if picks else np.zeros(0, int)
            rows = rows[_letters(windows[rows]) >= options.window // 4]
            lang = batch.column("lang").take(pa.array(np.searchsorted(at, rows, side="right") - 1))
            flat = pa.array([windows[i].tobytes() for i in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([lang, flat], names=["lang", "window"])

    found = rows.mapInArrow(run, "lang string, window binary").toArrow().sort_by([("lang", "ascending"), ("window", "ascending")])
    languages = tuple(sorted(set(found.column("lang").to_pylist())))
    labels = np.array([languages.index(x) for x in found.column("lang").to_pylist()], np.int64)
    windows = np.frombuffer(b"".join(found.column("window").to_pylist()), np.uint8).reshape(-1, options.window)
    return windows, labels, languages


def fit(docs: DataFrame, learned: Column, options: Options = Options()) -> Network | None:
    windows, labels, languages = sample(docs, learned, options)
    return train(windows, labels, languages, options) if len(labels) else None


def _predicted(net: Network | None, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    n = len(texts)
    if net is None:
        return pa.array([UNKNOWN] * n, pa.string()), np.zeros(n)
    data, offsets = tx.buffer(texts)
    windows, at = windows_of(data, offsets, net.window)
    parts = [net.probabilities(windows[i : i + 1024]) for i in range(0, len(windows), 1024)]
    p = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, len(net.languages)))
    weight = _letters(windows) + 1e-3
    mean = np.stack([tx.segment_sum(p[:, j] * weight, at) for j in range(p.shape[1])], axis=1)
    mean /= np.maximum(mean.sum(axis=1, keepdims=True), 1e-300)
    real = _lettered(texts, data, offsets)
    best = mean.argmax(axis=1)
    names = pa.array([net.languages[b] if ok else UNKNOWN for b, ok in zip(best, real)], pa.string())
    return names, np.where(real, np.clip(mean.max(axis=1), 0, 1), 0)


def predictions(docs: DataFrame, held_out: Column, options: Options = Options()) -> DataFrame:
    """The language of every text; documents for which ``held_out`` is true are not learned from."""
    net = fit(docs, ~held_out, options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tx.slices(batches, "text"):
            names, scores = _predicted(net, rows.column("text"))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), names, pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, RESULT)


def keep_identified(docs: DataFrame, learned: Column, min_score: float = 0.5, options: Options = Options()) -> DataFrame:
    """The rows whose language is known with at least ``min_score``; all rows if no language can be learned."""
    net = fit(docs, learned, options)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tx.slices(batches, "text"):
            found, scores = _predicted(net, rows.column("text"))
            keep = scores >= min_score if net is not None else np.ones(rows.num_rows, bool)
            yield rows.filter(pa.array(keep)).select(names)

    return docs.mapInArrow(run, docs.schema)
