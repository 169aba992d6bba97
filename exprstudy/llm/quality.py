"""Quality rules: base counts of a text and the divergence of its histograms from language references.

A text is described by two histograms: code points by character class, and words by
common word (with one cell for all others).  Each is compared by Jensen-Shannon distance
with the same histograms of every language, which are summed over all documents of the
corpus that pass the base rules.  A text is rejected if even the nearest reference is too
far, each test only from a minimum length on.

Cases: a null or empty text has counts of 0 and fails the base rules; a document without
``lang`` is judged but adds to no reference; without any reference nothing is rejected by
distance; repeated rows are judged alike; further columns stay out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprstudy.llm import textops as tx

COLUMNS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
VERDICT = COLUMNS + ", kept boolean, class_distance double, word_distance double, nearest string"

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Text bytes counted at once; counting takes some 50 bytes for each.
COUNTED_BYTES = 1 << 20

CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")


def _class_table() -> np.ndarray:
    """Character class of each byte; -1 for bytes that continue a code point."""
    table = np.full(256, CLASSES.index("symbol"))
    table[tx.SPACE] = CLASSES.index("space")
    table[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    table[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    table[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    table[list(b".,;:'\"-()?!")] = CLASSES.index("mark")
    table[0x80:0xC0] = -1
    table[0xC0:] = CLASSES.index("other")
    return table


CLASS_OF = _class_table()


@dataclass(frozen=True)
class Rules:
    """Distances are Jensen-Shannon distances with logarithms to base 2, so between 0 and 1."""

    common_words: int = 64
    max_class_distance: float = 0.28
    max_word_distance: float = 0.5
    min_class_chars: int = 100
    min_words: int = 50


@dataclass(frozen=True)
class References:
    """One row for each language; ``words`` holds the hashes of the common words in ascending order."""

    names: tuple[str, ...]
    classes: np.ndarray
    words: np.ndarray
    shares: np.ndarray


class Counted:
    """The counts of one slice of texts."""

    def __init__(self, texts: pa.Array):
        data, offsets = tx.buffer(texts)
        starts, ends, at = tx.words(data, offsets)
        self.n_words = np.diff(at)
        self.hashes = tx.hash_words(data, starts)
        self.lowered = tx.hash_words(tx.LOWER[data], starts)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.n_words)
        leads = (data & 0xC0) != 0x80
        points = tx.segment_sum(leads, offsets)
        self.word_chars = points - tx.segment_sum(tx.SPACE[data], offsets)
        self.n_symbols = tx.segment_sum(SYMBOLS[data], offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[leads]
        cells = row * len(CLASSES) + CLASS_OF[data[leads]]
        self.classes = np.bincount(cells, minlength=(len(offsets) - 1) * len(CLASSES)).reshape(-1, len(CLASSES))
        self.n_dup_lines = _repeated_lines(data, offsets, starts)
        self.n_repeat_words = _repeated_words(self.hashes, at)
        self.failed = (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)

    def columns(self, ids: pa.Array) -> list[pa.Array]:
        counts = (self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words)
        return [ids.cast(pa.int64()), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(self.failed)]


def _again(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: is it equal to an earlier row of its document, and does it occur more than once there."""
    order = np.lexsort((doc, key))
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    later, many = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return later, many


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    starts, ends, at = tx.lines(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, doc = starts[worded], ends[worded], doc[worded]
    # a line with a word has a byte, so its bytes are a span; the gap up to the next line is a span of its own
    edges = np.unique(np.concatenate([starts, ends[ends < len(data)]])) if len(starts) else starts
    hashes = tx.hash_spans(data, edges)[np.searchsorted(edges, starts)] if len(starts) else np.zeros(0, np.uint64)
    later, _ = _again(hashes, doc)
    return np.bincount(doc[later], minlength=len(offsets) - 1)


def _repeated_words(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of each text that lie in an 8-word window found twice or more in it."""
    n = np.diff(at)
    windows = np.maximum(n - WINDOW + 1, 0)
    first = tx.ragged(at[:-1], windows)
    doc = np.repeat(np.arange(len(n)), windows)
    key = np.zeros(len(first), np.uint64)
    factors = tx.powers(WINDOW + 1)[1:]
    for k in range(WINDOW):
        key += hashes[first + k] * factors[k]
    _, many = _again(tx.mix(key), doc)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, first[many], 1)
    np.add.at(edge, first[many] + WINDOW, -1)
    return tx.segment_sum(np.cumsum(edge[:-1]) > 0, at)


_REFERENCE_SCHEMA = pa.schema([("lang", pa.string()), ("is_class", pa.bool_()), ("key", pa.int64()), ("n", pa.int64())])
#: Text bytes whose counts are summed before they leave the task.
SUMMED_BYTES = 24 << 20


def _reference_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each language by class and by word hash, of some slices together."""
    held: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0
    for batch in tx.slices(batches, "text", COUNTED_BYTES):
        langs = batch.column("lang").dictionary_encode()
        code = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        found = Counted(batch.column("text"))
        good = ~found.failed & (code >= 0)
        for c, name in enumerate(langs.dictionary.to_pylist()):
            mine = good & (code == c)
            held.setdefault((name, False), []).append(np.unique(found.lowered[mine[found.doc]], return_counts=True))
            held.setdefault((name, True), []).append((np.arange(len(CLASSES), dtype=np.uint64), found.classes[mine].sum(axis=0)))
        size += tx.buffer(batch.column("text"))[1][-1]
        if size >= SUMMED_BYTES:
            yield from _summed(held)
            held, size = {}, 0
    yield from _summed(held)


def _summed(held: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for (name, is_class), parts in held.items():
        keys, code = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.bincount(code, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)
        if len(keys):
            columns = [pa.array([name] * len(keys), pa.string()), pa.array([is_class] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, schema=_REFERENCE_SCHEMA)


def references(docs: DataFrame, rules: Rules = Rules()) -> References:
    """Histograms of each language over all documents that pass the base rules.

    The result holds ``common_words + 1 + 7`` numbers for a language, whatever the corpus.
    """
    counts = (
        docs.select("text", "lang")
        .mapInArrow(_reference_rows, "lang string, is_class boolean, key bigint, n bigint")
        .groupBy("lang", "is_class", "key")
        .agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang", "is_class").orderBy(F.desc("n"), "key")
    totals = counts.groupBy("lang", "is_class").agg(F.sum("n").alias("total"))
    top = (
        counts.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= F.when(F.col("is_class"), len(CLASSES)).otherwise(rules.common_words))
        .join(totals, ["lang", "is_class"])
        .select("lang", "is_class", "key", (F.col("n") / F.col("total")).alias("share"))
    )
    rows = top.collect()  # languages x (common words + classes)
    names = tuple(sorted({r.lang for r in rows}))
    words = np.unique(np.array([r.key for r in rows if not r.is_class], np.int64))
    classes, shares = np.zeros((len(names), len(CLASSES))), np.zeros((len(names), len(words) + 1))
    for r in rows:
        if r.is_class:
            classes[names.index(r.lang), r.key] = r.share
        else:
            shares[names.index(r.lang), np.searchsorted(words, r.key)] = r.share
    shares[:, -1] = 1 - shares[:, :-1].sum(axis=1)
    return References(names, classes, words, shares)


def _xlogx(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` from each row of ``q``."""
    inner = [(_xlogx(p) + _xlogx(r)).sum(axis=1) / 2 - _xlogx((p + r) / 2).sum(axis=1) for r in q]
    return np.sqrt(np.clip(np.stack(inner, axis=1), 0, 1))


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def judge(found: Counted, refs: References, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept, distance of the classes, distance of the words (to the nearest language each), nearest language."""
    n = len(found.n_words)
    if not refs.names:
        return ~found.failed, np.zeros(n), np.zeros(n), np.full(n, -1)
    by_class = distance(_shares(found.classes), refs.classes)
    keys = found.lowered.view(np.int64)
    cell = np.searchsorted(refs.words, keys)
    known = cell < len(refs.words)
    known[known] = refs.words[cell[known]] == keys[known]
    cell[~known] = len(refs.words)
    width = len(refs.words) + 1
    words = np.bincount(found.doc * width + cell, minlength=n * width).reshape(n, width)
    by_word = distance(_shares(words), refs.shares)
    far = (found.classes.sum(axis=1) >= rules.min_class_chars) & (by_class.min(axis=1) > rules.max_class_distance)
    far |= (found.n_words >= rules.min_words) & (by_word.min(axis=1) > rules.max_word_distance)
    return ~found.failed & ~far, by_class.min(axis=1), by_word.min(axis=1), by_word.argmin(axis=1)


def verdicts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Counts, distances and verdict of every document."""
    refs = references(docs, rules)

    def run(batches):
        for batch in tx.slices(batches, "text", COUNTED_BYTES):
            found = Counted(batch.column("text"))
            kept, classes, words, near = judge(found, refs, rules)
            names = pa.array([refs.names[i] if i >= 0 else None for i in near], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*found.columns(batch.column("doc_id")), pa.array(kept), pa.array(classes), pa.array(words), names],
                names=[f.split(" ")[0] for f in VERDICT.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, VERDICT)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` whose text is kept; the decision is made on each row, so nothing is joined."""
    refs = references(docs, rules)
    names = docs.columns

    def run(batches):
        for batch in tx.slices(batches, "text", COUNTED_BYTES):
            kept, *_ = judge(Counted(batch.column("text")), refs, rules)
            yield batch.filter(pa.array(kept)).select(names)

    return docs.mapInArrow(run, docs.schema)
