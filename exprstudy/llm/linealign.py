"""Line deduplication by pairwise alignment.

Lines are rare by themselves or in company: every line with a word begins a run, the shortest
one of at least ``min_words`` words, and the first document that holds a run is its owner.  A
document is paired with each earlier owner of its runs, which is how overlapping documents
are found; a block of enough words begins with a run that both documents hold.  Each pair is
then aligned on the full line sequences of both, as patience diff does: equal lines at both
ends, then the lines that are unique in both, along the longest chain that ascends in both,
and the same again between two of them; where no line is unique, the k-th occurrence of a
line goes with the k-th.  Runs of aligned lines that follow each other in both documents are
common blocks; blocks of enough words are deleted from the later document.  What is left of
it is aligned with the same document again until no such block is found, at last without the
lines that are in no common run, so that moved blocks go as well.

A run leads to one owner, however many documents share it, so hot lines make no pairs; only
hashes of lines are moved for finding and aligning.  The texts are joined with the blocks by
a merge join at every size.

Cases: a null or empty text has no lines and is unchanged; lines without a word are never
deleted alone (an empty line inside a deleted block goes with it); equal documents: the
smallest id stays, later ones lose all their lines, if those have enough words; rows with one
``doc_id`` are one document for owning, are each aligned for itself, and lose nothing to each
other; a null ``doc_id`` owns and loses nothing; an empty table gives an empty result; further
columns pass through, but for those named like one of the result's own three.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from exprstudy.llm import textops as tx
from exprstudy.session import durable

#: A block of fewer words may be a coincidence or a formula, and stays.
MIN_BLOCK_WORDS = 10

COUNTS = ("n_lines", "n_deleted", "words_deleted")

_SEQUENCES = "doc_id bigint, digest bigint, lines array<bigint>, words array<int>"


def _line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    edges = np.unique(np.concatenate([starts, ends[ends < len(data)]]))
    return tx.hash_spans(data, edges)[np.searchsorted(edges, starts)]


def _worded_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and text of all lines, their words, and the places of those with a word."""
    word_at, _, _ = tx.words(data, offsets)
    starts, ends, at = tx.lines(data, offsets)
    words = np.searchsorted(word_at, ends) - np.searchsorted(word_at, starts)
    return starts, ends, np.repeat(np.arange(len(at) - 1), np.diff(at)), words, np.flatnonzero(words > 0)


def _digests(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each sequence of lines."""
    place = np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))
    return tx.segment_sum(tx.mix(hashes ^ tx.mix(place.astype(np.uint64))).view(np.int64), at)


def sequences(docs: DataFrame) -> DataFrame:
    """The lines with a word of each row, as hashes, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tx.slices(batches, "text"):
            data, offsets = tx.buffer(rows.column("text"))
            starts, ends, doc, words, worded = _worded_lines(data, offsets)
            hashes = _line_hashes(data, starts[worded], ends[worded]) if len(worded) else np.zeros(0, np.uint64)
            at = np.searchsorted(doc[worded], np.arange(rows.num_rows + 1))
            where = pa.array(at.astype(np.int32))
            lists = [pa.ListArray.from_arrays(where, pa.array(v)) for v in (hashes.view(np.int64), words[worded].astype(np.int32))]
            columns = [rows.column("doc_id").cast(pa.int64()), pa.array(_digests(hashes, at)), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in _SEQUENCES.split(", ")])

    found = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, _SEQUENCES)
    return found.where(F.size("lines") > 0)


def _run_keys(hashes: np.ndarray, words: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, length and hash of the shortest run of enough words from each line on, within sequences."""
    total = tx.offsets_of(words)
    last = np.searchsorted(total, total[:-1] + min_words, side="left") - 1
    first = np.flatnonzero(last < np.repeat(at[1:], np.diff(at)))
    length = last[first] - first + 1
    key = tx.mix(length.astype(np.uint64))
    for k in range(int(length.max(initial=0))):
        inside = np.flatnonzero(length > k)
        key[inside] = tx.mix(key[inside] * np.uint64(0x9E3779B97F4A7C15) + hashes[first[inside] + k])
    return first, length, key


def runs(found: DataFrame, min_words: int) -> DataFrame:
    """``(run, doc_id)``: the runs of each document, once for each line they begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, words = batch.column("lines"), batch.column("words").flatten().to_numpy()
            at = tx.offsets_of(lines.value_lengths().to_numpy())
            first, _, key = _run_keys(lines.flatten().to_numpy().view(np.uint64), words, at, min_words)
            ids = batch.column("doc_id").take(pa.array(np.searchsorted(at, first, side="right") - 1))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids], names=["run", "doc_id"])

    return found.mapInArrow(run, "run bigint, doc_id bigint")


def document_pairs(found: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``(doc_id, owner)``: each document and the earlier documents that first held one of its runs."""
    held = runs(found, min_words)
    firsts = held.groupBy("run").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("last > owner").select("run", "owner")
    return held.join(firsts.hint("merge"), "run").where("doc_id > owner").select("doc_id", "owner").distinct()


def longest_chain(places: np.ndarray) -> np.ndarray:
    """Positions of a longest strictly ascending subsequence."""
    tails: list[int] = []
    heads: list[int] = []
    before = np.full(len(places), -1)
    for i, p in enumerate(places.tolist()):
        k = bisect.bisect_left(tails, p)
        if k:
            before[i] = heads[k - 1]
        if k == len(tails):
            tails.append(p)
            heads.append(i)
        else:
            tails[k], heads[k] = p, i
    chain = []
    i = heads[-1] if heads else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return np.array(chain[::-1], np.int64)


def _unique_pairs(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines that are unique in both, by place in the first."""
    (a, a_at, a_n), (b, b_at, b_n) = (np.unique(x, return_index=True, return_counts=True) for x in (mine, theirs))
    a, a_at, b, b_at = a[a_n == 1], a_at[a_n == 1], b[b_n == 1], b_at[b_n == 1]
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(a_at[i])
    return a_at[i][order], b_at[j][order]


def _numbered_pairs(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k-th occurrences of lines that are in both, by place in the first."""

    def kinds(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x, kind="stable")
        new = np.append(True, x[order][1:] != x[order][:-1])
        number = np.zeros(len(x), np.int64)
        number[order] = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        return tx.mix(x.view(np.uint64) + tx.mix(number.astype(np.uint64)))

    return _unique_pairs(kinds(mine), kinds(theirs))


def patience(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of aligned lines in both sequences, ascending."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, len(mine), 0, len(theirs))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        n = min(a_end - a, b_end - b)
        if not n:
            continue
        differ = mine[a : a + n] != theirs[b : b + n]
        head = int(differ.argmax()) if differ.any() else n
        found.append((np.arange(a, a + head), np.arange(b, b + head)))
        a, b, n = a + head, b + head, n - head
        differ = (mine[a_end - n : a_end] != theirs[b_end - n : b_end])[::-1]
        tail = int(differ.argmax()) if differ.any() else n
        found.append((np.arange(a_end - tail, a_end), np.arange(b_end - tail, b_end)))
        a_end, b_end = a_end - tail, b_end - tail
        if a == a_end or b == b_end:
            continue
        i, j = _unique_pairs(mine[a:a_end], theirs[b:b_end])
        chain = longest_chain(j)
        if len(chain):
            i, j = i[chain] + a, j[chain] + b
            found.append((i, j))
            edges = zip(np.append(a, i + 1), np.append(i, a_end), np.append(b, j + 1), np.append(j, b_end))
            todo.extend(edge for edge in edges if edge[0] < edge[1] and edge[2] < edge[3])
        else:
            i, j = _numbered_pairs(mine[a:a_end], theirs[b:b_end])
            chain = longest_chain(j)
            found.append((i[chain] + a, j[chain] + b))
    i, j = (np.concatenate([f[side] for f in found] or [np.zeros(0, np.int64)]) for side in (0, 1))
    order = np.argsort(i)
    return i[order], j[order]


def _in_common_runs(mine: np.ndarray, words: np.ndarray, theirs: np.ndarray, their_words: np.ndarray, min_words: int) -> np.ndarray:
    """Whether each line is in a run that the other sequence holds."""
    (first, length, key), (_, _, other) = (
        _run_keys(lines.view(np.uint64), n, np.array([0, len(lines)]), min_words) for lines, n in ((mine, words), (theirs, their_words))
    )
    shared = np.isin(key, other)
    out = np.zeros(len(mine), bool)
    out[tx.ragged(first[shared], length[shared])] = True
    return out


def common_blocks(mine: np.ndarray, words: np.ndarray, theirs: np.ndarray, their_words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line, in the first sequence, of the aligned blocks of enough words.

    What is left of the first sequence is aligned again, until no block is found, then without
    the lines that are in no common run, which can only stand in the way.
    """
    firsts, lasts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left, bare = np.arange(len(mine)), False
    while len(left):
        i, j = patience(mine[left], theirs)
        # next to each other in the whole first sequence and in the second one
        starts = np.flatnonzero(np.append(True, (np.diff(left[i]) != 1) | (np.diff(j) != 1))) if len(i) else i
        good = np.add.reduceat(words[left[i]], starts) >= min_words if len(i) else np.zeros(0, bool)
        if good.any():
            ends = np.append(starts[1:], len(i)) - 1
            firsts.append(left[i[starts[good]]])
            lasts.append(left[i[ends[good]]])
            left = np.delete(left, i[tx.ragged(starts[good], (ends - starts + 1)[good])])
        elif bare:
            break
        else:
            left, bare = left[_in_common_runs(mine, words, theirs, their_words, min_words)[left]], True
    return np.concatenate(firsts), np.concatenate(lasts)


_BLOCKS = "array<struct<digest:bigint,first:int,last:int>>"


def deletions(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``(doc_id, blocks)``: the common blocks that a later document loses.

    ``first`` and ``last`` count lines with a word; ``digest`` names the row among those with this id.
    """
    found = durable(sequences(docs), "lines")
    pairs = document_pairs(found, min_words)
    mine = found.select("doc_id", "digest", "lines", "words").distinct()
    theirs = found.select(F.col("doc_id").alias("owner"), F.col("lines").alias("other"), F.col("words").alias("other_words"))
    both = pairs.join(mine.hint("merge"), "doc_id").join(theirs.hint("merge"), "owner").select("doc_id", "digest", "lines", "words", "other", "other_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("lines", "words", "other", "other_words")]
            flats = [x.flatten().to_numpy() for x in lists]
            at = [tx.offsets_of(x.value_lengths().to_numpy()) for x in lists]
            row, first, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(batch.num_rows):
                a, b = common_blocks(*(f[o[k] : o[k + 1]] for f, o in zip(flats, at)), min_words)
                row.append(np.full(len(a), k))
                first.append(a)
                last.append(b)
            rows = pa.array(np.concatenate(row))
            places = [pa.array(np.concatenate(x).astype(np.int32)) for x in (first, last)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("digest").take(rows), *places], names=["doc_id", "digest", "first", "last"])

    blocks = both.mapInArrow(run, "doc_id bigint, digest bigint, first int, last int")
    # no more blocks than lines of the document for each of its owners
    return blocks.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("digest", "first", "last")).alias("blocks"))


def without_blocks(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``docs`` with common blocks cut from later documents, and the columns ``n_lines``, ``n_deleted`` and ``words_deleted``."""
    cut = durable(deletions(docs, min_words), "blocks")
    names = {f"_c{i}": c for i, c in enumerate(docs.columns) if c not in COUNTS}
    plain = docs.select(*(F.col(c).alias(a) for a, c in names.items()))
    key, text = (next(a for a, c in names.items() if c == wanted) for wanted in ("doc_id", "text"))
    found = cut.select(F.col("doc_id").alias("_id"), F.col("blocks").alias("_blocks"))
    rows = plain.join(found.hint("merge"), F.col(key) == F.col("_id"), "left").drop("_id")
    out = plain.schema
    for name in COUNTS:
        out = out.add(f"_{name}", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, text):
            data, offsets = tx.buffer(batch.column(text))
            starts, ends, of_line, words, worded = _worded_lines(data, offsets)
            at = np.searchsorted(of_line, np.arange(batch.num_rows + 1))
            worded_at = np.searchsorted(of_line[worded], np.arange(batch.num_rows + 1))
            hashes = _line_hashes(data, starts[worded], ends[worded]) if len(worded) else np.zeros(0, np.uint64)
            lists = batch.column("_blocks")
            doc = np.repeat(np.arange(batch.num_rows), pc.fill_null(lists.value_lengths(), 0).to_numpy())
            digest, first, last = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
            # of the rows with one id, those that this block was found in
            real = digest == _digests(hashes, worded_at)[doc]
            first, last = (worded[x[real] + worded_at[:-1][doc[real]]] for x in (first, last))
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, last + 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_gone = np.bincount(of_line[gone], minlength=batch.num_rows)
            lost = np.bincount(of_line[gone], weights=words[gone], minlength=batch.num_rows).astype(np.int64)
            # a kept line brings the line feed before it, unless it is the first one kept of its text
            kept = np.flatnonzero(~gone)
            kept_doc = of_line[kept]
            lead = np.append(False, kept_doc[1:] == kept_doc[:-1]) if len(kept) else np.zeros(0, bool)
            begin = starts[kept] - lead
            # the byte before a kept line's start is its line feed
            pieces = data[tx.ragged(begin, ends[kept] - begin)]
            new_at = tx.offsets_of(np.bincount(kept_doc, weights=ends[kept] - begin, minlength=batch.num_rows).astype(np.int64))
            texts = tx.strings(pieces, new_at)
            if batch.column(text).null_count:
                texts = pa.array([t if ok else None for t, ok in zip(texts.to_pylist(), batch.column(text).is_valid().to_pylist())], pa.string())
            columns = [texts if a == text else batch.column(a) for a in names]
            columns += [pa.array(np.diff(at)), pa.array(n_gone), pa.array(lost)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_n_lines", "_n_deleted", "_words_deleted"])

    done = rows.mapInArrow(run, out)
    extra = [F.col(f"_{n}").alias(n) for n in COUNTS]
    return done.select(*(F.col(a).alias(c) for a, c in names.items()), *extra)
