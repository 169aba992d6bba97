"""Alignment of two tokenisations of each text, by merging them in lockstep.

Two tokenisations of the same bytes are two ascending lists of end offsets.  A merge walks
both: the tokens it stands on overlap, which is a link, and the one that ends first gives way
to its successor; where both end there is a cut.  Here one state vector holds the two
pointers of every document of a slice, and each step advances all of them at once; finished
documents leave the vector.  A long document is walked in several lanes: a lane begins at a
certain token of the first list and at the token of the second one that covers its first
byte, and ends before the next lane, so that the number of steps has a bound.

The links of a slice are stored as numbers of its distinct id pairs.  Only those distinct
pairs travel: they are counted over the corpus, and the counts come back to their slice.

Cases: a null or empty text, or one whose tokens do not spell a space and the text, has no
tokens; special tokens in a text are text; repeated rows are aligned and counted each for
itself; ties among the most frequent partners all count as best; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprstudy.llm import bpe
from exprstudy.llm import textops as tx
from exprstudy.session import durable

#: Text bytes that are encoded and aligned together.
BLOCK_BYTES = 2 << 20
#: Tokens of the first list that a lane walks.
LANE = 1024
#: Bits of the second id in a pair.
_SHIFT = 24


@lru_cache(maxsize=4)
def _spelled(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all entries of a byte-level file, one after the other, and their offsets."""
    byte_of = {c: i for i, c in enumerate(bpe._byte_characters())}
    vocabulary = bpe.library_file(path).library.get_vocab()
    entries = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if all(c in byte_of for c in token):
            entries[i] = bytes(byte_of[c] for c in token)
    return np.frombuffer(b"".join(entries), np.uint8), tx.offsets_of(np.array([len(e) for e in entries]))


@dataclass
class Tokens:
    """Ids of several documents, where each document begins, and where each token ends in the bytes of all of them."""

    ids: np.ndarray
    at: np.ndarray
    end: np.ndarray


@dataclass
class Alignment:
    """Both tokenisations of the documents of a slice and their merge."""

    a: Tokens
    b: Tokens
    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def lockstep(a: Tokens, b: Tokens, lane: int = LANE) -> Alignment:
    """Merge the token ends of all documents at once; documents have equal bytes in both."""
    n_lanes = -(-np.diff(a.at) // lane)
    doc = np.repeat(np.arange(len(n_lanes)), n_lanes)
    i = a.at[:-1][doc] + tx.ragged(np.zeros(len(n_lanes), np.int64), n_lanes) * lane
    stop = np.minimum(i + lane, a.at[1:][doc])
    begin = np.where(i > 0, a.end[i - 1], 0) if len(i) else i
    j = np.searchsorted(b.end, begin, side="right")
    cut_a, cut_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    links_a, links_b = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    while len(i):
        links_a.append(i.astype(np.int32))
        links_b.append(j.astype(np.int32))
        end_a, end_b = a.end[i], b.end[j]
        both = end_a == end_b
        cut_a[i[both]] = True
        cut_b[j[both]] = True
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    link_a, link_b = np.concatenate(links_a), np.concatenate(links_b)
    # from the order of steps to that of texts; the links of one token of the first list come in order
    order = np.argsort(link_a, kind="stable")
    return Alignment(a, b, link_a[order], link_b[order], cut_a, cut_b)


def _encoded(texts: pa.Array, path_a: str, path_b: str) -> tuple[Tokens, Tokens]:
    """Both tokenisations of texts of which every one has tokens or none in both."""
    texts = pc.fill_null(texts, "")
    led = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
    file_b = bpe.piece_file(path_b)
    ids_a, at_a = bpe.library_file(path_a).encode(led)
    framed, at_b = file_b.encode(texts)
    inner = np.ones(len(framed), bool)
    inner[at_b[:-1]] = inner[at_b[1:] - 1] = False
    ids_b, at_b = framed[inner].astype(np.int64), at_b - 2 * np.arange(len(at_b))
    data, offsets = tx.buffer(led)
    whole = np.ones(len(offsets) - 1, bool)
    found = []
    for ids, at, (spelled, spelled_at) in ((ids_a, at_a, _spelled(path_a)), (ids_b, at_b, (file_b.spelled, file_b.spelled_at))):
        lengths = np.diff(spelled_at)[ids]
        byte_at = tx.offsets_of(lengths)
        whole &= byte_at[at[1:]] - byte_at[at[:-1]] == np.diff(offsets)
        flat = np.empty(byte_at[-1], np.uint8)
        for low, high in tx.parts(byte_at, tx.HASH_BYTES):
            flat[byte_at[low] : byte_at[high]] = spelled[tx.ragged(spelled_at[ids[low:high]], lengths[low:high])]
        if len(flat) != len(data) or not whole.all() or not np.array_equal(flat, data):
            where = byte_at[at]
            whole &= [np.array_equal(flat[where[k] : where[k + 1]], data[offsets[k] : offsets[k + 1]]) for k in range(len(whole))]
        found.append((ids, at, lengths))
    out = []
    for ids, at, lengths in found:
        n = np.where(whole, np.diff(at), 0)
        if not whole.all():
            kept = np.repeat(whole, np.diff(at))
            ids, lengths = ids[kept], lengths[kept]
        out.append(Tokens(ids, tx.offsets_of(n), np.cumsum(lengths)))
    return out[0], out[1]


def _slices(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[tuple[pa.Array, Alignment]]:
    for rows in tx.slices(batches, "text", BLOCK_BYTES):
        yield rows.column("doc_id").cast(pa.int64()), lockstep(*_encoded(rows.column("text"), path_a, path_b))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


_ALIGNED = "doc_id bigint, a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>, cuts array<int>"


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Ids of both tokenisations, links as places in them, and the byte offsets of cuts in a space and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in _slices(batches, path_a, path_b):
            a, b = found.a, found.b
            doc = np.repeat(np.arange(len(keys)), np.diff(a.at))
            link_at = np.searchsorted(found.link_a, a.at)
            cut = np.flatnonzero(found.cut_a)
            base = np.append(0, a.end)[a.at[:-1]]
            columns = [
                keys,
                _lists(a.ids.astype(np.int32), a.at),
                _lists(b.ids.astype(np.int32), b.at),
                _lists((found.link_a - a.at[doc[found.link_a]]).astype(np.int32), link_at),
                _lists((found.link_b - b.at[doc[found.link_a]]).astype(np.int32), link_at),
                _lists((a.end[cut] - base[doc[cut]]).astype(np.int32), np.searchsorted(cut, a.at)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in _ALIGNED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _ALIGNED)


def spelled_groups(found: Alignment) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of all documents, each with a semicolon at its end, and their offsets."""
    a, b = found.a, found.b
    group_a = np.cumsum(found.cut_a) - found.cut_a
    group_b = np.cumsum(found.cut_b) - found.cut_b
    n_groups = int(found.cut_a.sum())
    of_a, of_b = (np.bincount(g, minlength=n_groups) for g in (group_a, group_b))
    place_a = np.arange(len(a.ids)) + (np.cumsum(of_b) - of_b)[group_a]
    place_b = np.arange(len(b.ids)) + np.cumsum(of_a)[group_b]
    n = len(a.ids) + len(b.ids)
    ids, mark = np.zeros(n, np.int32), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = a.ids, b.ids
    mark[place_a[found.cut_a]], mark[place_b[found.cut_b]] = ord("|"), ord(";")
    # the last token of a group is where its list of that side ends
    width = np.ones(n, np.int64)
    for power in range(1, 10):
        width += ids >= 10**power
    end = np.cumsum(width + 1)
    out = np.zeros(int(end[-1]) if n else 0, np.uint8)
    out[end - 1] = mark
    for digit in range(int(width.max(initial=0))):
        has = width > digit
        out[end[has] - 2 - digit] = ord("0") + ids[has] // 10**digit % 10
    return out.tobytes(), np.append(0, end)[a.at + b.at]


_BLOCKS = (
    "block bigint, pairs array<bigint>, times array<bigint>, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, codes array<int>"
)
_DOCS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_REPORT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each slice a row with its distinct pairs and how often they are linked, and a row for each of its documents."""
    names = [f.split(" ")[0] for f in _BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for keys, found in _slices(batches, path_a, path_b):
            block += 1
            a, b = found.a, found.b
            pair = a.ids[found.link_a].astype(np.int64) << _SHIFT | b.ids[found.link_b]
            distinct, code, _ = tx.numbered(pair)
            head = [
                pa.array([block]),
                _lists(distinct.astype(np.int64), np.array([0, len(distinct)])),
                _lists(np.bincount(code, minlength=len(distinct)), np.array([0, len(distinct)])),
                *(pa.nulls(1, pa.int64()) for _ in range(5)),
                pa.nulls(1, pa.string()),
                pa.nulls(1, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(head, names=names)
            n = len(keys)
            spelled, at = spelled_groups(found)
            digests = [hashlib.sha256(spelled[at[k] : at[k + 1] - 1]).hexdigest() if at[k + 1] > at[k] else "" for k in range(n)]
            link_at = np.searchsorted(found.link_a, a.at)
            rows = [
                pa.array(np.full(n, block)),
                *(pa.nulls(n, pa.list_(pa.int64())) for _ in range(2)),
                keys,
                *(pa.array(np.diff(x)) for x in (a.at, b.at, np.append(0, np.cumsum(found.cut_a))[a.at], link_at)),
                pa.array(digests, pa.string()),
                _lists(code.astype(np.int32), link_at),
            ]
            yield pa.RecordBatch.from_arrays(rows, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, _BLOCKS)


def reports(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Counts, the corpus-wide counts of linked id pairs, and the digest of the groups of each document."""
    stored = durable(blocks(docs, path_a, path_b), "alignments")
    # a slice's pairs are no more than its links, and a slice is bounded, so one row can hold them
    pairs = stored.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x")).select(
        "block", "place", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")
    )
    totals = durable(pairs.groupBy("pair").agg(F.sum("times").alias("total")).withColumn("b_id", F.col("pair").bitwiseAND((1 << _SHIFT) - 1)), "pair-counts")
    highest = totals.groupBy("b_id").agg(F.max("total").alias("highest"))
    marked = totals.join(highest, "b_id").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    known = pairs.select("block", "place", "pair").join(marked.hint("merge"), "pair").select(F.col("block").alias("of_block"), "place", "total", "best")
    rows = stored.where("pairs IS NULL").select("block", *_DOCS, "codes")

    def run(mine: pa.Table, counts: pa.Table) -> pa.Table:
        mine, counts = mine.combine_chunks(), counts.combine_chunks()
        place = counts.column("place").to_numpy()
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        total[place], best[place] = counts.column("total").to_numpy(), counts.column("best").to_numpy()
        code = mine.column("codes").combine_chunks()
        flat = pc.list_flatten(code).to_numpy()
        at = tx.offsets_of(mine.column("n_links").to_numpy())
        sums = {"n_best": pa.array(tx.segment_sum(best[flat], at)), "count_sum": pa.array(tx.segment_sum(total[flat], at))}
        names = [f.split(" ")[0] for f in _REPORT.split(", ")]
        return pa.table([sums[c] if c in sums else mine.column(c) for c in names], names=names)

    return rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(run, _REPORT)
