"""Best-fit packing by minimum bin slack.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.  Only the
lengths of pieces matter for packing, so the corpus is reduced to the number of pieces of
each length, ``capacity`` numbers however large it is.  For each bin the largest length
left is combined with the lengths that fill it best, found by dynamic programming over
subset sums in a bitset, and that combination is used as many times as the counts allow.
The plan is a short list of (combination, times); each piece then finds its place from its
rank among the pieces of its length.

Cases: a null or empty text is the end id alone; pieces of equal length are placed in the
order of document and piece, repeated rows side by side; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprstudy.llm import bpe
from exprstudy.llm import textops as tx
from exprstudy.session import durable

CAPACITY = 1024
#: Pieces of one length that a task orders, on average, if all had that length.
PART_PIECES = 100_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: place, length and checksum of their ids (with the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = bpe.library_file(path)
        for rows in tx.slices(batches, "text", bpe.UNIT_BYTES):
            ids, at = file.encode(rows.column("text"))
            lengths = np.diff(at) + 1
            out_at = tx.offsets_of(lengths)
            flat = np.full(out_at[-1], end_id, "<u4")
            flat[tx.ragged(out_at[:-1], lengths - 1)] = ids
            n = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(n.sum()) - np.repeat(tx.offsets_of(n)[:-1], n)
            head = lengths - (n - 1) * capacity
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            size = np.where(piece == 0, head[doc], capacity)
            raw, where = flat.tobytes(), out_at[:-1][doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + s)]) for a, s in zip(where.tolist(), size.tolist())]
            keys = rows.column("doc_id").cast(pa.int64()).take(pa.array(doc))
            columns = [keys, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def _fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """Lengths (and how often) whose sum is the largest possible up to ``room``; long ones are preferred.

    ``reach[i]`` is the bitset of the sums that the first ``i`` bundles make; a bundle is a
    power of two of one length, so that each number up to the count can be made.
    """
    bundles: list[tuple[int, int]] = []
    for length in range(room, 0, -1):
        left = min(int(counts[length]), room // length)
        power = 1
        while left > 0:
            take = min(power, left)
            bundles.append((length, take))
            left -= take
            power *= 2
    full = (1 << (room + 1)) - 1
    reach = [1]
    for length, take in bundles:
        now = (reach[-1] | reach[-1] << (length * take)) & full
        reach.append(now)
        if now >> room & 1:
            break
    at = reach[-1].bit_length() - 1
    used: dict[int, int] = {}
    for i in range(len(reach) - 1, 0, -1):
        if reach[i - 1] >> at & 1:
            continue
        length, take = bundles[i - 1]
        used[length] = used.get(length, 0) + take
        at -= length * take
    return used


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths with the number of bins filled by each; ``counts[length]`` pieces are placed."""
    left = counts.astype(np.int64).copy()
    bins = []
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            left[length] -= 1
            used = _fullest(left, capacity - length)
            left[length] += 1
            used[length] = used.get(length, 0) + 1
            times = min(int(left[size]) // n for size, n in used.items())
            for size, n in used.items():
                left[size] -= n * times
            bins.append((used, times))
    return bins


PLACED = PIECES + ", sequence_id bigint, offset bigint"


def _places(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces in each bin, offset), ordered by length and rank."""
    rank: dict[int, int] = {}
    rows, first_bin = [], 0
    for used, times in bins:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, rank.get(length, 0), first_bin, n, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += n * length
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces.

    Each combination of the plan uses up a length, so the plan that goes to the tasks has
    at most ``capacity`` combinations.
    """
    found = durable(found, "pieces")
    # a length may hold most pieces; its ranks are counted in parts whose number follows the pieces
    parts = max(64, found.count() // PART_PIECES)
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    sizes = durable(sizes.withColumn("before", before), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length
        counts[row.length] = row.n
    places = _places(plan(counts, capacity))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = places[:, 0] << 48 | places[:, 1]
        for rows in batches:
            length, rank = rows.column("length").to_numpy(), rows.column("rank").to_numpy()
            _, first, first_bin, per_bin, offset = places[np.searchsorted(key, length << 48 | rank, side="right") - 1].T
            inside = rank - first
            columns = [rows.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(first_bin + inside // per_bin), pa.array(offset + inside % per_bin * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    local = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = found.withColumn("local", local).join(sizes.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local") - 1).drop("local", "before", "part")
    return ranked.mapInArrow(put, PLACED)
