"""Token ids as Re-Pair grammars: a file format with random access.

A table of shards is written in ascending ``doc_id`` order.  A shard holds the ids of some
documents as a grammar: in each round the frequent pairs of neighbouring symbols become
nonterminals, and their occurrences are replaced from the left; rounds go on until no pair
is frequent.  Pairs inside words are counted over the distinct words of the shard, each
with its number of occurrences; when none is left, every word is one or few symbols, and
the rounds go on over the whole sequence.  Beside the rules stand their expansion lengths,
so any range of ids is decoded from the symbols that cover it: ``read`` decodes whole shards,
``read_documents`` only the ranges of the documents asked for.

Columns of a shard: ``part`` and ``seq`` (its place in the order), ``n_tokens``,
``doc_ids``, ``doc_valid`` and ``doc_lengths``, ``rounds`` (rules made in each round),
``rules`` (left and right symbol), ``expansions`` (ids of each rule) and ``body``.

Cases: a null or empty text is the end id alone; rows with one ``doc_id`` follow each other,
and equal rows are alike; a null ``doc_id`` comes first; an empty table makes an empty
file; further columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exprstudy.llm import bpe
from exprstudy.llm import textops as tx
from exprstudy.session import shared_folder

SHARDS = (
    "part int, seq int, n_tokens bigint, doc_ids binary, doc_valid binary, doc_lengths binary, "
    "rounds binary, rules binary, expansions binary, body binary"
)
#: Text bytes of a shard.
SHARD_BYTES = 8 << 20
#: A pair is frequent from this many occurrences on, and from this share of the most frequent pair of its round.
MIN_PAIRS, MIN_SHARE = 32, 1 / 64


@dataclass
class Grammar:
    """Symbols below ``n_terminals`` are ids; symbol ``n_terminals + k`` is rule ``k``; a rule uses symbols of earlier rounds."""

    n_terminals: int
    left: np.ndarray
    right: np.ndarray
    rounds: list[int]
    body: np.ndarray
    expansions: np.ndarray | None = None

    def lengths(self) -> np.ndarray:
        """Ids that each symbol stands for, as stored or from the rules."""
        if self.expansions is not None:
            return np.concatenate([np.ones(self.n_terminals, np.int64), self.expansions])
        out = np.ones(self.n_terminals + len(self.left), np.int64)
        done = self.n_terminals
        for n in self.rounds:
            rules = slice(done - self.n_terminals, done - self.n_terminals + n)
            out[done : done + n] = out[self.left[rules]] + out[self.right[rules]]
            done += n
        return out

    def expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every symbol, one after the other, and their offsets."""
        size = self.lengths()
        at = tx.offsets_of(size)
        flat = np.zeros(at[-1], np.int64)
        flat[: self.n_terminals] = np.arange(self.n_terminals)
        done = self.n_terminals
        for n in self.rounds:
            rules = slice(done - self.n_terminals, done - self.n_terminals + n)
            to = at[done : done + n]
            for side, shift in ((self.left[rules], 0), (self.right[rules], size[self.left[rules]])):
                flat[tx.ragged(to + shift, size[side])] = flat[tx.ragged(at[side], size[side])]
            done += n
        return flat, at

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids ``first .. last`` of the shard, from the symbols that cover them."""
        if first == 0 and last is None:
            flat, at = self.expanded()
            return flat[tx.ragged(at[self.body], np.diff(at)[self.body])]
        ends = np.cumsum(self.lengths()[self.body])
        return self.span(ends, first, int(ends[-1]) if last is None and len(ends) else last or 0)

    def span(self, ends: np.ndarray, first: int, last: int) -> np.ndarray:
        """The ids of a range, from nothing but the rules below the symbols that cover it."""
        a, b = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, last)
        before = int(ends[a - 1]) if a else 0
        ids = self.body[a : b + 1]
        while True:
            rule = ids - self.n_terminals
            open_ = rule >= 0
            if not open_.any():
                return ids[first - before : last - before]
            at = tx.offsets_of(1 + open_)[:-1]
            wider = np.empty(len(ids) + int(open_.sum()), np.int64)
            wider[at[~open_]] = ids[~open_]
            wider[at[open_]], wider[at[open_] + 1] = self.left[rule[open_]], self.right[rule[open_]]
            ids = wider


def _round(symbols: np.ndarray, owner: np.ndarray | None, weight: np.ndarray | None, first_new: int, min_pairs: int, live: np.ndarray | None):
    """One round: the new symbols, owners, the pairs that became rules, and where a frequent pair may still stand.

    Counts of old pairs only fall, so once every pair of ``min_pairs`` became a rule, those left
    out stay out; only pairs with a new symbol, and what is left of the frequent ones, are counted.
    """
    if len(symbols) < 2:
        return None
    left, right = symbols[:-1], symbols[1:]
    # a frequent pair has two frequent symbols
    common = np.bincount(symbols, weights=None if weight is None else weight[owner]) >= min_pairs
    possible = common[left] & common[right]
    if live is not None:
        possible &= live
    if owner is not None:
        possible &= owner[1:] == owner[:-1]
    where = np.flatnonzero(possible)
    keys, code, _ = tx.numbered(left[where] << np.int64(32) | right[where])
    if not len(keys):
        return None
    count = np.bincount(code, weights=None if weight is None else weight[owner[where]], minlength=len(keys))
    least = max(min_pairs, count.max() * MIN_SHARE)
    frequent = count >= least
    if not frequent.any():
        return None
    number = np.cumsum(frequent) - 1 + first_new
    hit = frequent[code]
    at, new = where[hit], number[code[hit]]
    run = np.append(True, np.diff(at) > 1)
    start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
    taken = (np.arange(len(at)) - start) % 2 == 0
    again = np.zeros(len(symbols), bool)
    again[at] = True
    at, new = at[taken], new[taken]
    symbols = symbols.copy()
    symbols[at] = new
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    symbols = symbols[keep]
    if least > min_pairs:
        live = None
    else:
        fresh = symbols >= first_new
        live = again[keep][:-1] | fresh[:-1] | fresh[1:]
    return symbols, None if owner is None else owner[keep], keys[frequent] >> np.int64(32), keys[frequent] & np.int64(0xFFFFFFFF), live


def _rounds(symbols, owner, weight, made: list, first_new: int, min_pairs: int):
    live = None
    while (found := _round(symbols, owner, weight, first_new, min_pairs, live)) is not None:
        symbols, owner, left, right, live = found
        made.append((left, right))
        first_new += len(left)
    return symbols, owner, first_new


def compress(ids: np.ndarray, lengths: np.ndarray, which: np.ndarray, n_terminals: int, min_pairs: int = MIN_PAIRS) -> Grammar:
    """The grammar of a sequence of words ``which``; word ``i`` has ``lengths[i]`` of ``ids``."""
    made: list[tuple[np.ndarray, np.ndarray]] = []
    owner = np.repeat(np.arange(len(lengths)), lengths)
    weight = np.bincount(which, minlength=len(lengths)).astype(np.float64)
    symbols, owner, new = _rounds(ids.astype(np.int64), owner, weight, made, n_terminals, min_pairs)
    sizes = np.bincount(owner, minlength=len(lengths))
    body = symbols[tx.ragged(tx.offsets_of(sizes)[:-1][which], sizes[which])]
    body, _, _ = _rounds(body, None, None, made, new, min_pairs)
    left, right = (np.concatenate([m[i] for m in made]) if made else np.zeros(0, np.int64) for i in (0, 1))
    return Grammar(n_terminals, left, right, [len(m[0]) for m in made], body)


def _planes(values: np.ndarray) -> bytes:
    """Four bytes of each value, byte by byte, compressed."""
    raw = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _values(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    raw = np.frombuffer(pa.decompress(packed[8:], size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


def _unpacked(row: dict, n_terminals: int) -> Grammar:
    rules = _values(row["rules"])
    half = len(rules) // 2
    return Grammar(n_terminals, rules[:half], rules[half:], _values(row["rounds"]).tolist(), _values(row["body"]), _values(row["expansions"]))


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Encode every text and write the shards under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = bpe.library_file(tokenizer_path)
        n_terminals = file.table.n_symbols
        part = TaskContext.get().partitionId()
        for seq, rows in enumerate(tx.slices(_joined(batches), "text", SHARD_BYTES)):
            ids, lengths, which, per_text = file.encode_units(rows.column("text"))
            # the end id is a word of its own after each text
            lengths, ids = np.append(lengths, 1), np.append(ids, end_id)
            at = tx.offsets_of(per_text + 1)
            order = np.full(at[-1], len(lengths) - 1)
            order[tx.ragged(at[:-1], per_text)] = which
            doc_lengths = tx.segment_sum(lengths[order], at)
            order = order[lengths[order] > 0]
            grammar = compress(ids, lengths, order, n_terminals)
            keys = rows.column("doc_id").cast(pa.int64())
            row = {
                "part": part,
                "seq": seq,
                "n_tokens": int(doc_lengths.sum()),
                "doc_ids": keys.fill_null(0).to_numpy().astype("<i8").tobytes(),
                "doc_valid": keys.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
                "doc_lengths": doc_lengths.astype("<i8").tobytes(),
                "rounds": _planes(np.array(grammar.rounds, np.int64)),
                "rules": _planes(np.concatenate([grammar.left, grammar.right])),
                "expansions": _planes(grammar.lengths()[n_terminals:]),
                "body": _planes(grammar.body),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_SHARD_SCHEMA)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, SHARDS).write.parquet(path)


_SHARD_SCHEMA = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64())]
    + [(n, pa.binary()) for n in ("doc_ids", "doc_valid", "doc_lengths", "rounds", "rules", "expansions", "body")]
)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about a shard's bytes, so that shards do not depend on the size of Arrow batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SHARD_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def read(spark: SparkSession, path: str, tokenizer_path: str) -> DataFrame:
    """Per document its place among all ids, its number of ids and their checksum, decoded from the file."""
    shards = spark.read.schema(SHARDS).parquet(path)
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each part of the file
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_start"))
    firsts = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("shard_start"))
    placed = firsts.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terminals = bpe.library_file(tokenizer_path).table.n_symbols
        for batch in batches:
            for row in batch.to_pylist():
                raw = _unpacked(row, n_terminals).decode().astype("<u4").tobytes()
                lengths = np.frombuffer(row["doc_lengths"], "<i8")
                at = tx.offsets_of(lengths)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["doc_valid"], np.uint8) == 0)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(row["first"] + at[:-1]), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    bodies = shards.drop("n_tokens").join(placed, ["part", "seq"])
    return bodies.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(spark: SparkSession, path: str, tokenizer_path: str, wanted: DataFrame) -> DataFrame:
    """``(doc_id, ids)`` of the documents whose id is in ``wanted.doc_id``, decoded by range.

    The ids of the shards are read alone and joined; a shard without a wanted document is not
    decoded, and in the others only the symbols that cover one are.  Ids wanted twice count
    once, ids that the file lacks or that are null give no row, rows with one id give one each.
    """
    shards = spark.read.schema(SHARDS).parquet(path)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = np.flatnonzero(np.frombuffer(row["doc_valid"], np.uint8))
                ids = np.frombuffer(row["doc_ids"], "<i8")[found]
                names = ["part", "seq", "place", "doc_id"]
                shard = [pa.array(np.full(len(ids), row[n]), pa.int32()) for n in names[:2]]
                yield pa.RecordBatch.from_arrays([*shard, pa.array(found, pa.int32()), pa.array(ids)], names=names)

    directory = shards.select("part", "seq", "doc_ids", "doc_valid").mapInArrow(places, "part int, seq int, place int, doc_id bigint")
    asked = wanted.select(F.col("doc_id").cast("bigint")).distinct()
    # places of a shard are bounded by its documents
    chosen = directory.join(asked, "doc_id").groupBy("part", "seq").agg(F.sort_array(F.collect_list("place")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terminals = bpe.library_file(tokenizer_path).table.n_symbols
        for batch in batches:
            for row in batch.to_pylist():
                grammar = _unpacked(row, n_terminals)
                ends = np.cumsum(grammar.lengths()[grammar.body])
                at = tx.offsets_of(np.frombuffer(row["doc_lengths"], "<i8"))
                ids = np.frombuffer(row["doc_ids"], "<i8")
                for place in row["places"]:
                    found = grammar.span(ends, int(at[place]), int(at[place + 1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[place : place + 1]), pa.array([found.astype("<i4")], pa.list_(pa.int32()))], names=["doc_id", "ids"]
                    )

    return shards.drop("n_tokens").join(chosen, ["part", "seq"]).mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a new file in the shared folder and read it back."""
    path = f"{shared_folder(docs.sparkSession)}/exprstudy/grammar-{uuid.uuid4().hex}"
    write(docs, tokenizer_path, end_id, path)
    return read(docs.sparkSession, path, tokenizer_path)
