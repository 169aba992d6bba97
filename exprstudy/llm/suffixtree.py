"""Language-model scores from a probabilistic suffix tree.

A text is the sequence of its words and one end.  The tree predicts each of them from the
longest suffix of the words before it that it holds as a state.  Its symbols are the
words seen twice or more, one symbol for all others, and the end; a word of the "others" is then
predicted by its count and its spelling, and the spelling again by a suffix tree, whose
symbols are bytes; a word unknown to the training texts has the share of all unknown words
times its spelling, among the spellings that no known word has.  In both trees

* a word context is a candidate from two occurrences on, so the tree of words grows with the
  corpus; a byte context from a share of all bytes of distinct words on, which bounds the
  number of spelling states;
* it is retained if what follows it diverges from what follows its own suffix: the sum of
  log ratios of the two distributions over its occurrences, each left out of the counts
  that predict it, must reach a threshold;
* a state mixes its discounted counts with the distribution of its suffix, down to the
  empty context, so that every symbol has a probability after every state.

The corpus is read once, into blocks that hold numbered words; blocks and what they exchange
are compressed cells of sorted numbers, since whole corpora of contexts as rows take many times
the disk of their texts.  The words of all blocks are dealt to parts by hash; a part counts its
words, numbers them from the most frequent one on and tells each block the counts and numbers of
its words.  Each position of a text then goes, as the numbers of its symbol and of the symbols
before it, to the part of the symbol just before it: all contexts that end alike and all that follows
them are in one part, so it counts and tests the states and scores the positions at once, and
sends a block one sum for each of its texts.  No part of the word tree is gathered.  Spellings
are counted in the same way, by the last two bytes of their contexts.

Cases: a null or empty text is the end alone; ties cannot occur; a repeated row counts and
is scored again; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprstudy.llm import textops as tx
from exprstudy.session import durable

RESULT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
RESULT_SQL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

#: Text bytes of a block.
BLOCK_BYTES = 8 << 20
#: Tokens for which there is a part, the fewest parts, and the positions of a part worked on at once.
PART_TOKENS, LEAST_PARTS, RUN_TOKENS = 2 << 20, 12, 1 << 19

BOUNDARY = 0x20
BYTE_BITS = 8
#: Symbols that are no word: none (before a text), words that are not frequent, the end; as what is predicted, an unknown word.
NONE, OTHER, END, UNKNOWN, WORDS = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class Options:
    """``word_count`` is at least 2, since a context is tested without one occurrence; ``byte_depth`` is at most 7: a context fits into one integer."""

    word_depth: int = 2
    word_count: int = 2
    byte_depth: int = 7
    byte_share: float = 1e-6
    divergence: float = 10.0
    discount: float = 0.75


@dataclass(frozen=True)
class Tree:
    """States sorted by key, their back-off weights, and ``(state number, symbol)`` pairs with discounted shares.

    ``root`` is the whole distribution of the empty context.
    """

    bits: int
    depth: int
    root: np.ndarray
    states: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray
    shares: np.ndarray


# --- cells -----------------------------------------------------------------

_CODEC = pa.Codec("zstd", compression_level=3)
_CELL = struct.Struct("<cBQQ")
_CELLS = "part int, block bigint, body binary"
_CELLS_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of bytes, of floats, or of integers from 0 on, each byte by byte of its width and compressed."""
    out = []
    for a in columns:
        kind = b"f" if a.dtype.kind == "f" else b"b" if a.dtype == np.uint8 else b"u"
        if kind == b"u":
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        width = a.dtype.itemsize
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T
        body = _CODEC.compress(planes.tobytes(), asbytes=True)
        out += [_CELL.pack(kind, width, len(a), len(body)), body]
    return b"".join(out)


def _expand(body: bytes) -> list[np.ndarray]:
    """The columns again; integers are int64 (those from 2**63 on are below 0)."""
    out, at = [], 0
    while at < len(body):
        kind, width, n, size = _CELL.unpack_from(body, at)
        at += _CELL.size
        planes = np.frombuffer(_CODEC.decompress(body[at : at + size], n * width, asbytes=True), np.uint8)
        at += size
        a = np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1)
        out.append(a if kind == b"b" else a.view(np.float64) if kind == b"f" else a.view(f"u{width}").astype(np.int64))
    return out


def _steps(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Differences of sorted rows: each column from the row before, or whole where a column before it changed."""
    out = []
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for a in columns:
        step = np.diff(a, prepend=0)
        out.append(np.where(new, a, step))
        new = new | (step != 0)
    return out


def _rows(steps: list[np.ndarray]) -> list[np.ndarray]:
    """What ``_steps`` was given."""
    out = []
    new = np.zeros(len(steps[0]), bool)
    new[:1] = True
    for step in steps:
        total = np.cumsum(step)
        first = np.flatnonzero(new)
        a = total - np.repeat(total[first] - step[first], np.diff(np.append(first, len(step))))
        out.append(a)
        new = new | (step != 0)
    return out


def _cells(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _CELLS_SCHEMA)], schema=_CELLS_SCHEMA)


def _ordered(cells: pa.Table) -> pa.Table:
    """Cells in an order that does not depend on the shuffle."""
    return cells.sort_by([("block", "ascending"), ("part", "ascending")])


# --- contexts --------------------------------------------------------------


def _contexts(flat: np.ndarray, place: np.ndarray, first: int, bits: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each depth: the predicted positions (``place`` from ``first`` on) with so many symbols before them, and their context keys."""
    at = np.flatnonzero(place >= first)
    key = np.zeros(len(at), np.uint64)
    for d in range(depth + 1):
        if d:
            far = place[at] >= d
            at, key = at[far], key[far]
            key = key | (flat[at - d] << np.uint64(bits * (d - 1)))
        yield d, at, key | np.uint64(d << 56)


_COUNT_SCHEMA = pa.schema([("context", pa.int64()), ("symbol", pa.int32()), ("n", pa.int64())])
_COUNT_SQL = "context bigint, symbol int, n bigint"


def _counted(key: np.ndarray, symbol: np.ndarray, weight: np.ndarray | None) -> pa.RecordBatch:
    order = np.lexsort((symbol, key))
    k, s = key[order], symbol[order]
    new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))) if len(k) else np.zeros(0, np.int64)
    if weight is None:
        n = np.diff(np.append(new, len(k)))
    else:
        n = np.add.reduceat(weight[order], new) if len(new) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(k[new].view(np.int64)), pa.array(s[new].astype(np.int32)), pa.array(n.astype(np.int64))], schema=_COUNT_SCHEMA)


def _shortened(depth: str, bits: int) -> str:
    """SQL of the last ``depth`` symbols of ``context``."""
    return f"(context & (shiftleft(1L, {bits} * cast({depth} as int)) - 1)) | shiftleft(cast({depth} as bigint), 56)"


def grow(
    counts: DataFrame, n_all: int, bits: int, depth: int, n_symbols: int, share: float, options: Options, longer: DataFrame | None = None
) -> Tree:
    """The tree of ``(context, symbol, n)``, ``n_all`` in sum for the empty context; rows may repeat.

    ``longer`` has the states of longer contexts, ``(context, symbol, n, total)``, and without
    a symbol the contexts among ``counts`` that are the suffixes of such states.  At most ``depth / share`` states reach the driver.  A context has no more followers than
    there are symbols, so its window is bounded.
    """
    spark = counts.sparkSession
    of_context = Window.partitionBy("context")
    counts = counts.repartition("context").groupBy("context", "symbol").agg(F.sum("n").alias("n"))
    counts = counts.withColumns({"total": F.sum("n").over(of_context), "kinds": F.count("*").over(of_context)})
    # every suffix of a frequent context is frequent
    frequent = durable(counts.where(F.col("total") >= max(2, share * n_all)), "tree-frequent")
    shorter = F.expr(_shortened("shiftright(context, 56) - 1", bits))
    child = frequent.where("context <> 0").select("context", "symbol", "n", "total", "kinds", shorter.alias("parent"))
    parent = frequent.select(F.col("context").alias("parent"), "symbol", (F.col("n") / F.col("total")).alias("parent_share"))
    left = F.greatest(F.col("n") - 1 - options.discount, F.lit(0)) + options.discount * F.col("kinds") * F.col("parent_share")
    gain = F.sum(F.col("n") * F.log(left / (F.col("total") - 1) / F.col("parent_share")))
    tested = (
        child.join(parent, ["parent", "symbol"])
        .groupBy("context")
        .agg(gain.alias("gain"))
        .where(F.col("gain") >= options.divergence)
        .select("context")
    )
    if longer is not None:
        tested = tested.unionByName(longer.where("symbol IS NULL").select("context"))
    # a state needs its suffixes, down to the empty one, as states
    lengths = tested.select("context", F.explode(F.expr("sequence(0L, shiftright(context, 56))")).alias("d"))
    root = spark.createDataFrame([(0,)], "context bigint")
    kept = lengths.select(F.expr(_shortened("d", bits)).alias("context")).unionByName(root).distinct()
    found = frequent.join(kept, "context").select("context", "symbol", "n", "total")
    if longer is not None:
        found = found.unionByName(longer.where("symbol IS NOT NULL"))
    found = found.toArrow()
    context, symbol, n, total = (found.column(c).to_numpy() for c in ("context", "symbol", "n", "total"))
    return _assemble(context, symbol, n, total, bits, depth, n_symbols, options.discount)


def _assemble(context, symbol, n, total, bits: int, depth: int, n_symbols: int, discount: float) -> Tree:
    states, number = np.unique(context, return_inverse=True)
    sums = np.ones(len(states))
    sums[number] = total
    backoff = discount * np.bincount(number, minlength=len(states)) / sums
    shares = (n - discount) / total
    root = np.full(n_symbols, 1 / n_symbols)
    if len(states) and states[0] == 0:
        root *= backoff[0]
        root[symbol[number == 0]] += shares[number == 0]
    pairs = number * n_symbols + symbol
    order = np.argsort(pairs)
    return Tree(bits, depth, root, states, backoff, pairs[order], shares[order])


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def probabilities(tree: Tree, flat: np.ndarray, place: np.ndarray, first: int) -> np.ndarray:
    """Probability of each symbol under its longest state; 1 before place ``first``."""
    p = np.ones(len(flat))
    symbols = flat.astype(np.int64)
    alive = None
    for d, at, key in _contexts(flat, place, first, tree.bits, tree.depth):
        if d == 0:
            p[at] = tree.root[symbols[at]]
            alive = np.ones(len(flat), bool)
            continue
        on = alive[at]
        at, key = at[on], key[on]
        state, known = _find(tree.states, key.view(np.int64))
        at, state = at[known], state[known]
        alive[:] = False
        alive[at] = True
        pair, seen = _find(tree.pairs, state * len(tree.root) + symbols[at])
        p[at] = tree.backoff[state] * p[at] + np.where(seen, tree.shares[pair] if len(tree.pairs) else 0.0, 0.0)
    return p


# --- blocks ----------------------------------------------------------------

_BLOCK = "block bigint, n_tokens bigint, n_train bigint, body binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("n_tokens", pa.int64()), ("n_train", pa.int64()), ("body", pa.binary())])


@dataclass
class Block:
    """Documents of a block, held-out ones last: ``words`` numbers into the distinct words, ``n_words`` of them for each document."""

    ids: np.ndarray
    valid: np.ndarray
    held: np.ndarray
    n_words: np.ndarray
    words: np.ndarray
    spelled: np.ndarray
    lengths: np.ndarray

    def pack(self) -> bytes:
        return _squeeze(self.ids.view(np.uint64), self.valid, self.held, self.n_words, self.words, self.spelled, self.lengths)

    @classmethod
    def unpack(cls, body: bytes) -> "Block":
        ids, valid, held, n_words, words, spelled, lengths = _expand(body)
        return cls(ids, valid.astype(bool), held.astype(bool), n_words, words, spelled, lengths)

    def parts(self, n_parts: int) -> np.ndarray:
        """The part of each distinct word."""
        return (tx.hash_words(self.spelled, tx.offsets_of(self.lengths)[:-1]) % np.uint64(n_parts)).astype(np.int64)

    def spellings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and lengths of the distinct words numbered ``which``."""
        return self.spelled[tx.ragged(tx.offsets_of(self.lengths)[which], self.lengths[which])], self.lengths[which]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in tx.slices(batches, "text", BLOCK_BYTES):
        held = rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(held, kind="stable")
        rows, held = rows.take(pa.array(order)), held[order]
        hashes, starts, lengths, counts = [], [], [], []
        whole, _ = tx.buffer(rows.column("text"))
        before = 0
        for part in tx.slices(iter([rows]), "text"):
            data, offsets = tx.buffer(part.column("text"))
            data = tx.LOWER[data]
            at, ends, of_text = tx.words(data, offsets)
            hashes.append(tx.hash_words(data, at))
            starts.append(at + before)
            lengths.append(ends - at)
            counts.append(np.diff(of_text))
            before += len(data)
        distinct, words, first = tx.numbered(np.concatenate(hashes))
        ids = rows.column("doc_id").cast(pa.int64())
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        n_words = np.concatenate(counts)
        starts, lengths = np.concatenate(starts)[first], np.concatenate(lengths)[first]
        spelled = tx.LOWER[whole[tx.ragged(starts, lengths)]]
        block = Block(ids.fill_null(0).to_numpy(), valid, held, n_words, words, spelled, lengths)
        row = [[uuid.uuid4().int >> 65], [len(words) + len(held)], [int((~held).sum())], [block.pack()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _BLOCK_SCHEMA)], schema=_BLOCK_SCHEMA)


# --- words -----------------------------------------------------------------

_WORDS = "part int, block bigint, n bigint, v bigint, once bigint, symbols bigint, kept bigint, bytes bigint, body binary"
_WORDS_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int64())] + [(c, pa.int64()) for c in ("n", "v", "once", "symbols", "kept", "bytes")] + [("body", pa.binary())]
)


def _deal_words(n_parts: int):
    """For each block and part its distinct words with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block.unpack(batch.column("body")[row].as_py())
                if not len(block.lengths):
                    continue
                trained = np.bincount(block.words[np.repeat(~block.held, block.n_words)], minlength=len(block.lengths))
                part = block.parts(n_parts)
                name = batch.column("block")[row].as_py()
                mine = ((int(p), np.flatnonzero(part == p)) for p in np.unique(part))
                yield _cells([(p, name, _squeeze(*block.spellings(at), trained[at])) for p, at in mine])
                tx.give_back()

    return run


def _binary(spelled: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(tx.offsets_of(lengths)), pa.py_buffer(np.ascontiguousarray(spelled))])


def _count_words(options: Options):
    """One row with the distinct words of a part and their counts, and for each block the counts and numbers of its words."""

    def run(cells: pa.Table) -> pa.Table:
        cells = _ordered(cells)
        read = [_expand(body) for body in cells.column("body").to_pylist()]
        words = pa.chunked_array([_binary(spelled, lengths) for spelled, lengths, _ in read]).combine_chunks().dictionary_encode()
        code = words.indices.to_numpy()
        size = len(words.dictionary)
        c = np.bincount(code, weights=np.concatenate([n for _, _, n in read]), minlength=size).astype(np.int64)
        number = np.empty(size, np.int64)
        number[np.argsort(-c, kind="stable")] = np.arange(size)
        spelled, lengths = _bytes_of(words.dictionary)
        frequent = c >= options.word_count
        sums = [c.sum(), (c > 0).sum(), (c == 1).sum(), frequent.sum(), c[frequent].sum(), (lengths + 1)[c > 0].sum()]
        part = cells.column("part")[0].as_py()
        rows = [(part, None, *map(int, sums), _squeeze(spelled, lengths, c))]
        at = tx.offsets_of(np.array([len(n) for _, _, n in read]))
        for k, block in enumerate(cells.column("block").to_pylist()):
            here = code[at[k] : at[k + 1]]
            rows.append((part, block, *[None] * 6, _squeeze(c[here], np.where(frequent, number, 0)[here])))
        tx.give_back()
        return pa.table([pa.array(list(a), f.type) for a, f in zip(zip(*rows), _WORDS_SCHEMA)], schema=_WORDS_SCHEMA)

    return run


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


# --- spelling --------------------------------------------------------------


def _spelling(spelled: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words with a boundary before and after each; place in the word; number of the word."""
    lengths = lengths + 2
    at = tx.offsets_of(lengths)
    flat = np.full(at[-1], BOUNDARY, np.uint64)
    flat[tx.ragged(at[:-1] + 1, lengths - 2)] = spelled
    word = np.repeat(np.arange(len(lengths)), lengths)
    return flat, np.arange(at[-1]) - at[word], word


def _known_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and lengths of the words that the training texts have, in runs of bounded size."""
    for batch in batches:
        for body in batch.column("body"):
            spelled, lengths, c = _expand(body.as_py())
            at = tx.offsets_of(lengths)
            for low, high in tx.parts(at, tx.SLICE_BYTES // 4):
                known = low + np.flatnonzero(c[low:high] > 0)
                yield spelled[tx.ragged(at[known], lengths[known])], lengths[known]
            tx.give_back()


#: Depth up to which contexts of spellings are counted as rows; longer ones are counted by their last two bytes.
SHORT = 2


def _spelling_counts(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _known_words(batches):
            flat, place, _ = _spelling(*words)
            for _, at, key in _contexts(flat, place, 1, BYTE_BITS, depth):
                yield _counted(key, flat[at], None)

    return run


def _deal_spellings(depth: int, n_parts: int):
    """Each byte of a word with the bytes before it as one integer, the predicted one first, dealt by the two before it.

    A boundary is only where a word begins, so it tells how long the context is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _known_words(batches):
            flat, place, _ = _spelling(*words)
            at = np.flatnonzero(place > SHORT)
            key = flat[at] << np.uint64(56)
            for d in range(1, depth + 1):
                key |= np.where(place[at] >= d, flat[at - d], np.uint64(0)) << np.uint64(BYTE_BITS * (d - 1))
            keys, n = np.unique(key, return_counts=True)
            part = (tx.mix(keys & np.uint64(0xFFFF)) % np.uint64(n_parts)).astype(np.int64)
            mine = ((int(p), np.flatnonzero(part == p)) for p in np.unique(part))
            yield _cells([(p, None, _squeeze(np.diff(keys[i], prepend=np.uint64(0)), n[i])) for p, i in mine])

    return run


_LONGER = "context bigint, symbol int, n bigint, total bigint"
_LONGER_SCHEMA = pa.schema([("context", pa.int64()), ("symbol", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])


def _gains(n: np.ndarray, of: np.ndarray, up: np.ndarray, total: np.ndarray, kinds: np.ndarray, discount: float) -> np.ndarray:
    """For each context (``total``, ``kinds``) the sum of log ratios over its followers: counts ``n`` of context ``of``, shares ``up`` after its suffix."""
    on = np.flatnonzero((n > 0) & (total[of] > 1))
    n, of, up = n[on], of[on], up[on]
    left = np.maximum(n - 1 - discount, 0) + discount * kinds[of] * up
    return np.bincount(of, weights=n * np.log(left / (total[of] - 1) / up), minlength=len(total))


def _spelling_states(depth: int, least: float, options: Options):
    """States longer than ``SHORT`` with their followers, and the suffixes of length ``SHORT`` that they need."""

    def run(cells: pa.Table) -> pa.Table:
        read = [_expand(body) for body in cells.column("body").to_pylist()]
        keys, number = np.unique(np.concatenate([np.cumsum(step.astype(np.uint64)) for step, _ in read]), return_inverse=True)
        n = np.bincount(number, weights=np.concatenate([n for _, n in read]))
        long = np.full(len(keys), depth)
        for d in range(depth, 0, -1):
            long[(keys >> np.uint64(BYTE_BITS * (d - 1))) & np.uint64(255) == BOUNDARY] = d
        symbol, up, levels = keys >> np.uint64(56), None, []
        at = np.flatnonzero(long >= SHORT)
        above = None
        for d in range(SHORT, depth + 1):
            on = long[at] >= d
            at = at[on]
            if above is not None:
                above, up = above[on], up[on]
            contexts, of = np.unique(keys[at] & np.uint64((1 << BYTE_BITS * d) - 1), return_inverse=True)
            pairs, first, pair = np.unique((of.astype(np.uint64) << np.uint64(8)) | symbol[at], return_index=True, return_inverse=True)
            count = np.bincount(pair, weights=n[at])
            owner = (pairs >> np.uint64(8)).astype(np.int64)
            total = np.bincount(owner, weights=count, minlength=len(contexts))
            kinds = np.bincount(owner, minlength=len(contexts))
            kept, suffix = np.zeros(len(contexts), bool), np.zeros(len(contexts), np.int64)
            if d > SHORT:
                kept = (total >= least) & (_gains(count, owner, up[first], total, kinds, options.discount) >= options.divergence)
                suffix[of] = above
            levels.append((d, contexts, kept, suffix, owner, (pairs & np.uint64(255)).astype(np.int64), count, total))
            # every suffix of a frequent context is frequent
            go = total[of] >= least
            at, above, up = at[go], of[go], (count[pair] / total[of])[go]
        parts = []
        for k in range(len(levels) - 1, -1, -1):
            d, contexts, kept, suffix, owner, follower, count, total = levels[k]
            tagged = (contexts | np.uint64(d << 56)).view(np.int64)
            if d == SHORT:
                short = tagged[kept]
                parts.append([pa.array(short), *(pa.nulls(len(short), t) for t in (pa.int32(), pa.int64(), pa.int64()))])
                continue
            levels[k - 1][2][suffix[kept]] = True
            i = kept[owner]
            values = tagged[owner[i]], follower[i].astype(np.int32), count[i].astype(np.int64), total[owner[i]].astype(np.int64)
            parts.append([pa.array(v) for v in values])
        tx.give_back()
        return pa.concat_tables([pa.table(p, schema=_LONGER_SCHEMA) for p in parts])

    return run


def _log_spelled(tree: Tree, spelled: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of each word's spelling."""
    at = tx.offsets_of(lengths)
    out = np.zeros(len(lengths))
    for low, high in tx.parts(at, tx.SLICE_BYTES // 4):
        flat, place, word = _spelling(spelled[at[low] : at[high]], lengths[low:high])
        out[low:high] = np.bincount(word, weights=np.log10(probabilities(tree, flat, place, 1)), minlength=high - low)
    return out


# --- words in context ------------------------------------------------------


@dataclass(frozen=True)
class Corpus:
    """What all parts know of the training texts: texts, tokens, distinct words, occurrences of infrequent ones, number of symbols and of those seen."""

    n_texts: int
    n_all: int
    n_words: int
    n_others: int
    n_symbols: int
    n_seen: int

    def counts(self, symbol: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol; ``count`` holds those of the words."""
        return np.where(symbol == END, self.n_texts, np.where((symbol == OTHER) | (symbol == UNKNOWN), self.n_others, count)).astype(float)

    def root(self, n: np.ndarray, options: Options) -> np.ndarray:
        """Probability of symbols seen ``n`` times after the empty context."""
        if self.n_all < options.word_count:
            return np.full(len(n), 1 / self.n_symbols)
        return options.discount * self.n_seen / self.n_all / self.n_symbols + np.maximum(n - options.discount, 0) / self.n_all


def _positions(block: Block, symbol: np.ndarray, predicted: np.ndarray, depth: int):
    """For all symbols but the first of a text: the symbols before it, last one first, and itself; its word (-1: the end); the text.

    Then the first symbol of each text, and its word.
    """
    lengths = block.n_words + 1
    at = tx.offsets_of(lengths)
    flat, seen, word = np.full(at[-1], END), np.full(at[-1], END), np.full(at[-1], -1)
    of_word = tx.ragged(at[:-1], block.n_words)
    flat[of_word], seen[of_word], word[of_word] = symbol[block.words], predicted[block.words], block.words
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(at[-1]) - at[text]
    later = np.flatnonzero(place >= 1)
    before = [np.where(place[later] >= d, flat[later - d], NONE) for d in range(1, depth + 1)]
    return [*before, seen[later]], word[later], text[later], seen[at[:-1]], word[at[:-1]]


def _deal_positions(n_parts: int, columns: list[np.ndarray], counts: np.ndarray, text: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each part the positions after its symbols, sorted, with their texts, and the counts of the distinct predicted symbols."""
    sizes = np.array([np.count_nonzero(~held), len(held)])
    part = columns[0] % n_parts
    for p in np.unique(part):
        here = np.flatnonzero(part == p)
        mine = [c[here] for c in columns]
        order = np.lexsort((text[here], *mine[::-1]))
        mine = [c[order] for c in mine]
        first = np.unique(mine[-1], return_index=True)[1]
        yield int(p), _squeeze(sizes, *_steps(mine), text[here][order], counts[here][order][first])


class _Positions:
    """The positions of a part, by cell, and their scores.

    The positions of a cell are sorted, so those after one context, or a run of contexts, are
    a slice of each cell.  Contexts are worked off in runs of about ``run`` positions; one with
    more of them is counted symbol by symbol, and the longer contexts that end with it again in runs.
    """

    def __init__(self, cells: list[bytes], corpus: Corpus, options: Options, run: int):
        self.options, self.run = options, run
        self.columns, self.texts, self.sizes, self.n_train, self.logs, symbols, counts = [], [], [], [], [], [], []
        for body in cells:
            (n_train, n_texts), *steps, text, count = _expand(body)
            columns = [r.astype(np.uint32) for r in _rows(steps)]
            self.columns.append(columns)
            self.texts.append(text.astype(np.uint32))
            self.sizes.append(int(n_texts))
            self.n_train.append(int(n_train))
            self.logs.append(np.zeros(len(text)))
            symbols.append(np.unique(columns[-1]))
            counts.append(count)
        self.symbols, first = np.unique(np.concatenate(symbols), return_index=True)
        n = corpus.counts(self.symbols, np.concatenate(counts)[first])
        p, up = corpus.root(n, options), n / max(corpus.n_all, 1)
        self._after([(k, 0, len(text)) for k, text in enumerate(self.texts)], 0, p, up)

    def _symbols(self, k: int, low: int, high: int) -> np.ndarray:
        """Numbers of the predicted symbols."""
        return np.searchsorted(self.symbols, self.columns[k][-1][low:high])

    def _after(self, slices: list[tuple[int, int, int]], d: int, p: np.ndarray, up: np.ndarray) -> bool:
        """Scores positions after one context of ``d`` symbols, as if it were a state that gives each symbol ``p``; whether a longer context is one.

        ``up`` is the share of each symbol after this context.
        """
        if d == self.options.word_depth:
            self._leave(slices, p)
            return False
        if sum(high - low for _, low, high in slices) <= self.run:
            return self._together(slices, d, p, up)
        found = [np.unique(self.columns[k][d][low:high], return_counts=True) for k, low, high in slices]
        contexts, of = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        sizes = np.bincount(of, weights=np.concatenate([f[1] for f in found])).astype(np.int64)
        large, run = sizes > self.run, np.cumsum(sizes) // self.run
        new = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | large[1:] | large[:-1]))
        longer = False
        for first, after in zip(new, np.append(new[1:], len(contexts))):
            some = []
            for k, low, high in slices:
                column = self.columns[k][d][low:high]
                i, j = low + np.searchsorted(column, contexts[first]), low + np.searchsorted(column, contexts[after - 1], "right")
                if i < j:
                    some.append((k, int(i), int(j)))
            if not large[first]:
                longer |= self._together(some, d, p, up)
            elif contexts[first] == NONE:
                self._leave(some, p)
            else:
                longer |= self._alone(some, d, p, up)
        return longer

    def _leave(self, slices: list[tuple[int, int, int]], p: np.ndarray) -> None:
        log = np.log10(p)
        for k, low, high in slices:
            self.logs[k][low:high] = log[self._symbols(k, low, high)]

    def _alone(self, slices: list[tuple[int, int, int]], d: int, p: np.ndarray, up: np.ndarray) -> bool:
        """Positions after one context of ``d + 1`` symbols; whether it is a state."""
        o, count = self.options, np.zeros(len(self.symbols))
        for k, low, high in slices:
            count += np.bincount(self._symbols(k, low, high)[self.texts[k][low:high] < self.n_train[k]], minlength=len(count))
        if len(unknown := np.flatnonzero(self.symbols == UNKNOWN)) and len(other := np.flatnonzero(self.symbols == OTHER)):
            count[unknown] = count[other]
        seen = (count > 0) & (self.symbols != UNKNOWN)
        total, kinds = count[self.symbols != UNKNOWN].sum(keepdims=True), seen.sum(keepdims=True)
        gain = _gains(np.where(seen, count, 0), np.zeros(len(count), np.int64), up, total, kinds, o.discount)[0]
        if total[0] < o.word_count:
            self._leave(slices, p)
            return False
        here = o.discount * kinds[0] / total[0] * p + np.maximum(count - o.discount, 0) / total[0]
        # a state needs its suffixes as states
        kept = self._after(slices, d + 1, here, count / total[0]) or gain >= o.divergence
        if not kept:
            self._leave(slices, p)
        return bool(kept)

    def _together(self, slices: list[tuple[int, int, int]], d: int, p: np.ndarray, up: np.ndarray) -> bool:
        """Positions after contexts of ``d`` symbols or more, one of which they share; whether a longer one is a state."""
        o, depth = self.options, self.options.word_depth
        symbol = np.concatenate([self._symbols(*part) for part in slices])
        train = np.concatenate([self.texts[k][low:high] < self.n_train[k] for k, low, high in slices])
        p, up = p[symbol], up[symbol]
        if len(unknown := np.flatnonzero(self.symbols == UNKNOWN)) and len(other := np.flatnonzero(self.symbols == OTHER)):
            symbol[symbol == unknown[0]] = other[0]
        at, of, levels = np.arange(len(symbol)), np.zeros(len(symbol), np.int64), []
        for level in range(d, depth):
            column = np.concatenate([self.columns[k][level][low:high] for k, low, high in slices])[at]
            far = column != NONE
            at, of, up, column = at[far], of[far], up[far], column[far]
            contexts, context = np.unique((of.astype(np.uint64) << np.uint64(32)) | column, return_inverse=True)
            pairs, first, pair = np.unique(context * len(self.symbols) + symbol[at], return_index=True, return_inverse=True)
            count, owner = np.bincount(pair, weights=train[at], minlength=len(pairs)), pairs // len(self.symbols)
            total = np.bincount(owner, weights=count, minlength=len(contexts))
            kinds = np.bincount(owner[count > 0], minlength=len(contexts))
            gain = _gains(count, owner, up[first], total, kinds, o.discount)
            kept = (total >= o.word_count) & (gain >= o.divergence)
            levels.append((at, context, pair, count, total, kinds, kept, (contexts >> np.uint64(32)).astype(np.int64)))
            of, up = context, count[pair] / np.maximum(total[context], 1)
        # a state needs its suffixes as states
        for (*_, kept, _), (*_, longer, suffix) in zip(levels[-2::-1], levels[:0:-1]):
            kept[suffix[longer]] = True
        alive = np.full(len(symbol), True)
        for at, context, pair, count, total, kinds, kept, _ in levels:
            on = alive[at] & kept[context]
            at, context, pair = at[on], context[on], pair[on]
            alive[:] = False
            alive[at] = True
            p[at] = o.discount * kinds[context] / total[context] * p[at] + np.maximum(count[pair] - o.discount, 0) / total[context]
        logs, done = np.log10(p), 0
        for k, low, high in slices:
            self.logs[k][low:high] = logs[done : done + high - low]
            done += high - low
        return bool(levels[0][6].any())


def _answer(corpus: Corpus, options: Options, apart: bool, run_tokens: int):
    """Counts, tests and scores all positions of a part; one cell for each block with the sums of its texts."""

    def run(cells: pa.Table) -> pa.Table:
        if cells.column("part")[0].as_py() < 0:
            return cells
        cells = _ordered(cells)
        scored = _Positions(cells.column("body").to_pylist(), corpus, options, run_tokens)
        rows = []
        for k, (part, block) in enumerate(zip(cells.column("part").to_pylist(), cells.column("block").to_pylist())):
            text, logs, size = scored.texts[k], scored.logs[k], scored.sizes[k]
            sums = [np.bincount(text, weights=logs, minlength=size)]
            if apart:
                sums.append(np.bincount(text, weights=np.where(scored.columns[k][-1] == UNKNOWN, logs, 0), minlength=size))
            rows.append((part, block, _squeeze(*sums)))
        del scored
        tx.give_back()
        return pa.Table.from_batches([_cells(rows)])

    return run


# --- scores ----------------------------------------------------------------


def scores(docs: DataFrame, held_out: Column, options: Options = Options(), apart: bool = False) -> DataFrame:
    """Score every document; those for which ``held_out`` is true teach nothing.

    ``apart`` adds ``unknown_score``, the part of ``score`` that is due to unknown words.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    blocks = durable(rows.mapInArrow(_blocks, _BLOCK), "blocks")
    size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("n_train")).first()
    n_parts = max(LEAST_PARTS, math.ceil(size.n_tokens / PART_TOKENS))
    n_texts = size.n_train

    dealt = blocks.select("block", "body").mapInArrow(_deal_words(n_parts), _CELLS).repartition(n_parts, "part")
    counted = durable(dealt.groupBy("part").applyInArrow(_count_words(options), _WORDS), "words")
    words = counted.where("block IS NULL").select("part", "body")
    sums = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once", "symbols", "kept", "bytes")]).first()
    n_all = sums.n + n_texts
    n_others = sums.n - sums.kept
    corpus = Corpus(n_texts, n_all, sums.v, n_others, sums.symbols + 2, sums.symbols + (n_others > 0) + (n_texts > 0))

    deep = options.byte_depth
    longer = None
    if deep > SHORT:
        least = max(2, options.byte_share * sums.bytes)
        windows = words.mapInArrow(_deal_spellings(deep, n_parts), _CELLS).repartition(n_parts, "part")
        longer = durable(windows.groupBy("part").applyInArrow(_spelling_states(deep, least, options), _LONGER), "tree-longer")
    spelled = words.mapInArrow(_spelling_counts(min(deep, SHORT)), _COUNT_SQL)
    spelling = spark.sparkContext.broadcast(grow(spelled, sums.bytes, BYTE_BITS, deep, 256, options.byte_share, options, longer))

    # What the discounts leave is shared: the part of words seen once goes to all unknown words together,
    # the rest to known words, and within both a word has its part by its spelling.
    spread = options.discount * sums.v / max(n_all, 1)
    unknown = min(sums.once / max(options.discount * sums.v, 1), 0.9) if sums.v else 1.0

    def spell(batches):
        for some in _known_words(batches):
            yield pa.RecordBatch.from_arrays([pa.array([float(np.power(10.0, _log_spelled(spelling.value, *some)).sum())])], names=["share"])

    spelled_known = words.mapInArrow(spell, "share double").agg(F.coalesce(F.sum("share"), F.lit(0.0))).first()[0]
    # an unknown word is not spelled like a known one, so its spelling is one among the others
    known_part = spread * (1 - unknown) / max(spelled_known, 1e-300)
    log_unknown = float(np.log10(max(spread * unknown, 1 / (n_all + 1)) / max(1 - spelled_known, 1e-9)))
    # the share of all words outside the frequent ones, to turn a word's probability into one among the others
    kept = (sums.kept - options.discount * sums.symbols) / max(n_all, 1)
    others = np.log10(max(1 - kept - n_texts / max(n_all, 1), spread, 1e-300))
    floor = np.log10(n_all + sums.v + (n_texts > 0) + 1)

    def ask(body: pa.Table, told: pa.Table) -> pa.Table:
        """The positions of a block for each part, and what is known of its texts without them."""
        if not body.num_rows:
            return _CELLS_SCHEMA.empty_table()
        block, name = Block.unpack(body.column("body")[0].as_py()), body.column("of_block")[0].as_py()
        part = block.parts(n_parts)
        c, number = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for p, answer in zip(told.column("part").to_pylist(), told.column("body").to_pylist()):
            here = np.flatnonzero(part == p)
            c[here], number[here] = _expand(answer)
        rare = c < options.word_count
        symbol = np.where(rare, OTHER, WORDS + number * n_parts + part)
        predicted = np.where(c > 0, symbol, UNKNOWN)
        logs, i = np.zeros(len(part)), np.flatnonzero(rare)
        log_spelled = _log_spelled(spelling.value, *block.spellings(i))
        p = np.maximum(c[i] - options.discount, 0) / max(n_all, 1) + known_part * np.power(10.0, log_spelled)
        logs[i] = np.minimum(np.where(c[i] > 0, np.log10(np.maximum(p, 1e-300)), log_spelled + log_unknown) - others, 0)

        columns, word, text, first, first_word = _positions(block, symbol, predicted, max(options.word_depth, 1))
        counts = np.append(c, 0)
        at = tx.offsets_of(block.n_words)
        own = tx.segment_sum(logs[block.words], at)
        own_unknown = tx.segment_sum(np.where(c > 0, 0, logs)[block.words], at)
        started = np.log10(corpus.root(corpus.counts(first, counts[first_word]), options))
        known = tx.segment_sum((c > 0)[block.words], at) + (n_texts > 0)
        base = tx.segment_sum((np.log10(c + 1.0) - floor)[block.words], at) + np.log10(n_texts + 1.0) - floor
        whole = _squeeze(
            block.ids.view(np.uint64), block.valid, block.held, block.n_words, known, base, own + started, own_unknown + np.where(first == UNKNOWN, started, 0)
        )
        # the texts go on by any part, marked by a number below 0
        rows = [(-1 - name % n_parts, name, whole)]
        rows += [(p, name, cell) for p, cell in _deal_positions(n_parts, columns, counts[word], text, block.held)]
        tx.give_back()
        return pa.Table.from_batches([_cells(rows)])

    bodies = blocks.select(F.col("block").alias("of_block"), "body").repartition(n_parts, "of_block")
    told = counted.where("block IS NOT NULL").select("block", "part", "body").repartition(n_parts, "block")
    asked = bodies.groupBy("of_block").cogroup(told.groupBy("block")).applyInArrow(ask, _CELLS)
    summed = asked.repartition(n_parts, "part").groupBy("part").applyInArrow(_answer(corpus, options, apart, RUN_TOKENS), _CELLS)

    result = RESULT.append(pa.field("unknown_score", pa.float64())) if apart else RESULT

    def add_up(cells: pa.Table) -> pa.Table:
        cells = _ordered(cells)
        whole, *bodies = cells.column("body").to_pylist()
        ids, valid, held, n_words, known, base, model, new = _expand(whole)
        for body in bodies:
            logs, *unknown_logs = _expand(body)
            model = model + logs
            if apart:
                new = new + unknown_logs[0]
        ids = pa.array(ids, mask=~valid.astype(bool))
        values = [ids, held.astype(bool), n_words + 1, known, np.full(len(ids), n_all), base, model, new]
        return pa.table([pa.array(v).cast(f.type) for v, f in zip(values, result)], schema=result)

    return summed.groupBy("block").applyInArrow(add_up, RESULT_SQL + (", unknown_score double" if apart else ""))
