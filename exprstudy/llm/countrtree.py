"""N-gram Jaccard join with an R-tree over count vectors.

A document is the set of its 3-word shingles.  The shingles are hashed into groups; how many
fall into each group is a point, and the sum of the smaller coordinates of two points bounds
the overlap of the two sets from above.  A node of the tree keeps the largest coordinates and
the least set size of what is below it, so the same sum bounds the overlap of anything below
two nodes, and a descent leaves out what cannot reach the similarity.  What survives down to
the points is verified on the full sets.

The tree's first level is exact too.  Two sets of ``a`` and ``b`` shingles with a similarity
of at least 0.9 differ in at most ``d = (a + b) / 19`` shingles; cut by hash into more than
``d`` parts they agree in a whole part.  So documents are filed under each of their parts, by
its whole content, and only documents of one file can link.  Sizes are cut into classes
that say how many parts there are; a document is filed for its own class and, if a larger
partner may be there, for the next one.  A few spare parts more than needed leave empty parts
out of this, unless a document has more empty parts than spare ones: then it is filed under
them, too.

Equal sets are one class from the start.  Members of a file are first compared with two
leaders of it; links join them into components.  Files that still hold several components get
a tree: their members in the order of size and coordinates, in pages, pages under nodes.
Pages with members outside the main component descend it and meet only pages that may hold a
partner from another component.  So large groups of near copies make no pairs among
themselves, and no link between components is lost.  What is left of the square of a file is
the comparison of points that are close but not linked.

Cases: a null text or one without words has an empty set and is linked with nothing; fewer
than three words are one shingle; a null ``doc_id`` is linked with nothing; rows with one
``doc_id`` are one node, linked if one of its texts is; ties go to the smaller id; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprstudy.llm import textops as tx
from exprstudy.llm.neardup import components
from exprstudy.session import durable


@dataclass(frozen=True)
class Options:
    """Similarity in percent, words a shingle, coordinates of a point, points of a page and pages of a node."""

    percent: int = 90
    words: int = 3
    groups: int = 64
    page: int = 64
    fanout: int = 32

    def may_link(self, overlap, a, b):
        """Whether an overlap is enough for sets of these sizes; with a bound of the overlap, whether it may be."""
        return (100 + self.percent) * overlap >= self.percent * (a + b)

    def difference(self, a, b):
        """The most shingles in which two linked sets of these sizes differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def largest_partner(self, n):
        return n * 100 // self.percent


# --- sets, points and files ----------------------------------------------------------


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and the offsets of the texts."""
    data, offsets = tx.buffer(texts)
    data = tx.LOWER[data]
    starts, _, at = tx.words(data, offsets)
    hashes = tx.hash_words(data, starts)
    n = np.diff(at)
    windows = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    first = tx.ragged(at[:-1], windows)
    text = np.repeat(np.arange(len(n)), windows)
    size = np.minimum(n, width)[text]
    factors = tx.powers(width + 1)
    key = size.astype(np.uint64)
    for k in range(width):
        inside = k < size
        key[inside] += hashes[first[inside] + k] * factors[k + 1]
    key = tx.mix(key)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])) if len(key) else np.zeros(0, bool)
    key, text = key[new], text[new]
    return key, np.searchsorted(text, np.arange(len(n) + 1))


def points(sets: np.ndarray, at: np.ndarray, groups: int) -> np.ndarray:
    """How many shingles of each set fall into each group."""
    n_sets = len(at) - 1
    cell = np.repeat(np.arange(n_sets), np.diff(at)) * groups + (tx.mix(sets ^ np.uint64(1)) % np.uint64(groups)).astype(np.int64)
    return np.bincount(cell, minlength=n_sets * groups).reshape(n_sets, groups).astype(np.int32)


def size_classes(largest: int) -> np.ndarray:
    """The first size of each class; a class reaches to half as much again."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out)


def files(sets: np.ndarray, at: np.ndarray, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the files of each set, and the offsets of the sets."""
    n = np.diff(at)
    bounds = size_classes(options.largest_partner(int(n.max(initial=1))) + 1)
    bounds = np.append(bounds, bounds[-1] * 3 // 2 + 1)
    own = np.searchsorted(bounds, n, side="right") - 1
    mixed = tx.mix(sets)
    keys, owner = [], []
    for step in (0, 1):
        kind = np.maximum(own, 0) + step
        last = bounds[kind + 1] - 1
        most = options.difference(last, last)
        # sets that differ nowhere are one class already
        wanted = (n > 0) & (most > 0) & ((step == 0) | (options.largest_partner(n) >= bounds[kind]))
        spare = 1 + most // 16
        parts = np.where(wanted, most + 1 + spare, 0)
        begin = tx.offsets_of(parts)
        used = np.repeat(wanted, n)
        text = np.repeat(np.arange(len(n)), n)[used]
        salted = tx.mix(mixed[used] + kind[text].astype(np.uint64))
        part = ((salted >> np.uint64(32)) * parts[text].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        cell = begin[:-1][text] + part
        content = np.zeros(begin[-1], np.uint64)
        np.add.at(content, cell, mixed[used])
        size = np.bincount(cell, minlength=begin[-1])
        doc = np.repeat(np.arange(len(n)), parts)
        empties = np.bincount(doc[size == 0], minlength=len(n))
        filed = (size > 0) | (empties > spare)[doc]
        place = np.arange(begin[-1]) - begin[:-1][doc]
        key = tx.mix(content + size.astype(np.uint64)) + (kind[doc] << 32 | place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys.append(tx.mix(key)[filed])
        owner.append(doc[filed])
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return keys[order], np.searchsorted(owner[order], np.arange(len(n) + 1))


_SKETCH = "doc_id bigint, n_shingles bigint, digest_a bigint, digest_b bigint, keys array<bigint>, point array<int>"


def sketches(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Set size, digest of the set, keys of its files and point of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tx.slices(batches, "text"):
            sets, at = shingle_sets(rows.column("text"), options.words)
            digests = [tx.segment_sum(tx.mix(sets ^ np.uint64(salt)).view(np.int64), at) for salt in (11, 12)]
            keys, keys_at = files(sets, at, options)
            where = points(sets, at, options.groups)
            lists = [
                pa.ListArray.from_arrays(pa.array(keys_at.astype(np.int32)), pa.array(keys.view(np.int64))),
                pa.ListArray.from_arrays(pa.array((np.arange(len(at)) * options.groups).astype(np.int32)), pa.array(where.reshape(-1))),
            ]
            ids = rows.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), *(pa.array(d) for d in digests), *lists], names=[f.split(" ")[0] for f in _SKETCH.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCH)


# --- verification ------------------------------------------------------------------------


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _bound(a: str, b: str) -> Column:
    """The sum of the smaller coordinates."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def verified(pairs: DataFrame, texts: DataFrame, options: Options) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text_a", tx.SLICE_BYTES // 4):
            for rows in tx.slices(iter([part]), "text_b", tx.SLICE_BYTES // 4):
                (a, at_a), (b, at_b) = (shingle_sets(rows.column(c), options.words) for c in ("text_a", "text_b"))
                pair = np.concatenate([np.repeat(np.arange(rows.num_rows), np.diff(at)) for at in (at_a, at_b)])
                key = np.concatenate([a, b])
                order = np.lexsort((key, pair))
                key, pair = key[order], pair[order]
                shared = np.bincount(pair[1:][(key[1:] == key[:-1]) & (pair[1:] == pair[:-1])], minlength=rows.num_rows)
                sizes = np.diff(at_a) + np.diff(at_b)
                yield rows.select(["a", "b"]).filter(pa.array(options.may_link(shared, sizes, 0) & (sizes > 0)))

    return both.mapInArrow(run, "a bigint, b bigint")


def leader_pairs(members: DataFrame, reps: DataFrame, options: Options) -> DataFrame:
    """Members of each file with its leaders, where the points allow a link."""
    other = F.min(F.struct(F.xxhash64("id").alias("h"), "id"))
    leaders = members.groupBy("key").agg(F.min("id").alias("first"), other.alias("other"))
    pairs = members.join(leaders, "key").select("id", F.explode(F.array_distinct(F.array("first", "other.id"))).alias("leader"))
    pairs = pairs.where("id <> leader").select(*_ordered("id", "leader")).distinct()
    sides = [reps.select(*(F.col(c).alias(f"{c}_{s}") for c in ("n_shingles", "point")), F.col("id").alias(s)) for s in "ab"]
    rated = pairs.join(sides[0], "a").join(sides[1], "b")
    return rated.where(options.may_link(_bound("point_a", "point_b"), F.col("n_shingles_a"), F.col("n_shingles_b"))).select("a", "b").distinct()


# --- the tree -------------------------------------------------------------------------------


def mixed_files(members: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Members of files with several components: component, point, and whether they are outside the main one."""
    labelled = members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    per = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = per.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rows = labelled.join(mixed.select("key", F.col("main.component").alias("main")), "key")
    return rows.join(reps.select("id", "n_shingles", "point"), "id").select("key", "id", "component", "n_shingles", "point", (F.col("component") != F.col("main")).alias("stray"))


def _corner(options: Options, column: str) -> Column:
    return F.array(*(F.max(F.col(column)[g]) for g in range(options.groups)))


def leaves(entries: DataFrame, options: Options) -> DataFrame:
    """Pages of neighbouring points of each file, with their upper corners and least sizes."""
    order = Window.partitionBy("key").orderBy("stray", "n_shingles", "point", "id")
    numbered = entries.withColumn("node", ((F.row_number().over(order) - 1) / options.page).cast("int"))
    entry = F.struct("id", "component", "n_shingles", "point")
    return numbered.groupBy("key", "node").agg(
        F.collect_list(entry).alias("entries"), _corner(options, "point").alias("corner"), F.min("n_shingles").alias("least"), F.max("stray").alias("stray")
    )


def levels(pages: DataFrame, options: Options) -> list[DataFrame]:
    """The nodes of all levels, pages first; each file has one node on the last level."""
    out = [pages.select("key", "node", "corner", "least")]
    most = pages.agg(F.max("node")).first()[0] or 0
    while most > 0:
        below = out[-1].withColumn("node", (F.col("node") / options.fanout).cast("int"))
        out.append(durable(below.groupBy("key", "node").agg(_corner(options, "corner").alias("corner"), F.min("least").alias("least")), "nodes"))
        most //= options.fanout
    return out


def page_pairs(pages: DataFrame, options: Options) -> DataFrame:
    """``(key, asks, node)``: each page with strays and the pages that may hold a partner, found by descent."""
    tree = levels(pages, options)
    asking = pages.where("stray").select("key", F.col("node").alias("asks"), F.col("corner").alias("mine"), F.col("least").alias("my_least"))
    may = options.may_link(_bound("mine", "corner"), F.col("my_least"), F.col("least"))
    found = asking.join(tree[-1], "key").where(may).select("key", "asks", "mine", "my_least", "node")
    for level in tree[-2::-1]:
        below = level.withColumn("parent", (F.col("node") / options.fanout).cast("int"))
        found = durable(found.withColumnRenamed("node", "parent"), "frontier").join(below, ["key", "parent"]).where(may).select("key", "asks", "mine", "my_least", "node")
    # of two pages that both ask, the first one does
    stray = pages.select("key", "node", "stray")
    return found.join(stray, ["key", "node"]).where("NOT stray OR asks <= node").select("key", "asks", "node")


def tree_pairs(entries: DataFrame, options: Options) -> DataFrame:
    """Pairs of different components whose points allow a link."""
    pages = durable(leaves(entries, options), "pages")
    met = page_pairs(pages, options)
    sides = met.join(pages.select("key", F.col("node").alias("asks"), F.col("entries").alias("mine")), ["key", "asks"])
    sides = sides.join(pages.select("key", "node", "entries"), ["key", "node"]).select((F.col("asks") == F.col("node")).alias("own"), "mine", "entries")

    def unpack(column: pa.Array, row: int):
        one = column.slice(row, 1).flatten()
        ids, component, n = (one.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        return ids, component, n, one.field(3).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((2, 0), np.int64)]
            for row in range(batch.num_rows):
                a_ids, a_part, a_n, a_at = unpack(batch.column("mine"), row)
                b_ids, b_part, b_n, b_at = unpack(batch.column("entries"), row)
                near = a_part[:, None] != b_part
                near &= options.may_link(np.minimum(a_at[:, None], b_at).sum(axis=2, dtype=np.int64), a_n[:, None], b_n)
                if batch.column("own")[row].as_py():
                    near &= a_ids[:, None] < b_ids
                i, j = near.nonzero()
                found.append(np.stack([np.minimum(a_ids[i], b_ids[j]), np.maximum(a_ids[i], b_ids[j])]))
            # a pair of several files comes once from a batch
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return sides.mapInArrow(run, "a bigint, b bigint").distinct()


# --- the join ----------------------------------------------------------------------------------


def groups(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document."""
    found = durable(sketches(docs, options), "sketches")
    filled = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["n_shingles", "digest_a", "digest_b"]
    # equal sets have equal keys and points
    classes = filled.groupBy(*digest).agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("point").alias("point"))
    reps = durable(classes, "classes")
    posted = reps.select("id", F.explode("keys").alias("key")).distinct()
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = durable(posted.join(shared.hint("merge"), "key"), "members")
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    texts = durable(docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi"), "candidate-texts")

    first = durable(leader_pairs(members, reps, options), "leader-pairs")
    labels = components(durable(verified(first, texts, options), "leader-links"))
    entries = mixed_files(members, labels, reps)
    rest = durable(tree_pairs(entries, options).join(first, ["a", "b"], "left_anti"), "tree-pairs")
    more = durable(verified(rest, texts, options), "tree-links")
    labels = components(labels.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more))

    named = reps.join(labels, "id", "left").select(*digest, F.coalesce("component", "id").alias("component"))
    rows = found.select("doc_id", *digest).join(named, digest, "left")
    own = F.when((F.col("n_shingles") == 0) | F.col("component").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"))
