"""Near-duplicate groups by b-bit MinHash.

A document is the set of its 5-word shingles.  Its signature is the minimum of each of many
hash functions over the set.  Bands of whole minima give candidate buckets; of each minimum
only the low bits are kept, packed into longs, and the share of equal ones, corrected for
chance, estimates the similarity of candidates by bit counts.  What the estimate does not
rule out is confirmed on the full sets, computed from the texts.

Equal sets are one class from the start.  In a bucket no pairs are spelled out: members are
compared with a few leaders of the bucket, links join them into components, and only then
are members outside the main component of their bucket compared with the members of other
components there.  Pairs inside a component need no look, so no link between components is
lost.  Components are found by passing on the smallest id; every step is a written table.

Cases: a text without words (or null) has an empty set and is linked with nothing; fewer
than five words are one shingle; a null ``doc_id`` is linked with nothing and kept; rows
with one ``doc_id`` are one node; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprstudy.llm import textops as tx
from exprstudy.session import durable

SHINGLE = 5


@dataclass(frozen=True)
class Options:
    """With 32 bands of 4 a pair at 0.75 misses all buckets once in 200,000; it is estimated below 0.65 less often.

    The bands use the first ``bands * rows`` minima, the estimate all.
    """

    percent: int = 75
    bands: int = 32
    rows: int = 4
    minima: int = 512
    bits: int = 4
    least_estimate: float = 0.65
    leaders: int = 3
    tries: int = 2

    @property
    def longs(self) -> int:
        return self.minima * self.bits // 64


# --- sets and signatures ----------------------------------------------------


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and the offsets of the texts."""
    data, offsets = tx.buffer(texts)
    data = tx.LOWER[data]
    starts, _, at = tx.words(data, offsets)
    hashes = tx.hash_words(data, starts)
    n = np.diff(at)
    windows = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    first = tx.ragged(at[:-1], windows)
    text = np.repeat(np.arange(len(n)), windows)
    size = np.minimum(n, SHINGLE)[text]
    factors = tx.powers(SHINGLE + 1)
    key = size.astype(np.uint64)
    for k in range(SHINGLE):
        inside = k < size
        key[inside] += hashes[first[inside] + k] * factors[k + 1]
    key = tx.mix(key)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])) if len(key) else np.zeros(0, bool)
    key, text = key[new], text[new]
    return key, np.searchsorted(text, np.arange(len(n) + 1))


def signatures(sets: np.ndarray, at: np.ndarray, options: Options) -> np.ndarray:
    """One row of minima for each non-empty set."""
    starts = at[:-1][np.diff(at) > 0]
    k = options.minima
    rng = np.random.default_rng(7)
    factors, shifts = rng.integers(1, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)
    out = np.zeros((len(starts), k), np.uint32)
    if len(starts):
        x = (sets >> np.uint64(32)).astype(np.uint32)
        for i in range(k):
            out[:, i] = np.minimum.reduceat(x * factors[i] + shifts[i], starts)
    return out


def bands_of(minima: np.ndarray, options: Options) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    grouped = minima[:, : options.bands * options.rows].reshape(len(minima), options.bands, options.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(options.bands, dtype=np.uint64), grouped.shape[:2]).copy()
    for r in range(options.rows):
        key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key


def packed(minima: np.ndarray, options: Options) -> np.ndarray:
    """The low bits of the minima, mixed before since minima are small numbers, side by side in longs."""
    low = tx.mix(minima.astype(np.uint64)) & np.uint64((1 << options.bits) - 1)
    per_long = 64 // options.bits
    shifts = (np.arange(per_long) * options.bits).astype(np.uint64)
    return np.bitwise_or.reduce(low.reshape(len(low), options.longs, per_long) << shifts, axis=2)


_SKETCH = "doc_id bigint, n_shingles bigint, digest_a bigint, digest_b bigint, bands array<bigint>, signature array<bigint>"


def sketches(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Set size, digest of the set, band keys and packed signature of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tx.slices(batches, "text"):
            sets, at = shingle_sets(rows.column("text"))
            minima = signatures(sets, at, options)
            n = np.diff(at)
            filled = n > 0
            digests = [tx.segment_sum(tx.mix(sets ^ np.uint64(salt)).view(np.int64), at) for salt in (11, 12)]
            lists = []
            for values, width in ((bands_of(minima, options), options.bands), (packed(minima, options), options.longs)):
                lists.append(pa.ListArray.from_arrays(pa.array(tx.offsets_of(filled * width).astype(np.int32)), pa.array(values.reshape(-1).view(np.int64))))
            ids = rows.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), *(pa.array(d) for d in digests), *lists], names=[f.split(" ")[0] for f in _SKETCH.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCH)


def estimate(a: str, b: str, options: Options) -> Column:
    """Similarity of two packed signatures, corrected for equal low bits of different minima."""
    total = options.minima
    ones = sum(1 << i for i in range(0, 64, options.bits))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    differing = []
    for i in range(options.longs):
        x = f"({a}[{i}] ^ {b}[{i}])"
        shift = 1
        while shift < options.bits:
            x = f"({x} | shiftrightunsigned({x}, {shift}))"
            shift *= 2
        differing.append(f"bit_count({x} & {ones}L)")
    chance = 2.0**-options.bits
    return F.expr(f"((1 - ({' + '.join(differing)}) / {total}D) - {chance}D) / {1 - chance}D")


# --- links -------------------------------------------------------------------


def _confirmed(pairs: DataFrame, texts: DataFrame, options: Options) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(iter([batch]), "text_a", tx.SLICE_BYTES // 4):
                for rows in tx.slices(iter([part]), "text_b", tx.SLICE_BYTES // 4):
                    a, at_a = shingle_sets(rows.column("text_a"))
                    b, at_b = shingle_sets(rows.column("text_b"))
                    pair = np.concatenate([np.repeat(np.arange(rows.num_rows), np.diff(at)) for at in (at_a, at_b)])
                    key = np.concatenate([a, b])
                    order = np.lexsort((key, pair))
                    key, pair = key[order], pair[order]
                    same = (key[1:] == key[:-1]) & (pair[1:] == pair[:-1])
                    both = np.bincount(pair[1:][same], minlength=rows.num_rows)
                    union = np.diff(at_a) + np.diff(at_b) - both
                    linked = (100 * both >= options.percent * union) & (union > 0)
                    yield rows.select(["a", "b"]).filter(pa.array(linked))

    return both.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of all ends of ``(a, b)``: the smallest id reachable."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = durable(both, "edges")
    labels = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(seen.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        # follow the label to the label of that node
        above = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        moved = lower.join(above, "component").select("id", "old", F.least("component", "up").alias("component"))
        new = durable(moved, "labels")
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return labels


def _bucket_pairs(members: DataFrame, reps: DataFrame, options: Options) -> DataFrame:
    """The most similar leaders of each member, by estimate, as pairs ``(a, b)``."""
    orders = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id")).alias(f"l{i}") for i in range(1, options.leaders)]
    leaders = members.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("l0"), *orders).where("n > 1")
    leaders = leaders.select("band", F.array_distinct(F.array("l0", *(f"l{i}.id" for i in range(1, options.leaders)))).alias("leaders"))
    pairs = (
        members.join(leaders, "band")
        .select("id", F.explode("leaders").alias("leader"))
        .where("id <> leader")
        .distinct()
    )
    sides = reps.select("id", "n_shingles", "signature")
    rated = pairs.join(sides, "id").join(
        sides.select(F.col("id").alias("leader"), F.col("n_shingles").alias("n_leader"), F.col("signature").alias("leader_signature")), "leader"
    )
    rated = rated.withColumn("estimate", estimate("signature", "leader_signature", options))
    rated = rated.where(_sizes("n_shingles", "n_leader", options) & (F.col("estimate") >= options.least_estimate))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("estimate"), "leader"))
    return rated.withColumn("place", best).where(F.col("place") <= options.tries).select(*_ordered("id", "leader")).distinct()


def _sizes(a: str, b: str, options: Options) -> Column:
    return 100 * F.least(a, b) >= options.percent * F.greatest(a, b)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _shareable(texts: DataFrame) -> DataFrame:
    """``(id, shareable)``: how many shingles of each text are in another of these texts too, which bounds every intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tx.slices(batches, "text"):
            sets, at = shingle_sets(rows.column("text"))
            text = np.repeat(np.arange(rows.num_rows), np.diff(at))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(text)), pa.array(sets.view(np.int64))], names=["id", "shingle"])

    rows = texts.mapInArrow(run, "id bigint, shingle bigint")
    alone = rows.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    return alone.groupBy("id").agg(F.count("*").alias("alone"))


def _cross_pairs(members: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, options: Options) -> DataFrame:
    """Pairs of one bucket and different components; one of them is outside the bucket's main component.

    A pair is left out where sizes, the estimate, or the shingles that only one document
    of these buckets has, rule a link out.
    """
    labelled = members.join(labels, "id", "left").select("band", "band_no", "id", F.coalesce("component", "id").alias("component"))
    per = labelled.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = per.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rated = labelled.join(mixed.select("band", F.col("main.component").alias("main")), "band").join(reps.select("id", "n_shingles", "bands", "signature"), "id")
    rated = durable(rated, "mixed-buckets")
    alone = _shareable(texts.join(rated.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    rated = rated.join(alone, "id", "left").withColumn("shareable", F.col("n_shingles") - F.coalesce("alone", F.lit(0))).drop("alone")
    # who cannot share enough with anyone is out at once
    rated = durable(rated.where(100 * F.col("shareable") >= options.percent * F.col("n_shingles")), "linkable")
    stray = rated.where("component <> main").select("band", *(F.col(c).alias(f"{c}_s") for c in ("id", "component", "n_shingles", "bands", "signature", "shareable")))
    most = F.least("shareable_s", "shareable")
    held = (
        (F.col("stray.band") == F.col("any.band"))
        & (F.col("component_s") != F.col("component"))
        & ((F.col("component") == F.col("main")) | (F.col("id_s") < F.col("id")))
        & _sizes("n_shingles_s", "n_shingles", options)
        & (100 * most >= options.percent * (F.col("n_shingles_s") + F.col("n_shingles") - most))
        & (estimate("signature_s", "signature", options) >= options.least_estimate)
        # a pair comes from its first common bucket only
        & (F.array_position(F.zip_with("bands_s", "bands", lambda x, y: x == y), True) == F.col("band_no") + 1)
    )
    return stray.alias("stray").join(rated.alias("any"), held).select(*_ordered("id_s", "id"))


def groups(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document."""
    found = durable(sketches(docs, options), "sketches")
    filled = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("n_shingles", "digest_a", "digest_b").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    classes = durable(classes, "classes")
    reps = durable(
        filled.join(classes.select(F.col("id").alias("doc_id"), "digest_a", "digest_b", "n_shingles"), ["doc_id", "n_shingles", "digest_a", "digest_b"])
        .dropDuplicates(["doc_id", "digest_a", "digest_b"])
        .select(F.col("doc_id").alias("id"), "n_shingles", "bands", "signature"),
        "representatives",
    )
    exploded = reps.select("id", F.posexplode("bands").alias("band_no", "band"))
    shared = exploded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = durable(exploded.join(shared, "band"), "members")
    texts = docs.select("doc_id", "text").join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id")
    # a node with several rows is judged by the text of its representative row
    texts = durable(texts, "candidate-texts")

    first = durable(_bucket_pairs(members, reps, options), "leader-pairs")
    links = durable(_confirmed(first, texts, options), "leader-links")
    labels = components(links)
    rest = durable(_cross_pairs(members, labels, reps, texts, options).join(first, ["a", "b"], "left_anti"), "cross-pairs")
    more = durable(_confirmed(rest, texts, options), "cross-links")
    labels = components(labels.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more))

    named = classes.join(labels, "id", "left").select("n_shingles", "digest_a", "digest_b", F.coalesce("component", "id").alias("component_id"))
    rows = found.select("doc_id", "n_shingles", "digest_a", "digest_b").join(named, ["n_shingles", "digest_a", "digest_b"], "left")
    own = F.when((F.col("n_shingles") == 0) | F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_first(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """One document of each group: the one with the smallest id, and only once."""
    kept = groups(docs, options).where("kept").select("doc_id", "component_id")
    ids = kept.where("doc_id IS NOT NULL").select("doc_id").distinct()
    without = docs.where("doc_id IS NULL")
    return docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(without).select(docs.columns)
