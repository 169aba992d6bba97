"""Exact quantiles per gene and training fold by radix selection.

A value has an integer key of the same order, made of its exponent and fraction.  The first
pass counts the exponents of every gene; a wanted rank falls into one of them, and the next
pass counts the following digits of only those values that share it, until the values that
hold the rank are all equal.  A counter belongs to (gene, prefix, digit) and has one number
for each training fold, so one pass serves all folds and quantiles, and counters are added
up map-side: what moves is bounded by genes x wanted prefixes x digits, never a value.
Measurements kept as 32-bit floats need three passes, any 64-bit float at most six.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprstudy.session import durable

#: What is left of a key after each pass: 12 bits of sign and exponent, then 12 bits of the fraction at a time.
SHIFTS = (52, 40, 28, 16, 4, 0)

#: Wanted prefixes up to this many are sent to the tasks that hold the values (at 16 bytes each); more are joined by a shuffle.
BROADCAST_PREFIXES = 2_000_000


def training_weights(cells: DataFrame, k: int) -> DataFrame:
    """``(gene_index, value, t0 .. tk-1)``: whether each cell counts for the training rows of each fold."""
    outside = [(F.col("fold") != f).cast("bigint").alias(f"t{f}") for f in range(k)]
    return cells.select("gene_index", F.col("value").cast("double").alias("value"), *outside)


def equal_values(values: DataFrame, k: int) -> DataFrame:
    """``values`` with one row for all equal values of a gene, for measurements that repeat, as counts and prices do.

    Weights are added up map-side, so what moves is at most one row for each distinct value of a
    task, and every pass after it reads distinct values only.
    """
    return values.groupBy("gene_index", "value").agg(*(F.sum(f"t{f}").alias(f"t{f}") for f in range(k)))


def order_key(value: Column) -> Column:
    """A 64-bit integer in the order of finite doubles; equal values have equal keys.

    The powers of two and the division by them are exact, so no digit is lost.
    """
    size = F.abs(value)
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))
    power = F.pow(F.lit(2.0), guess)
    # the logarithm may be off by one next to a power of two
    exponent = F.greatest(F.when(size < power, guess - 1).when(size >= power * 2, guess + 1).otherwise(guess), F.lit(-1022))
    fraction = size / F.pow(F.lit(2.0), exponent)
    one = F.lit(float(1 << 52))
    normal = (exponent + 1023) * (1 << 52) + ((fraction - 1) * one).cast("bigint")
    bits = F.when(fraction >= 1, normal).otherwise((fraction * one).cast("bigint"))
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value < 0, -bits).otherwise(bits)


def _counters(rows: DataFrame, before: list[str], shift: int, k: int) -> DataFrame:
    """Weights of each digit after the prefix, those of all lower digits, and the range of values."""
    counts = [F.sum(f"t{f}").alias(f"t{f}") for f in range(k)]
    bins = rows.groupBy("gene_index", *before, F.shiftright("key", shift).alias("bin")).agg(
        *counts, F.min("value").alias("low"), F.max("value").alias("high")
    )
    order = Window.partitionBy("gene_index", *before).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    below = F.array(*(F.coalesce(F.sum(f"t{f}").over(order), F.lit(0)) for f in range(k)))
    return bins.select("gene_index", *before, "bin", "low", "high", F.array(*(F.col(f"t{f}") for f in range(k))).alias("here"), below.alias("below"))


def _placed(ranks: DataFrame, bins: DataFrame, on: list[str]) -> DataFrame:
    """Each rank with the digit that holds it, and what is left of the rank there."""
    here, below = (F.get(c, F.col("eval_fold")) for c in ("here", "below"))
    held = (F.col("left") >= below) & (F.col("left") < below + here)
    return ranks.join(bins, on).where(held).select(
        "gene_index", "eval_fold", "rank", (F.col("left") - below).alias("left"), F.col("bin").alias("prefix"), "low", "high"
    )


def training_quantiles(values: DataFrame, probabilities: Sequence[float], k: int) -> DataFrame:
    """``(eval_fold, gene_index, q ARRAY<DOUBLE>)`` over the values that count for each fold.

    ``values`` is like the output of :func:`training_weights`, also with larger weights, and is
    read once a pass.  Interpolation between neighbouring order statistics is linear.
    """
    keyed = values.select("gene_index", "value", *(f"t{f}" for f in range(k)), order_key(F.col("value")).alias("key"))
    bins = durable(_counters(keyed, [], SHIFTS[0], k), "digits")
    sizes = bins.groupBy("gene_index").agg(*(F.sum(F.col("here")[f]).alias(f"n{f}") for f in range(k)))
    folds = sizes.select("gene_index", F.posexplode(F.array(*(F.col(f"n{f}") for f in range(k)))).alias("eval_fold", "n")).where("n > 0")
    targets = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(t), F.ceil(t)) for t in targets))))
    ranks = folds.select("gene_index", "eval_fold", F.explode(wanted).alias("rank")).withColumn("left", F.col("rank"))
    state = durable(_placed(ranks, bins, ["gene_index"]), "ranks")
    done = [state.where("low = high")]
    for before, shift in zip(SHIFTS, SHIFTS[1:]):
        state = state.where("low < high")
        prefixes = durable(state.select("gene_index", "prefix").distinct(), "prefixes")
        n_prefixes = prefixes.count()
        if not n_prefixes:
            break
        small = F.broadcast(prefixes) if n_prefixes <= BROADCAST_PREFIXES else prefixes
        inside = keyed.withColumn("prefix", F.shiftright("key", before)).join(small, ["gene_index", "prefix"])
        bins = _counters(inside, ["prefix"], shift, k)
        state = durable(_placed(state.drop("low", "high"), bins, ["gene_index", "prefix"]), "ranks")
        done.append(state.where("low = high"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    held = found.groupBy("gene_index", "eval_fold").agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("at"))
    quantiles = []
    for t in targets:
        share = t - F.floor(t)
        lower, upper = F.col("at")[F.floor(t)], F.col("at")[F.ceil(t)]
        quantiles.append(F.when(share > 0, lower * (1 - share) + upper * share).otherwise(lower))
    return folds.join(held, ["gene_index", "eval_fold"]).select(F.col("eval_fold").cast("int").alias("eval_fold"), "gene_index", F.array(*quantiles).alias("q"))
