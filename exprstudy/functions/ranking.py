"""Exact row numbers and rank cuts that never sort a whole class in one task.

A plain ``row_number() over (partition by class ...)`` sends every row of a class
to one task.  Here the order is first cut into buckets (a hash prefix, an index
range, or quantile bounds).  Counts per bucket are combined map-side and give
each bucket its offset; only rows of one bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(df: DataFrame, bucket: str, within: Sequence[str]) -> DataFrame:
    """Rows before each bucket; the table is one row per (group, bucket)."""
    counts = df.groupBy(*within, bucket).agg(F.count(F.lit(1)).alias("bucket_rows"))
    order = Window.partitionBy(*(within or [F.lit(0)])).orderBy(bucket)
    running = F.sum("bucket_rows").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("rows_before", running - F.col("bucket_rows"))


def bucketed_row_number(
    df: DataFrame, name: str, bucket: str, order: Sequence[Column], within: Sequence[str] = ()
) -> DataFrame:
    """Add the 1-based position of each row in the order (bucket, *order*), per ``within`` group."""
    keys = [*within, bucket]
    offsets = _offsets(df, bucket, list(within)).drop("bucket_rows")
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn(name, local)
        .join(offsets, keys)
        .withColumn(name, (F.col(name) + F.col("rows_before")).cast("bigint"))
        .drop("rows_before")
    )


def rank_cuts(df: DataFrame, ranks: DataFrame, group: str, key: str, bucket: str) -> DataFrame:
    """The keys at given 1-based ranks of each group, as ``(group, cuts ARRAY)``.

    ``ranks`` holds ``(group, rank)``.  ``bucket`` must be a prefix of ``key``: only
    the buckets that contain a wanted rank are ordered.
    """
    offsets = _offsets(df, bucket, [group])
    hit = (
        offsets.join(ranks, group)
        .where("rows_before < rank AND rank <= rows_before + bucket_rows")
        .select(group, bucket, (F.col("rank") - F.col("rows_before")).alias("local_rank"))
    )
    # a bucket is repeated once per wanted rank in it, which is rarely more than once
    order = Window.partitionBy(group, bucket, "local_rank").orderBy(key)
    edge = df.select(group, bucket, key).join(hit, [group, bucket]).withColumn("position", F.row_number().over(order))
    return (
        edge.where("position = local_rank").groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("cuts"))
    )


def index_bucket(index: Column, rows_per_bucket: int = 262_144) -> Column:
    """Bucket of a non-negative integer position, in position order."""
    return F.floor(index / F.lit(rows_per_bucket)).cast("bigint")


def quantile_bucket(df: DataFrame, value: str, name: str, n_buckets: int = 256) -> DataFrame:
    """Add an order-preserving bucket of ``value`` with about equal row counts.

    The bounds come from one sketch pass and are plain numbers afterwards, so
    every later use of the bucket agrees; any bounds give exact ranks, good bounds
    only balance the tasks.  Null and NaN go to the last bucket.
    """
    valid = df.select(value).where(F.col(value).isNotNull() & ~F.isnan(value))
    probabilities = [i / n_buckets for i in range(1, n_buckets)]
    bounds = sorted(set(valid.approxQuantile(value, probabilities, 1.0 / (4 * n_buckets))))
    splits = [float("-inf"), *[b for b in bounds if abs(b) != float("inf")], float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_bucket_value", outputCol=name, handleInvalid="keep")
    prepared = df.withColumn("_bucket_value", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))))
    return bucketizer.transform(prepared).drop("_bucket_value")
