"""Data-quality profile of a matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprstudy.constants import AUDIT_PROBABILITIES, AUDIT_QUANTILE_NAMES
from exprstudy.operators.matrix import is_finite, long_form
from exprstudy.operators.quantiles import training_quantiles, training_weights


def partial_counters(matrix: DataFrame) -> DataFrame:
    """Counters of one block of rows; blocks merge by sum, min and max."""
    cells = long_form(matrix, keep=())
    value = F.col("value")
    finite = F.when(is_finite(value), value)
    return cells.agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count(finite).alias("n_finite"),
        F.count_if(finite < 0).cast("bigint").alias("n_negative"),
        F.count_if(finite == 0).cast("bigint").alias("n_zero"),
        F.min(finite).cast("double").alias("minimum"),
        F.max(finite).cast("double").alias("maximum"),
    )


def merge_counters(parts: DataFrame) -> DataFrame:
    """Merge block counters and derive the fractions (of finite values)."""
    sums = ["n_values", "n_finite", "n_negative", "n_zero"]
    merged = parts.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums],
        F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
    )
    floor = F.greatest(F.col("n_finite"), F.lit(1))
    return merged.select(
        "n_values",
        "n_finite",
        (F.col("n_values") - F.col("n_finite")).alias("n_nonfinite"),
        "n_negative",
        "n_zero",
        (F.col("n_negative") / floor).alias("negative_fraction"),
        (F.col("n_zero") / floor).alias("zero_fraction"),
        "minimum",
        "maximum",
    )


def counters(matrix: DataFrame) -> DataFrame:
    return merge_counters(partial_counters(matrix))


def shape(matrix: DataFrame) -> DataFrame:
    return matrix.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.max(F.size("features")), F.lit(0)).alias("n_columns")
    )


def _sampled_cells(matrix: DataFrame, shape_row: DataFrame, max_values: int) -> DataFrame:
    """Every stride-th cell in row-major order, picked by index: other cells are never exploded."""
    sized = shape_row.select(
        F.col("n_columns").cast("bigint").alias("n_columns"),
        F.greatest(F.lit(1), F.ceil(F.col("n_rows") * F.col("n_columns") / F.lit(max_values)))
        .cast("bigint")
        .alias("stride"),
        F.lit(1).alias("_k"),
    )
    rows = matrix.select("cache_index", "features", F.lit(1).alias("_k")).join(F.broadcast(sized), "_k")  # one row
    start: Column = F.pmod(-F.col("cache_index") * F.col("n_columns"), F.col("stride"))
    last = F.col("n_columns") - 1
    picks = F.when(start <= last, F.sequence(start, last, F.col("stride"))).otherwise(F.array().cast("array<bigint>"))
    position = F.explode(picks).alias("position")
    return rows.select("stride", "features", position).select(
        "stride", F.get("features", F.col("position").cast("int")).cast("double").alias("value")
    )


def _all_quantiles(matrix: DataFrame) -> DataFrame:
    """Exact quantiles of all finite cells, from counters of digits."""
    cells = matrix.select(F.explode("features").alias("value")).select(F.lit(0).alias("gene_index"), F.lit(-1).alias("fold"), "value")
    weighed = training_weights(cells.where(is_finite(F.col("value").cast("double"))), 1)
    found = training_quantiles(weighed, AUDIT_PROBABILITIES, 1).agg(F.first("q").alias("q"))
    return found.select(
        *[F.coalesce(F.col("q")[i], F.lit(float("nan"))).alias(n) for i, n in enumerate(AUDIT_QUANTILE_NAMES)],
        F.lit(True).alias("quantiles_exact"),
    )


def quantiles(matrix: DataFrame, max_values: int | None = None) -> DataFrame:
    """One row of exact quantiles of all finite cells, and whether it was all values.

    Only if ``max_values`` is given, every n-th cell is taken instead, so that no more than
    that many are read; ``cache_index`` must then be the 0-based row number.
    """
    if max_values is None:
        return _all_quantiles(matrix)
    if max_values < 1:
        raise ValueError("max_quantile_values must be >= 1")
    cells = _sampled_cells(matrix, shape(matrix), max_values)
    finite = F.when(is_finite(F.col("value")), F.col("value"))
    measured = cells.agg(
        F.percentile(finite, F.array(*[F.lit(p) for p in AUDIT_PROBABILITIES])).alias("q"),
        F.max("stride").alias("stride"),
    )
    return measured.select(
        *[F.coalesce(F.col("q")[i], F.lit(float("nan"))).alias(n) for i, n in enumerate(AUDIT_QUANTILE_NAMES)],
        (F.col("q").isNull() | (F.coalesce("stride", F.lit(1)) == 1)).alias("quantiles_exact"),
    )


def profile(matrix: DataFrame, max_values: int | None = None) -> DataFrame:
    """The full one-row audit: shape, counters and quantiles."""
    one = F.lit(1).alias("_k")
    parts = [shape(matrix), counters(matrix), quantiles(matrix, max_values)]
    keyed = [p.select("*", one) for p in parts]
    return keyed[0].join(keyed[1], "_k").join(keyed[2], "_k").drop("_k")
