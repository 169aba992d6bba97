"""The labelled matrix: one row per sample with its features as ``ARRAY<FLOAT>``.

A matrix has ``cache_index, participant_barcode, cancer_type, features``.  The long
form has one row per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprstudy.constants import SPLITS
from exprstudy.functions.checks import fail_when, require_columns

ROW_COLUMNS = ("cache_index", "participant_barcode", "cancer_type")
CHUNK_GENES = 256


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def long_form(matrix: DataFrame, keep: Sequence[str] = ("cache_index",)) -> DataFrame:
    """One row per cell: the kept columns, ``gene_index`` and ``value``."""
    return matrix.select(*keep, F.posexplode("features").alias("gene_index", "value"))


def to_blocks(long: DataFrame, chunk_genes: int = CHUNK_GENES) -> DataFrame:
    """Sample-major blocks ``(cache_index, block, values ARRAY<FLOAT>)`` of ``chunk_genes`` genes.

    This is the transpose of the melt.  A group never holds more than one block.
    """
    if chunk_genes < 1:
        raise ValueError("chunk_genes must be >= 1")
    cell = F.struct("gene_index", "value")
    return (
        long.groupBy("cache_index", F.floor(F.col("gene_index") / chunk_genes).cast("int").alias("block"))
        .agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        .select("cache_index", "block", F.transform("cells", lambda c: c["value"]).alias("values"))
    )


def blocks_to_rows(blocks: DataFrame) -> DataFrame:
    """Join the blocks of a sample to its full feature row."""
    ordered = F.array_sort(F.collect_list(F.struct("block", "values")))
    return blocks.groupBy("cache_index").agg(F.flatten(F.transform(ordered, lambda b: b["values"])).alias("features"))


def build_matrix(long: DataFrame, samples: DataFrame, chunk_genes: int = CHUNK_GENES) -> DataFrame:
    """Long cells plus the sample table to the labelled matrix."""
    rows = blocks_to_rows(to_blocks(long, chunk_genes))
    return rows.join(samples.select(*ROW_COLUMNS), "cache_index").select(*ROW_COLUMNS, "features")


def cache_metadata(matrix: DataFrame) -> DataFrame:
    """One row ``(n_samples, n_genes, n_nonfinite_values)``, computed per row without exploding."""
    odd = F.size(F.filter("features", lambda v: ~is_finite(v)))
    return matrix.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.max(F.size("features")).cast("bigint").alias("n_genes"),
        F.coalesce(F.sum(odd), F.lit(0)).cast("bigint").alias("n_nonfinite_values"),
    )


def join_split(matrix: DataFrame, split: DataFrame, side: str) -> DataFrame:
    """Rows of one side of the split, with the manifest's labels.

    The side is chosen before the matrix is touched; a manifest index without a
    matrix row is refused.
    """
    require_columns(split, ["cache_index", "participant_barcode", "cancer_type", "split"], "split manifest")
    if side not in SPLITS:
        raise ValueError(f"unknown split {side!r}")
    chosen = split.where(F.col("split") == side).select(*ROW_COLUMNS)
    # reads the index column only
    lost = chosen.join(matrix.select("cache_index"), "cache_index", "left_anti").select("cache_index").limit(1).collect()
    if lost:
        raise ValueError(f"split manifest index outside the matrix: {lost[0][0]}")
    # an inner join lets Spark broadcast the manifest or shuffle by size, whichever side is larger
    return matrix.select("cache_index", "features").join(chosen, "cache_index").select(*ROW_COLUMNS, "features")


def development_matrix(matrix: DataFrame, split: DataFrame) -> DataFrame:
    """The only door to the rows a study may see."""
    return join_split(matrix, split, SPLITS[0])


def pair_filter(development: DataFrame, class_a: str, class_b: str, min_rows: int) -> DataFrame:
    """Rows of two classes; fails when either has fewer than ``min_rows``."""
    pair = development.where(F.col("cancer_type").isin(class_a, class_b))
    sizes = pair.groupBy("cancer_type").agg(F.count(F.lit(1)).alias("n"))
    enough = sizes.agg(F.count_if(F.col("n") >= min_rows).alias("classes")).withColumn("_k", F.lit(1))
    checked = pair.withColumn("_k", F.lit(1)).join(F.broadcast(enough), "_k")  # one row
    label = fail_when(
        F.col("classes") < 2, f"each class of a pair needs at least {min_rows} development samples", F.col("cancer_type")
    )
    return checked.withColumn("cancer_type", label).drop("_k", "classes")


def selected_matrix(long: DataFrame, selected: DataFrame) -> DataFrame:
    """Cells of the genes a fold selected: ``selected`` holds ``(eval_fold, gene_index)``."""
    return long.join(selected.select("eval_fold", "gene_index"), "gene_index")


def annotate(table: DataFrame, genes: DataFrame) -> DataFrame:
    """Add gene names by ``gene_index``."""
    return table.join(genes.select("gene_index", "source_gene_id", "symbol", "entrez_id"), "gene_index")
