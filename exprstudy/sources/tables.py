"""Readers of delimited tables with explicit schemas, and their constraint reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exprstudy.constants import SPLITS
from exprstudy.functions.barcodes import barcode_struct, expand_compact, parse_bool
from exprstudy.functions.checks import duplicates, fail_when, find_columns, require_columns, violations

COHORT_COLUMNS = ("matrix_index", "expression_barcode", "participant_barcode", "cancer_type")
SAMPLE_COLUMNS = ("cache_index", *COHORT_COLUMNS)
SPLIT_COLUMNS = ("cache_index", "participant_barcode", "cancer_type", "split")
GENE_COLUMNS = ("gene_index", "source_gene_id", "symbol", "entrez_id")


#: Names that the columns of a quality table may bear; case and separators do not matter.
QUALITY_NAMES = {
    "aliquot": ("aliquot_barcode",),
    "class": ("cancer_type", "acronym"),
    "platform": ("platform",),
    "flag": ("do_not_use",),
}


def read_text_table(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A tab-separated table, every column text; typed casts follow and fail on junk."""
    table = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    return require_columns(table, required, path) if required else table


def quality_records(raw: DataFrame) -> DataFrame:
    """Typed quality rows from a raw text table with tolerant column names."""
    names = find_columns(raw.columns, QUALITY_NAMES)
    aliquot, cancer, platform, flag = (names[key] for key in QUALITY_NAMES)
    rows = raw.select(
        expand_compact(F.coalesce(raw[f"`{aliquot}`"], F.lit(""))).alias("aliquot_barcode"),
        F.upper(F.trim(F.coalesce(raw[f"`{cancer}`"], F.lit("")))).alias("cancer_type"),
        F.trim(F.coalesce(raw[f"`{platform}`"], F.lit(""))).alias("platform"),
        raw[f"`{flag}`"].alias("flag"),
    ).where("aliquot_barcode <> ''")
    parsed = rows.withColumn("parsed", barcode_struct(F.col("aliquot_barcode")))
    return parsed.select(
        "aliquot_barcode",
        fail_when(
            F.col("parsed.sample").isNull(),
            F.concat(F.lit("quality annotation lacks a sample-level barcode: "), F.col("aliquot_barcode")),
            F.col("parsed.sample"),
        ).alias("sample_barcode"),
        F.col("parsed.participant").alias("participant_barcode"),
        "cancer_type",
        "platform",
        parse_bool(F.col("flag")).alias("do_not_use"),
    )


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    return quality_records(read_text_table(spark, path))


def _label(name: str):
    return F.upper(F.trim(F.col(name))).alias(name)


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    raw = read_text_table(spark, path, COHORT_COLUMNS)
    return raw.select(F.col("matrix_index").cast("bigint"), *[_label(c) for c in COHORT_COLUMNS[1:]])


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    raw = read_text_table(spark, path, SAMPLE_COLUMNS)
    return raw.select(
        F.col("cache_index").cast("bigint"),
        F.col("matrix_index").cast("bigint"),
        *[_label(c) for c in SAMPLE_COLUMNS[2:]],
    )


def read_split(spark: SparkSession, path: str) -> DataFrame:
    raw = read_text_table(spark, path, SPLIT_COLUMNS)
    known = F.col("split").isin(*SPLITS)
    return raw.select(
        F.col("cache_index").cast("bigint"),
        "participant_barcode",
        "cancer_type",
        fail_when(~known, F.concat(F.lit("unknown split label: "), F.col("split")), F.col("split")).alias("split"),
    )


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    raw = read_text_table(spark, path, GENE_COLUMNS)
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in GENE_COLUMNS[1:]]
    return raw.select(F.col("gene_index").cast("int"), *text)


def manifest_checks(manifest: DataFrame, index: str = "matrix_index") -> DataFrame:
    """``(check, n_violations)``: non-empty, unique index, unique participant."""
    empty = manifest.agg((F.count(F.lit(1)) == 0).cast("bigint").alias("n_violations"))
    return (
        empty.select(F.lit("empty").alias("check"), "n_violations")
        .unionByName(violations(f"duplicate_{index}", duplicates(manifest, index)))
        .unionByName(violations("duplicate_participant", duplicates(manifest, "participant_barcode")))
    )


def split_domain_check(split: DataFrame) -> DataFrame:
    """Split labels outside the two known ones, with their row count."""
    unknown = F.col("split").isNull() | ~F.col("split").isin(*SPLITS)
    return split.where(unknown).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def gene_table_check(genes: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row telling whether gene indices run 0..n-1 and match the width of every matrix row."""
    table = genes.agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.min("gene_index").alias("lowest"),
        F.max("gene_index").alias("highest"),
        F.count_distinct("gene_index").alias("n_distinct"),
    ).withColumn("_k", F.lit(1))
    width = F.size("features")
    rows = matrix.agg(F.min(width).alias("narrowest"), F.max(width).alias("widest")).withColumn("_k", F.lit(1))
    contiguous = "n_genes > 0 AND lowest = 0 AND highest = n_genes - 1 AND n_distinct = n_genes"
    return table.join(rows, "_k").select(
        F.col("n_genes").cast("bigint").alias("n_genes"),
        F.expr(contiguous).alias("contiguous"),
        F.expr("narrowest = n_genes AND widest = n_genes").alias("matches_matrix"),
    )
