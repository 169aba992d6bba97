"""Cohort building: match, exclude with an account, one row per participant."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprstudy.constants import EXCLUSION_REASONS, PRIMARY_SAMPLE_CODE, RNA_PLATFORM, TARGET_CLASSES
from exprstudy.functions.barcodes import barcode_struct, clean_barcode
from exprstudy.functions.checks import duplicates, fail_when, require_columns
from exprstudy.functions.ranking import bucketed_row_number, index_bucket
from exprstudy.session import durable

QUALITY_FIELDS = ("sample_barcode", "participant_barcode", "cancer_type", "do_not_use")
MANIFEST_COLUMNS = (
    "matrix_index",
    "expression_barcode",
    "sample_barcode",
    "participant_barcode",
    "sample_type_code",
    "cancer_type",
)


def _distinct_quality(quality: DataFrame, platform: str) -> DataFrame:
    """The different quality records per aliquot of one platform; copies collapse map-side."""
    require_columns(quality, ["aliquot_barcode", "platform", *QUALITY_FIELDS], "quality table")
    return quality.where(F.col("platform") == platform).select("aliquot_barcode", *QUALITY_FIELDS).distinct()


def quality_conflicts(quality: DataFrame, platform: str = RNA_PLATFORM) -> DataFrame:
    """Aliquots whose duplicate quality rows disagree (identical copies are fine)."""
    return duplicates(_distinct_quality(quality, platform), "aliquot_barcode").select("aliquot_barcode")


def classify(
    samples: DataFrame,
    quality: DataFrame,
    targets: Iterable[str] = TARGET_CLASSES,
    platform: str = RNA_PLATFORM,
    primary_code: str = PRIMARY_SAMPLE_CODE,
) -> DataFrame:
    """Each sample ``(matrix_index, barcode)`` with its first exclusion ``reason`` (null: candidate)."""
    require_columns(samples, ["matrix_index", "barcode"], "sample list")
    wanted = [target.upper() for target in targets]
    parsed = samples.select(
        F.col("matrix_index").cast("bigint").alias("matrix_index"),
        clean_barcode(F.col("barcode")).alias("expression_barcode"),
        barcode_struct(F.col("barcode")).alias("parsed"),
    )
    # the window sorts by the join key, so a large join reuses its order
    versions = F.count(F.lit(1)).over(Window.partitionBy("aliquot_barcode"))
    conflict = F.concat(F.lit("conflicting quality rows for aliquot "), F.col("aliquot_barcode"))
    known = (
        _distinct_quality(quality, platform)
        .withColumn("versions", versions)
        .select(
            fail_when(F.col("versions") > 1, conflict, F.col("aliquot_barcode")).alias("expression_barcode"),
            F.col("cancer_type"),
            F.col("do_not_use"),
        )
    )
    code = F.col("parsed.sample_type_code")
    reason = (
        F.when(F.col("do_not_use").isNull(), EXCLUSION_REASONS[0])
        .when(F.col("do_not_use"), EXCLUSION_REASONS[1])
        .when(code.isNull() | (code != primary_code), EXCLUSION_REASONS[2])
        .when(~F.coalesce(F.col("cancer_type").isin(*wanted), F.lit(False)), EXCLUSION_REASONS[3])
    )
    return parsed.join(known, "expression_barcode", "left").select(
        "matrix_index",
        "expression_barcode",
        F.col("parsed.sample").alias("sample_barcode"),
        F.col("parsed.participant").alias("participant_barcode"),
        F.col("parsed.sample_type_code").alias("sample_type_code"),
        "cancer_type",
        reason.alias("reason"),
    )


def unmatched_samples(samples: DataFrame, quality: DataFrame, platform: str = RNA_PLATFORM) -> DataFrame:
    known = quality.where(F.col("platform") == platform).select(F.col("aliquot_barcode").alias("barcode"))
    return samples.join(known, "barcode", "left_anti")


def select_participants(classified: DataFrame) -> DataFrame:
    """One candidate per participant: the smallest (barcode, matrix_index).

    A minimum combines map-side, so a participant with very many samples costs one
    partial row per task.
    """
    first = F.min(F.struct("expression_barcode", *[c for c in MANIFEST_COLUMNS if c != "expression_barcode"]))
    return (
        classified.where("reason IS NULL")
        .groupBy("participant_barcode")
        .agg(first.alias("chosen"), F.count(F.lit(1)).alias("choices"))
        .select(*[F.col(f"chosen.{c}").alias(c) for c in MANIFEST_COLUMNS], "choices")
    )


def exclusion_counts(classified: DataFrame) -> DataFrame:
    """``(reason, n)`` with a row for every reason, also the ones that never fired."""
    spark = classified.sparkSession
    # candidates are counted per participant, exclusions per reason, in one pass
    counted = classified.groupBy(
        "reason", F.when(F.col("reason").isNull(), F.col("participant_barcode")).alias("participant")
    ).agg(F.count(F.lit(1)).alias("n"))
    totals = (
        counted.select(
            F.coalesce("reason", F.lit(EXCLUSION_REASONS[4])).alias("reason"),
            F.when(F.col("reason").isNull(), F.col("n") - 1).otherwise(F.col("n")).alias("n"),
        )
        .groupBy("reason")
        .agg(F.sum("n").alias("n"))
    )
    every = spark.createDataFrame([(r,) for r in EXCLUSION_REASONS], "reason string")
    return every.join(totals, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def number_manifest(manifest: DataFrame) -> DataFrame:
    """Add ``cache_index``: 0-based position in matrix order.

    The manifest is written first, so the cohort is built once and not per branch.
    """
    bucketed = durable(manifest, "manifest").withColumn("_bucket", index_bucket(F.col("matrix_index")))
    numbered = bucketed_row_number(bucketed, "cache_index", "_bucket", [F.col("matrix_index")])
    return numbered.withColumn("cache_index", F.col("cache_index") - 1).drop("_bucket")


def build(
    samples: DataFrame,
    quality: DataFrame,
    targets: Iterable[str] = TARGET_CLASSES,
    platform: str = RNA_PLATFORM,
    primary_code: str = PRIMARY_SAMPLE_CODE,
) -> tuple[DataFrame, DataFrame]:
    """``(manifest, exclusions)``."""
    classified = classify(samples, quality, targets, platform, primary_code)
    return select_participants(classified).drop("choices"), exclusion_counts(classified)


def summary(classified: DataFrame) -> DataFrame:
    """One row: samples read, participants selected and the five exclusion counts."""
    counted = classified.groupBy(
        "reason", F.when(F.col("reason").isNull(), F.col("participant_barcode")).alias("participant")
    ).agg(F.count(F.lit(1)).alias("n"))
    def fired(reason):
        return F.coalesce(F.sum(F.when(F.col("reason") == reason, F.col("n"))), F.lit(0))

    candidate = F.col("reason").isNull()
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_expression_samples"),
        F.count_if(candidate).cast("bigint").alias("n_selected"),
        *[fired(reason).cast("bigint").alias(reason) for reason in EXCLUSION_REASONS[:4]],
        F.coalesce(F.sum(F.when(candidate, F.col("n") - 1)), F.lit(0)).cast("bigint").alias(EXCLUSION_REASONS[4]),
    )
