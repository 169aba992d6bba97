import pytest
from pyspark.errors import PySparkException

from exprstudy.operators import cohort
from exprstudy.sources import tables

RNA = "IlluminaHiSeq_RNASeqV2"


def barcode(who, code="01A", tail="11R-A100-07"):
    return f"TCGA-AA-{who}-{code}-{tail}"


SAMPLES = [
    barcode("0001", tail="12R-A100-07"),  # later barcode of the same participant
    barcode("0001"),
    barcode("0002"),  # no annotation at all
    barcode("0003"),  # annotated for another platform only
    barcode("0004"),  # flagged
    barcode("0005", "11A"),  # normal tissue
    barcode("0006"),  # other cancer
]
QUALITY = [
    (barcode("0001", tail="12R-A100-07"), "BRCA", RNA, "False"),
    (barcode("0001"), " brca ", RNA, ""),
    (barcode("0001"), "BRCA", RNA, "no"),  # identical copy after cleaning
    (barcode("0003"), "BRCA", "OtherArray", "False"),
    (barcode("0004"), "BRCA", RNA, "True"),
    (barcode("0005", "11A"), "BRCA", RNA, "False"),
    (barcode("0006"), "GBM", RNA, "False"),
    ("", "BRCA", RNA, "False"),
]
NAMES = "`aliquot_barcode` string, `cancer type` string, platform string, `Do_not_use` string"


def frames(spark, quality=QUALITY):
    samples = spark.createDataFrame(list(enumerate(SAMPLES)), "matrix_index bigint, barcode string")
    return samples, tables.quality_records(spark.createDataFrame(quality, NAMES))


def test_golden_account(spark):
    samples, quality = frames(spark)
    manifest, exclusions = cohort.build(samples, quality)
    assert {r["reason"]: r["n"] for r in exclusions.collect()} == {
        "unmatched_quality": 2,
        "do_not_use": 1,
        "non_primary": 1,
        "non_target_cancer": 1,
        "duplicate_participant": 1,
    }
    rows = cohort.number_manifest(manifest).collect()
    assert [(r["cache_index"], r["matrix_index"], r["expression_barcode"]) for r in rows] == [(0, 1, SAMPLES[1])]
    assert rows[0]["sample_barcode"] == "TCGA-AA-0001-01" and rows[0]["cancer_type"] == "BRCA"


def test_summary_adds_up(spark):
    samples, quality = frames(spark)
    row = cohort.summary(cohort.classify(samples, quality)).first().asDict()
    assert row["n_expression_samples"] == 7 and row["n_selected"] == 1
    assert sum(v for k, v in row.items() if k != "n_expression_samples") == 7


def test_reasons_that_never_fire_are_zero(spark):
    samples, quality = frames(spark)
    only = samples.where("matrix_index = 1")
    counts = {r["reason"]: r["n"] for r in cohort.exclusion_counts(cohort.classify(only, quality)).collect()}
    assert len(counts) == 5 and set(counts.values()) == {0}


def test_targets_and_code_can_change(spark):
    samples, quality = frames(spark)
    reasons = {r["matrix_index"]: r["reason"] for r in cohort.classify(samples, quality, ["gbm"], primary_code="11").collect()}
    assert reasons[5] == "non_target_cancer" and reasons[6] == "non_primary"


def test_conflicting_annotations(spark):
    clash = [*QUALITY, (barcode("0001"), "LUAD", RNA, "no")]
    samples, quality = frames(spark, clash)
    assert [r[0] for r in cohort.quality_conflicts(quality).collect()] == [barcode("0001")]
    with pytest.raises(PySparkException, match="conflicting quality rows"):
        cohort.classify(samples, quality).collect()


def test_quality_reader_errors(spark):
    with pytest.raises(PySparkException, match="sample-level"):
        tables.quality_records(spark.createDataFrame([("TCGA-AA-0001", "BRCA", RNA, "no")], NAMES)).collect()
    with pytest.raises(PySparkException, match="invalid barcode"):
        tables.quality_records(spark.createDataFrame([("junk", "BRCA", RNA, "no")], NAMES)).collect()


def test_numbering_over_many_buckets(spark):
    from pyspark.sql import functions as F

    from exprstudy.functions.ranking import bucketed_row_number

    rows = spark.range(0, 5000, 7).select((F.col("id") * 13 % 5003).alias("matrix_index"))
    bucketed = rows.withColumn("b", F.floor(F.col("matrix_index") / 100))
    got = {r["matrix_index"]: r["n"] for r in bucketed_row_number(bucketed, "n", "b", [F.col("matrix_index")]).collect()}
    expected = {v: i + 1 for i, v in enumerate(sorted(got))}
    assert got == expected
