import math

import pytest
from pyspark.errors import PySparkException

from exprstudy.operators import cohort, matrix
from exprstudy.sources import sinks, tables, wide_text

B = [f"TCGA-AA-000{i}-01A-01R-A001-07" for i in range(3)]
TEXT = (
    "﻿gene_id\t" + "\t".join([B[0], f'"{B[1].lower()}"', B[2]]) + "\n"
    "?|100\t1.5\tNA\t-0.25\n"
    "\n"
    '"TP53|7157"\t\t2\tnan\r\n'
    "SOLO\t3\t4\t5\n"
)


@pytest.fixture
def lines(spark, tmp_path):
    path = tmp_path / "wide.tsv"
    path.write_text(TEXT, encoding="utf-8")
    return wide_text.read_lines(spark, str(path))


def test_header_and_stats(lines):
    assert [(r[0], r[1]) for r in wide_text.header(lines).orderBy("matrix_index").collect()] == list(enumerate(B))
    assert tuple(wide_text.scan_stats(lines).first()) == (3, 3)


def test_gene_order_and_ids(lines):
    rows = wide_text.genes(wide_text.gene_rows(lines)).orderBy("gene_index").collect()
    assert [(r["gene_index"], r["source_gene_id"], r["symbol"], r["entrez_id"]) for r in rows] == [
        (0, "?|100", "?", "100"),
        (1, "TP53|7157", "TP53", "7157"),
        (2, "SOLO", "SOLO", ""),
    ]


def test_melt_picks_columns_and_transposes(spark, lines):
    picked = spark.createDataFrame([(2, 0, "P2", "A"), (0, 1, "P0", "B")], "matrix_index bigint, cache_index bigint, participant_barcode string, cancer_type string")
    long = wide_text.melt(wide_text.gene_rows(lines), picked, 3)
    for chunk in (1, 2, 256):
        built = {r["cache_index"]: list(r["features"]) for r in matrix.build_matrix(long, picked, chunk).collect()}
        assert built[0][0] == -0.25 and math.isnan(built[0][1]) and built[0][2] == 5.0
        assert built[1][0] == 1.5 and math.isnan(built[1][1]) and built[1][2] == 3.0
    meta = matrix.cache_metadata(matrix.build_matrix(long, picked)).first()
    assert tuple(meta) == (2, 3, 2)


def test_bad_rows_are_named(spark, tmp_path):
    path = tmp_path / "bad.tsv"
    path.write_text("gene_id\t" + "\t".join(B) + "\nA\t1\t2\nB\t1\t2\t3\nC\t1\tx\t3\nD\n", encoding="utf-8")
    lines = wide_text.read_lines(spark, str(path))
    rows = wide_text.gene_rows(lines)
    bad = {tuple(r) for r in wide_text.bad_rows(rows, wide_text.scan_stats(lines)).collect()}
    assert bad == {(0, 2, 0), (2, 3, 1), (3, 0, 0)}
    everyone = spark.createDataFrame([(0, 0)], "matrix_index bigint, cache_index bigint")
    with pytest.raises(PySparkException, match="wrong number of values"):
        wide_text.melt(rows, everyone, 3).collect()


def test_header_errors(spark, tmp_path):
    def header_of(text):
        path = tmp_path / f"h{abs(hash(text))}.tsv"
        path.write_text(text, encoding="utf-8")
        return wide_text.header(wide_text.read_lines(spark, str(path))).collect()

    with pytest.raises(PySparkException, match="expected gene_id"):
        header_of(f"gene\t{B[0]}\n")
    with pytest.raises(PySparkException, match="at least one sample"):
        header_of("gene_id\n")
    with pytest.raises(PySparkException, match="duplicate column"):
        header_of(f"gene_id\t{B[0]}\t{B[0].lower()}\n")
    with pytest.raises(PySparkException, match="invalid barcode"):
        header_of("gene_id\tnonsense\n")
    assert len(header_of(f"Gene ID\t{B[0]}\n")) == 1


def test_line_order_survives_splits(spark, tmp_path):
    path = tmp_path / "long.tsv"
    path.write_text("gene_id\t" + B[0] + "\n" + "".join(f"G{i}|{i}\t{i}\n" for i in range(3000)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = wide_text.read_lines(spark, str(path))
        rows = wide_text.gene_rows(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["gene_index"], r["source_gene_id"]) for r in rows) == [(i, f"G{i}|{i}") for i in range(3000)]


def test_manifest_against_header(spark, lines):
    manifest = spark.createDataFrame([(0, B[0]), (1, B[2]), (9, B[1])], "matrix_index bigint, expression_barcode string")
    found = {r["matrix_index"]: r["problem"] for r in wide_text.manifest_header_mismatch(manifest, wide_text.header(lines)).collect()}
    assert found == {1: "barcode_mismatch", 9: "out_of_range"}


def test_tables_round_trip(spark, tmp_path):
    manifest = spark.createDataFrame([(0, 4, B[0], "p0", "a")], "cache_index bigint, matrix_index bigint, expression_barcode string, participant_barcode string, cancer_type string")
    target = str(tmp_path / "samples")
    sinks.write_table(manifest, target, text=True)
    assert tuple(tables.read_samples(spark, target).first()) == (0, 4, B[0], "P0", "A")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_table(manifest, target, text=True)
    with pytest.raises(ValueError, match="must contain"):
        tables.read_split(spark, target)
    parquet = str(tmp_path / "m")
    sinks.write_table(manifest, parquet)
    assert spark.read.parquet(parquet).count() == 1


def test_split_reader_refuses_unknown_labels(spark, tmp_path):
    path = tmp_path / "split.tsv"
    path.write_text("cache_index\tparticipant_barcode\tcancer_type\tsplit\n0\tP\tA\ttrain\n", encoding="utf-8")
    with pytest.raises(PySparkException, match="unknown split label"):
        tables.read_split(spark, str(path)).collect()


def test_manifest_and_gene_checks(spark):
    manifest = spark.createDataFrame([(0, "P"), (0, "Q"), (1, "Q")], "matrix_index bigint, participant_barcode string")
    found = {r["check"]: r["n_violations"] for r in tables.manifest_checks(manifest).collect()}
    assert found == {"empty": 0, "duplicate_matrix_index": 1, "duplicate_participant": 1}
    assert cohort.number_manifest(spark.createDataFrame([(5,), (2,)], "matrix_index bigint")).orderBy("cache_index").collect()[0][0] == 2
    genes = spark.createDataFrame([(0,), (2,)], "gene_index int")
    rows = spark.createDataFrame([([1.0, 2.0],)], "features array<float>")
    assert tuple(tables.gene_table_check(genes, rows).first()) == (2, False, True)


def test_a_table_without_gene_lines_is_an_error(spark):
    lines = spark.createDataFrame([(0, "gene_id\tTCGA-AA-0001-01A"), (1, " \t")], "line_index bigint, line string")
    with pytest.raises(PySparkException, match="no gene line"):
        wide_text.scan_stats(lines).collect()


def test_gene_buckets_need_no_shuffle(spark):
    """A bucketed matrix is aggregated by gene without an exchange, holds all cells, and is not overwritten."""
    name = "gene_buckets_of_a_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    long = spark.createDataFrame([(i % 7, i, float(i)) for i in range(200)], "gene_index int, cache_index bigint, value double")
    sinks.write_gene_bucketed(long, name, 4)
    try:
        summed = spark.table(name).groupBy("gene_index").sum("value")
        assert "Exchange" not in summed._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in summed.collect()} == {(g, float(sum(range(g, 200, 7)))) for g in range(7)}
        with pytest.raises(PySparkException):
            sinks.write_gene_bucketed(long, name, 4)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
