"""Wide measurement text: a header of sample barcodes, then one line per gene.

Lines are read as text (a schema with thousands of columns would not scale) and
carry ``(file, block, offset)``, so their file order survives splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exprstudy.functions.barcodes import barcode_struct, clean_barcode, gene_id_struct, parse_number, unquote
from exprstudy.functions.checks import duplicates, fail_when, violations
from exprstudy.functions.ranking import bucketed_row_number

BYTE_ORDER_MARK = "\ufeff"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_index, line)`` of the non-empty lines; the header has index 0."""
    lines = (
        spark.read.text(path)
        .select(
            F.concat_ws(
                ":", "_metadata.file_path", F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
            ).alias("_block"),
            F.monotonically_increasing_id().alias("_order"),
            F.rtrim("value", F.lit("\r\n")).alias("line"),
        )
        .where("line <> ''")
    )
    numbered = bucketed_row_number(lines, "line_index", "_block", [F.col("_order")])
    # a mark belongs to the encoding only where the text begins
    marked = (F.col("line_index") == 1) & F.col("line").startswith(BYTE_ORDER_MARK)
    line = F.when(marked, F.expr("substring(line, 2)")).otherwise(F.col("line"))
    return numbered.select((F.col("line_index") - 1).alias("line_index"), line.alias("line"))


def fields(line: Column) -> Column:
    return F.split(line, "\t", -1)


def header(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``(matrix_index, barcode)`` from the header line.

    ``strict`` fails on a first column other than gene_id, on an empty header, on a
    barcode that does not parse and on duplicates.
    """
    head = lines.where("line_index = 0").select(fields(F.col("line")).alias("raw"))
    if strict:
        short = "header must contain gene_id and at least one sample"
        head = head.where(fail_when(F.size("raw") < 2, short, F.lit(True)))
    cells = head.select(F.posexplode("raw").alias("position", "cell")).withColumn("cell", unquote(F.col("cell")))
    if strict:
        plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim("cell")), "[^a-z0-9]+", "_"), "^_+|_+$", "")
        wrong = (F.col("position") == 0) & (plain != "gene_id")
        message = F.concat(F.lit("expected gene_id as first column, found "), F.col("cell"))
        cells = cells.where(fail_when(wrong, message, F.lit(True)))
    barcodes = cells.where("position > 0").select(
        (F.col("position") - 1).cast("bigint").alias("matrix_index"), clean_barcode(F.col("cell")).alias("barcode")
    )
    if not strict:
        return barcodes
    # a header is one line of text, so its names meet in few tasks whatever the matrix size
    first = F.min("matrix_index").over(Window.partitionBy("barcode"))
    parsed = barcodes.select("matrix_index", "barcode", first.alias("first"), barcode_struct(F.col("barcode")).alias("p"))
    repeated = F.col("first") != F.col("matrix_index")
    message = F.concat(F.lit("duplicate column barcode: "), F.col("barcode"))
    return parsed.select("matrix_index", fail_when(repeated, message, F.col("p.raw")).alias("barcode"))


def scan_stats(lines: DataFrame) -> DataFrame:
    """One row ``(n_samples, n_genes)``; a table without a gene line is an error."""
    cells = F.when(F.col("line_index") == 0, F.size(fields(F.col("line"))) - 1)
    gene = (F.col("line_index") > 0) & (F.trim(F.translate("line", "\t", " ")) != "")
    counted = lines.agg(F.max(cells).cast("bigint").alias("n_samples"), F.count_if(gene).cast("bigint").alias("n_genes"))
    nothing = F.lit("the measurement table has a header but no gene line")
    return counted.select("n_samples", fail_when(F.col("n_genes") == 0, nothing, F.col("n_genes")).alias("n_genes"))


def gene_rows(lines: DataFrame) -> DataFrame:
    """``(gene_index, source_gene_id, values ARRAY<STRING>)`` of the gene lines, in file order."""
    cells = fields(F.col("line"))
    return lines.where("line_index > 0").select(
        (F.col("line_index") - 1).cast("int").alias("gene_index"),
        unquote(cells[0]).alias("source_gene_id"),
        F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))).alias("values"),
    )


def genes(rows: DataFrame) -> DataFrame:
    """Gene table ``(gene_index, source_gene_id, symbol, entrez_id)``."""
    parsed = gene_id_struct(F.col("source_gene_id"))
    return rows.select("gene_index", "source_gene_id", parsed["symbol"].alias("symbol"), parsed["entrez_id"].alias("entrez_id"))


def bad_rows(rows: DataFrame, n_samples: DataFrame) -> DataFrame:
    """Gene lines with a wrong value count or an unreadable value: ``(gene_index, n_values, n_unreadable)``.

    ``n_samples`` is the one-row table ``(n_samples)``.
    """
    unreadable = F.size(F.filter("values", lambda v: parse_number(v, strict=False).isNull()))
    checked = rows.select("gene_index", F.size("values").alias("n_values"), unreadable.alias("n_unreadable"))
    expected = n_samples.select("n_samples").withColumn("_k", F.lit(1))
    return (
        checked.withColumn("_k", F.lit(1))
        .join(F.broadcast(expected), "_k")  # one row
        .where("n_values <> n_samples OR n_unreadable > 0")
        .select("gene_index", "n_values", "n_unreadable")
    )


def melt(rows: DataFrame, cohort: DataFrame, n_samples: int) -> DataFrame:
    """Wide to long for the cohort's columns: ``(cache_index, gene_index, value FLOAT)``.

    Every line must have the header's ``n_samples`` values, no more and no fewer.

    ``cohort`` holds ``(matrix_index, cache_index)``.  Packed to one array it is no wider
    than one line, which bounds the broadcast; each line then picks its cells by
    position, so cells outside the cohort are never exploded, joined or parsed.
    """
    pick = F.struct(F.col("matrix_index").cast("int").alias("position"), F.col("cache_index").alias("cache_index"))
    packed = cohort.agg(F.array_sort(F.collect_list(pick)).alias("picks")).withColumn("_k", F.lit(1))
    joined = rows.withColumn("_k", F.lit(1)).join(F.broadcast(packed), "_k")
    wrong = F.size("values") != n_samples
    message = F.concat(F.lit("gene row has the wrong number of values: "), F.col("gene_index").cast("string"))
    cells = joined.select(
        fail_when(wrong, message, F.col("gene_index")).alias("gene_index"),
        F.explode(
            F.transform(
                "picks", lambda p: F.struct(p["cache_index"].alias("i"), F.get("values", p["position"]).alias("text"))
            )
        ).alias("c"),
    )
    return cells.select(F.col("c.i").alias("cache_index"), "gene_index", parse_number(F.col("c.text")).alias("value"))


def manifest_header_mismatch(cohort: DataFrame, header_barcodes: DataFrame) -> DataFrame:
    """Cohort rows whose index is out of range or names another barcode."""
    named = header_barcodes.select("matrix_index", F.col("barcode").alias("header_barcode"))
    problem = F.when(F.col("header_barcode").isNull(), "out_of_range").when(
        F.col("header_barcode") != F.col("expression_barcode"), "barcode_mismatch"
    )
    return (
        cohort.select("matrix_index", "expression_barcode")
        .join(named, "matrix_index", "left")
        .select("matrix_index", "expression_barcode", "header_barcode", problem.alias("problem"))
        .where("problem IS NOT NULL")
    )


def header_checks(barcodes: DataFrame) -> DataFrame:
    """``(check, n_violations)`` for a leniently read header."""
    parsed = barcodes.select(barcode_struct(F.col("barcode"), strict=False)["error"].alias("error"))
    return violations("duplicate_barcode", duplicates(barcodes, "barcode")).unionByName(
        violations("bad_barcode", parsed.where("error IS NOT NULL"))
    )
