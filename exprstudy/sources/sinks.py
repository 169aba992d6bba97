"""Writing results: tables, one-row summaries and documents that may exist only once."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, text: bool = False) -> None:
    """Parquet (or tab-separated text); an existing target is refused."""
    writer = df.write.mode("errorifexists")
    if text:
        writer.csv(path, sep="\t", header=True, emptyValue="", nullValue="")
    else:
        writer.parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row (or small grouped) summary as JSON lines; an existing target is refused."""
    df.write.mode("errorifexists").json(path)


def write_gene_bucketed(long: DataFrame, table: str, buckets: int = 512) -> None:
    """Long cells bucketed and sorted by gene, for many gene-wise jobs over one matrix."""
    long.write.mode("errorifexists").bucketBy(buckets, "gene_index").sortBy("gene_index").saveAsTable(table)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def create_document(spark: SparkSession, path: str, payload: Mapping) -> None:
    """Create a JSON document; fails if it is there already (the file system decides, not a check)."""
    fs, target = _file_system(spark, path)
    try:
        stream = fs.create(target, False)
    except Exception as problem:
        if fs.exists(target):
            raise FileExistsError(f"refusing to overwrite {path}") from problem
        raise
    try:
        stream.write((json.dumps(payload, indent=2, sort_keys=True) + "\n").encode("utf-8"))
    finally:
        stream.close()


def read_document(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()  # one small document
    return json.loads(rows[0][0])
