"""A training-data pipeline over ``documents``: filter, deduplicate, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and gives what it reads back to the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exprstudy.llm import langid, linealign, neardup, packing, quality
from exprstudy.llm.catalogue import remainder, tokenizer
from exprstudy.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go."""
    learned = F.coalesce(remainder(3) != 1, F.lit(True))
    return langid.keep_identified(docs, learned)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later documents lose the blocks they share with earlier ones; a document that loses its last word goes."""
    # given columns with the names of the operator's counts step aside
    aside = {c: f"given {c}" for c in linealign.COUNTS if c in docs.columns}
    cut = linealign.without_blocks(docs.withColumnsRenamed(aside))
    emptied = (F.col("words_deleted") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = cut.where(~F.coalesce(emptied, F.lit(False))).drop(*linealign.COUNTS)
    kept = kept.withColumnsRenamed({there: c for c, there in aside.items()})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return kept.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return neardup.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json"), 2))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Language identification, line alignment and packing are not SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
