"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exprstudy.llm import oracles

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(modulus: int):
    """crc32 of the document's id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query
def op1_suffix_tree_scores(spark, folder):
    from exprstudy.llm import suffixtree

    return suffixtree.scores(_table(spark, folder, "documents"), F.coalesce(remainder(7) == 2, F.lit(False)))


@query
def op2_near_duplicates(spark, folder):
    from exprstudy.llm import neardup

    return neardup.groups(_table(spark, folder, "documents"))


@query
def op3_layout_text(spark, folder):
    from exprstudy.llm import htmltext

    return htmltext.texts(_table(spark, folder, "pages"))


@query
def op4_permutation_search(spark, folder):
    from exprstudy.llm import permindex

    return permindex.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_pair_grammar(spark, folder):
    from exprstudy.llm import grammar

    return grammar.round_trip(_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), 2)


@query
def op6_piece_digests(spark, folder):
    from exprstudy.llm import pieces

    return pieces.digests(_table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


@query
def op7_line_alignment(spark, folder):
    from exprstudy.llm import linealign

    cut = linealign.without_blocks(_table(spark, folder, "documents"))
    return cut.select("doc_id", "n_lines", "n_deleted", "words_deleted", "text")


@query
def op8_byte_languages(spark, folder):
    from exprstudy.llm import langid

    return langid.predictions(_table(spark, folder, "documents"), F.coalesce(remainder(3) == 1, F.lit(False)))


@query
def op9_best_fit_packing(spark, folder):
    from exprstudy.llm import packing

    return packing.pack(packing.pieces(_table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), 2))


@query
def op10_quality_rules(spark, folder):
    from exprstudy.llm import quality

    return quality.verdicts(_table(spark, folder, "documents"))


@query
def op11_turn_repair(spark, folder):
    from exprstudy.llm import turnrepair

    return turnrepair.reports(turnrepair.damaged(_table(spark, folder, "conversations")))


@query
def op12_count_rtree_join(spark, folder):
    from exprstudy.llm import countrtree

    return countrtree.groups(_table(spark, folder, "documents"))


@query
def op13_lockstep_alignment(spark, folder):
    from exprstudy.llm import tokenalign

    return tokenalign.reports(_table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


ORACLES["op2_near_duplicates"] = oracles.linked_components(5, 75, kept=True)
ORACLES["op11_turn_repair"] = oracles.repaired_conversations()
ORACLES["op12_count_rtree_join"] = oracles.linked_components(3, 90, kept=False)
