"""Stability and direction of selected features across folds.

Coefficient tables are long: ``fold, class, gene_index, coefficient``, with one row
per class also for two-class models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coefficient_expand(binary: DataFrame, class_a: str, class_b: str) -> DataFrame:
    """One coefficient per gene to one per class: ``-c`` for the first class, ``c`` for the second."""
    sides = F.explode(
        F.array(
            F.struct(F.lit(class_a).alias("class"), (-F.col("coefficient")).alias("coefficient")),
            F.struct(F.lit(class_b).alias("class"), F.col("coefficient").alias("coefficient")),
        )
    ).alias("s")
    kept = [c for c in binary.columns if c != "coefficient"]
    return binary.select(*kept, sides).select(*kept, "s.class", "s.coefficient")


def feature_stability(coefficients: DataFrame, k: int, groups: Sequence[str] = ()) -> DataFrame:
    """Per gene: folds that selected it, frequency, and mean over those folds of the class-mean |coefficient|."""
    per_fold = coefficients.groupBy(*groups, "gene_index", "fold").agg(F.avg(F.abs("coefficient")).alias("strength"))
    return per_fold.groupBy(*groups, "gene_index").agg(
        F.count(F.lit(1)).alias("selected_folds"),
        (F.count(F.lit(1)) / F.lit(k)).alias("selection_frequency"),
        F.avg("strength").alias("mean_abs_coefficient"),
    )


def pair_gene_interpretation(coefficients: DataFrame, class_a: str, class_b: str, k: int, groups: Sequence[str] = ()) -> DataFrame:
    """Direction and sign consistency of each selected gene of a pair study, strongest first."""
    of = lambda name: F.when(F.col("class") == name, F.col("coefficient"))
    folds = F.count(of(class_b))
    up = F.count_if(of(class_b) > 0)
    down = F.count_if(of(class_b) < 0)
    summed = coefficients.groupBy(*groups, "gene_index").agg(
        folds.alias("selected_folds"),
        (folds / F.lit(k)).alias("selection_frequency"),
        F.avg(of(class_a)).alias("mean_coefficient_a"),
        F.avg(of(class_b)).alias("mean_coefficient_b"),
        F.coalesce(F.try_divide(F.greatest(up, down), up + down), F.lit(0.0)).alias("sign_consistency"),
    )
    direction = (
        F.when(F.col("mean_coefficient_b") > 0, class_b).when(F.col("mean_coefficient_b") < 0, class_a).otherwise("neutral")
    )
    strength = (F.abs("mean_coefficient_a") + F.abs("mean_coefficient_b")) / 2.0
    return summed.select(
        *groups,
        "gene_index",
        "selected_folds",
        "selection_frequency",
        "mean_coefficient_a",
        "mean_coefficient_b",
        strength.alias("mean_abs_coefficient"),
        direction.alias("direction"),
        "sign_consistency",
    ).orderBy(*groups, F.desc("selection_frequency"), F.desc("mean_abs_coefficient"), "gene_index")


def importance_aggregate(importances: DataFrame, k: int) -> DataFrame:
    """Mean importance over the folds that selected a gene, strongest first."""
    return (
        importances.groupBy("gene_index")
        .agg(
            F.count(F.lit(1)).alias("selected_folds"),
            (F.count(F.lit(1)) / F.lit(k)).alias("selection_frequency"),
            F.avg("importance").alias("mean_gain_importance"),
        )
        .orderBy(F.desc("mean_gain_importance"), "gene_index")
    )


def stability_histogram(selected: DataFrame, k: int) -> DataFrame:
    """How many genes were selected by exactly 1 .. k folds, with the share of the union."""
    folds = selected.groupBy("gene_index").agg(F.count_distinct("eval_fold").alias("selected_folds"))
    counts = folds.groupBy("selected_folds").agg(F.count(F.lit(1)).alias("n_genes"))
    total = counts.agg(F.sum("n_genes").alias("union_genes"))
    numbers = F.array(*[F.lit(i).cast("bigint") for i in range(1, k + 1)])
    every = total.select("union_genes", F.explode(numbers).alias("selected_folds"))
    return every.join(counts, "selected_folds", "left").select(
        "selected_folds",
        F.coalesce("n_genes", F.lit(0)).alias("n_genes"),
        F.coalesce(F.try_divide(F.col("n_genes"), F.col("union_genes")), F.lit(0.0)).alias("share_of_union"),
    )
