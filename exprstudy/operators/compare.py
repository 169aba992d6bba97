"""Candidate evidence: parse, gate, rank.

An evidence document is one JSON text per row ``(evidence_file, document)``.  It
must declare a development-only scope, and has one of three shapes: a list of
models, one model with a list of budgets, or one benchmark record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exprstudy.constants import DEVELOPMENT_SCOPE
from exprstudy.functions.checks import assert_no_violations

_SUMMARY = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())])
_CANDIDATE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("gene_budget", T.StringType()),
        T.StructField("resolved_device", T.StringType()),
        T.StructField(
            "metrics",
            T.StructType([T.StructField("macro_f1", _SUMMARY), T.StructField("balanced_accuracy", _SUMMARY)]),
        ),
        T.StructField("wall_seconds", T.DoubleType()),
    ]
)
EVIDENCE_SCHEMA = T.StructType(
    [
        T.StructField("evaluation_scope", T.StringType()),
        T.StructField("holdout_used", T.BooleanType()),
        T.StructField("model", T.StringType()),
        T.StructField("models", T.ArrayType(_CANDIDATE)),
        T.StructField("budgets", T.ArrayType(_CANDIDATE)),
        T.StructField("benchmark", _CANDIDATE),
    ]
)


def read_evidence(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole JSON files as ``(evidence_file, document)``."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("evidence_file"), F.col("value").alias("document"))


def parse(evidence: DataFrame) -> DataFrame:
    return evidence.select("evidence_file", F.from_json("document", EVIDENCE_SCHEMA).alias("d"))


def gate(evidence: DataFrame) -> DataFrame:
    """Documents that may not be used: ``(evidence_file, problem)``."""
    d = parse(evidence)
    known = F.col("d.models").isNotNull() | F.col("d.benchmark").isNotNull() | (
        F.col("d.budgets").isNotNull() & F.col("d.model").isNotNull()
    )
    scope = F.col("d.evaluation_scope")
    problem = (
        F.when(scope.isNull() | (scope != DEVELOPMENT_SCOPE), "not_development_only")
        .when(F.col("d.holdout_used").isNull() | F.col("d.holdout_used"), "holdout_used")
        .when(~known, "unknown_shape")
    )
    return d.select("evidence_file", problem.alias("problem")).where("problem IS NOT NULL")


def assert_gate(evidence: DataFrame) -> None:
    bad = gate(evidence).groupBy("problem").agg(F.count(F.lit(1)).alias("n_violations"))
    assert_no_violations(bad.withColumnRenamed("problem", "check"))


def candidates(evidence: DataFrame) -> DataFrame:
    """One row per candidate of all documents, whatever their shape."""
    d = parse(evidence).select("evidence_file", "d.*")

    def rows(source: DataFrame, candidate_id) -> DataFrame:
        return source.select(
            F.concat_ws(":", *candidate_id).alias("candidate_id"),
            F.coalesce("c.model", F.lit("")).alias("model"),
            F.col("c.gene_budget").alias("gene_budget"),
            F.col("c.metrics.macro_f1.mean").alias("macro_f1_mean"),
            F.col("c.metrics.macro_f1.std").alias("macro_f1_std"),
            F.col("c.metrics.balanced_accuracy.mean").alias("balanced_accuracy_mean"),
            F.col("c.wall_seconds").alias("wall_seconds"),
            "evidence_file",
        )

    none = F.lit("None")
    models = d.where("models IS NOT NULL").select("evidence_file", F.explode("models").alias("c"))
    budgets = d.where("models IS NULL AND budgets IS NOT NULL AND model IS NOT NULL").select(
        "evidence_file", F.col("model").alias("fitted"), F.explode("budgets").alias("c")
    )
    single = d.where("models IS NULL AND (budgets IS NULL OR model IS NULL) AND benchmark IS NOT NULL").select(
        "evidence_file", F.col("benchmark").alias("c")
    )
    budget = F.coalesce("c.gene_budget", none)
    return (
        rows(models, [F.lit("classical"), F.coalesce("c.model", F.lit("unknown"))])
        .unionByName(rows(budgets, [F.lit("feature-budget"), F.col("fitted"), budget]))
        .unionByName(rows(single, [F.lit("xgboost"), F.coalesce("c.resolved_device", none), budget]))
    )


def rank(found: DataFrame) -> DataFrame:
    """Rank by mean macro F1 (ties by id).  Candidates are a list of model configurations; no winner is chosen."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("macro_f1_mean"), "candidate_id")
    return found.withColumn("rank_by_macro_f1", F.row_number().over(order))


def compare(evidence: DataFrame) -> DataFrame:
    """Gate, then rank; a document that touched the holdout fails the comparison."""
    assert_gate(evidence)
    return rank(candidates(evidence))


def in_fold_order(value: str) -> Column:
    """The sum of a candidate's few folds, added up in their order, so that it never differs in its last digits."""
    listed = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("fold", F.col(value).alias("v")))))
    return F.when(F.count(value) > 0, F.aggregate(listed, F.lit(0.0), lambda total, x: total + x["v"]))


def tradeoff(fold_metrics: DataFrame, walls: DataFrame) -> DataFrame:
    """Per candidate: metric gap to the best, folds won against it, and cost ratio.

    ``fold_metrics`` is ``(candidate_id, fold, value)``, ``walls`` ``(candidate_id, wall_seconds)``.
    """
    means = fold_metrics.groupBy("candidate_id").agg((in_fold_order("value") / F.count("value")).alias("mean"))
    # largest mean, earliest id: the minimum of (-mean, id)
    best = means.agg(F.min(F.struct((-F.col("mean")).alias("m"), F.col("candidate_id").alias("candidate_id"))).alias("b"))
    leader = best.select(F.col("b.candidate_id").alias("candidate_id"))
    lead = (
        fold_metrics.join(F.broadcast(leader), "candidate_id", "left_semi")  # one row
        .select("fold", F.col("value").alias("best_value"))
    )
    wins = (
        fold_metrics.join(lead, "fold")
        .groupBy("candidate_id")
        .agg(
            (in_fold_order("value") / F.count("value")).alias("mean"),
            F.count_if(F.col("value") > F.col("best_value")).cast("bigint").alias("folds_won"),
            (in_fold_order("best_value") / F.count("best_value")).alias("best_mean"),
        )
    )
    lead_wall = walls.join(F.broadcast(leader), "candidate_id", "left_semi").select(
        F.col("wall_seconds").alias("best_wall"), F.lit(1).alias("_k")
    )
    return (
        wins.join(walls, "candidate_id")
        .withColumn("_k", F.lit(1))
        .join(F.broadcast(lead_wall), "_k", "left")  # one row
        .select(
            "candidate_id",
            "mean",
            (F.col("mean") - F.col("best_mean")).alias("gap_to_best"),
            "folds_won",
            F.try_divide(F.col("wall_seconds"), F.col("best_wall")).alias("cost_ratio"),
        )
    )


def hardest_first(study_metrics: DataFrame) -> DataFrame:
    """Study results with the lowest macro F1 first; one row per (pair, model), so the list is short."""
    order = Window.partitionBy(F.lit(0)).orderBy("macro_f1", "pair", "model")
    return study_metrics.withColumn("position", F.row_number().over(order))


def run_speedup(runs: DataFrame) -> DataFrame:
    """Speed-up of each run over the first cpu run of the log; null for a wall time of zero or less.

    The baseline is found with a minimum, so the log is never sorted in one task.
    """
    first_cpu = runs.where("device = 'cpu'").agg(F.min(F.struct("run", "wall_seconds")).alias("b"))
    baseline = first_cpu.select(F.col("b.wall_seconds").alias("baseline_seconds"), F.lit(1).alias("_k"))
    speedup = F.when(F.col("wall_seconds") > 0, F.col("baseline_seconds") / F.col("wall_seconds"))
    return (
        runs.withColumn("_k", F.lit(1))
        .join(F.broadcast(baseline), "_k")  # one row
        .select("run", "device", "wall_seconds", speedup.alias("speedup_vs_first_cpu"))
    )
