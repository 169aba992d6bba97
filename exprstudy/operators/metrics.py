"""Evaluation tables from predictions.

Predictions have ``cache_index, fold, true_label, predicted_label`` and, where a
model has scores, ``scores ARRAY<DOUBLE>`` in class order.  Counts are combined
map-side to class by class cells, and every metric derives from those cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprstudy.constants import LOG_LOSS_EPS
from exprstudy.functions.ranking import quantile_bucket
from exprstudy.session import durable

OVERALL = ("macro_f1", "weighted_f1", "balanced_accuracy", "accuracy")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def confusion_counts(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*groups, "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


def confusion_grid(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Every true by predicted cell with its count and share of the true row (zero-filled).

    The grid is spanned by the labels themselves: each label's partner list is an
    array, so no join of rows is needed.
    """
    counts = confusion_counts(predictions, groups)
    labels = counts.groupBy(*groups).agg(
        F.array_sort(F.array_union(F.collect_set("true_label"), F.collect_set("predicted_label"))).alias("labels")
    )
    grid = labels.select(*groups, F.explode("labels").alias("true_label"), "labels").select(
        *groups, "true_label", F.explode("labels").alias("predicted_label")
    )
    row = Window.partitionBy(*groups, "true_label")
    filled = grid.join(counts, [*groups, "true_label", "predicted_label"], "left").select(
        *groups, "true_label", "predicted_label", F.coalesce("n", F.lit(0)).alias("n")
    )
    return filled.withColumn("row_fraction", _ratio(F.col("n"), F.sum("n").over(row)))


def per_class(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; an empty denominator gives 0."""
    counts = confusion_counts(predictions, groups)
    hit = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)
    sides = F.explode(
        F.array(
            F.struct(F.col("true_label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"), hit.alias("hits")),
            F.struct(F.col("predicted_label").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hits")),
        )
    ).alias("s")
    totals = (
        counts.select(*groups, sides)
        .groupBy(*groups, F.col("s.class").alias("class"))
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "called", "hits")])
    )
    return totals.select(
        *groups,
        "class",
        _ratio(F.col("hits"), F.col("called")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("called") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )


def overall(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Macro F1 (labels seen on either side), weighted F1, balanced accuracy (true classes), accuracy."""
    classes = per_class(predictions, groups)
    recall_of_true = F.when(F.col("support") > 0, F.col("recall"))
    return classes.groupBy(*groups).agg(
        F.avg("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg(recall_of_true).alias("balanced_accuracy"),
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("n_samples"),
        (F.sum("support") - F.sum("hits")).alias("n_errors"),
    )


def metric_summary(fold_metrics: DataFrame, keys: Sequence[str], names: Sequence[str] = OVERALL) -> DataFrame:
    """Long fold metrics to ``(keys, metric, mean, std, fold_values)``; std is the population one."""
    long = fold_metrics.unpivot([*keys, "fold"], list(names), "metric", "value")
    return summarise_folds(long, [*keys, "metric"])


def summarise_folds(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("fold", "value")))
    return long.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.transform(ordered, lambda v: v["value"]).alias("fold_values"),
    )


def log_loss(predictions: DataFrame, classes: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Mean of ``-ln p(true)`` with the probability clipped away from 0 and 1."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("true_label"))
    p = F.get("scores", (position - 1).cast("int"))
    clipped = F.greatest(F.least(p, F.lit(1.0 - LOG_LOSS_EPS)), F.lit(LOG_LOSS_EPS))
    return predictions.groupBy(*groups).agg(F.avg(-F.log(clipped)).alias("multiclass_log_loss"))


def ovr_auc(predictions: DataFrame, classes: Sequence[str], n_buckets: int = 256) -> DataFrame:
    """``(class, auc)`` one class against the rest, by pair counting with ties as one half.

    Equal scores are combined first.  The score axis is then cut at quantiles, so a
    class's running count is a sum over buckets plus a window inside one bucket.
    Two classes give the second class's AUC only.
    """
    wanted = list(enumerate(classes))[1:] if len(classes) == 2 else list(enumerate(classes))
    per_class_score = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("class"),
                    F.get("scores", F.lit(i)).alias("score"),
                    (F.col("true_label") == name).cast("bigint").alias("positive"),
                )
                for i, name in wanted
            ]
        )
    ).alias("s")
    ties = (
        predictions.select(per_class_score)
        .groupBy(F.col("s.class").alias("class"), F.col("s.score").alias("score"))
        .agg(F.sum("s.positive").alias("pos"), (F.count(F.lit(1)) - F.sum("s.positive")).alias("neg"))
    )
    # written once: the bounds, the bucket totals and the windows all read it
    placed = quantile_bucket(durable(ties, "score-ties"), "score", "bucket", n_buckets)
    per_bucket = placed.groupBy("class", "bucket").agg(F.sum("pos").alias("bucket_pos"), F.sum("neg").alias("bucket_neg"))
    whole = Window.partitionBy("class")
    offsets = per_bucket.select(
        "class",
        "bucket",
        (F.sum("bucket_neg").over(whole.orderBy("bucket")) - F.col("bucket_neg")).alias("neg_before"),
        F.sum("bucket_pos").over(whole).alias("all_pos"),
        F.sum("bucket_neg").over(whole).alias("all_neg"),
    )
    inside = Window.partitionBy("class", "bucket").orderBy("score")
    below = F.col("neg_before") + F.sum("neg").over(inside) - F.col("neg")
    won = placed.join(offsets, ["class", "bucket"]).select(
        "class", "all_pos", "all_neg", (F.col("pos") * (below + F.col("neg") / 2.0)).alias("won")
    )
    pairs = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    return won.groupBy("class").agg(F.try_divide(F.sum("won"), F.nullif(pairs, F.lit(0.0))).alias("auc"))


def macro_auc(predictions: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Mean AUC over classes, null with a note when a class has no positives or no negatives."""
    parts = ovr_auc(predictions, classes)
    undefined = F.count_if(F.col("auc").isNull()) > 0
    return parts.agg(
        F.when(~undefined, F.avg("auc")).alias("ovr_roc_auc_macro"),
        F.when(undefined, "undefined: a class has only one label value").alias("note"),
    )


def error_flags(predictions: DataFrame, margin: str = "margin") -> DataFrame:
    """Add ``correct``, a finite ``margin`` or null, and its absolute value."""
    finite = F.when(~F.isnan(margin) & (F.abs(margin) != float("inf")), F.col(margin))
    return predictions.select(
        *[c for c in predictions.columns if c != margin],
        finite.alias(margin),
        F.abs(finite).alias("absolute_margin"),
        (F.col("true_label") == F.col("predicted_label")).alias("correct"),
    )


def ranked_errors(flagged: DataFrame) -> DataFrame:
    """Wrong predictions, most confident first; without a margin last, then by participant."""
    return flagged.where(~F.col("correct")).orderBy(F.desc_nulls_last("absolute_margin"), "participant_barcode")


def error_pattern(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """``(true, predicted, n, share)`` over the errors."""
    wrong = confusion_counts(predictions, groups).where("true_label <> predicted_label")
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    return wrong.withColumn("share", F.col("n") / F.sum("n").over(whole))


def coverage(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """``(check, n)``: rows predicted never, more than once, or not asked for."""
    seen = predictions.groupBy("cache_index").agg(F.count(F.lit(1)).alias("times"))
    asked = expected.select("cache_index").withColumn("asked", F.lit(True))
    both = seen.join(asked, "cache_index", "full")
    state = (
        F.when(F.col("asked").isNull(), "unexpected")
        .when(F.col("times").isNull(), "never")
        .when(F.col("times") > 1, "repeated")
        .otherwise("once")
    )
    return both.groupBy(state.alias("coverage")).agg(F.count(F.lit(1)).alias("n"))


def prior_model(development: DataFrame) -> DataFrame:
    """Class priors and the majority class (first in sort order on ties)."""
    sizes = development.groupBy("cancer_type").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    # the smallest (-n, class) is the largest class, earliest name first
    top = F.min(F.struct((-F.col("n")).alias("m"), F.col("cancer_type").alias("c"))).over(whole)
    return sizes.select(
        "cancer_type", "n", (F.col("n") / F.sum("n").over(whole)).alias("prior"), (top["c"] == F.col("cancer_type")).alias("majority")
    )


def signed_margin(scores: Column, classes: Sequence[str], positive: str) -> Column:
    """Margin toward ``positive`` from two scores, or from one score that points to the second class."""
    if len(classes) != 2 or positive not in classes:
        raise ValueError("a signed margin needs exactly two classes, one of them the positive class")
    sign = 1.0 if classes[1] == positive else -1.0
    wide = F.get(scores, F.lit(1)) - F.get(scores, F.lit(0))
    return (
        F.when(F.size(scores) == 2, wide * F.lit(sign))
        .when(F.size(scores) == 1, F.get(scores, F.lit(0)) * F.lit(sign))
        .otherwise(F.lit(float("nan")))
    )
