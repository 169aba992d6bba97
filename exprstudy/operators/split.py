"""Deterministic stratified holdout and folds.

Membership follows ``md5(seed ':' participant)``.  A class is cut at exact hash
ranks, so assigning a row is a comparison with its class's cut keys: the samples
themselves are never shuffled or sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprstudy.constants import DEFAULT_FOLDS, DEFAULT_HOLDOUT_FRACTION, DEFAULT_SEED, SPLITS
from exprstudy.functions.checks import duplicates, fail_when, require_columns, violations
from exprstudy.functions.ranking import rank_cuts

ID = "participant_barcode"
CLASS = "cancer_type"
BUCKET_DIGITS = 4


INDEX = "cache_index"


def sample_violations(samples: DataFrame) -> DataFrame:
    """``(violation, key, n)``: participants and row numbers that several rows claim.

    Counts are combined map-side, so a participant with a third of all rows moves as one row per task.
    """
    found = None
    for name, column in (("repeated_participant", ID), ("repeated_index", INDEX)):
        if column in samples.columns:
            counted = samples.groupBy(F.col(column).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            part = counted.select(F.lit(name).alias("violation"), "key", "n")
            found = part if found is None else found.unionByName(part)
    return found


def refuse_ambiguous(samples: DataFrame) -> DataFrame:
    """The samples, if there are any and every participant and row number is there once."""
    if samples.isEmpty():
        raise ValueError("there are no samples to split")
    worst = sample_violations(samples).orderBy("violation", F.desc("n"), "key").first()
    if worst is not None:
        raise ValueError(f"a split by participant needs one row each: {worst['violation']} {worst['key']!r} has {worst['n']} rows")
    return samples


def _keyed(samples: DataFrame, seed: int) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ID)).cast("binary"))
    return samples.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))


def _class_sizes(samples: DataFrame) -> DataFrame:
    """``(class, n, total, before)``: class sizes, their sum, and rows of earlier classes."""
    sizes = samples.groupBy(CLASS).agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(F.lit(0))
    return sizes.select(
        CLASS,
        "n",
        F.sum("n").over(one).alias("total"),
        (F.sum("n").over(one.orderBy(CLASS)) - F.col("n")).alias("before"),
    )


def holdout_quota(samples: DataFrame, fraction: float) -> DataFrame:
    """``(class, n, quota)``: ``ceil(total * fraction)`` rows spread by largest remainder."""
    share = F.col("n") * F.lit(float(fraction))
    alone = F.concat(F.lit("a class must have at least two participants, one for each side: "), F.col(CLASS))
    sized = _class_sizes(samples).select(
        CLASS,
        "n",
        fail_when(F.col("n") < 2, alone, F.floor(share)).alias("base"),
        (share - F.floor(share)).alias("remainder"),
        F.ceil(F.col("total") * F.lit(float(fraction))).alias("wanted"),
    )
    one = Window.partitionBy(F.lit(0))
    spare = F.col("wanted") - F.sum("base").over(one)
    turn = F.row_number().over(one.orderBy(F.desc("remainder"), CLASS))
    return sized.select(CLASS, "n", (F.col("base") + (turn <= spare).cast("int")).cast("bigint").alias("quota"))


def _cut_keys(samples: DataFrame, ranks: DataFrame, seed: int) -> DataFrame:
    return rank_cuts(_keyed(samples.select(ID, CLASS), seed), ranks, CLASS, "_key", "_bucket")


def _part(rows: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """Add the class's cut table and ``_part``: how many of its cut keys lie below the row's key."""
    below = F.size(F.filter("cuts", lambda cut: cut < F.col("_key")))
    # one row per class with at most k keys; Spark broadcasts it while it is small
    return (
        _keyed(rows, seed)
        .join(table, CLASS, "left")
        .withColumn("_part", F.when(F.col("cuts").isNotNull(), below))
    )


def holdout_cuts(
    samples: DataFrame, fraction: float = DEFAULT_HOLDOUT_FRACTION, seed: int = DEFAULT_SEED
) -> DataFrame:
    """``(class, cuts)``: the last hash key of each class that belongs to the holdout."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("holdout_fraction must be between 0 and 1")
    require_columns(samples, [ID, CLASS], "samples table")
    quota = holdout_quota(samples.select(CLASS), fraction)
    return _cut_keys(samples, quota.where("quota > 0").select(CLASS, F.col("quota").alias("rank")), seed)


def assign_holdout(rows: DataFrame, cuts: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    split = F.when(F.col("_part") == 0, SPLITS[1]).otherwise(SPLITS[0])
    return _part(rows, cuts, seed).withColumn("split", split).drop("_key", "_bucket", "_part", "cuts")


def holdout(
    samples: DataFrame, fraction: float = DEFAULT_HOLDOUT_FRACTION, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Add ``split`` (development or holdout) to the samples; empty tables and repeated participants or row numbers are refused."""
    return assign_holdout(samples, holdout_cuts(refuse_ambiguous(samples), fraction, seed), seed)


def fold_layout(samples: DataFrame, k: int) -> DataFrame:
    """``(class, n, fold, rank)`` for the non-empty folds: the last in-class rank of each.

    Fold sizes within a class differ by at most one, and the class start rotates so
    that overall fold sizes differ by at most one as well.
    """
    sizes = _class_sizes(samples)
    spread = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

    def dealt(end):  # positions 0 .. end-1 that are congruent to the fold
        return F.floor((end - F.col("fold") + F.lit(k - 1)) / F.lit(k)).cast("bigint")

    size = dealt(F.col("before") + F.col("n")) - dealt(F.col("before"))
    in_order = Window.partitionBy(CLASS).orderBy("fold")
    return (
        spread.withColumn("size", size)
        .where("size > 0")
        .select(CLASS, "n", "fold", F.sum("size").over(in_order).alias("rank"))
    )


def fold_cuts(development: DataFrame, k: int = DEFAULT_FOLDS, seed: int = DEFAULT_SEED) -> DataFrame:
    """``(class, cuts, _folds)``: the cut keys between the folds of a class, and the folds in key order."""
    if k < 2:
        raise ValueError("n_splits must be >= 2")
    require_columns(development, [ID, CLASS], "development table")
    layout = fold_layout(development.select(CLASS), k)
    names = layout.groupBy(CLASS).agg(F.array_sort(F.collect_list("fold")).alias("_folds"))
    cuts = _cut_keys(development, layout.where("rank < n").select(CLASS, "rank"), seed)
    return names.join(cuts, CLASS, "left").select(CLASS, "cuts", "_folds")


def assign_folds(rows: DataFrame, cuts: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    fold = F.element_at("_folds", F.coalesce("_part", F.lit(0)) + 1).cast("int")
    return _part(rows, cuts, seed).withColumn("fold", fold).drop("_key", "_bucket", "_part", "cuts", "_folds")


def folds(development: DataFrame, k: int = DEFAULT_FOLDS, seed: int = DEFAULT_SEED) -> DataFrame:
    """Add ``fold`` (0 .. k-1) to the development samples."""
    return assign_folds(development, fold_cuts(development, k, seed), seed)


def split_class_counts(split: DataFrame) -> DataFrame:
    """Class by split counts, zero-filled."""
    return split.groupBy(CLASS).agg(
        *[F.count_if(F.col("split") == name).cast("bigint").alias(name) for name in SPLITS]
    )


def split_summary(split: DataFrame) -> DataFrame:
    return split.agg(
        F.count(F.lit(1)).alias("n_samples"),
        *[F.count_if(F.col("split") == name).cast("bigint").alias(f"n_{name}") for name in SPLITS],
    )


def split_overlap(split: DataFrame) -> DataFrame:
    """Participants on both sides (must be empty), as one count."""
    sides = split.groupBy(ID).agg(F.count_distinct("split").alias("sides"))
    return sides.agg(F.count_if(F.col("sides") > 1).cast("bigint").alias("n_overlap"))


def class_set_diff(split: DataFrame) -> DataFrame:
    """Classes present on one side only."""
    seen = split_class_counts(split)
    return seen.where("(development = 0) <> (holdout = 0)").select(
        CLASS, F.when(F.col("development") > 0, SPLITS[0]).otherwise(SPLITS[1]).alias("only_in")
    )


def split_constraints(split: DataFrame, matrix: DataFrame) -> DataFrame:
    """``(check, n_violations)`` for a split manifest against its matrix."""
    known = matrix.select("cache_index")
    bad_name = ~F.col("split").isin(*SPLITS)
    sides = split.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    empty_side = sides.select(sum((F.col(s) == 0).cast("bigint") for s in SPLITS).alias("n_violations"))
    return (
        violations("duplicate_cache_index", duplicates(split, "cache_index"))
        .unionByName(violations("duplicate_participant", duplicates(split, ID)))
        .unionByName(violations("index_out_of_range", split.join(known, "cache_index", "left_anti")))
        .unionByName(violations("unknown_split", split.where(bad_name)))
        .unionByName(violations("class_on_one_side", class_set_diff(split)))
        .unionByName(empty_side.select(F.lit("empty_side").alias("check"), "n_violations"))
    )
