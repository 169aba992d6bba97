"""Preprocessing learned from training rows only.

The order is log2(x + 1), median impute, constant-feature drop, ANOVA top-k,
scale.  All folds are fitted from one pass: moments are kept per (gene, class,
fold) cell, and the training moments of a fold are the merged moments of the
other folds.  Medians do not merge, so only genes with missing values (or all
genes, for the robust scaler) take a second, exact pass.

``fold`` numbers the held-out part of a row and ``eval_fold`` the experiment, so
the training rows of experiment f are those with ``fold <> f``.  A final fit on
all development rows is the one experiment 0 over rows with fold -1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprstudy.functions.budgets import parse_budget
from exprstudy.functions.transforms import log2p1
from exprstudy.operators.matrix import long_form
from exprstudy.operators.quantiles import training_quantiles, training_weights
from exprstudy.session import durable

SCALERS = ("standard", "robust")
WHOLE_FOLD = -1


def logged_cells(matrix: DataFrame, negative_policy: str) -> DataFrame:
    """``(cancer_type, fold, gene_index, value)`` on the log scale; missing is NaN."""
    cells = long_form(matrix, keep=("cancer_type", "fold"))
    return cells.withColumn("value", log2p1(F.col("value"), negative_policy))


def _present(value: str = "value") -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value)


def cell_moments(cells: DataFrame) -> DataFrame:
    """Count, mean, sum of squared deviations, range and missing count per (gene, class, fold)."""
    x = F.when(_present(), F.col("value").cast("double"))
    n = F.count(x)
    return cells.groupBy("gene_index", "cancer_type", "fold").agg(
        n.alias("n"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias("m2"),
        F.min(x).alias("lowest"),
        F.max(x).alias("highest"),
        (F.count(F.lit(1)) - n).alias("n_missing"),
    )


def _other_folds(k: int) -> Column:
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold")))


def training_moments(moments: DataFrame, k: int) -> DataFrame:
    """Merge the cells outside each fold to one row per (eval_fold, gene, class).

    The exchange is on (eval_fold, gene), which serves this merge and the per-gene
    steps that follow.
    """
    spread = moments.withColumn("eval_fold", _other_folds(k)).repartition("eval_fold", "gene_index")
    group = Window.partitionBy("eval_fold", "gene_index", "cancer_type")
    centre = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(group), F.sum("n").over(group))
    centred = spread.withColumn("centre", F.coalesce(centre, F.lit(0.0)))
    gap = F.col("mean") - F.col("centre")
    return centred.groupBy("eval_fold", "gene_index", "cancer_type").agg(
        F.sum("n").alias("n"),
        F.first("centre").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        F.sum("n_missing").alias("n_missing"),
    )


def impute_medians(cells: DataFrame, moments: DataFrame, k: int) -> DataFrame:
    """``(eval_fold, gene_index, median)`` for genes with any missing value."""
    missing = moments.where("n_missing > 0").select("gene_index").distinct()
    observed = cells.join(missing, "gene_index", "left_semi").where(_present())
    found = training_quantiles(training_weights(observed, k), [0.5], k)
    return found.select("eval_fold", "gene_index", F.col("q")[0].alias("median"))


def _imputed(train: DataFrame, medians: DataFrame) -> DataFrame:
    """Class moments after the missing cells took the training median."""
    joined = train.join(medians, ["eval_fold", "gene_index"], "left")
    filled = F.when(F.col("median").isNotNull(), F.col("n_missing")).otherwise(0)
    total = F.col("n") + filled
    value = F.coalesce("median", F.lit(0.0))
    mean = F.coalesce(F.try_divide(F.col("n") * F.col("mean") + filled * value, total), F.lit(0.0))
    seen = joined.select("*", total.alias("n_all"), mean.alias("mean_all"), filled.alias("filled"), value.alias("fill"))
    old_gap = F.col("mean") - F.col("mean_all")
    new_gap = F.col("fill") - F.col("mean_all")
    m2 = F.col("m2") + F.col("n") * old_gap * old_gap + F.col("filled") * new_gap * new_gap
    return seen.select(
        "eval_fold",
        "gene_index",
        "cancer_type",
        F.col("n_all").alias("n"),
        F.col("mean_all").alias("mean"),
        m2.alias("m2"),
        "lowest",
        "highest",
        "median",
        "n_missing",
    )


def gene_statistics(train: DataFrame) -> DataFrame:
    """Per (eval_fold, gene): overall mean and sd, range, ANOVA F over classes, eligibility."""
    gene = Window.partitionBy("eval_fold", "gene_index")
    centre = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(gene), F.sum("n").over(gene))
    gap = F.col("mean") - F.col("centre")
    summed = (
        train.withColumn("centre", F.coalesce(centre, F.lit(0.0)))
        .groupBy("eval_fold", "gene_index")
        .agg(
            F.sum("n").alias("n"),
            F.count_if(F.col("n") > 0).alias("classes"),
            F.first("centre").alias("mean"),
            F.sum("m2").alias("within"),
            F.sum(F.col("n") * gap * gap).alias("between"),
            F.min("lowest").alias("lowest"),
            F.max("highest").alias("highest"),
            F.first("median").alias("median"),
            F.sum("n_missing").alias("n_missing"),
        )
    )
    mean_between = F.try_divide(F.col("between"), F.col("classes") - 1)
    mean_within = F.try_divide(F.col("within"), F.col("n") - F.col("classes"))
    score = F.when((F.col("within") <= 0) & (F.col("between") > 0), F.lit(float("inf"))).otherwise(
        F.try_divide(mean_between, mean_within)
    )
    return summed.select(
        "eval_fold",
        "gene_index",
        "n",
        "mean",
        F.sqrt(F.try_divide(F.col("within") + F.col("between"), F.col("n"))).alias("sd"),
        F.coalesce(F.col("highest") > F.col("lowest"), F.lit(False)).alias("eligible"),
        score.alias("f_score"),
        "median",
        "n_missing",
    )


def fit(matrix: DataFrame, k: int, scaler: str = "standard", negative_policy: str = "error") -> DataFrame:
    """Training parameters ``(eval_fold, gene_index, median, center, scale, f_score, eligible)``.

    ``matrix`` is a development matrix with ``fold``.
    """
    if scaler not in SCALERS:
        raise ValueError("scaler must be 'standard' or 'robust'")
    cells = logged_cells(matrix, negative_policy)
    moments = durable(cell_moments(cells), "moments")  # the one full pass; all else reads this summary
    has_missing = not moments.where("n_missing > 0").isEmpty()
    train = training_moments(moments, k)
    if has_missing:
        train = _imputed(train, impute_medians(cells, moments, k))
    else:
        train = train.withColumn("median", F.lit(None).cast("double"))
    statistics = gene_statistics(train)
    if scaler == "standard":
        scale = F.when(F.coalesce(F.col("sd"), F.lit(0.0)) > 0, F.col("sd")).otherwise(1.0)
        return statistics.select(
            "eval_fold", "gene_index", "median", F.col("mean").alias("center"), scale.alias("scale"), "f_score", "eligible"
        )
    quartiles = robust_quartiles(cells, statistics, k)
    spread = F.col("q")[2] - F.col("q")[0]
    return statistics.join(quartiles, ["eval_fold", "gene_index"], "left").select(
        "eval_fold",
        "gene_index",
        "median",
        F.col("q")[1].alias("center"),
        F.when(spread > 0, spread).otherwise(1.0).alias("scale"),
        "f_score",
        "eligible",
    )


def robust_quartiles(cells: DataFrame, statistics: DataFrame, k: int) -> DataFrame:
    """Exact training quartiles after imputation: missing cells count as copies of the median."""
    observed = training_weights(cells.where(_present()), k)
    copies = [F.when(F.col("eval_fold") == f, F.col("n_missing")).otherwise(0).alias(f"t{f}") for f in range(k)]
    imputed = statistics.where("n_missing > 0 AND median IS NOT NULL").select(
        "gene_index", F.col("median").alias("value"), *copies
    )
    return training_quantiles(observed.unionByName(imputed), [0.25, 0.5, 0.75], k)


def rank_features(params: DataFrame, largest: int | None = None) -> DataFrame:
    """Eligible genes ranked per experiment by F, ties to the larger index.

    With ``largest`` the limit is pushed below the exchange, so one ranking serves
    every budget up to it and only the leaders move.
    """
    order = Window.partitionBy("eval_fold").orderBy(F.desc("f_score"), F.desc("gene_index"))
    ranked = params.where("eligible").withColumn("rank", F.row_number().over(order))
    return ranked if largest is None else ranked.where(F.col("rank") <= largest)


def select_k_best(params: DataFrame, budget: int | str) -> DataFrame:
    """The parameters of the genes a budget keeps: min(budget, survivors) per experiment, or all."""
    wanted = parse_budget(budget)
    if wanted == "all":
        return params.where("eligible")
    return rank_features(params, wanted)


def pack(params: DataFrame) -> DataFrame:
    """One row per experiment: its gene parameters as an array in gene order.

    A packed row is as wide as one matrix row, which bounds it.
    """
    entry = F.struct("gene_index", "median", "center", "scale")
    return params.groupBy("eval_fold").agg(F.array_sort(F.collect_list(entry)).alias("params"))


def transform(
    matrix: DataFrame,
    packed: DataFrame,
    experiments: Sequence[int],
    negative_policy: str = "error",
    scaled: bool = True,
) -> DataFrame:
    """Selected, imputed and scaled features of every row for each experiment.

    Adds ``eval_fold`` and ``x ARRAY<DOUBLE>``.  The packed parameters hold one row
    per experiment, no wider than a matrix row, so they are broadcast; rows never
    shuffle and genes outside the selection are never computed.
    """
    spread = matrix.withColumn("eval_fold", F.explode(F.array(*[F.lit(int(e)) for e in experiments])))
    joined = spread.join(F.broadcast(packed.where(F.col("eval_fold").isin(*map(int, experiments)))), "eval_fold")

    def prepared(p: Column) -> Column:
        value = log2p1(F.get("features", p["gene_index"]), negative_policy).cast("double")
        filled = F.when(F.isnan(value) | value.isNull(), p["median"]).otherwise(value)
        return (filled - p["center"]) / p["scale"] if scaled else filled

    return joined.withColumn("x", F.transform("params", prepared)).drop("params", "features")


def class_weights(rows: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Balanced weights ``n / (classes * n_class)`` per class (and group)."""
    sizes = rows.groupBy(*groups, "cancer_type").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    weight = F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    return sizes.select(*groups, "cancer_type", "n", weight.alias("weight"))
