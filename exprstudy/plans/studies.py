"""Development-only studies.

Every study starts from a development matrix with a ``fold`` column; no function
here accepts rows of the other side.  Preprocessing of all folds is one job.  Linear
models of all folds, budgets and kinds are fitted by one optimiser over one copy of
the rows, trees of all folds in step by another; PCA models are an MLlib job for each fold.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprstudy.constants import CLASSICAL_MODELS, DEFAULT_FOLDS, DEFAULT_SEED, FOCUSED_PAIRS, GENE_BUDGETS, LINEAR_MODELS
from exprstudy.functions.budgets import parse_budget, parse_budgets
from exprstudy.operators import blockfit, interpret, matrix, metrics, models, prep, split, treefit
from exprstudy.session import durable


@dataclass(frozen=True)
class Prepared:
    """A development matrix with frozen folds and the training parameters of every fold."""

    rows: DataFrame
    params: DataFrame
    classes: list[str]
    sizes: dict[tuple[int, str], int]
    k: int
    negative_policy: str

    def n_rows(self) -> int:
        return sum(self.sizes.values())

    def training_counts(self, experiment: int) -> list[int]:
        return [
            sum(n for (fold, name), n in self.sizes.items() if name == wanted and fold != experiment)
            for wanted in self.classes
        ]


@dataclass(frozen=True)
class Outcome:
    """Held-out predictions of every fold, and what the fitted models expose."""

    predictions: DataFrame
    coefficients: DataFrame | None
    importances: DataFrame | None
    selected: DataFrame
    fits: DataFrame | None = None
    packed: DataFrame | None = None
    weights: DataFrame | None = None


@dataclass(frozen=True)
class Request:
    """One linear model to cross-validate, with the genes of one budget."""

    name: str
    budget: int | str = "all"
    C: float = 1.0
    l1_ratio: float | None = None
    max_iter: int | None = None

    def settings(self) -> dict:
        loss, ratio, steps = LINEAR_DEFAULTS[self.name]
        return {
            "loss": loss,
            "C": self.C,
            "l1_ratio": ratio if self.l1_ratio is None else self.l1_ratio,
            "max_iter": steps if self.max_iter is None else self.max_iter,
        }


#: loss, L1 share and most iterations of the linear models
LINEAR_DEFAULTS = {
    "logistic_l2": ("logistic", 0.0, 2_000),
    "elastic_net": ("logistic", 0.5, 5_000),
    "linear_svm": ("squared_hinge", 0.0, 10_000),
}


def freeze_folds(development: DataFrame, k: int = DEFAULT_FOLDS, seed: int = DEFAULT_SEED) -> DataFrame:
    """The development matrix with its folds.

    Only the cut keys are written (a few per class); rows compare with them, so the
    matrix is neither shuffled nor joined with a table of its own size.
    """
    return split.assign_folds(development, durable(split.fold_cuts(development, k, seed), "fold-cuts"), seed)


def prepare(
    rows: DataFrame, k: int = DEFAULT_FOLDS, scaler: str = "standard", negative_policy: str = "error"
) -> Prepared:
    """Fit the preprocessing of all folds; ``rows`` is a development matrix with ``fold``."""
    params = durable(prep.fit(rows, k, scaler, negative_policy), "params")
    counted = rows.groupBy("fold", "cancer_type").agg(F.count(F.lit(1)).alias("n")).collect()  # folds x classes
    sizes = {(row["fold"], row["cancer_type"]): row["n"] for row in counted}
    return Prepared(rows, params, sorted({name for _, name in sizes}), sizes, k, negative_policy)


def labelled(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("cancer_type"))
    return rows.withColumn("label", (position - 1).cast("double"))


def _weighted(rows: DataFrame, counts: Sequence[int]) -> DataFrame:
    present = [n for n in counts if n > 0]
    weights = [sum(present) / (len(present) * n) if n else 0.0 for n in counts]
    return rows.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("label").cast("int")))


def fit_experiment(prepared: Prepared, packed: DataFrame, name: str, experiment: int, seed: int, scaled: bool, params: dict):
    """Fit one model on the rows outside the fold; returns it with the labelled rows of the fold."""
    design = prep.transform(prepared.rows, packed, [experiment], prepared.negative_policy, scaled)
    design = models.as_vectors(labelled(design, prepared.classes))
    counts = prepared.training_counts(experiment)
    train = _weighted(design.where(F.col("fold") != experiment), counts).select("x", "label", "weight")
    held_out = design.where(F.col("fold") == experiment)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        wanted = dict(params)
        if name == "pca_logistic":
            width = packed.where(F.col("eval_fold") == experiment).select(F.size("params")).first()[0]
            if "components" not in wanted:
                requested = wanted.pop("pca_components", 100)
                wanted["components"] = models.pca_components(requested, width, [sum(prepared.training_counts(i)) for i in range(prepared.k)])
            return models.pca_logistic(train, sum(counts), wanted["components"], wanted.get("max_iter", 2_000)), held_out
        estimator = models.estimator(name, sum(counts), len(prepared.classes), seed, **wanted)
        return estimator.fit(train), held_out
    finally:
        train.unpersist()


def predict(fitted, held_out: DataFrame, classes: Sequence[str]) -> DataFrame:
    predicted = fitted.transform(held_out)
    names = F.array(*[F.lit(c) for c in classes])
    two = len(classes) == 2 and "rawPrediction" in predicted.columns
    margin = F.get(models.margin_scores(predicted), F.lit(0)) if two else F.lit(None).cast("double")
    return predicted.select(
        "cache_index",
        "participant_barcode",
        "fold",
        F.col("cancer_type").alias("true_label"),
        F.get(names, F.col("prediction").cast("int")).alias("predicted_label"),
        models.scores_of(fitted, predicted).alias("scores"),
        margin.alias("margin"),
    )


def _numbers(packed: DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """The packed parameters of each experiment as arrays; they are as large as the models."""
    fields = ("gene_index", "median", "center", "scale")
    found = packed.select("eval_fold", *[F.col("params")[name].alias(name) for name in fields]).collect()
    return {
        row["eval_fold"]: {
            name: np.array([0 if v is None else v for v in row[name]], int if name == "gene_index" else float) for name in fields
        }
        for row in found
    }


def fit_linear(prepared: Prepared, requests: Sequence[Request], held_out: DataFrame | None = None) -> list[Outcome]:
    """Fit all requests together: every step of the optimiser reads the rows once for all of them.

    Predictions are those of each fold by the model that did not see it, or of ``held_out``,
    whose ``fold`` then names the experiment.
    """
    scored = prepared.rows if held_out is None else held_out
    blocks = blockfit.write_blocks(labelled(prepared.rows, prepared.classes), prepared.negative_policy)
    packs = {
        budget: durable(prep.pack(prep.select_k_best(prepared.params, budget)), "packed")
        for budget in dict.fromkeys(r.budget for r in requests)
    }
    numbers = {budget: _numbers(packed) for budget, packed in packs.items()}
    # budgets beyond the usable genes ask for the same model, which is fitted and scored once
    problems, places, asked = [], {}, []
    for request in requests:
        own = []
        for experiment in range(prepared.k):
            if experiment not in numbers[request.budget]:
                raise ValueError(f"fold {experiment} has no usable gene to fit on")
            p = numbers[request.budget][experiment]
            key = experiment, p["gene_index"].tobytes(), tuple(request.settings().items())
            if key not in places:
                places[key] = len(problems)
                problems.append(
                    blockfit.Problem(
                        experiment, p["gene_index"], p["median"], p["center"], p["scale"],
                        prepared.training_counts(experiment), **request.settings(),
                    )
                )
            own.append(places[key])
        asked.append(tuple(own))
    fitted = blockfit.fit_all(blocks, problems)
    outcomes = {}
    for request, own in zip(requests, asked):
        if own not in outcomes:
            outcomes[own] = _linear_outcome(prepared, packs[request.budget], request, [fitted[i] for i in own], scored)
    return [outcomes[own] for own in asked]


def _linear_outcome(prepared: Prepared, packed: DataFrame, request: Request, fitted: Sequence[blockfit.Fitted], scored: DataFrame) -> Outcome:
    spark = prepared.rows.sparkSession
    experiments = range(prepared.k)
    rows = [(e, f.weights.tolist(), f.intercepts.tolist()) for e, f in zip(experiments, fitted)]
    table = durable(spark.createDataFrame(rows, "eval_fold int, weights array<array<double>>, intercepts array<double>"), "weights")
    selected = packed.select("eval_fold", F.posexplode("params").alias("position", "p")).select(
        F.col("eval_fold").alias("fold"), "position", F.col("p.gene_index").alias("gene_index")
    )
    matrices = [np.vstack([-f.weights, f.weights]) if len(prepared.classes) == 2 else f.weights for f in fitted]
    weights = _parameter_table(prepared.rows, experiments, matrices, prepared.classes, "coefficient")
    coefficients = weights.join(selected, ["fold", "position"]).select("fold", "class", "gene_index", "coefficient")
    ends = [(e, f.iterations, f.gradient, f.converged) for e, f in zip(experiments, fitted)]
    fits = spark.createDataFrame(ends, "fold int, iterations int, gradient double, converged boolean")
    loss = LINEAR_DEFAULTS[request.name][0]
    predictions = score_linear(scored, packed, table, prepared.classes, prepared.negative_policy, loss)
    return Outcome(predictions, coefficients, None, selected.select("fold", "gene_index"), fits, packed, table)


def _with_chances(rows: DataFrame, two: bool) -> DataFrame:
    """Rows with ``margins`` and the class probabilities as ``chances``.

    What all classes share is a column of its own; inside a lambda it would be found again for each.
    """
    if two:
        second = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.get("margins", F.lit(0))))
        return rows.withColumn("chances", F.array(F.lit(1.0) - second, second))
    rows = rows.withColumn("top", F.array_max("margins"))
    rows = rows.withColumn("raised", F.transform("margins", lambda m: F.exp(m - F.col("top"))))
    rows = rows.withColumn("total", F.aggregate("raised", F.lit(0.0), lambda a, b: a + b))
    return rows.withColumn("chances", F.transform("raised", lambda v: v / F.col("total"))).drop("top", "raised", "total")


def linear_margins(rows: DataFrame, packed: DataFrame, weights: DataFrame, negative_policy: str, wanted: Column) -> DataFrame:
    """``x`` and ``margins`` of the (row, experiment) pairs that ``wanted`` picks by ``fold`` and ``eval_fold``."""
    experiments = [r[0] for r in weights.select("eval_fold").collect()]  # one row for each experiment
    design = prep.transform(rows, packed, experiments, negative_policy).where(wanted)
    product = F.zip_with(
        "weights",
        "intercepts",
        lambda w, b: F.aggregate(F.zip_with("x", w, lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v) + b,
    )
    return design.join(weights, "eval_fold").withColumn("margins", product)


def optimality(prepared: Prepared, outcome: Outcome, request: Request) -> DataFrame:
    """How far each parameter is from its optimum: ``(fold, class, gene_index, coefficient, violation)``.

    The violation is the steepest one-sided derivative of the mean penalised loss over the
    training rows, zero at the minimum, found from the row-wise features and the stored weights
    alone.  One aggregate over (experiment, feature); the intercept has no ``gene_index``.
    """
    classes, settings = prepared.classes, request.settings()
    columns = [classes[1]] if len(classes) == 2 else classes
    rows = labelled(prepared.rows, classes)
    found = linear_margins(rows, outcome.packed, outcome.weights, prepared.negative_policy, F.col("fold") != F.col("eval_fold"))
    shares = []
    for experiment in range(prepared.k):
        counts = prepared.training_counts(experiment)
        present = [n for n in counts if n > 0]
        shares.append([sum(present) / (len(present) * n) if n else 0.0 for n in counts])
    table = F.array(*[F.array(*[F.lit(v) for v in row]) for row in shares])
    found = found.withColumn("own", F.get(F.get(table, F.col("eval_fold")), F.col("label").cast("int")))
    if settings["loss"] == "logistic":
        found = _with_chances(found, len(columns) == 1)
    residuals = []
    for at, name in enumerate(columns):
        here = F.col("cancer_type") == name
        margin = F.get("margins", F.lit(at))
        if settings["loss"] == "squared_hinge":
            sign = F.when(here, 1.0).otherwise(-1.0)
            cost = F.col("own") if len(columns) == 1 else F.when(here, F.col("own")).otherwise(1.0)
            residuals.append(-2 * cost * sign * F.greatest(F.lit(0.0), 1 - sign * margin))
        else:
            chance = F.get("chances", F.lit(at + (len(columns) == 1)))
            residuals.append(F.col("own") * (chance - here.cast("double")))
    # residuals belong to a row, so they are found before its cells are laid out
    found = found.select("eval_fold", F.array(*residuals).alias("r"), F.concat("x", F.array(F.lit(1.0))).alias("x"))
    cells = found.select("eval_fold", "r", F.posexplode("x").alias("position", "v"))
    sums = [F.sum(F.col("v") * F.get("r", F.lit(i))) for i in range(len(columns))]
    slopes = cells.groupBy("eval_fold", "position").agg(F.array(*sums).alias("slope"))
    sizes = F.array(*[F.lit(float(sum(prepared.training_counts(e)))) for e in range(prepared.k)])
    joined = slopes.join(outcome.weights, "eval_fold").join(outcome.packed, "eval_fold")
    each = joined.select(
        F.col("eval_fold").alias("fold"),
        F.get("params", F.col("position"))["gene_index"].alias("gene_index"),
        F.get(sizes, F.col("eval_fold")).alias("n"),
        F.posexplode(F.zip_with("slope", F.zip_with("weights", "intercepts", lambda w, b: F.get(F.concat(w, F.array(b)), F.col("position"))),
                                lambda g, w: F.struct(g.alias("g"), w.alias("w")))).alias("at", "p"),
    )
    strength = F.lit(1.0) / (F.lit(settings["C"]) * F.col("n"))
    if settings["loss"] == "logistic":
        strength = F.when(F.col("gene_index").isNull(), 0.0).otherwise(strength)
    w, l1 = F.col("p.w"), settings["l1_ratio"] * strength
    slope = F.col("p.g") / F.col("n") + (1 - settings["l1_ratio"]) * strength * w
    violation = F.when(w == 0, F.greatest(F.lit(0.0), F.abs(slope) - l1)).otherwise(F.abs(slope + F.signum(w) * l1))
    return each.select(
        "fold", F.get(F.array(*[F.lit(c) for c in columns]), F.col("at")).alias("class"), "gene_index", w.alias("coefficient"), violation.alias("violation")
    )


def score_linear(rows: DataFrame, packed: DataFrame, weights: DataFrame, classes: Sequence[str], negative_policy: str, loss: str) -> DataFrame:
    """Predictions in the form of :func:`predict`; probabilities for the logistic loss, margins for the hinge."""
    two = len(classes) == 2
    found = linear_margins(rows, packed, weights, negative_policy, F.col("fold") == F.col("eval_fold"))
    first = F.get("margins", F.lit(0))
    if loss == "logistic":
        return _called(_with_chances(found, two), classes, F.col("chances"))
    return _called(found, classes, F.array(-first, first) if two else F.col("margins"))


def fit_trees(prepared: Prepared, budget: int | str = "all", seed: int = DEFAULT_SEED, held_out: DataFrame | None = None, **params) -> Outcome:
    """Boosted trees of all folds in step, on unscaled features; ``weights`` of the outcome holds the trees.

    Predictions are those of each fold by the trees that did not see it, or of ``held_out``.
    """
    settings = treefit.Settings(seed=seed, **params)
    spark, classes = prepared.rows.sparkSession, prepared.classes
    experiments = list(range(prepared.k))
    packed = durable(prep.pack(prep.select_k_best(prepared.params, budget)), "packed")
    # a file of few row groups is read by as few tasks, and each row becomes a row of every fold, then its cells
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = labelled(prepared.rows, classes).repartition(tasks, "cache_index")
    design = prep.transform(spread, packed, experiments, prepared.negative_policy, False)
    cuts = treefit.find_cuts(design, settings.max_bin)
    missing = sorted(set(experiments) - set(cuts))
    if missing:
        raise ValueError(f"folds {missing} have no usable gene to fit on")
    blocks = treefit.write_bins(design, cuts, settings.exact)
    trees = durable(treefit.grow_all(blocks, {e: prepared.training_counts(e) for e in experiments}, cuts, settings), "trees")
    selected = packed.select("eval_fold", F.posexplode("params").alias("position", "p")).select(
        F.col("eval_fold").alias("fold"), "position", F.col("p.gene_index").alias("gene_index")
    )
    shares = treefit.table_importances(trees, {e: len(cuts[e]) for e in experiments})
    gains = _parameter_table(prepared.rows, experiments, [shares[e] for e in experiments], None, "importance")
    importances = gains.join(selected, ["fold", "position"]).select("fold", "gene_index", "importance")
    scored = prepared.rows if held_out is None else held_out
    predictions = score_trees(scored, packed, trees, classes, prepared.negative_policy)
    return Outcome(predictions, None, importances, selected.select("fold", "gene_index"), None, packed, trees)


def score_trees(rows: DataFrame, packed: DataFrame, trees: DataFrame, classes: Sequence[str], negative_policy: str) -> DataFrame:
    """Predictions in the form of :func:`predict`, with class probabilities in the order of ``classes``."""
    two = len(classes) == 2
    experiments = [r[0] for r in packed.select("eval_fold").collect()]  # one row for each experiment
    design = prep.transform(rows, packed, experiments, negative_policy, False).where(F.col("fold") == F.col("eval_fold"))
    wanted = design.select("cache_index", "participant_barcode", "fold", "cancer_type", "eval_fold", "x")
    return _called(_with_chances(treefit.score(wanted, trees, 1 if two else len(classes)), two), classes, F.col("chances"))


def _called(found: DataFrame, classes: Sequence[str], scores: Column) -> DataFrame:
    """The class of the largest margin, the first of equal ones; two classes have one margin."""
    two = len(classes) == 2
    first = F.get("margins", F.lit(0))
    position = F.when(first > 0, 1).otherwise(0) if two else F.array_position("margins", F.array_max("margins")).cast("int") - 1
    return found.select(
        "cache_index",
        "participant_barcode",
        "fold",
        F.col("cancer_type").alias("true_label"),
        F.get(F.array(*[F.lit(c) for c in classes]), position).alias("predicted_label"),
        scores.alias("scores"),
        (first if two else F.lit(None).cast("double")).alias("margin"),
    )


def _parameter_table(rows: DataFrame, experiments: Sequence[int], arrays: Sequence[np.ndarray], classes: Sequence[str] | None, value: str):
    """Model parameters (driver side in MLlib) as a table keyed by experiment and feature position."""
    frames = []
    for experiment, array in zip(experiments, arrays, strict=True):
        table = np.atleast_2d(array)
        frames.append(
            pd.DataFrame(
                {
                    "fold": experiment,
                    "class": np.repeat(classes or [""], table.shape[1]),
                    "position": np.tile(np.arange(table.shape[1]), table.shape[0]),
                    value: table.ravel(),
                }
            )
        )
    return rows.sparkSession.createDataFrame(
        pd.concat(frames), f"fold int, class string, position int, {value} double"
    )


def cross_validate(
    prepared: Prepared,
    name: str,
    budget: int | str = "all",
    seed: int = DEFAULT_SEED,
    parallelism: int = 2,
    **params,
) -> Outcome:
    """Fit ``name`` once per fold and predict the fold it did not see."""
    if name == "dummy":
        return _prior_outcome(prepared)
    if name not in models.MODEL_NAMES:
        raise ValueError(f"unknown model {name!r}; choose from {models.MODEL_NAMES}")
    if name in LINEAR_MODELS:
        return fit_linear(prepared, [Request(name, budget, **params)])[0]
    if name == "boosted_trees":
        return fit_trees(prepared, budget, seed, **params)
    # the selection is small and fixed, so it is written once and every fit reads it
    packed = durable(prep.pack(prep.select_k_best(prepared.params, budget)), "packed")
    experiments = list(range(prepared.k))
    job = inheritable_thread_target(prepared.rows.sparkSession)(
        lambda e: fit_experiment(prepared, packed, name, e, seed, True, params)
    )
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fitted = list(pool.map(job, experiments))
    predictions = None
    for model, held_out in fitted:
        part = predict(model, held_out, prepared.classes)
        predictions = part if predictions is None else predictions.unionByName(part)
    selected = packed.select("eval_fold", F.posexplode("params").alias("position", "p")).select(
        F.col("eval_fold").alias("fold"), "position", F.col("p.gene_index").alias("gene_index")
    )
    coefficients = None
    matrices = [models.coefficient_matrix(model, len(prepared.classes)) for model, _ in fitted]
    if name != "pca_logistic" and matrices[0] is not None:
        table = _parameter_table(prepared.rows, experiments, matrices, prepared.classes, "coefficient")
        coefficients = table.join(selected, ["fold", "position"]).select("fold", "class", "gene_index", "coefficient")
    return Outcome(predictions, coefficients, None, selected.select("fold", "gene_index"))


def _prior_outcome(prepared: Prepared) -> Outcome:
    """Majority class and class priors of the training rows of each fold."""
    best, priors = [], []
    for experiment in range(prepared.k):
        counts = prepared.training_counts(experiment)
        best.append(prepared.classes[max(range(len(counts)), key=lambda i: (counts[i], -i))])
        priors.append([n / sum(counts) for n in counts])
    prior = F.array(*[F.array(*[F.lit(p) for p in row]) for row in priors])
    predictions = prepared.rows.select(
        "cache_index",
        "participant_barcode",
        "fold",
        F.col("cancer_type").alias("true_label"),
        F.get(F.array(*[F.lit(b) for b in best]), F.col("fold")).alias("predicted_label"),
        F.get(prior, F.col("fold")).alias("scores"),
        F.lit(None).cast("double").alias("margin"),
    )
    empty = prepared.rows.sparkSession.createDataFrame([], "fold int, gene_index int")
    return Outcome(predictions, None, None, empty)


def benchmark(
    development: DataFrame,
    names: Iterable[str] = CLASSICAL_MODELS,
    k: int = DEFAULT_FOLDS,
    seed: int = DEFAULT_SEED,
    scaler: str = "standard",
    negative_policy: str = "error",
    model_params: dict[str, dict] | None = None,
    parallelism: int = 2,
) -> DataFrame:
    """Cross-validated metrics of several models: ``(model, metric, mean, std, fold_values)``."""
    wanted = list(names)
    if len(set(wanted)) != len(wanted):
        raise ValueError("model list contains duplicates")
    unknown = sorted(set(wanted) - set(models.MODEL_NAMES))
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    prepared = prepare(freeze_folds(development, k, seed), k, scaler, negative_policy)
    given = model_params or {}
    linear = [name for name in wanted if name in LINEAR_MODELS]
    together = dict(zip(linear, fit_linear(prepared, [Request(name, **given.get(name, {})) for name in linear]))) if linear else {}
    parts = None
    for name in wanted:
        outcome = together.get(name) or cross_validate(prepared, name, seed=seed, parallelism=parallelism, **given.get(name, {}))
        rows = outcome.predictions.select(F.lit(name).alias("model"), "fold", "true_label", "predicted_label")
        parts = rows if parts is None else parts.unionByName(rows)
    return metrics.metric_summary(metrics.overall(parts, ["model", "fold"]), ["model"])


def feature_budget(
    development: DataFrame,
    genes: DataFrame,
    name: str = "elastic_net",
    budgets: Iterable[int | str] = GENE_BUDGETS,
    k: int = DEFAULT_FOLDS,
    seed: int = DEFAULT_SEED,
    scaler: str = "standard",
    negative_policy: str = "error",
    parallelism: int = 2,
    **params,
) -> dict[str, DataFrame]:
    """Metrics, stability and coefficients per budget.

    F does not depend on the budget, so the genes are ranked once and each budget is a
    filter on the rank.
    """
    if name not in LINEAR_MODELS:
        raise ValueError(f"feature-budget model must be one of {LINEAR_MODELS}")
    prepared = prepare(freeze_folds(development, k, seed), k, scaler, negative_policy)
    predictions = coefficients = None
    wanted = list(parse_budgets(budgets))
    for budget, outcome in zip(wanted, fit_linear(prepared, [Request(name, budget, **params) for budget in wanted])):
        key = F.lit(str(budget)).alias("gene_budget")
        rows = outcome.predictions.select(key, "fold", "true_label", "predicted_label")
        weights = outcome.coefficients.select(key, "*")
        predictions = rows if predictions is None else predictions.unionByName(rows)
        coefficients = weights if coefficients is None else coefficients.unionByName(weights)
    coefficients = durable(coefficients, "coefficients")
    sizes = (
        coefficients.groupBy("gene_budget", "fold").agg(F.count_distinct("gene_index").alias("n"))
        .groupBy("gene_budget")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "n"))), lambda s: s["n"]).alias("selected_per_fold"))
    )
    summary = metrics.metric_summary(metrics.overall(predictions, ["gene_budget", "fold"]), ["gene_budget"])
    return {
        "metrics": summary.join(sizes, "gene_budget"),
        "stability": matrix.annotate(interpret.feature_stability(coefficients, k, ["gene_budget"]), genes),
        "coefficients": matrix.annotate(coefficients, genes),
    }


def pair_study(
    development: DataFrame,
    genes: DataFrame,
    pair: tuple[str, str],
    name: str = "elastic_net",
    budget: int | str = 1_000,
    k: int = DEFAULT_FOLDS,
    seed: int = DEFAULT_SEED,
    scaler: str = "standard",
    negative_policy: str = "error",
    parallelism: int = 2,
    **params,
) -> dict[str, DataFrame]:
    """Two classes told apart: out-of-fold predictions, errors, metrics, confusion and genes."""
    if name not in LINEAR_MODELS:
        raise ValueError(f"focused-pair model must be one of {LINEAR_MODELS}")
    class_a, class_b = pair
    rows = matrix.pair_filter(development, class_a, class_b, k)
    prepared = prepare(freeze_folds(rows, k, seed), k, scaler, negative_policy)
    outcome = cross_validate(prepared, name, parse_budget(budget), seed, parallelism, **params)
    classes = prepared.classes
    sign = 1.0 if classes[1] == class_b else -1.0
    toward_b = outcome.predictions.withColumn("margin", F.col("margin") * F.lit(sign))
    predictions = durable(metrics.error_flags(toward_b).drop("scores"), "pair-predictions")
    per_fold = metrics.overall(predictions, ["fold"])
    gene_rows = interpret.pair_gene_interpretation(outcome.coefficients, class_a, class_b, k)
    return {
        "predictions": predictions,
        "coverage": metrics.coverage(predictions, prepared.rows),
        "errors": metrics.ranked_errors(predictions),
        "metrics": metrics.overall(predictions),
        "fold_metrics": metrics.metric_summary(
            per_fold.withColumn("pair", F.lit(f"{class_a}/{class_b}")), ["pair"], ("macro_f1", "balanced_accuracy", "accuracy")
        ),
        "per_class": metrics.per_class(predictions),
        "confusion": metrics.confusion_grid(predictions),
        "genes": matrix.annotate(gene_rows, genes),
    }


def pair_studies(
    development: DataFrame,
    genes: DataFrame,
    pairs: dict[str, tuple[str, str]] | None = None,
    names: Iterable[str] = ("elastic_net",),
    **options,
) -> tuple[dict[tuple[str, str], dict[str, DataFrame]], DataFrame]:
    """All (pair, model) studies and their ranking, hardest first."""
    from exprstudy.operators.compare import hardest_first

    studies = {}
    ranking = None
    for pair_name, pair in (pairs or FOCUSED_PAIRS).items():
        for name in names:
            study = pair_study(development, genes, pair, name, **options)
            studies[pair_name, name] = study
            row = study["metrics"].select(
                F.lit(pair_name).alias("pair"), F.lit(name).alias("model"), "macro_f1", "balanced_accuracy", "n_errors"
            )
            ranking = row if ranking is None else ranking.unionByName(row)
    return studies, hardest_first(ranking)


def boosted_trees(
    development: DataFrame,
    genes: DataFrame,
    budget: int | str = 1_000,
    k: int = DEFAULT_FOLDS,
    seed: int = DEFAULT_SEED,
    negative_policy: str = "error",
    parallelism: int = 2,
    **params,
) -> dict[str, DataFrame]:
    """Cross-validated boosted trees (unscaled features) and mean importances."""
    prepared = prepare(freeze_folds(development, k, seed), k, "standard", negative_policy)
    outcome = cross_validate(prepared, "boosted_trees", budget, seed, parallelism, **params)
    return {
        "predictions": outcome.predictions,
        "metrics": metrics.metric_summary(
            metrics.overall(outcome.predictions, ["fold"]).withColumn("model", F.lit("boosted_trees")), ["model"]
        ),
        "importances": matrix.annotate(interpret.importance_aggregate(outcome.importances, k), genes),
    }
