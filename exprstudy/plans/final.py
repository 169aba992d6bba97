"""The one-time evaluation on the holdout.

Order matters because Spark is lazy: the lock is verified on digests only, then the
receipt is reserved, and only then is a DataFrame over holdout rows built.
"""

from __future__ import annotations

import posixpath
from datetime import datetime, timezone

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exprstudy.constants import BOOSTED_DEFAULTS, FINAL_SCOPE, LINEAR_MODELS, SPLITS
from exprstudy.functions.checks import assert_no_violations
from exprstudy.operators import lock, matrix, metrics, models, prep, split
from exprstudy.plans import studies
from exprstudy.session import durable
from exprstudy.sources.sinks import create_document, exists, read_document, write_summary, write_table

MODEL_OF_FAMILY = {"pca_logistic": "pca_logistic", "xgboost": "boosted_trees"}


def _stamp() -> str:
    return datetime.now(timezone.utc).isoformat()


def _inside(path: str, folder: str) -> bool:
    path, folder = posixpath.normpath(path), posixpath.normpath(folder)
    return path == folder or path.startswith(folder + "/")


def fit_and_score(rows: DataFrame, split_manifest: DataFrame, selection: dict, **overrides) -> dict[str, DataFrame]:
    """Fit the selected model on development rows and score the holdout rows once."""
    chosen = dict(selection)
    policy = chosen["negative_policy"]
    development = matrix.development_matrix(rows, split_manifest).withColumn("fold", F.lit(prep.WHOLE_FOLD))
    prepared = studies.prepare(development, 1, chosen.get("scaler", "standard"), policy)
    name = MODEL_OF_FAMILY.get(chosen["family"], chosen.get("model"))
    known = ("pca_components", *BOOSTED_DEFAULTS)
    params = {key: chosen[key] for key in known if key in chosen} | overrides
    holdout = matrix.join_split(rows, split_manifest, SPLITS[1]).withColumn("fold", F.lit(0))
    if name in LINEAR_MODELS:
        request = studies.Request(name, chosen.get("gene_budget", "all"), **params)
        outcome = studies.fit_linear(prepared, [request], holdout)[0]
        loss = request.settings()["loss"]
        how = {"model": name, "classes": prepared.classes, "negative_policy": policy, "scaled": True, "loss": loss}
        return _results(name, prepared.classes, outcome.weights, outcome.packed, how, outcome.predictions)
    if name == "boosted_trees":
        outcome = studies.fit_trees(prepared, chosen["gene_budget"], chosen["seed"], holdout, **params)
        how = {"model": name, "classes": prepared.classes, "negative_policy": policy, "scaled": False}
        return {
            **_results(name, prepared.classes, outcome.weights, outcome.packed, how, outcome.predictions),
            "importances": outcome.importances.select("gene_index", "importance"),
        }
    packed = durable(prep.pack(prep.select_k_best(prepared.params, chosen.get("gene_budget", "all"))), "packed")
    if name == "pca_logistic":
        width = packed.select(F.size("params")).first()[0]
        largest = min(width, prepared.n_rows() - 1)
        if params["pca_components"] > largest:
            raise ValueError(f"locked PCA components exceed the final-fit maximum ({largest})")
        params["components"] = params.pop("pca_components")
    # held-out rows play fold 0 of the single experiment 0
    both = studies.Prepared(
        development.unionByName(holdout), prepared.params, prepared.classes, prepared.sizes, 1, policy
    )
    fitted, held_out = studies.fit_experiment(both, packed, name, 0, chosen["seed"], True, params)
    how = {"model": name, "classes": prepared.classes, "negative_policy": policy, "scaled": True}
    return _results(name, prepared.classes, fitted, packed, how, studies.predict(fitted, held_out, prepared.classes))


def _results(name: str, classes: list[str], fitted, packed: DataFrame, how: dict, scored: DataFrame) -> dict:
    predictions = durable(scored, "final-predictions")
    overall = metrics.overall(predictions).withColumn("_k", F.lit(1))
    if name in models.WITH_PROBABILITY:
        chances = metrics.log_loss(predictions, classes).withColumn("_k", F.lit(1))
        areas = metrics.macro_auc(predictions, classes).withColumn("_k", F.lit(1))
        overall = overall.join(chances, "_k").join(areas, "_k")
    else:
        overall = overall.select(
            "*",
            F.lit(None).cast("double").alias("multiclass_log_loss"),
            F.lit(None).cast("double").alias("ovr_roc_auc_macro"),
            F.lit("the locked model has no class probabilities").alias("note"),
        )
    return {
        "model": fitted,
        "parameters": packed,
        "description": how,
        "predictions": predictions,
        "metrics": overall.drop("_k"),
        "per_class": metrics.per_class(predictions),
        "confusion": metrics.confusion_grid(predictions),
        "errors": metrics.error_pattern(predictions),
    }


def save_model(spark: SparkSession, results: dict, outdir: str) -> None:
    """Write what scoring new rows needs: the model, the parameters of its features, and how they are used."""
    if isinstance(results["model"], DataFrame):  # weights of linear models, or trees
        write_table(results["model"], f"{outdir}/model")
    else:
        results["model"].write().save(f"{outdir}/model")
    write_table(results["parameters"], f"{outdir}/parameters")
    create_document(spark, f"{outdir}/model.json", results["description"])


def load_and_score(spark: SparkSession, outdir: str, rows: DataFrame) -> DataFrame:
    """Predictions of a saved model for matrix rows with ``cancer_type`` (null where it is not known)."""
    how = read_document(spark, f"{outdir}/model.json")
    packed = spark.read.parquet(f"{outdir}/parameters")
    rows = rows.withColumn("fold", F.lit(0))
    if "loss" in how:
        weights = spark.read.parquet(f"{outdir}/model")
        return studies.score_linear(rows, packed, weights, how["classes"], how["negative_policy"], how["loss"])
    if how["model"] == "boosted_trees":
        return studies.score_trees(rows, packed, spark.read.parquet(f"{outdir}/model"), how["classes"], how["negative_policy"])
    model = DefaultParamsReader.loadParamsInstance(f"{outdir}/model", spark)
    design = prep.transform(rows, packed, [0], how["negative_policy"], how["scaled"])
    design = models.as_vectors(studies.labelled(design, how["classes"]))
    return studies.predict(model, design, how["classes"])


def artifacts_of(rows: DataFrame, split_manifest: DataFrame, genes: DataFrame) -> DataFrame:
    features = F.array_join(F.transform("features", lambda v: v.cast("string")), ",", "NULL")
    return lock.artifact_digests(
        {
            "matrix": (rows, ["cache_index", features]),
            "split_manifest": (split_manifest, ["cache_index", "participant_barcode", "cancer_type", "split"]),
            "gene_table": (genes, ["gene_index", "source_gene_id", "symbol", "entrez_id"]),
        }
    )


def run(
    spark: SparkSession,
    lock_path: str,
    rows: DataFrame,
    split_manifest: DataFrame,
    genes: DataFrame,
    outdir: str,
    receipt_dir: str,
    evidence: DataFrame | None = None,
    **overrides,
) -> dict[str, DataFrame]:
    """Verify, reserve the receipt, evaluate once, and record the final state.

    The receipt is a folder of write-once documents: ``started.json`` and then
    ``completed.json`` or ``failed.json``.  A second run fails on ``started.json``.
    """
    document = lock.load(spark, lock_path)
    lock.assert_verified(spark, document, artifacts_of(rows, split_manifest, genes), evidence)
    if _inside(receipt_dir, outdir):
        raise ValueError("receipt must be outside the final output directory")
    if exists(spark, outdir):
        raise FileExistsError(f"refusing to reuse an existing final output directory: {outdir}")
    head = {"lock_sha256": document["lock_sha256"], "output_directory": outdir, "holdout_used": True, "evaluation_scope": FINAL_SCOPE}
    create_document(spark, f"{receipt_dir}/started.json", {**head, "status": "holdout_access_started", "at_utc": _stamp()})
    try:
        assert_no_violations(split.split_constraints(split_manifest, rows))
        results = fit_and_score(rows, split_manifest, document["selection"]["pipeline"], **overrides)
        for name in ("predictions", "confusion", "per_class", "errors"):
            write_table(results[name], f"{outdir}/{name}")
        if "importances" in results:
            write_table(results["importances"], f"{outdir}/importances")
        write_summary(results["metrics"], f"{outdir}/metrics")
        save_model(spark, results, outdir)
        digests = lock.artifact_digests(
            {name: (results[name], list(results[name].columns)) for name in ("confusion", "per_class")}
        )
        outputs = {row["artifact"]: row["sha256"] for row in digests.collect()}
        create_document(spark, f"{receipt_dir}/completed.json", {**head, "status": "completed", "at_utc": _stamp(), "outputs": outputs})
        return results
    except Exception as problem:
        failure = {"status": "failed_after_holdout_reservation", "error_type": type(problem).__name__, "error": str(problem)}
        create_document(spark, f"{receipt_dir}/failed.json", {**head, **failure, "at_utc": _stamp()})
        raise
