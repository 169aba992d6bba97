import numpy as np
import pytest
from conftest import gene_table, planted
from pyspark.sql import functions as F
from test_metrics import evidence

from exprstudy.operators import lock, matrix, models, split
from exprstudy.plans import final, studies
from exprstudy.session import durable
from exprstudy.sources.sinks import exists, read_document


@pytest.fixture(scope="module")
def world(spark):
    rows, values, labels = planted(spark, n_per_class=20, n_genes=9, strength=5.0)
    manifest = durable(split.holdout(rows.drop("features")))
    return rows, manifest, gene_table(spark, 9)


def test_models_beat_the_prior(world):
    rows, manifest, _ = world
    found = studies.benchmark(
        matrix.development_matrix(rows, manifest),
        ("dummy", "logistic_l2", "elastic_net", "pca_logistic"),
        k=3,
        model_params={"logistic_l2": {"max_iter": 50}, "elastic_net": {"max_iter": 50}, "pca_logistic": {"max_iter": 50}},
        parallelism=3,
    )
    macro = {r["model"]: r for r in found.where("metric = 'macro_f1'").collect()}
    for name in ("logistic_l2", "elastic_net", "pca_logistic"):
        assert macro[name]["mean"] > macro["dummy"]["mean"] + 0.4
        assert len(macro[name]["fold_values"]) == 3


def test_svm_and_trees_find_the_signal(world):
    rows, manifest, genes = world
    development = matrix.development_matrix(rows, manifest)
    found = studies.benchmark(development, ("linear_svm",), k=2, model_params={"linear_svm": {"max_iter": 10}})
    assert found.where("metric = 'macro_f1'").first()["mean"] > 0.7
    trees = studies.boosted_trees(development, genes, 6, 2, n_estimators=3, max_depth=2, max_bin=16, learning_rate=0.3)
    assert trees["metrics"].where("metric = 'macro_f1'").first()["mean"] > 0.7
    gains = trees["importances"].collect()
    assert all(r["selected_folds"] <= 2 and r["mean_gain_importance"] >= 0 for r in gains)


def test_budget_study_tables(world):
    rows, manifest, genes = world
    found = studies.feature_budget(
        matrix.development_matrix(rows, manifest), genes, "logistic_l2", (3, "all"), k=2, max_iter=20
    )
    sizes = {r["gene_budget"]: r["selected_per_fold"] for r in found["metrics"].where("metric = 'accuracy'").collect()}
    assert sizes == {"3": [3, 3], "all": [9, 9]}
    stability = found["stability"].where("gene_budget = 'all'").collect()
    assert {r["gene_index"] for r in stability} == set(range(9)) and all(r["selection_frequency"] == 1.0 for r in stability)
    wide = {(r["fold"], r["class"]) for r in found["coefficients"].collect()}
    assert wide == {(f, c) for f in range(2) for c in "ABC"}
    with pytest.raises(ValueError, match="must be one of"):
        studies.feature_budget(rows, genes, "dummy")


def test_pair_study_never_shows_holdout(world):
    rows, manifest, genes = world
    study, ranking = studies.pair_studies(
        matrix.development_matrix(rows, manifest), genes, {"a_b": ("A", "B")}, ("logistic_l2",), budget=6, k=2, max_iter=20
    )
    got = study["a_b", "logistic_l2"]
    seen = {r[0] for r in got["predictions"].select("participant_barcode").collect()}
    held = {r[0] for r in manifest.where("split = 'holdout'").select("participant_barcode").collect()}
    assert seen and not seen & held
    assert {r["coverage"] for r in got["coverage"].collect()} == {"once"}
    assert got["metrics"].first()["macro_f1"] > 0.8 and ranking.first()["pair"] == "a_b"
    # a positive margin means class B, so calls and margins agree
    assert got["predictions"].where("(margin > 0) <> (predicted_label = 'B')").count() == 0
    direction = {r["gene_index"]: r["direction"] for r in got["genes"].collect()}
    assert all(direction[g] == "A" for g in range(3) if g in direction)
    assert all(direction[g] == "B" for g in range(3, 6) if g in direction)


def test_pair_needs_enough_rows(world):
    rows, manifest, _ = world
    development = matrix.development_matrix(rows, manifest)
    with pytest.raises(Exception, match="at least 99"):
        matrix.pair_filter(development, "A", "B", 99).collect()


def test_wide_projection_spans_the_pca_plane(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 12)) + 5
    rows = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>").select(array_to_vector("x").alias("x"))
    projected = models.wide_projection(rows, 3)(rows).select(vector_to_array("pc").alias("pc")).collect()
    got = np.array([r["pc"] for r in projected])
    assert np.abs(got).sum(0).min() > 0
    centred = x - x.mean(0)
    assert (got**2).sum() == pytest.approx((centred**2).sum(), rel=1e-6)


def test_decompositions_of_folds_run_one_at_a_time(spark, monkeypatch):
    import threading
    import time
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(r.tolist(),) for r in rng.normal(size=(30, 6))], "x array<double>").select(array_to_vector("x").alias("x")).cache()
    running, most, guard, plain = [0], [0], threading.Lock(), models.RowMatrix.computeSVD

    def watched(self, *args):
        with guard:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(1)
        try:
            return plain(self, *args)
        finally:
            with guard:
                running[0] -= 1

    monkeypatch.setattr(models.RowMatrix, "computeSVD", watched)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: models.principal_axes(rows, 3), range(4)))
    assert most[0] == 1


def test_final_query_locks_evidence_that_is_found_once(spark, monkeypatch):
    import secrets

    from exprstudy.plans import queries, roles

    rows, _, _ = planted(spark, n_per_class=20, n_genes=9, strength=5.0)
    monkeypatch.setattr(roles, "matrix", lambda *_: rows)
    monkeypatch.setattr(roles, "genes", lambda *_: gene_table(spark, 9))
    # documents whose text is another one each time they are found
    blank = F.udf(lambda: " " * secrets.randbelow(100_000)).asNondeterministic()()
    monkeypatch.setattr(roles, "evidence", lambda *_: evidence(spark).withColumn("document", F.concat("document", blank)))
    found = queries._final(spark, "unused", SELECTION["candidate_id"], SELECTION["pipeline"])
    assert found["predictions"].count() == 12


SELECTION = {
    "candidate_id": "feature-budget:logistic_l2:6",
    "selection_rationale": "small and stable",
    "pipeline": {"family": "linear_gene_budget", "model": "logistic_l2", "gene_budget": 6},
}


def test_selection_config_is_strict():
    full = lock.normalise_selection(SELECTION)
    assert full["pipeline"]["scaler"] == "standard" and full["pipeline"]["negative_policy"] == "error"
    trees = lock.normalise_selection({**SELECTION, "pipeline": {"family": "xgboost"}})["pipeline"]
    assert trees["n_estimators"] == 300 and trees["max_bin"] == 256
    for change in (
        {"extra": 1},
        {"primary_metric": "accuracy"},
        {"candidate_id": " "},
        {"pipeline": {"family": "forest"}},
        {"pipeline": {**SELECTION["pipeline"], "surprise": 1}},
        {"pipeline": {**SELECTION["pipeline"], "gene_budget": 0}},
        {"pipeline": {"family": "xgboost", "subsample": 1.5}},
        {"pipeline": {"family": "pca_logistic", "pca_components": 0}},
    ):
        with pytest.raises(ValueError):
            lock.normalise_selection({**SELECTION, **change})


def test_holdout_is_evaluated_once(spark, world, tmp_path):
    rows, manifest, genes = world
    path, out, receipt = (str(tmp_path / n) for n in ("lock.json", "out", "receipt"))
    proof = evidence(spark)
    lock.create(spark, path, SELECTION, final.artifacts_of(rows, manifest, genes), proof)
    with pytest.raises(FileExistsError):
        lock.create(spark, path, SELECTION, final.artifacts_of(rows, manifest, genes), proof)
    with pytest.raises(ValueError, match="outside"):
        final.run(spark, path, rows, manifest, genes, out, out + "/receipt", proof)
    # a changed table is refused before any receipt exists
    other = durable(split.holdout(rows.drop("features"), seed=5))
    with pytest.raises(ValueError, match="split_manifest digest_mismatch"):
        final.run(spark, path, rows, other, genes, out, receipt, proof)
    assert not exists(spark, receipt)
    results = final.run(spark, path, rows, manifest, genes, out, receipt, proof, max_iter=30)
    assert read_document(spark, receipt + "/completed.json")["status"] == "completed"
    scored = {r[0] for r in results["predictions"].select("participant_barcode").collect()}
    assert scored == {r[0] for r in manifest.where("split = 'holdout'").select("participant_barcode").collect()}
    row = results["metrics"].first()
    assert row["macro_f1"] > 0.7 and 0 < row["multiclass_log_loss"] < 2 and row["ovr_roc_auc_macro"] > 0.8
    assert spark.read.parquet(out + "/predictions").count() == len(scored)
    # the saved model gives the same predictions again
    again = final.load_and_score(spark, out, matrix.join_split(rows, manifest, "holdout"))
    answers = {r[0]: (r[1], r[2]) for r in again.select("participant_barcode", "predicted_label", "scores").collect()}
    first = {r[0]: (r[1], r[2]) for r in results["predictions"].select("participant_barcode", "predicted_label", "scores").collect()}
    assert answers.keys() == first.keys() and all(answers[k][0] == first[k][0] for k in first)
    assert all(answers[k][1] == pytest.approx(first[k][1]) for k in first)
    with pytest.raises(FileExistsError):
        final.run(spark, path, rows, manifest, genes, out, receipt, proof)
    with pytest.raises(FileExistsError, match="started"):
        final.run(spark, path, rows, manifest, genes, out + "2", receipt, proof)


def test_saved_axes_score_new_rows_of_a_wide_matrix(spark, tmp_path):
    rows, _, _ = planted(spark, n_per_class=10, n_genes=4_200, strength=5.0)
    manifest = durable(split.holdout(rows.drop("features")))
    chosen = {"family": "pca_logistic", "pca_components": 4, "gene_budget": "all", "negative_policy": "error", "scaler": "standard", "seed": 1}
    results = final.fit_and_score(rows, manifest, chosen, max_iter=30)
    final.save_model(spark, results, str(tmp_path / "out"))
    again = final.load_and_score(spark, str(tmp_path / "out"), matrix.join_split(rows, manifest, "holdout"))
    want = {r[0]: (r[1], r[2]) for r in results["predictions"].select("participant_barcode", "predicted_label", "scores").collect()}
    got = {r[0]: (r[1], r[2]) for r in again.select("participant_barcode", "predicted_label", "scores").collect()}
    assert got.keys() == want.keys() and results["metrics"].first()["macro_f1"] > 0.7
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_failure_after_reservation_is_recorded(spark, world, tmp_path):
    rows, manifest, genes = world
    path, receipt = str(tmp_path / "lock.json"), str(tmp_path / "receipt")
    negative = rows.withColumn("features", F.transform("features", lambda v: v - 5))
    lock.create(spark, path, SELECTION, final.artifacts_of(negative, manifest, genes), evidence(spark))
    with pytest.raises(Exception, match="negative value"):
        final.run(spark, path, negative, manifest, genes, str(tmp_path / "out"), receipt)
    assert read_document(spark, receipt + "/failed.json")["status"] == "failed_after_holdout_reservation"


def test_changed_lock_is_refused(spark, world, tmp_path):
    import json

    rows, manifest, genes = world
    path = tmp_path / "lock.json"
    lock.create(spark, str(path), SELECTION, final.artifacts_of(rows, manifest, genes), evidence(spark))
    document = json.loads(path.read_text())
    document["selection"]["pipeline"]["gene_budget"] = 3
    changed = tmp_path / "changed.json"
    changed.write_text(json.dumps(document))
    with pytest.raises(ValueError, match="lock was changed"):
        lock.load(spark, str(changed))
