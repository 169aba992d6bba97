import numpy as np
import pytest
from conftest import planted
from pyspark.sql import functions as F

from exprstudy.operators import blockfit, models, prep
from exprstudy.plans import studies


@pytest.fixture(scope="module")
def study(spark):
    rows, values, labels = planted(spark, n_per_class=16, n_genes=9, strength=1.6, missing=0.05)
    folded = studies.freeze_folds(rows, 3)
    return studies.prepare(folded, 3, negative_policy="error")


def design(study, experiment):
    """Training rows of one experiment through the row-wise path: features, class positions, weights."""
    packed = prep.pack(prep.select_k_best(study.params, "all"))
    rows = prep.transform(study.rows, packed, [experiment], study.negative_policy)
    rows = studies.labelled(rows, study.classes).where(F.col("fold") != experiment).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([int(r["label"]) for r in rows])
    counts = np.array(study.training_counts(experiment), float)
    return x, y, (counts.sum() / (len(counts) * counts))[y]


def tables(outcome, study, experiment):
    rows = outcome.coefficients.where(F.col("fold") == experiment).collect()
    genes = sorted({r["gene_index"] for r in rows})
    found = np.zeros((len(study.classes), len(genes)))
    for r in rows:
        found[study.classes.index(r["class"]), genes.index(r["gene_index"])] = r["coefficient"]
    return found


def chances(z):
    raised = np.exp(z - z.max(1, keepdims=True))
    return raised / raised.sum(1, keepdims=True)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4))
    missing = rng.random(x.shape) < 0.2
    for loss, classes in (("logistic", 3), ("logistic", 2), ("squared_hinge", 3), ("squared_hinge", 2)):
        labels = rng.integers(0, classes, 30)
        block = rng.integers(0, 3, 30), labels, np.where(missing, 0.0, x), missing
        genes = np.array([0, 2, 3])
        problem = blockfit.Problem(1, genes, np.full(3, 0.3), np.full(3, 0.2), np.array([0.5, 2.0, 1.0]), list(np.bincount(labels, minlength=classes)), loss)
        point = rng.normal(size=problem.size)
        got = blockfit.block_gradient(problem, point, block)
        for i in range(problem.size):
            step = np.eye(problem.size)[i] * 1e-6
            slope = (blockfit.block_gradient(problem, point + step, block)[0] - blockfit.block_gradient(problem, point - step, block)[0]) / 2e-6
            assert got[1 + i] == pytest.approx(slope, rel=1e-4, abs=1e-5)


def test_folds_fitted_together_are_optimal_each(study):
    l2, net = studies.fit_linear(study, [studies.Request("logistic_l2"), studies.Request("elastic_net", C=0.2)])
    assert all(r["converged"] for r in [*l2.fits.collect(), *net.fits.collect()])
    zeros = 0
    for experiment in range(3):
        x, y, s = design(study, experiment)
        for outcome, strength, ratio in ((l2, 1.0, 0.0), (net, 0.2, 0.5)):
            w = tables(outcome, study, experiment)
            # intercepts are free: find them again by Newton steps on the plain loss
            b = np.zeros(len(study.classes))
            for _ in range(200):
                p = chances(x @ w.T + b)
                g = (s[:, None] * (p - np.eye(len(b))[y])).sum(0)
                b -= np.linalg.pinv((s[:, None, None] * (np.einsum("ni,ij->nij", p, np.eye(len(b))) - np.einsum("ni,nj->nij", p, p))).sum(0)) @ g
            p = chances(x @ w.T + b)
            slope = (s[:, None] * (p - np.eye(len(b))[y])).T @ x / len(y) + (1 - ratio) * w / (strength * len(y))
            l1 = np.full(w.size, ratio / (strength * len(y)))
            assert np.abs(blockfit.pseudo_gradient(w.ravel(), slope.ravel(), l1)).max() < 5e-6
            zeros += int((w == 0).sum()) if ratio else 0
    assert zeros > 0


def test_coefficients_equal_single_fits(study):
    together = studies.fit_linear(study, [studies.Request("logistic_l2")])[0]
    packed = prep.pack(prep.select_k_best(study.params, "all"))
    for experiment in range(3):
        rows = prep.transform(study.rows, packed, [experiment], study.negative_policy)
        rows = models.as_vectors(studies.labelled(rows, study.classes)).where(F.col("fold") != experiment)
        counts = study.training_counts(experiment)
        train = studies._weighted(rows, counts).select("x", "label", "weight")
        alone = models.logistic(sum(counts), 0.0, 2_000).setTol(1e-13).fit(train)
        want = alone.coefficientMatrix.toArray()
        got = tables(together, study, experiment)
        assert np.abs((got - got.mean(0)) - (want - want.mean(0))).max() < 1e-4


def test_squared_hinge_is_optimal(study):
    svm = studies.fit_linear(study, [studies.Request("linear_svm")])[0]
    assert all(r["converged"] for r in svm.fits.collect())
    x, y, s = design(study, 0)
    counts = study.training_counts(0)
    w = tables(svm, study, 0)
    for c in range(len(study.classes)):
        sign, cost = np.where(y == c, 1.0, -1.0), np.where(y == c, s, 1.0)
        wide = np.hstack([x, np.ones((len(x), 1))])
        point = np.zeros(wide.shape[1])
        for _ in range(50):  # Newton on the primal, intercept penalised like a weight
            gap = np.maximum(0, 1 - sign * (wide @ point))
            active = gap > 0
            slope = point - 2 * wide.T @ (cost * sign * gap)
            bend = np.eye(len(point)) + 2 * (wide[active] * cost[active, None]).T @ wide[active]
            point = point - np.linalg.solve(bend, slope)
        assert np.abs(point[:-1] - w[c]).max() < 1e-3
    assert sum(counts) == len(x)


def test_budgets_together_equal_budgets_alone(study):
    both = studies.fit_linear(study, [studies.Request("logistic_l2", 4), studies.Request("logistic_l2", "all")])
    alone = studies.fit_linear(study, [studies.Request("logistic_l2", 4)])[0]
    key = ["fold", "class", "gene_index"]
    joined = both[0].coefficients.join(alone.coefficients.withColumnRenamed("coefficient", "again"), key)
    assert joined.count() == 3 * 3 * 4
    assert joined.where(F.abs(F.col("coefficient") - F.col("again")) > 1e-9).count() == 0


def test_equal_budgets_are_fitted_once(study, monkeypatch):
    asked, plain = [], blockfit.fit_all
    monkeypatch.setattr(blockfit, "fit_all", lambda blocks, problems: asked.extend(problems) or plain(blocks, problems))
    four, many, whole = studies.fit_linear(study, [studies.Request("logistic_l2", b) for b in (4, 1_000, "all")])
    assert len(asked) == 3 * 2
    assert [o.coefficients.count() for o in (four, many, whole)] == [3 * 3 * 4, 3 * 3 * 9, 3 * 3 * 9]


def test_all_cores_take_part_in_a_step(spark, monkeypatch):
    rows, _, _ = planted(spark, n_per_class=40, n_genes=9)
    blocks = blockfit.write_blocks(studies.labelled(rows.withColumn("fold", F.lit(0)), ["A", "B", "C"]), "error")
    assert blockfit.load_blocks(blocks).getNumPartitions() == 1
    monkeypatch.setattr(blockfit, "LEAST_BYTES", 1_000)
    assert blockfit.load_blocks(blocks).getNumPartitions() == spark.sparkContext.defaultParallelism


def test_two_classes_and_scores(spark):
    rows, _, _ = planted(spark, n_per_class=15, classes=("A", "B"), n_genes=4, strength=5.0)
    study = studies.prepare(studies.freeze_folds(rows, 3), 3)
    for name in ("logistic_l2", "elastic_net", "linear_svm"):
        outcome = studies.cross_validate(study, name)
        got = outcome.predictions.collect()
        assert len(got) == 30 and {r["fold"] for r in got} == {0, 1, 2}
        assert all((r["margin"] > 0) == (r["predicted_label"] == "B") and len(r["scores"]) == 2 for r in got)
        assert sum(r["true_label"] == r["predicted_label"] for r in got) >= 27
    assert outcome.coefficients.groupBy("fold", "gene_index").agg(F.sum("coefficient").alias("s")).where("abs(s) > 1e-12").count() == 0


def test_an_unfinished_fit_says_so(study):
    fits = studies.fit_linear(study, [studies.Request("logistic_l2", max_iter=1)])[0].fits.collect()
    assert all(not r["converged"] and r["iterations"] == 1 for r in fits)


def test_certificates_tell_optima_from_other_points(spark, study):
    for request in (studies.Request("logistic_l2"), studies.Request("elastic_net", C=0.2), studies.Request("linear_svm")):
        outcome = studies.fit_linear(study, [request])[0]
        found = studies.optimality(study, outcome, request).collect()
        assert len(found) == 3 * 3 * (9 + 1) and sum(r["gene_index"] is None for r in found) == 9
        assert max(r["violation"] for r in found) < 1e-5
    early = studies.Request("logistic_l2", max_iter=1)
    found = studies.optimality(study, studies.fit_linear(study, [early])[0], early)
    assert found.where("violation > 1e-3").count() > 10
