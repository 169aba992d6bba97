"""Boosted trees against a plain version that looks at every value of every node."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from conftest import gene_table, planted
from exprstudy.operators import lock, matrix, split, treefit
from exprstudy.plans import final, studies


def plain_trees(x, labels, keys, classes, s, experiment, cuts):
    """Rounds of nested dictionaries, one tree a class, by exhaustive search over cut values."""
    n, columns = len(x), 1 if classes == 2 else classes
    counts = np.bincount(labels, minlength=classes)
    w = n / (classes * counts[labels])
    f = np.zeros((n, columns))

    def soft(g):
        return np.sign(g) * max(abs(g) - s.reg_alpha, 0)

    def grow(rows, g, h, features, depth):
        own_g, own_h = g[rows].sum(), h[rows].sum()
        best = None
        for j in features if depth < s.max_depth else ():
            for cut in cuts[j]:
                left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                if min(h[left].sum(), h[right].sum()) < max(s.min_child_weight, 1e-12):
                    continue
                sides = [(g[p].sum(), h[p].sum()) for p in (left, right)]
                gain = sum(soft(a) ** 2 / (b + s.reg_lambda) for a, b in sides) - soft(own_g) ** 2 / (own_h + s.reg_lambda)
                if gain > max(s.gamma, 1e-9) and (best is None or gain > best[0] * (1 + treefit.TIE)):
                    best = gain, j, cut, left, right
        if best is None:
            return {"value": -s.learning_rate * soft(own_g) / (own_h + s.reg_lambda)}
        _, j, cut, left, right = best
        return {"j": j, "cut": cut, "left": grow(left, g, h, features, depth + 1), "right": grow(right, g, h, features, depth + 1)}

    def value(node, row):
        while "j" in node:
            node = node["left"] if row[node["j"]] <= node["cut"] else node["right"]
        return node["value"]

    for r in range(s.n_estimators):
        if columns == 1:
            p = 1 / (1 + np.exp(-f))
            g, h = w[:, None] * (p - labels[:, None]), w[:, None] * p * (1 - p)
        else:
            p = np.exp(f) / np.exp(f).sum(1, keepdims=True)
            g, h = w[:, None] * (p - np.eye(classes)[labels]), 2 * w[:, None] * p * (1 - p)
        for c in range(columns):
            rows = np.flatnonzero(treefit.drawn(keys, s.subsample, s.seed, experiment, r, c))
            tree = grow(rows, g[:, c], h[:, c], treefit.features_of(s, x.shape[1], experiment, r, c), 0)
            f[:, c] += [value(tree, row) for row in x]
    return f


@pytest.mark.parametrize(
    "classes, more",
    [
        (3, {}),
        (3, {"reg_alpha": 0.4, "reg_lambda": 2.5, "gamma": 0.3, "min_child_weight": 2.0}),
        (2, {"subsample": 1.0, "colsample_bytree": 1.0}),
    ],
)
def test_trees_are_those_of_a_plain_search(spark, classes, more):
    rng = np.random.default_rng(classes)
    n, wide, k = 90, 5, 2
    x = np.round(rng.normal(size=(n, wide)), 1)
    labels = (np.digitize(x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.3, n), [-0.4, 0.6][: classes - 1])).astype(int)
    fold = np.arange(n) % k
    keys = rng.permutation(10 * n)[:n]
    s = treefit.Settings(**{"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3, "max_bin": 12, "min_child_weight": 0.5, **more})
    rows = [(e, int(fold[i]), int(keys[i]), int(labels[i]), [float(v) for v in x[i]]) for i in range(n) for e in range(k)]
    design = spark.createDataFrame(rows, "eval_fold int, fold int, cache_index bigint, label int, x array<double>").repartition(3)
    cuts = treefit.find_cuts(design, s.max_bin)
    for e in range(k):
        train = x[fold != e]
        for j in range(wide):
            assert set(cuts[e][j]) <= set(train[:, j]) and len(cuts[e][j]) <= s.max_bin - 1
            assert (np.diff(cuts[e][j]) > 0).all()
    blocks = treefit.write_bins(design, cuts)
    assert blocks.count() > k  # several tasks wrote blocks of an experiment
    counts = {e: np.bincount(labels[fold != e], minlength=classes).tolist() for e in range(k)}
    rounds = treefit.fit_all(blocks, counts, cuts, s)
    scored = treefit.score(design, treefit.table_of(spark, rounds, cuts), 1 if classes == 2 else classes)
    got = {(r["eval_fold"], r["cache_index"]): r["margins"] for r in scored.where("fold <> eval_fold").collect()}
    for e in range(k):
        own = fold != e
        wanted = plain_trees(x[own], labels[own], keys[own], classes, s, e, cuts[e])
        assert np.abs(wanted).max() > 0.1
        np.testing.assert_allclose([got[e, int(key)] for key in keys[own]], wanted, atol=1e-9)
        shares = treefit.importances(rounds[e], wide)
        assert shares.sum() == pytest.approx(1.0) and (shares >= 0).all()


@pytest.mark.parametrize("classes, more", [(3, {}), (3, {"reg_alpha": 0.4, "gamma": 0.3, "reg_lambda": 0.5}), (2, {"subsample": 1.0})])
def test_exact_trees_try_every_value(spark, monkeypatch, classes, more):
    rng = np.random.default_rng(classes)
    n, wide, k = 150, 5, 2
    x = np.where(rng.random((n, wide)) < 0.3, 0.0, rng.normal(size=(n, wide)))
    labels = (np.digitize(x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.3, n), [-0.4, 0.6][: classes - 1])).astype(int)
    fold, keys = np.arange(n) % k, rng.permutation(10 * n)[:n]
    wanted = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "max_bin": 4, "min_child_weight": 0.5, "colsample_bytree": 0.8, **more}
    s = treefit.Settings(exact=True, **wanted)
    rows = [(e, int(fold[i]), int(keys[i]), int(labels[i]), [float(v) for v in x[i]]) for i in range(n) for e in range(k)]
    design = spark.createDataFrame(rows, "eval_fold int, fold int, cache_index bigint, label int, x array<double>").repartition(3)
    monkeypatch.setattr(treefit, "FEATURE_BLOCK", 2)
    monkeypatch.setattr(treefit, "SEARCH_ROWS", 64)
    cuts = treefit.find_cuts(design, s.max_bin)
    counts = {e: np.bincount(labels[fold != e], minlength=classes).tolist() for e in range(k)}
    rounds = treefit.fit_all(treefit.write_bins(design, cuts, True), counts, cuts, s)
    scored = treefit.score(design, treefit.table_of(spark, rounds, cuts), 1 if classes == 2 else classes)
    got = {(r["eval_fold"], r["cache_index"]): r["margins"] for r in scored.where("fold <> eval_fold").collect()}
    for e in range(k):
        own = fold != e
        every = [np.unique(x[own, j]) for j in range(wide)]
        plain = plain_trees(x[own], labels[own], keys[own], classes, s, e, every)
        np.testing.assert_allclose([got[e, int(key)] for key in keys[own]], plain, atol=1e-9)


def test_bins_are_searched_wherever_a_cut_may_gain_more():
    rng = np.random.default_rng(3)
    s = treefit.Settings(reg_alpha=0.2, reg_lambda=0.5, min_child_weight=0.1)
    for _ in range(30):
        g, h = rng.normal(size=60), rng.random(60)
        bins = np.sort(rng.integers(0, 6, 60))
        columns = np.stack([g, h, np.maximum(g, 0)], 1)
        sums = np.stack([columns[bins == b].sum(0) for b in range(6)])[None, None]
        gain = treefit._gains(g.cumsum(), h.cumsum(), g.sum(), h.sum(), s)
        for least in np.quantile(gain[np.isfinite(gain)], [0.5, 0.9, 1.0]):
            marked = treefit.worth_search(sums, np.array([least]), s)[0, 0]
            assert marked[np.unique(bins[gain >= least])].all()


def test_first_splits_equal_sql_beyond_the_bins(spark, tmp_path):
    """More distinct values than bins: the best cut may lie inside a bin."""
    rng = np.random.default_rng(5)
    n = 9_000
    x = rng.normal(1.0, 0.6, (n, 3)).astype("float32")
    rows = pa.table({"vec_id": np.arange(n), "embedding": list(x), "label": rng.integers(0, 3, n).astype("int32")})
    pq.write_table(rows, f"{tmp_path}/embeddings.parquet")
    columns = ["fold", "class", "gene_index", "cut", "gain", "left_score", "right_score"]
    got = driver.queries()["tree_first_splits"](spark, str(tmp_path)).select(columns).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
        wanted = db.execute(f"SELECT {', '.join(columns)} FROM ({driver.oracle_sql()['tree_first_splits']})").fetchall()
    assert len(got) == 15 and sorted(tuple(r) for r in got) == sorted(wanted)


def test_small_tables_reach_every_core(spark):
    n, k = 20_000, 2
    rows = spark.range(n).repartition(1).select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("eval_fold"), (F.col("id") % k).cast("int").alias("fold"), F.col("id").alias("cache_index"),
        (F.col("id") % 3).cast("int").alias("label"), F.array((F.col("id") % 50).cast("double"), F.col("id").cast("double")).alias("x"),
    )
    cuts = {e: [np.arange(0.0, 50.0, 5.0), np.arange(0.0, n, 2_000.0)] for e in range(k)}
    held = treefit.load_bins(treefit.write_bins(rows, cuts), k).glom().collect()
    sizes = [sum(len(b.keys) for b in part) for part in held]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and min(sizes) > 0 and max(sizes) <= n / 4
    for e in range(k):
        own = [b for part in held for b in part if b.experiment == e]
        keys = np.concatenate([b.keys for b in own])
        assert sorted(keys.tolist()) == [i for i in range(n) if i % k != e]
        wanted = np.stack([np.searchsorted(cuts[e][0], keys % 50), np.searchsorted(cuts[e][1], keys)], 1)
        assert (np.concatenate([b.bins for b in own]) == wanted).all() and (np.concatenate([b.labels for b in own]) == keys % 3).all()


def test_margins_survive_being_rebuilt(spark, monkeypatch):
    rows, _, _ = planted(spark, 10)
    prepared = studies.prepare(studies.freeze_folds(rows, 2), 2)
    wanted = {"n_estimators": 5, "max_depth": 2, "max_bin": 8}
    once = studies.fit_trees(prepared, **wanted).weights.orderBy("eval_fold", "round", "tree").collect()
    monkeypatch.setattr(treefit, "REBASE", 2)
    monkeypatch.setattr(treefit, "FEATURE_BLOCK", 2)
    again = studies.fit_trees(prepared, **wanted).weights.orderBy("eval_fold", "round", "tree").collect()
    assert len(once) == 2 * 5 * 3
    for a, b in zip(once, again):
        assert a["features"] == b["features"] and a["cuts"] == b["cuts"]
        np.testing.assert_allclose(a["scores"], b["scores"], atol=1e-12)


def test_odd_inputs(spark):
    with pytest.raises(ValueError, match="share"):
        treefit.Settings(subsample=0.0)
    with pytest.raises(ValueError, match="penalties"):
        treefit.Settings(reg_lambda=-1.0)
    with pytest.raises(ValueError, match="a round"):
        treefit.Settings(max_bin=1)
    # nothing to gain: every tree is its root, and every class has the same chance
    rows, _, _ = planted(spark, 6)
    prepared = studies.prepare(studies.freeze_folds(rows, 2), 2)
    flat = studies.fit_trees(prepared, n_estimators=2, gamma=1e9, subsample=1.0)
    assert {tuple(r["features"]) for r in flat.weights.collect()} == {(-1,)}
    for r in flat.predictions.collect():
        assert r["scores"] == pytest.approx([1 / 3] * 3, abs=0.02)
    assert {r["importance"] for r in flat.importances.collect()} == {0.0}


def test_locked_trees_have_probabilities_and_load_again(spark, tmp_path):
    rows, _, _ = planted(spark, 14, missing=0.05)
    manifest = split.holdout(rows.drop("features"))
    genes = gene_table(spark, 9)
    pipeline = {"family": "xgboost", "gene_budget": 6, "n_estimators": 20, "max_depth": 2, "learning_rate": 0.3, "reg_alpha": 0.1}
    selection = {"candidate_id": "xgboost:cpu:6", "selection_rationale": "test", "pipeline": pipeline}
    full = lock.normalise_selection(selection)["pipeline"]
    assert full["reg_lambda"] == 1.0 and full["colsample_bytree"] == 0.5
    results = final.fit_and_score(rows, manifest, full)
    row = results["metrics"].first()
    assert row["macro_f1"] > 0.8 and 0 < row["multiclass_log_loss"] < 1.0 and row["ovr_roc_auc_macro"] > 0.9
    assert results["importances"].count() == 6
    final.save_model(spark, results, f"{tmp_path}/out")
    again = final.load_and_score(spark, f"{tmp_path}/out", matrix.join_split(rows, manifest, "holdout"))
    pairs = results["predictions"].join(again.select("cache_index", F.col("scores").alias("other"), F.col("predicted_label").alias("call")), "cache_index")
    for r in pairs.collect():
        assert r["scores"] == pytest.approx(r["other"], abs=1e-12) and r["call"] == r["predicted_label"]
        assert sum(r["scores"]) == pytest.approx(1.0)
    assert pairs.count() == manifest.where("split = 'holdout'").count()


def test_boosted_study_grows_all_rounds(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(11)
    n, labels = 240, np.arange(240) % 3
    x = (rng.normal(1.0, 0.5, (n, 4)) + 2.0 * (labels[:, None] == np.arange(4))).astype("float32")
    rows = pa.table({"vec_id": np.arange(n), "embedding": list(x), "label": labels.astype("int32")})
    pq.write_table(rows, f"{tmp_path}/embeddings.parquet")
    outcomes, plain = [], studies.fit_trees

    def fit_trees(*args, **params):
        outcomes.append(plain(*args, **params))
        return outcomes[-1]

    monkeypatch.setattr(studies, "fit_trees", fit_trees)
    got = {r["gene_index"]: r["mean_gain_importance"] for r in driver.queries()["boosted_study"](spark, str(tmp_path)).collect()}
    (outcome,) = outcomes
    trees = outcome.weights.collect()
    assert {(r["eval_fold"], r["round"], r["tree"]) for r in trees} == {(e, i, c) for e in range(5) for i in range(300) for c in range(3)}
    assert len(trees) == 5 * 300 * 3
    wanted = np.zeros(4)
    for e in range(5):
        gains = [[] for _ in range(4)]
        for r in trees:
            for feature, gain in zip(r["features"], r["gains"]):
                if r["eval_fold"] == e and feature >= 0:
                    gains[feature].append(gain)
        means = np.array([np.mean(own) if own else 0.0 for own in gains])
        wanted += means / means.sum() / 5
    assert got == pytest.approx(dict(enumerate(wanted)), abs=1e-6)


def binned(spark, classes, wide=7, n=400, k=2):
    rng = np.random.default_rng(classes)
    x = np.round(rng.normal(size=(n, wide)), 1)
    labels = (np.digitize(x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.3, n), [-0.4, 0.6][: classes - 1])).astype(int)
    rows = [(e, i % k, 3 * i, int(labels[i]), [float(v) for v in x[i]]) for i in range(n) for e in range(k)]
    design = spark.createDataFrame(rows, "eval_fold int, fold int, cache_index bigint, label int, x array<double>").repartition(3)
    counts = {e: np.bincount(labels[np.arange(n) % k != e], minlength=classes).tolist() for e in range(k)}
    return design, counts


@pytest.mark.parametrize(
    "classes, more",
    [
        (3, {}),
        (3, {"reg_alpha": 0.4, "reg_lambda": 2.5, "gamma": 0.3, "min_child_weight": 2.0}),
        (3, {"reg_lambda": 0.0, "min_child_weight": 0.0, "max_bin": 300}),
        (2, {"subsample": 1.0, "colsample_bytree": 1.0, "min_child_weight": 12.0}),
    ],
)
def test_whole_experiments_grow_the_trees_of_levels(spark, monkeypatch, classes, more):
    design, counts = binned(spark, classes)
    s = treefit.Settings(**{"n_estimators": 5, "max_depth": 5, "learning_rate": 0.3, "max_bin": 24, **more})
    cuts = treefit.find_cuts(design, s.max_bin)
    blocks = treefit.write_bins(design, cuts)
    whole = treefit.grow_all(blocks, counts, cuts, s).cache()
    monkeypatch.setattr(treefit, "WHOLE_BYTES", 0)
    monkeypatch.setattr(treefit, "_grow_experiments", None)
    by_level = treefit.grow_all(blocks, counts, cuts, s)
    tables = [trees.orderBy("eval_fold", "round", "tree").collect() for trees in (whole, by_level)]
    shares = [treefit.table_importances(trees, {e: 7 for e in cuts}) for trees in (whole, by_level)]
    rounds = treefit.fit_all(blocks, counts, cuts, s)
    for e in cuts:
        for found in shares:
            np.testing.assert_allclose(found[e], treefit.importances(rounds[e], 7), atol=1e-9)
    assert len(tables[0]) == len(tables[1]) == 2 * 5 * (1 if classes == 2 else classes)
    for a, b in zip(*tables):
        assert a["features"] == b["features"] and a["cuts"] == b["cuts"]
        np.testing.assert_allclose(a["scores"], b["scores"], atol=1e-9)
        np.testing.assert_allclose(a["gains"], b["gains"], atol=1e-7)


def test_large_experiments_grow_by_levels(spark, monkeypatch):
    monkeypatch.setattr(treefit, "_grow_experiments", None)
    monkeypatch.setattr(treefit, "WHOLE_BYTES", 0)
    test_margins_survive_being_rebuilt(spark, monkeypatch)
    s = treefit.Settings()
    assert treefit._whole_bytes(440_000, 64, 256, 10, s) < 320 << 20 < treefit._whole_bytes(2_000_000, 64, 256, 10, s)
