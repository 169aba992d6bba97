import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprstudy.functions.ranking import bucketed_row_number, quantile_bucket
from exprstudy.operators import compare, interpret, lock, metrics
from exprstudy.plans import roles
from exprstudy.sources.sinks import create_document

CLASSES = ["A", "B", "C"]


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    truth = rng.choice(CLASSES, 120, p=[0.6, 0.25, 0.15])
    raw = rng.random((120, 3)).round(1) + 0.05  # rounded scores give ties
    scores = raw / raw.sum(1, keepdims=True)
    called = np.array(CLASSES)[scores.argmax(1)]
    called[:3] = "Z"  # a label that is never true
    rows = [(i, f"P{i:03d}", i % 4, truth[i], str(called[i]), [float(v) for v in scores[i]], float(scores[i][0] - 0.3)) for i in range(120)]
    schema = "cache_index bigint, participant_barcode string, fold int, true_label string, predicted_label string, scores array<double>, margin double"
    return spark.createDataFrame(rows, schema), truth, called, scores


def by_hand(truth, called):
    labels = sorted(set(truth) | set(called))
    out = {}
    for c in labels:
        hit = ((truth == c) & (called == c)).sum()
        p = hit / max((called == c).sum(), 1)
        r = hit / max((truth == c).sum(), 1)
        out[c] = (p, r, 0.0 if p + r == 0 else 2 * p * r / (p + r), (truth == c).sum())
    return out


def test_class_and_overall_metrics(scored):
    rows, truth, called, _ = scored
    hand = by_hand(truth, called)
    got = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in metrics.per_class(rows).collect()}
    assert got.keys() == hand.keys() and all(got[c] == pytest.approx(hand[c]) for c in hand)
    overall = metrics.overall(rows).first()
    assert overall["macro_f1"] == pytest.approx(np.mean([v[2] for v in hand.values()]))
    assert overall["balanced_accuracy"] == pytest.approx(np.mean([v[1] for v in hand.values() if v[3]]))
    assert overall["weighted_f1"] == pytest.approx(sum(v[2] * v[3] for v in hand.values()) / 120)
    assert overall["accuracy"] == pytest.approx((truth == called).mean()) and overall["n_errors"] == (truth != called).sum()


def test_confusion_is_a_full_grid(scored):
    rows, truth, called, _ = scored
    grid = {(r["true_label"], r["predicted_label"]): (r["n"], r["row_fraction"]) for r in metrics.confusion_grid(rows).collect()}
    assert len(grid) == 16 and sum(n for n, _ in grid.values()) == 120
    assert all(grid["Z", c] == (0, 0.0) for c in [*CLASSES, "Z"])
    for c in CLASSES:
        assert sum(grid[c, p][1] for p in [*CLASSES, "Z"]) == pytest.approx(1.0)


def test_auc_counts_pairs_with_ties(scored):
    rows, truth, _, scores = scored
    hand = {}
    for i, c in enumerate(CLASSES):
        pos, neg = scores[truth == c, i], scores[truth != c, i]
        hand[c] = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    for buckets in (2, 16, 256):
        got = {r["class"]: r["auc"] for r in metrics.ovr_auc(rows, CLASSES, buckets).collect()}
        assert got == {c: pytest.approx(hand[c]) for c in CLASSES}
    assert metrics.macro_auc(rows, CLASSES).first()["ovr_roc_auc_macro"] == pytest.approx(np.mean(list(hand.values())))
    two = rows.where("true_label <> 'C'")
    assert [r["class"] for r in metrics.ovr_auc(two, ["A", "B"]).collect()] == ["B"]
    lone = metrics.macro_auc(rows.where("true_label = 'A'"), CLASSES).first()
    assert lone["ovr_roc_auc_macro"] is None and lone["note"].startswith("undefined")


def test_log_loss_clips(spark, scored):
    rows, truth, _, scores = scored
    chosen = scores[np.arange(120), [CLASSES.index(t) for t in truth]]
    assert metrics.log_loss(rows, CLASSES).first()[0] == pytest.approx(-np.log(chosen).mean())
    sure = spark.createDataFrame([("A", [0.0, 1.0])], "true_label string, scores array<double>")
    assert metrics.log_loss(sure, ["A", "B"]).first()[0] == pytest.approx(-math.log(2.220446049250313e-16))


def test_summary_uses_population_deviation(scored):
    rows, *_ = scored
    per_fold = metrics.overall(rows, ["fold"])
    folds = {r["fold"]: r["accuracy"] for r in per_fold.collect()}
    got = metrics.metric_summary(per_fold.withColumn("model", F.lit("m")), ["model"]).where("metric = 'accuracy'").first()
    values = [folds[f] for f in sorted(folds)]
    assert got["fold_values"] == pytest.approx(values)
    assert got["mean"] == pytest.approx(np.mean(values)) and got["std"] == pytest.approx(np.std(values))


def test_ranked_errors_and_coverage(spark, scored):
    rows, truth, called, _ = scored
    holes = rows.withColumn("margin", F.when(F.col("cache_index") % 5 == 0, float("nan")).otherwise(F.col("margin")))
    errors = metrics.ranked_errors(metrics.error_flags(holes)).collect()
    assert len(errors) == (truth != called).sum()
    keys = [(-(r["absolute_margin"] if r["absolute_margin"] is not None else -1.0), r["participant_barcode"]) for r in errors]
    assert keys == sorted(keys)
    twice = rows.where("cache_index > 1").unionByName(rows.where("cache_index = 7"))
    expected = rows.where("cache_index <> 5").select("cache_index")
    got = {r["coverage"]: r["n"] for r in metrics.coverage(twice, expected).collect()}
    assert got == {"once": 116, "repeated": 1, "never": 2, "unexpected": 1}


def test_quantile_bucket_keeps_order(spark):
    rows = spark.createDataFrame([(float(v),) for v in [0.0] * 40 + list(range(60))], "v double")
    placed = quantile_bucket(rows, "v", "b", 8).collect()
    ordered = sorted((r["v"], r["b"]) for r in placed)
    assert [b for _, b in ordered] == sorted(b for _, b in ordered) and len({b for _, b in ordered}) > 3
    ranked = bucketed_row_number(quantile_bucket(rows, "v", "b", 8), "n", "b", [F.col("v")]).collect()
    assert sorted(r["n"] for r in ranked) == list(range(1, 101))
    assert all(a["v"] <= b["v"] for a, b in zip(sorted(ranked, key=lambda r: r["n"]), sorted(ranked, key=lambda r: r["n"])[1:]))


def coefficients(spark):
    rows = [(0, "A", 1, -0.5), (0, "B", 1, 0.5), (1, "A", 1, 0.1), (1, "B", 1, -0.1), (0, "A", 2, 0.0), (0, "B", 2, 0.0)]
    return spark.createDataFrame(rows, "fold int, class string, gene_index int, coefficient double")


def test_stability_and_pair_genes(spark):
    table = coefficients(spark)
    got = {r["gene_index"]: r for r in interpret.feature_stability(table, 4).collect()}
    assert got[1]["selected_folds"] == 2 and got[1]["selection_frequency"] == 0.5
    assert got[1]["mean_abs_coefficient"] == pytest.approx(0.3)
    pairs = interpret.pair_gene_interpretation(table, "A", "B", 4).collect()
    assert [r["gene_index"] for r in pairs] == [1, 2]
    assert pairs[0]["direction"] == "B" and pairs[0]["sign_consistency"] == 0.5
    assert pairs[1]["direction"] == "neutral" and pairs[1]["sign_consistency"] == 0.0
    binary = spark.createDataFrame([(0, 3, 1.5)], "fold int, gene_index int, coefficient double")
    assert {(r["class"], r["coefficient"]) for r in interpret.coefficient_expand(binary, "A", "B").collect()} == {("A", -1.5), ("B", 1.5)}


def test_histogram_lists_every_count(spark):
    selected = spark.createDataFrame([(f, g) for g, n in {1: 3, 2: 1, 3: 1}.items() for f in range(n)], "eval_fold int, gene_index int")
    got = [tuple(r) for r in interpret.stability_histogram(selected, 4).orderBy("selected_folds").collect()]
    assert got == [(1, 2, pytest.approx(2 / 3)), (2, 0, 0.0), (3, 1, pytest.approx(1 / 3)), (4, 0, 0.0)]


def test_signed_margin_errors():
    with pytest.raises(ValueError):
        metrics.signed_margin(None, ["A"], "A")


HEAD = {"evaluation_scope": "development_cross_validation_only", "holdout_used": False}


def measured(mean):
    return {"metrics": {"macro_f1": {"mean": mean, "std": 0.1}, "balanced_accuracy": {"mean": mean}}, "wall_seconds": 2.5}


DOCUMENTS = {
    "a.json": {**HEAD, "models": [{"model": "elastic_net", **measured(0.7)}, {"model": "dummy", **measured(0.1)}]},
    "b.json": {**HEAD, "model": "linear_svm", "budgets": [{"model": "linear_svm", "gene_budget": 20, **measured(0.9)}, {"gene_budget": "all", **measured(0.7)}]},
    "c.json": {**HEAD, "benchmark": {"model": "trees", "resolved_device": "cpu", "gene_budget": 1000, **measured(0.8)}},
}


def evidence(spark, documents=DOCUMENTS):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in documents.items()], "evidence_file string, document string")


def test_candidates_of_all_shapes_are_ranked(spark, tmp_path):
    ranked = compare.compare(evidence(spark)).orderBy("rank_by_macro_f1").collect()
    assert [r["candidate_id"] for r in ranked] == [
        "feature-budget:linear_svm:20",
        "xgboost:cpu:1000",
        "classical:elastic_net",
        "feature-budget:linear_svm:all",
        "classical:dummy",
    ]
    for name, document in DOCUMENTS.items():
        create_document(spark, str(tmp_path / name), document)
    assert compare.compare(compare.read_evidence(spark, str(tmp_path / "*.json"))).count() == 5


def test_gate_names_problems(spark):
    bad = {
        "h.json": {**DOCUMENTS["a.json"], "holdout_used": True},
        "s.json": {**DOCUMENTS["a.json"], "evaluation_scope": "final"},
        "u.json": {**HEAD, "other": 1},
        "n.json": {"evaluation_scope": HEAD["evaluation_scope"], "models": []},
    }
    found = {r["evidence_file"]: r["problem"] for r in compare.gate(evidence(spark, {**DOCUMENTS, **bad})).collect()}
    assert found == {"h.json": "holdout_used", "s.json": "not_development_only", "u.json": "unknown_shape", "n.json": "holdout_used"}
    with pytest.raises(ValueError, match="violations"):
        compare.compare(evidence(spark, bad))


def test_tradeoff_and_speedup(spark):
    folds = spark.createDataFrame([("x", 0, 0.9), ("x", 1, 0.5), ("y", 0, 0.4), ("y", 1, 0.8)], "candidate_id string, fold int, value double")
    walls = spark.createDataFrame([("x", 10.0), ("y", 5.0)], "candidate_id string, wall_seconds double")
    got = {r["candidate_id"]: r for r in compare.tradeoff(folds, walls).collect()}
    assert got["y"]["folds_won"] == 1 and got["y"]["gap_to_best"] == pytest.approx(-0.1) and got["y"]["cost_ratio"] == 0.5
    runs = spark.createDataFrame([(1, "cuda", 1.0), (2, "cpu", 8.0), (3, "cpu", 0.0)], "run int, device string, wall_seconds double")
    assert {r["run"]: r["speedup_vs_first_cpu"] for r in compare.run_speedup(runs).collect()} == {1: 8.0, 2: 1.0, 3: None}


def test_fold_metrics_do_not_depend_on_the_order_of_events(spark, tmp_path):
    rows = [(i, 0, "view", 0.1 * (i % 97) + 10.0 ** (i % 7), '{"k": 1}') for i in range(4_000)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string")
    found = set()
    for n in (1, 3, 7):
        events.repartition(n, F.col("event_id") % 11).sortWithinPartitions(F.xxhash64("event_id", F.lit(n))).write.parquet(str(tmp_path / str(n) / "events.parquet"))
        found.add(tuple(sorted((r["fold"], r["value"], r["seconds"]) for r in roles.fold_metrics(spark, str(tmp_path / str(n))).collect())))
    assert len(found) == 1


def test_lock_comparison(spark):
    schema = "artifact string, n_rows bigint, sha256 string"
    want = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 2, "x")], schema)
    have = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("d", 3, "x"), ("e", 1, "x")], schema)
    got = {r["artifact"]: r["status"] for r in lock.verify(want, have).collect()}
    assert got == {"a": "match", "b": "digest_mismatch", "c": "missing", "d": "size_mismatch", "e": "not_locked"}


def plain_tree(lines):
    level = [hashlib.sha256(x).hexdigest() for x in lines]
    while True:
        level = [hashlib.sha256("".join(level[i : i + 1024]).encode()).hexdigest() for i in range(0, len(level), 1024)]
        if len(level) < 2:
            return level[0] if level else hashlib.sha256(b"").hexdigest()


def plain_fingerprint(data):
    lines = data.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    return hashlib.sha256(f"{plain_tree(lines)}:{len(lines)}:{len(data)}".encode()).hexdigest()


def test_fingerprints_of_any_bytes_and_split_size(spark, tmp_path):
    rng = np.random.default_rng(4)
    files = {
        "raw.bin": rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes(),
        "text.tsv": b"".join(b"%d\tline\r\n" % i for i in range(3000)),
        "no_end.tsv": b"a\nb",
        "end.tsv": b"a\nb\n",
        "swapped.tsv": b"b\na\n",
        "blank.tsv": b"\n\n\n",
        "empty.tsv": b"",
        "with space.tsv": b"\xff\xfe\n\x00",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = sorted((len(d), plain_fingerprint(d)) for d in files.values() if d)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("134217728", "7000"):
            spark.conf.set(key, size)
            got = lock.file_fingerprints(spark, str(tmp_path)).collect()
            assert sorted((r["size_bytes"], r["sha256"]) for r in got) == want
            assert {r["name"] for r in got} >= {"raw.bin", "end.tsv"} and len({r["sha256"] for r in got}) == len(files) - 1
    finally:
        spark.conf.set(key, before)
    changed = bytearray(files["raw.bin"])
    changed[150_000] ^= 1
    assert plain_fingerprint(bytes(changed)) != plain_fingerprint(files["raw.bin"])


def test_folder_fingerprint_does_not_depend_on_files(spark, tmp_path):
    lines = [f"line {i % 7} {i}" for i in range(2500)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    for n in (1, 5):
        rows.repartitionByRange(n, "i").sortWithinPartitions("i").select("value").write.text(str(tmp_path / str(n)))
        got = lock.folder_fingerprint(spark, str(tmp_path / str(n))).collect()
        assert [tuple(r) for r in got] == [(2500, sum(len(x) + 1 for x in lines), plain_tree([x.encode() for x in lines]))]
    rows.where("i < 0").select("value").write.text(str(tmp_path / "none"))
    assert tuple(lock.folder_fingerprint(spark, str(tmp_path / "none")).first()) == (0, 0, hashlib.sha256(b"").hexdigest())


def test_lines_are_numbered_where_they_lie(spark, tmp_path):
    spark.range(1_000).select(F.col("id").cast("string")).write.text(str(tmp_path / "text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lock._numbered_lines(spark, str(tmp_path / "text"))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
