import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from exprstudy.constants import AUDIT_QUANTILE_NAMES
from exprstudy.functions import digest, transforms
from exprstudy.operators import audit, matrix, split

PROBS = [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]
NAN = float("nan")


def rows_of(spark, values):
    data = [(i, [float(v) for v in row]) for i, row in enumerate(values)]
    return spark.createDataFrame(data, "cache_index bigint, features array<float>").repartition(3)


def test_audit_counters_and_exact_quantiles(spark):
    values = np.array([[0, 1, -0.01], [3, NAN, 7]], dtype="float32")
    got = audit.profile(rows_of(spark, values)).first().asDict()
    assert (got["n_values"], got["n_finite"], got["n_nonfinite"], got["n_negative"], got["n_zero"]) == (6, 5, 1, 1, 1)
    assert got["negative_fraction"] == 0.2 and got["maximum"] == 7.0 and got["quantiles_exact"]
    finite = values[np.isfinite(values)].astype(float)
    assert [got[n] for n in AUDIT_QUANTILE_NAMES] == pytest.approx(np.quantile(finite, PROBS).tolist())


@pytest.mark.parametrize("limit", [1, 7, 50, 1000])
def test_strided_quantiles_match_numpy(spark, limit):
    values = np.random.default_rng(3).normal(size=(23, 11)).astype("float32")
    values[4, 3] = np.inf
    stride = max(1, math.ceil(values.size / limit))
    sample = values.reshape(-1)[::stride]
    sample = sample[np.isfinite(sample)].astype(float)
    got = audit.quantiles(rows_of(spark, values), limit).first()
    assert [got[n] for n in AUDIT_QUANTILE_NAMES] == pytest.approx(np.quantile(sample, PROBS).tolist())
    assert got["quantiles_exact"] == (stride == 1)


def test_audit_without_finite_values(spark):
    got = audit.profile(rows_of(spark, [[NAN, float("inf")]])).first()
    assert got["minimum"] is None and got["n_finite"] == 0 and got["negative_fraction"] == 0
    assert math.isnan(got["q50"]) and got["quantiles_exact"]


def test_block_counters_merge(spark):
    values = np.random.default_rng(5).normal(size=(20, 6))
    rows = rows_of(spark, values)
    parts = audit.partial_counters(rows.where("cache_index < 7")).unionByName(audit.partial_counters(rows.where("cache_index >= 7")))
    assert audit.merge_counters(parts).first() == audit.counters(rows).first()


def test_log2p1_policies(spark):
    rows = rows_of(spark, [[0, -0.01, 3, NAN, float("inf")]])
    got = rows.select(transforms.log2p1_array(F.col("features"), "clip").alias("x")).first()["x"]
    assert got[:3] == [0, 0, 2] and math.isnan(got[3]) and math.isnan(got[4])
    with pytest.raises(PySparkException, match="negative value"):
        rows.select(transforms.log2p1_array(F.col("features"))).collect()
    report = transforms.negative_policy_report(rows).first()
    assert report["n_negative"] == 1 and report["minimum_negative"] == pytest.approx(-0.01)
    with pytest.raises(ValueError, match="negative_policy"):
        transforms.log2p1(F.lit(1.0), "ignore")


def test_log2p1_transformer_persists(spark, tmp_path):
    stage = transforms.Log2p1(inputCol="features", outputCol="x", negativePolicy="clip")
    stage.write().save(str(tmp_path / "stage"))
    again = transforms.Log2p1.load(str(tmp_path / "stage"))
    assert again.transform(rows_of(spark, [[3, -1]])).first()["x"] == [2, 0]


def samples(spark, sizes):
    rows = []
    for name, n in sizes.items():
        rows += [(len(rows) + i, f"{name}-{i:05d}", name) for i in range(n)]
    return spark.createDataFrame(rows, "cache_index bigint, participant_barcode string, cancer_type string"), rows


def test_holdout_sizes_and_membership(spark):
    sizes = {"A": 53, "B": 20, "C": 2, "D": 301}
    frame, rows = samples(spark, sizes)
    got = split.holdout(frame).collect()
    held = Counter(r["cancer_type"] for r in got if r["split"] == "holdout")
    total = math.ceil(sum(sizes.values()) * 0.2)
    assert sum(held.values()) == total and len(got) == len(rows)
    for name, n in sizes.items():
        assert abs(held[name] - n * 0.2) < 1
        mine = sorted((r[1] for r in rows if r[2] == name), key=lambda w: hashlib.md5(f"20260825:{w}".encode()).hexdigest())
        assert {r["participant_barcode"] for r in got if r["cancer_type"] == name and r["split"] == "holdout"} == set(mine[: held[name]])


def test_holdout_ignores_input_order_and_follows_seed(spark):
    frame, _ = samples(spark, {"A": 40, "B": 30})
    side = lambda df, **kw: {r["participant_barcode"]: r["split"] for r in split.holdout(df, **kw).collect()}
    assert side(frame) == side(frame.orderBy(F.desc("participant_barcode")).repartition(5))
    assert side(frame) != side(frame, seed=1)


def test_holdout_errors(spark):
    frame, _ = samples(spark, {"A": 5, "B": 1})
    with pytest.raises(PySparkException, match="at least two"):
        split.holdout(frame).collect()
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            split.holdout(frame, bad)
    with pytest.raises(ValueError):
        split.folds(frame, 1)


@pytest.mark.parametrize("sizes", [{"A": 53, "B": 20, "C": 3, "D": 101}, {"A": 1, "B": 1, "C": 1}, {"A": 400}])
def test_folds_are_balanced(spark, sizes):
    frame, rows = samples(spark, sizes)
    got = split.folds(frame, 5).collect()
    assert len(got) == len(rows)
    for name, n in sizes.items():
        per_fold = Counter(r["fold"] for r in got if r["cancer_type"] == name)
        counts = [per_fold.get(f, 0) for f in range(5)]
        assert sum(counts) == n and max(counts) - min(counts) <= 1
    overall = Counter(r["fold"] for r in got)
    counts = [overall.get(f, 0) for f in range(5)]
    assert max(counts) - min(counts) <= 1


def test_split_constraints_find_each_problem(spark):
    manifest = spark.createDataFrame(
        [(0, "P", "A", "development"), (0, "Q", "A", "holdout"), (1, "Q", "B", "holdout"), (9, "R", "C", "elsewhere")],
        "cache_index bigint, participant_barcode string, cancer_type string, split string",
    )
    rows = rows_of(spark, [[1], [2]])
    found = {r["check"]: r["n_violations"] for r in split.split_constraints(manifest, rows).collect()}
    assert found == {
        "duplicate_cache_index": 1,
        "duplicate_participant": 1,
        "index_out_of_range": 1,
        "unknown_split": 1,
        "class_on_one_side": 1,
        "empty_side": 0,
    }
    with pytest.raises(ValueError, match="outside the matrix: 9"):
        matrix.join_split(rows, manifest.withColumn("split", F.lit("development")), "development")


def test_split_of_many_classes(spark):
    """Classes are a table like any other; there is no largest number of them."""
    frame, _ = samples(spark, {f"K{i:05d}": 2 for i in range(20_000)})
    sides = split.holdout(frame).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in sides} == {"holdout": 8_000, "development": 32_000}


def test_quantiles_with_an_outlier(spark):
    """One far value does not change the way; many bins give what one gives."""
    values = [float(i) for i in range(1, 2_000)] + [1e300]
    rows = [(i, [values[2 * i], values[2 * i + 1]]) for i in range(1_000)]
    frame = spark.createDataFrame(rows, "cache_index bigint, features array<double>")
    got = audit.quantiles(frame).first()
    expected = np.quantile(np.array(values), [0, 0.01, 0.25, 0.5, 0.75, 0.99])
    assert list(got)[:6] == pytest.approx(list(expected)) and got["q100"] == 1e300 and got["quantiles_exact"]


def test_table_digest_sees_order_free_content(spark):
    frame, _ = samples(spark, {"A": 30})
    of = lambda df: tuple(digest.table_digest(df, ["cache_index", "participant_barcode"]).first())
    assert of(frame) == of(frame.repartition(7).orderBy(F.desc("cache_index")))
    doubled = frame.unionByName(frame.where("cache_index = 3"))
    assert of(frame) != of(doubled) and of(doubled)[0] == 31
    assert of(frame) != of(frame.withColumn("participant_barcode", F.when(F.col("cache_index") == 3, "x").otherwise(F.col("participant_barcode"))))


def test_split_refuses_empty_tables_and_repeated_rows(spark):
    schema = "cache_index bigint, participant_barcode string, cancer_type string"
    rows = [(i, f"P{i}", "AB"[i % 2]) for i in range(12)]
    assert split.holdout(spark.createDataFrame(rows, schema)).count() == 12
    for bad, message in (([], "no samples"), ([*rows, (12, "P3", "A")], "repeated_participant 'P3' has 2"), ([*rows, (5, "P12", "B")], "repeated_index '5' has 2")):
        with pytest.raises(ValueError, match=message):
            split.holdout(spark.createDataFrame(bad, schema))
