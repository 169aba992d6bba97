import math

import numpy as np
import pytest
from conftest import planted
from pyspark.sql import functions as F

from exprstudy.operators import prep, quantiles
from exprstudy.plans import studies

K = 4


@pytest.fixture(scope="module")
def folded(spark):
    rows, values, labels = planted(spark, n_per_class=16, n_genes=9, missing=0.08)
    flat = F.transform("features", lambda v, i: F.when(i == 8, F.lit(1.0).cast("float")).otherwise(v))
    rows = rows.withColumn("features", flat).withColumn("fold", (F.col("cache_index") % K).cast("int"))
    values = values.copy()
    values[:, 8] = 1.0
    return rows, np.log2(values + np.float32(1)).astype("float32").astype(float), np.array(labels)


def imputed(x, train):
    medians = np.nanmedian(x[train], axis=0)
    return np.where(np.isnan(x), medians, x), medians


def anova(x, y):
    names = np.unique(y)
    mean = x.mean(0)
    between = sum((y == c).sum() * (x[y == c].mean(0) - mean) ** 2 for c in names) / (len(names) - 1)
    within = sum(((x[y == c] - x[y == c].mean(0)) ** 2).sum(0) for c in names) / (len(y) - len(names))
    with np.errstate(all="ignore"):
        return between / within


@pytest.mark.parametrize("scaler", ["standard", "robust"])
def test_parameters_equal_numpy_on_training_rows_only(folded, scaler):
    rows, x, y = folded
    got = {(r["eval_fold"], r["gene_index"]): r for r in prep.fit(rows, K, scaler).collect()}
    for f in range(K):
        train = np.arange(len(y)) % K != f
        filled, medians = imputed(x, train)
        scores = anova(filled[train], y[train])
        for g in range(9):
            r = got[f, g]
            if np.isnan(x[:, g]).any():
                assert r["median"] == pytest.approx(medians[g])
            assert r["eligible"] == (g != 8)
            if scaler == "standard":
                assert r["center"] == pytest.approx(filled[train, g].mean())
                sd = filled[train, g].std()
                assert r["scale"] == pytest.approx(sd if sd > 0 else 1.0)
            else:
                q1, q2, q3 = np.percentile(filled[train, g], [25, 50, 75])
                assert r["center"] == pytest.approx(q2)
                assert r["scale"] == pytest.approx(q3 - q1 if q3 > q1 else 1.0)
            if g != 8:
                assert r["f_score"] == pytest.approx(scores[g])


def test_held_out_rows_leave_no_trace(folded):
    rows, _, _ = folded
    shifted = rows.withColumn(
        "features", F.when(F.col("fold") == 1, F.transform("features", lambda v: v + 25)).otherwise(F.col("features"))
    )
    pick = lambda df: {r["gene_index"]: (r["center"], r["scale"], r["f_score"]) for r in prep.fit(df, K).where("eval_fold = 1").collect()}
    plain, moved = pick(rows), pick(shifted)
    assert all(plain[g] == pytest.approx(moved[g]) for g in plain)
    other = {r["gene_index"]: r["center"] for r in prep.fit(shifted, K).where("eval_fold = 0").collect()}
    assert any(abs(other[g] - plain[g][0]) > 0.5 for g in other)


def test_selection_transform_and_index_mapping(folded):
    rows, x, y = folded
    params = prep.fit(rows, K)
    chosen = prep.select_k_best(params, 3)
    design = prep.transform(rows, prep.pack(chosen), range(K))
    got = {(r["eval_fold"], r["cache_index"]): r["x"] for r in design.collect()}
    assert len(got) == K * len(y)
    for f in range(K):
        train = np.arange(len(y)) % K != f
        filled, _ = imputed(x, train)
        scores = anova(filled[train], y[train])
        scores[8] = -1
        best = sorted(sorted(range(9), key=lambda g: (scores[g], g))[-3:])
        z = (filled[:, best] - filled[train][:, best].mean(0)) / filled[train][:, best].std(0)
        for i in (0, 5, 17):
            assert got[f, i] == pytest.approx(z[i].tolist())
    unscaled = prep.transform(rows, prep.pack(chosen), [0], scaled=False).where("cache_index = 5").first()["x"]
    assert len(unscaled) == 3


def test_budget_is_capped_by_survivors(folded):
    rows, _, _ = folded
    params = prep.fit(rows, K)
    for budget in (50, "all"):
        counts = {r["eval_fold"]: r["n"] for r in prep.select_k_best(params, budget).groupBy("eval_fold").agg(F.count("*").alias("n")).collect()}
        assert counts == {f: 8 for f in range(K)}


def test_ties_favour_the_larger_index(spark):
    params = spark.createDataFrame([(0, g, 5.0 if g < 4 else 1.0, True) for g in range(6)], "eval_fold int, gene_index int, f_score double, eligible boolean")
    assert sorted(r["gene_index"] for r in prep.select_k_best(params, 2).collect()) == [2, 3]


def test_gene_missing_in_all_training_rows_is_ineligible(spark):
    rows, _, _ = planted(spark, n_per_class=8, n_genes=4)
    nan = F.lit(float("nan")).cast("float")
    rows = rows.withColumn("fold", (F.col("cache_index") % 2).cast("int"))
    holes = F.transform("features", lambda v, i: F.when((i == 1) & (F.col("fold") == 1), nan).otherwise(v))
    got = {(r["eval_fold"], r["gene_index"]): r["eligible"] for r in prep.fit(rows.withColumn("features", holes), 2).collect()}
    assert not got[0, 1] and got[1, 1] and got[0, 0]


def test_perfect_separation_ranks_first(spark):
    rows = spark.createDataFrame([(i, "AB"[i % 2], [float(i % 2), float(i)], i % 3 if i < 9 else 0) for i in range(12)], "cache_index bigint, cancer_type string, features array<float>, fold int")
    best = prep.select_k_best(prep.fit(rows, 3), 1).collect()
    assert {r["gene_index"] for r in best} == {0} and all(r["f_score"] == float("inf") for r in best)


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_radix_quantiles_equal_the_plain_ones(spark, monkeypatch, broadcast):
    """Ties, both signs, floats and doubles, neighbours in the last digit, subnormal and huge values."""
    monkeypatch.setattr(quantiles, "BROADCAST_PREFIXES", broadcast)
    rng = np.random.default_rng(11)
    close = np.nextafter(1.0, 2.0) ** np.arange(40) * rng.choice([1.0, -1.0], 40)
    genes = [
        np.concatenate([rng.normal(size=300), np.zeros(200)]),
        rng.lognormal(3, 4, 400).astype("float32").astype(float),
        np.concatenate([close, [5e-324, -5e-324, 1e-310, 1.7e308, -1.7e308, 2.0**-1022, 0.0, -0.0]]),
        np.full(90, 7.5),
        2.0 ** np.arange(-30, 30),
    ]
    data = [(g, int(i % 3), float(v)) for g, values in enumerate(genes) for i, v in enumerate(values)]
    cells = spark.createDataFrame(data, "gene_index int, fold int, value double")
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r[0], r[1]): r[2] for r in quantiles.training_quantiles(quantiles.training_weights(cells, 3), probabilities, 3).collect()}
    assert len(got) == 15
    for (fold, gene), q in got.items():
        mine = sorted(v for g, f, v in data if g == gene and f != fold)
        for p, value in zip(probabilities, q):
            at = p * (len(mine) - 1)
            low, high = mine[math.floor(at)], mine[math.ceil(at)]
            assert value == (low if at == int(at) else low * (1 - (at - int(at))) + high * (at - int(at)))


def test_order_key_is_the_order_of_doubles(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 4000, dtype=np.uint64).view(float)
    values = np.concatenate([values[np.isfinite(values)], 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1022, 1024), 0)])
    values = np.concatenate([values, -values, [0.0]])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", quantiles.order_key(F.col("v")).alias("k")).collect()
    for r in rows:
        bits = int(np.float64(abs(r.v)).view(np.int64))
        assert r.k == (bits if r.v >= 0 else -bits)


def test_weights_count_as_copies(spark):
    rows = spark.createDataFrame([(0, 1.0, 5), (0, 2.0, 1), (0, 9.0, 0), (0, 3.0, 4)], "gene_index int, value double, t0 bigint")
    assert quantiles.training_quantiles(rows, [0.5, 0.75, 1.0], 1).first().q == pytest.approx(np.quantile([1] * 5 + [2] + [3] * 4, [0.5, 0.75, 1]))


def test_class_weights(spark):
    rows = spark.createDataFrame([("A",)] * 6 + [("B",)] * 2, "cancer_type string")
    got = {r["cancer_type"]: r["weight"] for r in prep.class_weights(rows).collect()}
    assert got == {"A": pytest.approx(8 / 12), "B": pytest.approx(2.0)}


def test_prepared_counts(folded):
    rows, _, y = folded
    prepared = studies.prepare(rows, K)
    assert prepared.classes == ["A", "B", "C"] and prepared.n_rows() == len(y)
    assert sum(prepared.training_counts(0)) == (np.arange(len(y)) % K != 0).sum()


def test_quantiles_of_counted_values_are_those_of_all(spark):
    from exprstudy.operators import quantiles

    rows = [(i % 3, i % 2, float((i * i) % 17) / 100 - 0.05) for i in range(600)] + [(0, 1, -0.0), (0, 0, 0.0)]
    cells = spark.createDataFrame(rows, "fold int, gene_index int, value double")
    weights = quantiles.training_weights(cells, 3)
    counted = quantiles.equal_values(weights, 3)
    assert counted.count() == cells.select("gene_index", "value").distinct().count() < 40
    plain, again = ({(r["eval_fold"], r["gene_index"]): r["q"] for r in quantiles.training_quantiles(v, [0.01, 0.3, 0.5, 1.0], 3).collect()} for v in (weights, counted))
    assert plain == again and len(plain) == 6
