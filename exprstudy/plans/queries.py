"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exprstudy.constants import AUDIT_QUANTILE_NAMES, DEFAULT_SEED
from exprstudy.functions import barcodes as bc
from exprstudy.functions import digest, transforms
from exprstudy.operators import audit, cohort, compare, interpret, lock, matrix, metrics, prep, quantiles, split
from exprstudy.plans import final, roles, studies
from exprstudy.session import durable, shared_folder
from exprstudy.sources import tables, wide_text

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
TOP = 20
LINE_PROBABILITIES = (0.01, 0.25, 0.5, 0.75, 0.99)


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _finite(col: Column) -> Column:
    return F.when(matrix.is_finite(col), col)


# --- sources --------------------------------------------------------------


@query
def header_barcodes(spark, sf):
    return wide_text.header(roles.wide_lines(spark, sf))


@query
def header_checks(spark, sf):
    return wide_text.header_checks(roles.messy_barcodes(spark, sf).select("matrix_index", F.upper(F.trim("barcode")).alias("barcode")))


@query
def scan_stats(spark, sf):
    return wide_text.scan_stats(roles.wide_lines(spark, sf))


def _melted(spark, sf) -> DataFrame:
    lines = roles.wide_lines(spark, sf)
    barcodes = wide_text.header(lines)
    primary = barcodes.where(bc.barcode_struct(F.col("barcode"))["is_primary"])
    return wide_text.melt(wide_text.gene_rows(lines), cohort.number_manifest(primary), barcodes.count())


@query
def melt_matrix(spark, sf):
    cells = _melted(spark, sf)
    return cells.select("cache_index", "gene_index", F.round(_finite(F.col("value").cast("double")), 6).alias("value"))


@query
def built_matrix(spark, sf):
    """From wide text to the labelled matrix, as one job: header, cohort, melt, blocks, rows."""
    lines = roles.wide_lines(spark, sf)
    barcodes = wide_text.header(lines)
    primary = cohort.number_manifest(barcodes.where(bc.barcode_struct(F.col("barcode"))["is_primary"]))
    long = wide_text.melt(wide_text.gene_rows(lines), primary, barcodes.count())
    samples = primary.select("cache_index", F.col("barcode").alias("participant_barcode"), F.concat(F.lit("C"), F.col("cache_index") % 3).alias("cancer_type"))
    whole = F.aggregate("features", F.lit(0.0), lambda a, v: a + F.coalesce(_finite(v.cast("double")), F.lit(0.0)))
    missing = F.size(F.filter("features", lambda v: ~matrix.is_finite(v)))
    return matrix.build_matrix(long, samples).select(
        "cache_index", F.upper("participant_barcode").alias("participant_barcode"), "cancer_type",
        F.size("features").alias("n_features"), missing.alias("n_missing"), F.round(whole, 3).alias("total"),
    )


@query
def matrix_blocks(spark, sf):
    blocks = matrix.to_blocks(_melted(spark, sf))
    whole = F.aggregate(
        "values", F.lit(0.0), lambda a, v: a + F.coalesce(_finite(v.cast("double")), F.lit(0.0))
    )
    return blocks.select(
        "cache_index",
        "block",
        F.size("values").alias("n_values"),
        F.round(whole, 4).alias("total"),
        F.round(_finite(F.element_at("values", -1).cast("double")), 6).alias("last_value"),
    )


@query
def bad_rows(spark, sf):
    lines = roles.damaged_lines(spark, sf)
    return wide_text.bad_rows(wide_text.gene_rows(lines), wide_text.scan_stats(lines))


@query
def gene_ids(spark, sf):
    return wide_text.genes(wide_text.gene_rows(roles.wide_lines(spark, sf)))


@query
def quality_scan(spark, sf):
    return tables.quality_records(roles.raw_quality(spark, sf))


@query
def manifest_checks(spark, sf):
    rows = roles.aliquots(spark, sf).select(
        "matrix_index", bc.barcode_struct(F.col("barcode"))["participant"].alias("participant_barcode")
    )
    return tables.manifest_checks(rows)


@query
def split_domain_check(spark, sf):
    labelled = roles.table(spark, sf, "documents").select(
        F.when(F.col("lang") == "en", "development").when(F.col("lang") == "fr", "holdout").otherwise(F.col("lang")).alias("split")
    )
    return tables.split_domain_check(labelled)


@query
def gene_table_check(spark, sf):
    return tables.gene_table_check(roles.genes(spark, sf), roles.matrix(spark, sf))


@query
def cache_metadata(spark, sf):
    return matrix.cache_metadata(roles.matrix(spark, sf, missing=True))


# --- scalar expressions ---------------------------------------------------


@query
def barcode_parse(spark, sf):
    parsed = roles.messy_barcodes(spark, sf).select(
        "matrix_index", bc.barcode_struct(F.col("barcode"), strict=False).alias("p")
    )
    return parsed.select("matrix_index", "p.*")


@query
def barcode_compact(spark, sf):
    return roles.compact_barcodes(spark, sf).select("matrix_index", bc.expand_compact(F.col("barcode")).alias("barcode"))


@query
def bool_parse(spark, sf):
    word = F.when(F.col("quality") == 1, "Yes").when(F.col("toxic") == 1, " T ").when(F.col("doc_id") % 2 == 0, "maybe")
    return roles.table(spark, sf, "labels").select("doc_id", bc.parse_bool(word, strict=False).alias("flag"))


@query
def gene_id_parse(spark, sf):
    text = (
        F.when(F.col("p_size") < 10, F.concat(F.lit("?|"), "p_partkey"))
        .when(F.col("p_size") < 20, F.col("p_brand"))
        .otherwise(F.concat(F.lit(" "), "p_name", F.lit(" |"), "p_partkey", F.lit("|x ")))
    )
    parsed = bc.gene_id_struct(text)
    return roles.table(spark, sf, "part").select("p_partkey", parsed["symbol"].alias("symbol"), parsed["entrez_id"].alias("entrez_id"))


@query
def numeric_parse(spark, sf):
    rows = wide_text.gene_rows(roles.damaged_lines(spark, sf))
    value = bc.parse_number(F.col("text"), strict=False)
    state = F.when(value.isNull(), "junk").when(F.isnan(value), "missing").otherwise("number")
    return (
        rows.select("gene_index", F.explode("values").alias("text"))
        .select("gene_index", state.alias("state"), _finite(value.cast("double")).alias("value"))
        .groupBy("gene_index", "state")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    )


@query
def log2p1_clip(spark, sf):
    cells = matrix.long_form(roles.matrix(spark, sf, missing=True))
    value = transforms.log2p1(F.col("value"), "clip").cast("double")
    return cells.select("cache_index", "gene_index", F.round(_finite(value), 5).alias("value"))


@query
def negative_policy_report(spark, sf):
    return rounded(transforms.negative_policy_report(roles.matrix(spark, sf)), ["minimum_negative"])


@query
def budget_parse(spark, sf):
    text = (
        F.when(F.col("p_size") == 1, " ALL ")
        .when(F.col("p_size") == 2, "0")
        .when(F.col("p_size") == 3, F.col("p_brand"))
        .otherwise(F.concat(F.lit(" "), F.col("p_size")))
    )
    parsed = bc.budget_value(text)
    return roles.table(spark, sf, "part").select("p_partkey", parsed["kind"].alias("kind"), parsed["k"].alias("k"))


@query
def error_flags(spark, sf):
    flagged = metrics.error_flags(roles.predictions(spark, sf))
    return rounded(
        flagged.select("cache_index", "true_label", "predicted_label", "correct", "margin", "absolute_margin"),
        ["margin", "absolute_margin"],
    )


@query
def signed_margin(spark, sf):
    rows = roles.table(spark, sf, "embeddings")
    pair = F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double"))
    one = F.slice(pair, 1, 1)
    scores = F.when(F.col("label") < 4, pair).when(F.col("label") < 8, one)
    margin = metrics.signed_margin(F.coalesce(scores, F.array().cast("array<double>")), ["C0", "C1"], "C0")
    return rows.select("vec_id", F.round(_finite(margin), 6).alias("margin"))


@query
def coef_expand(spark, sf):
    binary = matrix.long_form(roles.matrix(spark, sf), keep=("cache_index",)).select(
        F.col("cache_index").alias("fold"), "gene_index", F.col("value").cast("double").alias("coefficient")
    )
    return rounded(interpret.coefficient_expand(binary, "C0", "C1"), ["coefficient"])


# --- cohort ---------------------------------------------------------------


def _classified(spark, sf) -> DataFrame:
    quality = tables.quality_records(roles.raw_quality(spark, sf))
    return cohort.classify(roles.aliquots(spark, sf), quality, roles.COHORT_TARGETS)


@query
def cohort_exclusions(spark, sf):
    return cohort.exclusion_counts(_classified(spark, sf))


@query
def cohort_dedup(spark, sf):
    manifest = cohort.select_participants(_classified(spark, sf))
    return cohort.number_manifest(manifest)


@query
def cohort_summary(spark, sf):
    return cohort.summary(_classified(spark, sf))


@query
def unmatched_samples(spark, sf):
    return cohort.unmatched_samples(roles.document_samples(spark, sf), roles.label_quality(spark, sf))


@query
def quality_conflicts(spark, sf):
    return cohort.quality_conflicts(roles.customer_quality(spark, sf))


@query
def manifest_header_mismatch(spark, sf):
    # orders claim their neighbour's position when their status is P, so the manifest disagrees there
    manifest = roles.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey")).alias("matrix_index"),
        roles.order_barcode().alias("expression_barcode"),
    )
    return wide_text.manifest_header_mismatch(manifest, roles.aliquots(spark, sf))


# --- audit ----------------------------------------------------------------


@query
def audit_counters(spark, sf):
    found = audit.counters(roles.matrix(spark, sf, missing=True))
    return rounded(found, ["negative_fraction", "zero_fraction", "minimum", "maximum"])


@query
def audit_counters_lines(spark, sf):
    found = audit.counters(roles.line_matrix(spark, sf))
    return rounded(found, ["negative_fraction", "zero_fraction", "minimum", "maximum"], 4)


@query
def audit_profile(spark, sf):
    """Shape, counters and quantiles of a matrix in one row."""
    found = audit.profile(roles.matrix(spark, sf, missing=True))
    return rounded(found, ["negative_fraction", "zero_fraction", "minimum", "maximum", *AUDIT_QUANTILE_NAMES])


@query
def audit_quantiles(spark, sf):
    return rounded(audit.quantiles(roles.matrix(spark, sf, missing=True)), AUDIT_QUANTILE_NAMES)


@query
def audit_quantiles_strided(spark, sf):
    return rounded(audit.quantiles(roles.matrix(spark, sf, missing=True), max_values=10_000), AUDIT_QUANTILE_NAMES)


# --- split ----------------------------------------------------------------


@query
def stratified_holdout(spark, sf):
    return split.holdout(roles.matrix(spark, sf).drop("features"))


@query
def stratified_folds(spark, sf):
    rows = roles.matrix(spark, sf).drop("features")
    development = roles.split_manifest(rows).where("split = 'development'").drop("split")
    return split.folds(development, roles.FOLDS)


@query
def split_refusals(spark, sf):
    """Orders taken as samples of their customers: what a split would refuse."""
    samples = roles.table(spark, sf, "orders").select(
        F.pmod("o_orderkey", F.lit(1000)).alias("cache_index"), F.col("o_custkey").cast("string").alias("participant_barcode")
    )
    return split.sample_violations(samples)


@query
def stratified_holdout_orders(spark, sf):
    samples = roles.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cache_index"),
        F.col("o_orderkey").cast("string").alias("participant_barcode"),
        F.col("o_orderpriority").alias("cancer_type"),
    )
    return split.holdout(samples)


@query
def split_class_counts(spark, sf):
    return split.split_class_counts(split.holdout(roles.matrix(spark, sf).drop("features")))


@query
def split_summary(spark, sf):
    return split.split_summary(split.holdout(roles.matrix(spark, sf).drop("features")))


@query
def split_overlap(spark, sf):
    return split.split_overlap(split.holdout(roles.matrix(spark, sf).drop("features")))


@query
def class_set_diff(spark, sf):
    sides = roles.table(spark, sf, "orders").select(
        F.concat_ws("/", "o_orderpriority", F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")).alias("cancer_type"),
        F.when(F.col("o_orderstatus") == "P", "holdout").otherwise("development").alias("split"),
    )
    return split.class_set_diff(sides)


@query
def split_constraints(spark, sf):
    # documents as a split manifest: few sources, so participants repeat; not every document is in the matrix
    manifest = roles.table(spark, sf, "documents").select(
        F.col("doc_id").alias("cache_index"),
        F.col("source").alias("participant_barcode"),
        F.col("lang").alias("cancer_type"),
        F.when(F.col("lang") == "en", "development").when(F.col("lang") == "fr", "holdout").otherwise("unknown").alias("split"),
    )
    return split.split_constraints(manifest, roles.matrix(spark, sf))


@query
def development_matrix(spark, sf):
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return roles.development(spark, sf).select(
        "cache_index", "participant_barcode", "cancer_type", F.size("features").alias("n_features"), F.round(total, 5).alias("total")
    )


@query
def pair_filter(spark, sf):
    return matrix.pair_filter(roles.development(spark, sf), "C3", "C9", roles.FOLDS).drop("features")


# --- integrity ------------------------------------------------------------


@query
def file_fingerprints(spark, sf):
    return lock.file_fingerprints(spark, f"{sf}/*.parquet").drop("modified")


@query
def text_fingerprint(spark, sf):
    """The order lines, written as text in many files, and the digest of what was written."""
    rows = roles.table(spark, sf, "lineitem")
    line = F.concat_ws("\t", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))
    path = f"{shared_folder(spark)}/exprstudy/text-{uuid.uuid4().hex}"
    rows.orderBy("l_orderkey", "l_linenumber", line).select(line.alias("value")).write.text(path)
    return lock.folder_fingerprint(spark, path)


@query
def split_digest(spark, sf):
    manifest = split.holdout(roles.matrix(spark, sf).drop("features"))
    return digest.table_digest(manifest, ["cache_index", "participant_barcode", "cancer_type", "split"])


def _feature_text() -> Column:
    scaled = F.transform("features", lambda v: F.round(v.cast("double") * 1e6).cast("bigint").cast("string"))
    return F.array_join(scaled, ",")


@query
def matrix_digest(spark, sf):
    return digest.table_digest(roles.matrix(spark, sf), ["cache_index", _feature_text()])


@query
def lines_digest(spark, sf):
    rows = roles.table(spark, sf, "lineitem")
    scaled = [F.round(F.col(c) * 100).cast("bigint") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    seconds = F.unix_timestamp("l_shipdate")
    return digest.table_digest(
        rows, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *scaled, "l_returnflag", "l_linestatus", seconds]
    )


@query
def lock_verify(spark, sf):
    rows = roles.matrix(spark, sf)
    columns = ["cache_index", "participant_barcode", "cancer_type", "split"]
    locked = lock.artifact_digests(
        {
            "matrix": (rows, ["cache_index", _feature_text()]),
            "split_manifest": (split.holdout(rows.drop("features")), columns),
            "gene_table": (roles.genes(spark, sf), ["gene_index", "source_gene_id"]),
        }
    )
    observed = lock.artifact_digests(
        {
            "matrix": (rows, ["cache_index", _feature_text()]),
            "split_manifest": (split.holdout(rows.drop("features"), seed=DEFAULT_SEED + 1), columns),
            "documents": (roles.document_samples(spark, sf), ["matrix_index", "barcode"]),
        }
    )
    return lock.verify(locked, observed)


# --- preprocessing --------------------------------------------------------


@query
def class_weights(spark, sf):
    return rounded(prep.class_weights(roles.folded(spark, sf), ["fold"]), ["weight"])


@query
def class_weights_lines(spark, sf):
    return rounded(prep.class_weights(roles.line_matrix(spark, sf)), ["weight"])


@query
def prior_model(spark, sf):
    return rounded(metrics.prior_model(roles.development(spark, sf)), ["prior"])


@query
def impute_median(spark, sf):
    found = roles.training_parameters(spark, sf, missing=True)
    return rounded(found.select("eval_fold", "gene_index", "median"), ["median"])


@query
def lines_quantiles(spark, sf):
    """Quantiles of four measured features outside each fold, over every order line."""
    rows = roles.line_matrix(spark, sf).select("features", F.pmod("cache_index", F.lit(3)).cast("int").alias("fold"))
    cells = rows.select("fold", F.posexplode("features").alias("gene_index", "value"))
    # quantities, prices and rates repeat, so each value is counted once before the passes
    values = durable(quantiles.equal_values(quantiles.training_weights(cells, 3), 3), "values")
    found = quantiles.training_quantiles(values, LINE_PROBABILITIES, 3)
    picked = [F.col("q")[i].alias(f"q{round(100 * p)}") for i, p in enumerate(LINE_PROBABILITIES)]
    return rounded(found.select("eval_fold", "gene_index", *picked), [f"q{round(100 * p)}" for p in LINE_PROBABILITIES])


@query
def standardize_fold(spark, sf):
    found = roles.training_parameters(spark, sf, missing=True)
    return rounded(found.select("eval_fold", "gene_index", "center", "scale"), ["center", "scale"])


@query
def robust_scale_fold(spark, sf):
    found = roles.training_parameters(spark, sf, "robust", missing=True)
    return rounded(found.select("eval_fold", "gene_index", "center", "scale"), ["center", "scale"])


@query
def variance_filter(spark, sf):
    # dimensions in the first eighth are made constant where the whole class is one value: clip of -|x|
    rows = roles.folded(spark, sf)
    flat = F.transform("features", lambda v, i: F.when(i % 8 == 0, -F.abs(v)).otherwise(v))
    found = prep.fit(rows.withColumn("features", flat), roles.FOLDS, negative_policy="clip")
    return found.select("eval_fold", "gene_index", "eligible")


@query
def anova_f(spark, sf):
    found = roles.training_parameters(spark, sf)
    return rounded(found.select("eval_fold", "gene_index", "f_score"), ["f_score"])


@query
def anova_f_lines(spark, sf):
    rows = roles.line_matrix(spark, sf).withColumn("fold", F.lit(prep.WHOLE_FOLD))
    return rounded(prep.fit(rows, 1).select("gene_index", "center", "scale", "f_score"), ["center", "scale", "f_score"], 4)


@query
def select_k_best(spark, sf):
    return rounded(
        prep.select_k_best(roles.training_parameters(spark, sf), TOP).select("eval_fold", "rank", "gene_index", "f_score"), ["f_score"]
    )


@query
def selected_matrix(spark, sf):
    rows = roles.folded(spark, sf)
    chosen = prep.select_k_best(prep.fit(rows, roles.FOLDS, negative_policy="clip"), TOP)
    cells = matrix.selected_matrix(matrix.long_form(rows), chosen)
    return rounded(cells.select("eval_fold", "cache_index", "gene_index", "value"), ["value"])


@query
def budget_features(spark, sf):
    """The chain log, impute, variance, select, scale, for every row and fold."""
    rows = roles.folded(spark, sf, missing=True)
    chosen = prep.select_k_best(prep.fit(rows, roles.FOLDS, negative_policy="clip"), TOP)
    design = prep.transform(rows, prep.pack(chosen), range(roles.FOLDS), "clip")
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    return design.select(
        "eval_fold",
        "cache_index",
        F.when(F.col("fold") == F.col("eval_fold"), "test").otherwise("train").alias("role"),
        F.size("x").alias("n_features"),
        F.round(total, 4).alias("total"),
        F.round(square, 4).alias("square"),
    )


# --- evaluation -----------------------------------------------------------


@query
def confusion_grid(spark, sf):
    return rounded(metrics.confusion_grid(roles.predictions(spark, sf)), ["row_fraction"])


@query
def per_class_prf(spark, sf):
    found = metrics.per_class(roles.predictions(spark, sf), ["fold"]).drop("hits")
    return rounded(found, ["precision", "recall", "f1"])


@query
def overall_metrics(spark, sf):
    return rounded(metrics.overall(roles.predictions(spark, sf), ["fold"]), metrics.OVERALL)


@query
def cv_metric_summary(spark, sf):
    per_fold = metrics.overall(roles.predictions(spark, sf), ["fold"]).withColumn("model", F.lit("softmax"))
    found = metrics.metric_summary(per_fold, ["model"])
    text = F.array_join(F.transform("fold_values", lambda v: F.format_number(v, 5)), ",").alias("fold_values")
    return rounded(found.select("model", "metric", "mean", "std", text), ["mean", "std"])


@query
def log_loss(spark, sf):
    return rounded(metrics.log_loss(roles.predictions(spark, sf), roles.CLASSES, ["fold"]), ["multiclass_log_loss"])


@query
def ovr_auc(spark, sf):
    return rounded(metrics.ovr_auc(roles.predictions(spark, sf), roles.CLASSES), ["auc"])


@query
def macro_auc(spark, sf):
    return rounded(metrics.macro_auc(roles.predictions(spark, sf), roles.CLASSES), ["ovr_roc_auc_macro"])


@query
def ranked_errors(spark, sf):
    flagged = metrics.error_flags(roles.predictions(spark, sf))
    return rounded(
        metrics.ranked_errors(flagged).select("participant_barcode", "true_label", "predicted_label", "absolute_margin"),
        ["absolute_margin"],
    )


@query
def error_pattern(spark, sf):
    return rounded(metrics.error_pattern(roles.predictions(spark, sf)), ["share"])


@query
def oof_coverage(spark, sf):
    # fold 0 predictions are delivered twice and class C9 never, to see both counted
    found = roles.predictions(spark, sf)
    delivered = found.where("true_label <> 'C9'")
    again = found.where("fold = 0 AND true_label <> 'C9'")
    return metrics.coverage(delivered.unionByName(again), roles.matrix(spark, sf))


# --- interpretation -------------------------------------------------------


def _coefficients(spark, sf) -> DataFrame:
    rows = roles.folded(spark, sf)
    chosen = prep.select_k_best(prep.fit(rows, roles.FOLDS, negative_policy="clip"), TOP)
    return roles.contrasts(rows, chosen)


@query
def feature_stability(spark, sf):
    found = interpret.feature_stability(_coefficients(spark, sf), roles.FOLDS)
    return rounded(found, ["selection_frequency", "mean_abs_coefficient"])


@query
def stability_annotated(spark, sf):
    found = matrix.annotate(interpret.feature_stability(_coefficients(spark, sf), roles.FOLDS), roles.genes(spark, sf))
    return rounded(found.drop("mean_abs_coefficient"), ["selection_frequency"])


@query
def pair_gene_interpretation(spark, sf):
    pair = _coefficients(spark, sf).where("class IN ('C3', 'C9')")
    found = interpret.pair_gene_interpretation(pair, "C3", "C9", roles.FOLDS)
    numbers = ["selection_frequency", "mean_coefficient_a", "mean_coefficient_b", "mean_abs_coefficient", "sign_consistency"]
    return rounded(found, numbers)


@query
def importance_aggregate(spark, sf):
    chosen = prep.select_k_best(roles.training_parameters(spark, sf), TOP)
    gains = chosen.select(F.col("eval_fold").alias("fold"), "gene_index", F.col("f_score").alias("importance"))
    return rounded(interpret.importance_aggregate(gains, roles.FOLDS), ["selection_frequency", "mean_gain_importance"])


@query
def stability_histogram(spark, sf):
    chosen = prep.select_k_best(roles.training_parameters(spark, sf), TOP)
    return rounded(interpret.stability_histogram(chosen, roles.FOLDS), ["share_of_union"])


# --- comparison -----------------------------------------------------------


@query
def evidence_union(spark, sf):
    found = compare.candidates(roles.evidence(spark, sf))
    return rounded(found, ["macro_f1_mean", "macro_f1_std", "balanced_accuracy_mean", "wall_seconds"], 9)


@query
def evidence_gate(spark, sf):
    return compare.gate(roles.evidence(spark, sf, tainted=True))


@query
def candidate_ranking(spark, sf):
    found = compare.compare(roles.evidence(spark, sf))
    return rounded(found.select("rank_by_macro_f1", "candidate_id", "macro_f1_mean"), ["macro_f1_mean"], 9)


@query
def candidate_tradeoff(spark, sf):
    per_fold = roles.fold_metrics(spark, sf)
    walls = per_fold.groupBy("candidate_id").agg(compare.in_fold_order("seconds").alias("wall_seconds"))
    found = compare.tradeoff(per_fold.select("candidate_id", "fold", "value"), walls)
    return rounded(found, ["mean", "gap_to_best", "cost_ratio"], 9)


@query
def hardest_first(spark, sf):
    studies_ = metrics.overall(
        roles.predictions(spark, sf).withColumn("pair", F.concat_ws("_", "true_label", "predicted_label")).withColumn("model", F.lit("softmax")),
        ["pair", "model"],
    ).select("pair", "model", "macro_f1", "n_errors")
    return rounded(compare.hardest_first(studies_), ["macro_f1"])


@query
def run_speedup(spark, sf):
    return rounded(compare.run_speedup(roles.run_log(spark, sf)), ["speedup_vs_first_cpu"], 4)


# --- models ---------------------------------------------------------------

# rounds of the tree queries other than boosted_study, which grows the default 300, see the README
FEW_TREES = {"n_estimators": 20}
FITTED = ("logistic_l2", "elastic_net", "linear_svm", "pca_logistic", "boosted_trees")
PAIRS = {"c3_c9": ("C3", "C9"), "c1_c2": ("C1", "C2")}


def _cross_validated(spark, sf, name: str) -> studies.Outcome:
    prepared = studies.prepare(roles.folded(spark, sf), roles.FOLDS, negative_policy="clip")
    params = FEW_TREES if name == "boosted_trees" else {}
    return studies.cross_validate(prepared, name, parallelism=5, **params)


def _scores(name: str) -> Query:
    def run(spark, sf):
        outcome = _cross_validated(spark, sf, name)
        return rounded(metrics.overall(outcome.predictions, ["fold"]), metrics.OVERALL)

    return run


def _shape(name: str) -> Query:
    def run(spark, sf):
        rows = _cross_validated(spark, sf, name).predictions
        known = F.col("predicted_label").isin(*roles.CLASSES)
        return rows.groupBy("fold", "true_label").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("cache_index").alias("n_samples"),
            F.count_if(known).cast("bigint").alias("n_known_labels"),
            F.count_if(F.size("scores") == len(roles.CLASSES)).cast("bigint").alias("n_full_scores"),
        )

    return run


def _optimality(name: str) -> Query:
    """Parameters of each fold's model, and those whose derivative is not zero at the fitted point."""

    def run(spark, sf):
        prepared = studies.prepare(roles.folded(spark, sf), roles.FOLDS, negative_policy="clip")
        request = studies.Request(name)
        found = studies.optimality(prepared, studies.fit_linear(prepared, [request])[0], request)
        return found.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n_parameters"),
            F.count_distinct("gene_index").alias("n_genes"),
            F.count_if(~(F.col("violation") <= 1e-5)).cast("bigint").alias("n_not_optimal"),
        )

    return run


for _name in FITTED[:3]:
    REGISTRY[f"cv_{_name}_kkt"] = _optimality(_name)
for _name in FITTED:
    REGISTRY[f"cv_{_name}"] = _scores(_name)
    REGISTRY[f"cv_{_name}_shape"] = _shape(_name)


@query
def tree_first_splits(spark, sf):
    """The first split of every fold and class over all rows, features and values."""
    prepared = studies.prepare(roles.folded(spark, sf), roles.FOLDS, negative_policy="clip")
    whole = {"n_estimators": 1, "max_depth": 1, "subsample": 1.0, "colsample_bytree": 1.0, "max_bin": 4_096, "exact": True}
    outcome = studies.fit_trees(prepared, **whole)
    selected = outcome.packed.select("eval_fold", F.posexplode("params").alias("position", "p"))
    names = F.array(*[F.lit(c) for c in prepared.classes])
    splits = outcome.weights.select(
        "eval_fold",
        F.get(names, F.col("tree")).alias("class"),
        F.get("features", F.lit(0)).alias("position"),
        F.get("cuts", F.lit(0)).alias("cut"),
        F.get("gains", F.lit(0)).alias("gain"),
        F.get("scores", F.lit(1)).alias("left_score"),
        F.get("scores", F.lit(2)).alias("right_score"),
    )
    found = splits.join(selected, ["eval_fold", "position"]).select(
        F.col("eval_fold").alias("fold"), "class", F.col("p.gene_index").alias("gene_index"), "cut", "gain", "left_score", "right_score"
    )
    return rounded(found, ["cut", "gain", "left_score", "right_score"])


@query
def boosted_study(spark, sf):
    found = studies.boosted_trees(roles.development(spark, sf), roles.genes(spark, sf), k=roles.FOLDS, negative_policy="clip")
    return rounded(found["importances"], ["selection_frequency", "mean_gain_importance"])


@query
def cv_prior(spark, sf):
    outcome = _cross_validated(spark, sf, "dummy")
    return rounded(metrics.overall(outcome.predictions, ["fold"]), metrics.OVERALL)


@query
def cv_benchmark(spark, sf):
    found = studies.benchmark(roles.development(spark, sf), k=roles.FOLDS, negative_policy="clip", parallelism=5)
    return rounded(found.drop("fold_values"), ["mean", "std"])


@query
def cv_benchmark_shape(spark, sf):
    found = studies.benchmark(roles.development(spark, sf), k=roles.FOLDS, negative_policy="clip", parallelism=5)
    return found.select("model", "metric", F.size("fold_values").cast("bigint").alias("n_folds"))


def _budgets(spark, sf) -> dict[str, DataFrame]:
    return studies.feature_budget(roles.development(spark, sf), roles.genes(spark, sf), k=roles.FOLDS, negative_policy="clip")


@query
def budget_study(spark, sf):
    found = _budgets(spark, sf)["metrics"]
    return rounded(found.drop("fold_values", "selected_per_fold"), ["mean", "std"])


@query
def budget_study_shape(spark, sf):
    found = _budgets(spark, sf)["stability"]
    return found.select("gene_budget", "gene_index", "symbol", "selected_folds")


def _pairs(spark, sf):
    return studies.pair_studies(
        roles.development(spark, sf), roles.genes(spark, sf), PAIRS, k=roles.FOLDS, negative_policy="clip"
    )


@query
def pair_study(spark, sf):
    return rounded(_pairs(spark, sf)[1], ["macro_f1", "balanced_accuracy"])


@query
def pair_study_shape(spark, sf):
    found = None
    for (pair, _), study in _pairs(spark, sf)[0].items():
        rows = study["predictions"].select(F.lit(pair).alias("pair"), "cache_index", "participant_barcode", "true_label", "fold")
        found = rows if found is None else found.unionByName(rows)
    return found


ELASTIC_NET = {"family": "linear_gene_budget", "model": "elastic_net", "negative_policy": "clip"}
TREES = {"family": "xgboost", "negative_policy": "clip", **FEW_TREES}


def _final(spark, sf, candidate: str = "feature-budget:elastic_net:1000", pipeline: dict = ELASTIC_NET) -> dict[str, DataFrame]:
    """Lock, gate, receipt, one evaluation, record."""
    rows, genes = roles.matrix(spark, sf), roles.genes(spark, sf)
    # evidence is locked byte for byte; found again from the events, its averages may differ in their last digits
    proof = durable(roles.evidence(spark, sf), "evidence")
    manifest = roles.split_manifest(rows)
    folder = f"{shared_folder(spark)}/final/{uuid.uuid4().hex}"
    selection = {
        "candidate_id": candidate,
        "selection_rationale": "the library default",
        "pipeline": pipeline,
    }
    lock.create(spark, f"{folder}/lock.json", selection, final.artifacts_of(rows, manifest, genes), proof)
    found = final.run(spark, f"{folder}/lock.json", rows, manifest, genes, f"{folder}/out", f"{folder}/receipt", proof)
    again = final.load_and_score(spark, f"{folder}/out", matrix.join_split(rows, manifest, "holdout"))
    return {**found, "reloaded": again}


@query
def final_reload_agrees(spark, sf):
    return _agreement(_final(spark, sf))


@query
def final_trees_reload_agrees(spark, sf):
    return _agreement(_final(spark, sf, "xgboost:cpu:1000", TREES))


@query
def final_trees_metrics(spark, sf):
    found = _final(spark, sf, "xgboost:cpu:1000", TREES)["metrics"]
    return rounded(found, [*metrics.OVERALL, "multiclass_log_loss", "ovr_roc_auc_macro"])


def _agreement(found: dict[str, DataFrame]) -> DataFrame:
    """Holdout rows by the recorded predictions, and those that the saved model calls otherwise."""
    again = found["reloaded"].select("cache_index", F.col("predicted_label").alias("again"), F.col("scores").alias("scores_again"))
    joined = found["predictions"].join(again, "cache_index", "left")
    close = F.forall(F.zip_with("scores", "scores_again", lambda a, b: F.abs(a - b) <= 1e-9), lambda v: v)
    same = F.coalesce((F.col("again") == F.col("predicted_label")) & close, F.lit(False))
    return joined.groupBy("true_label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).cast("bigint").alias("n_differ"))


@query
def final_holdout_metrics(spark, sf):
    found = _final(spark, sf)["metrics"]
    return rounded(found, [*metrics.OVERALL, "multiclass_log_loss", "ovr_roc_auc_macro"])


@query
def final_holdout_metrics_shape(spark, sf):
    return _final(spark, sf)["predictions"].select("cache_index", "participant_barcode", "true_label")
