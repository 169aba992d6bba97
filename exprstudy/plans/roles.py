"""The given tables in the roles a study needs.

``embeddings`` is the labelled matrix, ``orders`` the aliquots of participants,
``documents`` and ``labels`` samples with partial annotations, ``events`` the fold
metrics, evidence and run log, ``lineitem`` a long labelled table with few features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exprstudy.constants import DEVELOPMENT_SCOPE, FINAL_SCOPE, RNA_PLATFORM
from exprstudy.operators import matrix as mx
from exprstudy.operators import prep, split
from exprstudy.plans import studies
from exprstudy.session import durable

FOLDS = 5
COHORT_TARGETS = ("URGENT", "HIGH", "MEDIUM", "LOW")
CLASSES = tuple(f"C{i}" for i in range(10))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _missing_at(index: Column, position: Column) -> Column:
    return (index * 7 + position) % 13 == 0


def matrix(spark: SparkSession, sf_dir: str, missing: bool = False) -> DataFrame:
    """One row per vector; ``missing`` blanks a fixed pattern of cells."""
    features = F.col("embedding")
    if missing:
        blank = F.lit(float("nan")).cast("float")
        features = F.transform(features, lambda v, i: F.when(_missing_at(F.col("vec_id"), i), blank).otherwise(v))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cache_index"),
        F.concat(F.lit("P"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("participant_barcode"),
        F.concat(F.lit("C"), F.col("label").cast("string")).alias("cancer_type"),
        features.alias("features"),
    )


def line_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows of four measured features, class = return flag."""
    features = F.array(*[F.col(c).cast("float") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("cache_index"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("participant_barcode"),
        F.col("l_returnflag").alias("cancer_type"),
        features.alias("features"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gene table as wide as the widest matrix row."""
    width = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("n"))
    index = width.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("gene_index"))
    return index.select(
        "gene_index",
        F.concat(F.lit("G"), F.col("gene_index"), F.lit("|"), F.col("gene_index") + 1000).alias("source_gene_id"),
        F.concat(F.lit("G"), F.col("gene_index")).alias("symbol"),
        (F.col("gene_index") + 1000).cast("string").alias("entrez_id"),
    )


def split_manifest(rows: DataFrame) -> DataFrame:
    """The frozen split of a matrix."""
    return durable(split.holdout(rows.drop("features")), "split")


def development(spark: SparkSession, sf_dir: str, missing: bool = False) -> DataFrame:
    rows = matrix(spark, sf_dir, missing)
    return mx.development_matrix(rows, split_manifest(rows))


def folded(spark: SparkSession, sf_dir: str, missing: bool = False) -> DataFrame:
    """Development rows with frozen folds."""
    return studies.freeze_folds(development(spark, sf_dir, missing), FOLDS)


def training_parameters(spark: SparkSession, sf_dir: str, scaler: str = "standard", missing: bool = False) -> DataFrame:
    return prep.fit(folded(spark, sf_dir, missing), FOLDS, scaler, "clip")


def contrasts(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Class mean less overall mean over training rows, per selected gene: a stand-in coefficient table."""
    train = prep.training_moments(prep.cell_moments(prep.logged_cells(rows, "clip")), FOLDS)
    overall = train.groupBy("eval_fold", "gene_index").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("overall")
    )
    return (
        train.join(overall, ["eval_fold", "gene_index"])
        .join(selected.select("eval_fold", "gene_index"), ["eval_fold", "gene_index"])
        .select(
            F.col("eval_fold").alias("fold"),
            F.col("cancer_type").alias("class"),
            "gene_index",
            (F.col("mean") - F.col("overall")).alias("coefficient"),
        )
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over the first ten dimensions as class scores, their argmax as prediction."""
    first = F.slice("embedding", 1, len(CLASSES))
    raised = F.transform(first, lambda v: F.exp(v.cast("double")))
    total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    ten = F.array(*[F.lit(c) for c in CLASSES])
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cache_index"),
        F.concat(F.lit("P"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("participant_barcode"),
        (F.col("vec_id") % FOLDS).cast("int").alias("fold"),
        F.concat(F.lit("C"), F.col("label").cast("string")).alias("true_label"),
        F.get(ten, (F.array_position(first, F.array_max(first)) - 1).cast("int")).alias("predicted_label"),
        F.transform(raised, lambda v: v / total).alias("scores"),
        (F.col("embedding")[0].cast("double") - F.col("embedding")[1].cast("double")).alias("margin"),
    )


# --- barcodes -------------------------------------------------------------


def _participant() -> Column:
    digest = F.upper(F.md5(F.col("o_custkey").cast("string").cast("binary")))
    return F.concat(F.lit("TCGA-"), F.substring(digest, 1, 2), F.lit("-"), F.substring(digest, 3, 4))


def _sample_code() -> Column:
    kind = F.col("o_orderkey") % 10
    return F.when(kind == 0, "11").when(kind == 1, "06").otherwise("01")


def _vial() -> Column:
    return F.chr(F.lit(65) + F.col("o_orderkey") % 3)


def _tail() -> Column:
    return F.concat(F.lit("-A"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit("-07"))


def _portion() -> Column:
    return F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")


def order_barcode() -> Column:
    return F.concat(_participant(), F.lit("-"), _sample_code(), _vial(), F.lit("-"), _portion(), F.lit("R"), _tail())


def aliquots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as one measured aliquot of its customer."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("matrix_index"), order_barcode().alias("barcode"))


def messy_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliquot barcodes with typical damage by order status and priority."""
    good = order_barcode()
    text = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("  "), F.lower(good), F.lit(" ")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", _participant())
        .when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), F.substring(good, 1, 7))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit("X"), good))
        .when(F.col("o_totalprice") > 450000, F.concat(_participant(), F.lit("-0X-01R")))
        .otherwise(good)
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("matrix_index"), text.alias("barcode"))


def compact_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliquot barcodes where open orders carry the fused sample and portion field."""
    fused = F.concat(_participant(), F.lit("-"), _sample_code(), _vial(), _portion(), _tail())
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("matrix_index"),
        F.when(F.col("o_orderstatus") == "O", fused).otherwise(order_barcode()).alias("barcode"),
    )


def raw_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality annotations as a raw text table, one row per order."""
    return table(spark, sf_dir, "orders").select(
        order_barcode().alias("aliquot_barcode"),
        F.lower(F.element_at(F.split("o_orderpriority", "-", 2), 2)).alias("cancer type"),
        F.when(F.col("o_orderstatus") == "P", "OtherPlatform").otherwise(RNA_PLATFORM).alias("platform"),
        F.when(F.col("o_totalprice") > 400000, "True").when(F.col("o_orderstatus") == "F", "").otherwise("no").alias("Do_not_use"),
    )


def customer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rows keyed by customer, so repeat customers carry several versions."""
    return table(spark, sf_dir, "orders").select(
        F.concat(_participant(), F.lit("-01A")).alias("aliquot_barcode"),
        F.concat(_participant(), F.lit("-01")).alias("sample_barcode"),
        _participant().alias("participant_barcode"),
        F.upper(F.element_at(F.split("o_orderpriority", "-", 2), 2)).alias("cancer_type"),
        F.when(F.col("o_orderstatus") == "P", RNA_PLATFORM).otherwise("OtherPlatform").alias("platform"),
        (F.col("o_totalprice") > 400000).alias("do_not_use"),
    )


def document_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("matrix_index"), F.col("doc_id").cast("string").alias("barcode")
    )


def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("aliquot_barcode"),
        F.when(F.col("quality") == 1, RNA_PLATFORM).otherwise("OtherPlatform").alias("platform"),
    )


# --- wide text ------------------------------------------------------------


def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide text table: one line per vector, one column per dimension, with missing-value words.

    The header names every dimension's sample; each fourth one is a normal sample.
    """
    source = table(spark, sf_dir, "embeddings")
    word = lambda i: F.get(F.array(F.lit("NA"), F.lit(""), F.lit("nan")), (i % 3).cast("int"))
    cells = F.transform(
        "embedding",
        lambda v, i: F.when(_missing_at(F.col("vec_id"), i), word(i)).otherwise(v.cast("string")),
    )
    name = F.concat(F.lit("SYM"), F.col("vec_id"), F.lit("|"), F.col("vec_id") + 1000)
    body = source.select(
        (F.col("vec_id") + 1).cast("bigint").alias("line_index"), F.concat_ws("\t", name, F.array_join(cells, "\t")).alias("line")
    )
    width = source.agg(F.max(F.size("embedding")).alias("n"))
    column = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.concat(
            F.lit("tcga-AA-"), F.lpad(i.cast("string"), 4, "0"), F.when(i % 4 == 3, "-11A").otherwise("-01A"), F.lit("-01R-A001-07")
        ),
    )
    head = width.select(F.lit(0).cast("bigint").alias("line_index"), F.concat_ws("\t", F.lit("gene_id"), F.array_join(column, "\t")).alias("line"))
    return head.unionByName(body)


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide lines with damage by label: an extra value, a lost value, a value that is no number."""
    labels = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("line_index"), "label")
    line = (
        F.when(F.col("label") == 0, F.concat("line", F.lit("\t1.5")))
        .when(F.col("label") == 1, F.regexp_replace("line", "\t[^\t]*$", ""))
        .when(F.col("label") == 2, F.regexp_replace("line", "\t[^\t]*$", "\tabc"))
        .otherwise(F.col("line"))
    )
    return wide_lines(spark, sf_dir).join(labels, "line_index", "left").select("line_index", line.alias("line"))


# --- evidence -------------------------------------------------------------


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(candidate_id, event_type, k, fold, value, seconds)``: mean and sum of event values per candidate and fold.

    Values are added up as whole billionths, so the order of adding changes no digit; groups
    with values that are not finite keep the plain mean and sum.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    finite = F.abs("value") < float("inf")
    total = F.sum(F.when(finite, F.round(F.col("value") * 1e9)).cast("decimal(38,0)")).cast("double")
    exact = F.count("value") == F.count_if(finite)
    return (
        table(spark, sf_dir, "events")
        .select("event_type", k.alias("k"), (F.col("event_id") % FOLDS).cast("int").alias("fold"), "value")
        .groupBy("event_type", "k", "fold")
        .agg(
            F.when(exact, F.try_divide(total, F.count("value")) / 1e9).otherwise(F.avg("value")).alias("value"),
            F.when(exact, total / 1e9).otherwise(F.sum("value")).alias("seconds"),
        )
        .select(F.concat_ws(":", "event_type", F.lpad(F.col("k").cast("string"), 3, "0")).alias("candidate_id"), "*")
    )


def evidence(spark: SparkSession, sf_dir: str, tainted: bool = False) -> DataFrame:
    """Evidence documents of all three shapes from the event log.

    ``tainted`` marks signup documents as holdout users and view documents as final scope.
    """
    summary = fold_metrics(spark, sf_dir).groupBy("event_type", "k").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.sum("seconds").alias("seconds")
    )
    scope = F.lit(DEVELOPMENT_SCOPE)
    used = F.lit(False)
    if tainted:
        scope = F.when(F.col("event_type") == "view", FINAL_SCOPE).otherwise(DEVELOPMENT_SCOPE)
        used = F.col("event_type") == "signup"
    measured = F.struct(
        F.struct(F.col("mean"), F.col("std")).alias("macro_f1"),
        F.struct((F.col("mean") / 2).alias("mean")).alias("balanced_accuracy"),
    ).alias("metrics")
    head = (scope.alias("evaluation_scope"), used.alias("holdout_used"))

    def documents(source: DataFrame, candidate: Column, file: Column, field: str, *extra: Column) -> DataFrame:
        gathered = source.groupBy("event_type", file.alias("evidence_file")).agg(F.collect_list(candidate).alias(field))
        return gathered.select("evidence_file", F.to_json(F.struct(*head, *extra, F.col(field))).alias("document"))

    name = F.concat("event_type", F.lit(".json"))
    wall = F.col("seconds").alias("wall_seconds")
    model = F.struct(F.concat(F.lit("k"), F.col("k")).alias("model"), measured, wall)
    budget = F.struct(F.lit("elastic_net").alias("model"), F.col("k").alias("gene_budget"), measured, wall)
    device = F.struct(
        F.lit("boosted").alias("model"), F.lit("cpu").alias("resolved_device"), F.col("k").alias("gene_budget"), measured, wall
    )
    lists = documents(summary.where(F.col("event_type").isin("click", "view", "signup")), model, name, "models")
    budgets = documents(
        summary.where("event_type = 'error'"), budget, name, "budgets", F.lit("elastic_net").alias("model")
    )
    single = summary.where("event_type = 'purchase'").select(
        F.concat("event_type", F.lit("-"), "k", F.lit(".json")).alias("evidence_file"),
        F.to_json(F.struct(*head, device.alias("benchmark"))).alias("document"),
    )
    return lists.unionByName(budgets).unionByName(single)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as one timed run; purchases ran on the other device, errors took no time."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run"),
        F.when(F.col("event_type") == "purchase", "cuda").otherwise("cpu").alias("device"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("wall_seconds"),
    )
