"""Fixed values the results depend on."""

# --- fixed values: names, codes and defaults of the study design ---------
DEFAULT_SEED = 20260825
DEFAULT_HOLDOUT_FRACTION = 0.20
DEFAULT_FOLDS = 5

TARGET_CLASSES = (
    "BRCA",
    "LUAD",
    "LUSC",
    "KIRC",
    "KIRP",
    "LIHC",
    "STAD",
    "THCA",
    "UCEC",
    "COAD",
)
RNA_PLATFORM = "IlluminaHiSeq_RNASeqV2"
PRIMARY_SAMPLE_CODE = "01"

PARTICIPANT_PATTERN = "^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}$"
# participant, then optionally a sample code with a vial letter, then anything
BARCODE_PATTERN = "^(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4})(?:-([0-9]{2})([A-Z]?)(?:-.*)?)?$"
# six fields whose fourth fuses sample, vial and portion
COMPACT_PATTERN = "^((?:[^-]*-){3}[0-9]{2}[A-Z])([0-9]{2}(?:-[^-]*){2})$"

TRUE_WORDS = ("true", "t", "1", "yes", "y")
FALSE_WORDS = ("false", "f", "0", "no", "n", "")
MISSING_WORDS = ("", "na", "nan")

EXCLUSION_REASONS = (
    "unmatched_quality",
    "do_not_use",
    "non_primary",
    "non_target_cancer",
    "duplicate_participant",
)

SPLITS = ("development", "holdout")
DEVELOPMENT_SCOPE = "development_cross_validation_only"
FINAL_SCOPE = "locked_final_holdout_once"

AUDIT_PROBABILITIES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
AUDIT_QUANTILE_NAMES = ("q0", "q01", "q25", "q50", "q75", "q99", "q100")

GENE_BUDGETS = (20, 50, 100, 200, 500, 1_000, 5_000, "all")
FOCUSED_PAIRS = {
    "luad_lusc": ("LUAD", "LUSC"),
    "kirc_kirp": ("KIRC", "KIRP"),
}

CLASSICAL_MODELS = ("dummy", "logistic_l2", "elastic_net", "linear_svm", "pca_logistic")
LINEAR_MODELS = ("logistic_l2", "elastic_net", "linear_svm")
PIPELINE_FAMILIES = ("linear_gene_budget", "pca_logistic", "xgboost")

# probabilities are clipped to [eps, 1 - eps] before the log
LOG_LOSS_EPS = 2.220446049250313e-16

# --- fixed values: defaults of the boosted trees --------------------------
BOOSTED_DEFAULTS = {
    "n_estimators": 300,
    "max_depth": 6,
    "learning_rate": 0.05,
    "subsample": 0.8,
    "colsample_bytree": 0.5,
    "min_child_weight": 1.0,
    "reg_alpha": 0.0,
    "reg_lambda": 1.0,
    "gamma": 0.0,
    "max_bin": 256,
}
