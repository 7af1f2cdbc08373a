"""Fixed values of the data formats: protocols, descriptor names, field names, tokens."""

from __future__ import annotations

# The ten descriptors of a dataset, in report order.
DESCRIPTORS = (
    "n_samples",
    "n_features",
    "n_classes",
    "samples_per_feature",
    "categorical_fraction",
    "missing_fraction",
    "rows_with_missing_fraction",
    "constant_feature_fraction",
    "minority_class_fraction",
    "imbalance_ratio",
)

# Identifier and outcome columns of the meta-table.
IDENTIFIERS = ("dataset", "openml_id", "version", "family", "clinical")
GAP = "performance_gap_mlp_minus_gbdt"
SCORE_GBDT = "mean_balanced_accuracy_gbdt"
SCORE_DNN = "mean_balanced_accuracy_mlp"
OUTCOMES = (GAP, SCORE_GBDT, SCORE_DNN, "actual_best_pipeline", "near_tie_within_margin")

# Names a descriptor may not take, because a meta-row already uses them.
RESERVED_ROW_FIELDS = IDENTIFIERS + ("development_only", "result_mode") + OUTCOMES

FAMILIES = ("GBDT", "DNN")
MODEL_OF_FAMILY = {"GBDT": "hist_gradient_boosting", "DNN": "mlp"}

# Token that stands for a missing categorical value.
MISSING_LEVEL = "__missing__"

MATRIX_LIMIT_BYTES = 512 * 1024 * 1024
FLOAT_BYTES = 8
MAX_EXACT_INTEGER = 2**53 - 1
ARITHMETIC_TOLERANCE = 1e-12
MARGIN = 0.01
TUNING_SEED = 42

# Identity written into and expected from run artifacts; callers may pass their own.
PROJECT = "pairgauge"
