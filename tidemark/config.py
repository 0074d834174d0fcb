"""Thresholds of the audit.  The numbers are the semantics, so they live in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AuditConfig:
    """Settings of one audit run; every threshold can be overridden by the caller."""

    test_fraction: float = 0.2
    seed: int = 42
    stratify_below_classes: int = 20
    dev_rows: int = 5000
    preview_rows: int = 5
    # column checks
    near_constant_share: float = 0.99
    cardinality_limit: int = 100
    cardinality_limit_text: int = 50
    skew_limit: float = 2.0
    minority_pct: float = 20.0
    correlation_limit: float = 0.9
    leakage_limit: float = 0.95
    iqr_factor: float = 1.5
    # drift
    psi_bins: int = 10
    stability_bins: int = 30
    variance_ratio_limit: float = 3.0
    missingness_delta: float = 0.15
    # models
    num_trees: int = 100
    max_depth: int = 10
    dev_num_trees: int = 10
    dev_max_depth: int = 5
    cv_folds: int = 5
    permutation_repeats: int = 5
    min_category_share: float = 0.01


# The smoothing constant used by PSI, symmetric KL, variance ratio and calibration.
EPSILON = 1e-8

# Severities by rising priority.
SEVERITY_PRIORITY = {"info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}

# Other spellings of a severity.
SEVERITY_ALIASES = {"warn": "medium", "warning": "medium", "severe": "critical", "danger": "critical"}

# Text that counts as a missing cell in a CSV (own list, then the pandas defaults).
MISSING_TOKENS = ("", " ", "NA", "N/A", "NULL", "null", "None", "none", "?", "-")
PANDAS_MISSING_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Metric names by falling preference when one metric stands for a model.
PRIMARY_METRICS = ("f1", "accuracy", "precision", "recall", "r2", "rmse", "mae")
ERROR_METRICS = ("rmse", "mae")

# Recommendation text per issue type; {columns} is the column preview.
RECOMMENDATION_TEXT = {
    "missing_values": "Investigate missing-value patterns and consider imputation improvements for: {columns}.",
    "feature_drift": "Detected train/test distribution drift. Review feature stability and data collection "
                     "for: {columns}.",
    "multicollinearity": "High multicollinearity detected. Consider feature selection or dimensionality "
                         "reduction for: {columns}.",
    "split_overlap": "Potential train/test leakage detected. Review dataset splitting strategy and "
                     "deduplication safeguards.",
    "class_imbalance": "Class imbalance detected. Consider rebalancing techniques, class weighting, or "
                       "threshold tuning.",
    "outliers": "Outlier-heavy distributions detected. Consider robust scaling, clipping, or "
                "distribution-aware preprocessing.",
    "high_cardinality": "High-cardinality categorical features detected. Review encoding strategy and memory "
                        "impact.",
}
# The texts around the recommendations.
RECOMMENDATION_FALLBACK = ("Review detected issues and validate data quality, preprocessing stability, and "
                           "model robustness.")
CRITICAL_PREFIX = "Immediate attention recommended. "
