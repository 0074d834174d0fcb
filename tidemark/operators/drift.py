"""Train against test: PSI, symmetric KL, variance ratio, missingness, multicollinearity."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import EPSILON, AuditConfig
from ..functions.selection import median
from ..functions.stats import co_moments, histogram, moments, widened
from ..schema import banded, col, flat_columns, local_frame, materialise, number, numeric_columns, value

DEFAULT = AuditConfig()
# Up to this many columns the Gram matrix is a plain SQL aggregate; wider ones use numpy blocks per task.
GRAM_SQL_COLUMNS = 12


def _ranges(df: DataFrame, cols: Sequence[str], split: str) -> dict[str, dict[str, tuple[float, float, int]]]:
    """(min, max, count) per side for the columns with values, all finite, on both sides: one scan, a few numbers."""
    out: dict[str, dict[str, tuple[float, float, int]]] = {c: {} for c in cols}
    for r in moments(df, cols, by=split, fields=("n", "min", "max")).collect():
        if r["n"] and r[split] in ("train", "test") and math.isfinite(r["min"]) and math.isfinite(r["max"]):
            out[r["feature"]][r[split]] = (float(r["min"]), float(r["max"]), r["n"])
    return {c: sides for c, sides in out.items() if len(sides) == 2}


def _counts(df: DataFrame, edges: dict[str, tuple[float, float]], bins: int, split: str) -> DataFrame:
    """(feature, bin, train, test): rows per bin, -1 for values outside; a few rows per column."""
    return materialise(histogram(df, {c: widened(lo, hi) for c, (lo, hi) in edges.items()}, bins, split))


def _shares(counts: DataFrame, features: Sequence[str], bins: int) -> DataFrame:
    """(feature, bin, p, q): smoothed train and test shares of every bin, empty bins included."""
    grid = (local_frame(counts.sparkSession, [(c,) for c in features], "feature string")
            .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))))
    full = grid.join(counts, ["feature", "bin"], "left").na.fill(0, ["train", "test"])
    whole = Window.partitionBy("feature")

    def share(side: str) -> Column:
        return (F.col(side) + F.lit(EPSILON)) / (F.sum(side).over(whole) + F.lit(EPSILON))

    return full.select("feature", "bin", share("train").alias("p"), share("test").alias("q"))


def psi(df: DataFrame, cols: Sequence[str] | None = None, split: str = "split", bins: int = DEFAULT.psi_bins
        ) -> DataFrame:
    """(feature, psi, out_of_range_pct): population stability of test against train.

    Bins are equal-width over the train range.  Test values outside it do not enter the score, so
    their share is reported next to it.  A column that is empty or holds infinite values on one side scores 0.
    """
    cols = list(cols or numeric_columns(df))
    ranges = _ranges(df, cols, split)
    empty = local_frame(df.sparkSession, [(c, 0.0, 0.0) for c in cols if c not in ranges],
                        "feature string, psi double, out_of_range_pct double")
    if not ranges:
        return empty
    edges = {c: side["train"][:2] for c, side in ranges.items()}
    counts = _counts(df, edges, bins, split)
    p, q = F.col("p"), F.col("q")
    score = F.sum((p - q) * F.ln(p / q))
    raw = _shares(counts, list(edges), bins).groupBy("feature").agg(
        F.when(F.isnan(score), F.lit(0.0)).when(score == float("inf"), F.lit(999.0)).otherwise(score).alias("psi"))
    outside = counts.groupBy("feature").agg(
        (F.sum(F.when(F.col("bin") < 0, F.col("test")).otherwise(0)) / F.sum("test") * 100).alias("out_of_range_pct"))
    return raw.join(outside, "feature").select("feature", "psi", "out_of_range_pct").unionByName(empty)


def psi_severity(score: Column) -> Column:
    return F.when(score >= 0.50, "HIGH").when(score >= 0.25, "MEDIUM").otherwise("LOW")


def psi_table(scores: DataFrame) -> DataFrame:
    """(feature, psi_score, drift_severity, rank): rounded scores, most drift first."""
    rows = scores.select("feature", F.round("psi", 4).alias("psi_score"),
                         psi_severity(F.col("psi")).alias("drift_severity"))
    return rows.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("psi_score"), "feature")).cast("bigint"))  # one row per column


def drift_band(score: Column) -> Column:
    return F.when(score < 0.1, "low").when(score < 0.25, "medium").when(score < 0.5, "high").otherwise("critical")


def drift_bands(scores: DataFrame) -> DataFrame:
    """(band, features, n_features): feature names per drift band."""
    return (scores.groupBy(drift_band(F.col("psi")).alias("band"))
            .agg(F.array_sort(F.collect_list("feature")).alias("features"),
                 F.count(F.lit(1)).alias("n_features")))


# What each drift impact means for a deployment.
DRIFT_IMPACT = {
    "critical": ("Extensive distribution shift detected.",
                 "Model trained on significantly different distribution.", "Hold deployment immediately."),
    "high": ("Significant feature drift detected.", "Prediction quality may degrade.",
             "Deploy only with enhanced monitoring."),
    "medium": ("Moderate drift detected.", "Monitor feature stability in production.",
               "Track PSI during inference."),
}


def impact_severity(severe: Column) -> Column:
    return F.when(severe > 5, "critical").when(severe > 2, "high").otherwise("medium")


def drift_impact(scores: DataFrame) -> DataFrame:
    """(severe_features, severity, message, implication, action) over all features."""
    severe = F.count_if(F.col("psi") >= 0.25)
    text = F.create_map(*[x for k, (m, i, a) in DRIFT_IMPACT.items() for x in (F.lit(k), F.struct(
        F.lit(m).alias("message"), F.lit(i).alias("implication"), F.lit(a).alias("action")))])
    return (scores.agg(severe.alias("severe_features")).withColumn("severity", impact_severity(F.col("severe_features")))
            .withColumn("t", F.element_at(text, F.col("severity")))
            .select("severe_features", "severity", "t.message", "t.implication", "t.action"))


def variance_ratio(df: DataFrame, cols: Sequence[str] | None = None, split: str = "split") -> DataFrame:
    """(feature, train_var, test_var, ratio, severity); severity is missing for a stable column."""
    cols = list(cols or numeric_columns(df))
    per = moments(df, cols, by=split, fields=("var_pop",))

    def side(name: str) -> Column:
        return F.max(F.when(col(split) == name, F.col("var_pop"))).alias(f"{name}_var")

    long = per.groupBy("feature").agg(side("train"), side("test")).na.drop()
    ratio = F.greatest("train_var", "test_var") / (F.least("train_var", "test_var") + F.lit(EPSILON))
    return long.withColumn("ratio", ratio).withColumn(
        "severity", banded(F.col("ratio"), [(10, "critical"), (DEFAULT.variance_ratio_limit, "high")], None))


def feature_stability(df: DataFrame, cols: Sequence[str] | None = None, split: str = "split",
                      bins: int = DEFAULT.stability_bins) -> DataFrame:
    """(feature, kl_divergence, stability_score, rank) over bins of the pooled range."""
    cols = list(cols or numeric_columns(df))
    edges = {c: (min(v[0] for v in side.values()), max(v[1] for v in side.values()))
             for c, side in _ranges(df, cols, split).items()}
    if not edges:
        return local_frame(df.sparkSession, [],
                           "feature string, kl_divergence double, stability_score double, rank bigint")
    p, q = F.col("p"), F.col("q")
    kl = (F.sum(p * F.ln(p / q)) + F.sum(q * F.ln(q / p))) / 2.0
    scored = (_shares(_counts(df, edges, bins, split), list(edges), bins).groupBy("feature").agg(kl.alias("kl_divergence"))
              .withColumn("stability_score", F.exp(-F.col("kl_divergence"))))
    return scored.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("stability_score"), "feature")).cast("bigint"))  # one row per column


def informative_missingness(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """(feature, delta, severity): how far the mean target moves where a column is missing.

    One aggregate for all columns.  A column that is never or always missing is skipped, and a target
    that is no number gives no rows.
    """
    cols = [c for c in (cols or flat_columns(df)) if c != target]
    schema = "feature string, delta double, severity string"
    if target not in numeric_columns(df):
        return local_frame(df.sparkSession, [], schema)
    gaps = df.select(number(df, target).alias("__y"), *[value(df, c).isNull().alias(c) for c in cols]).unpivot(
        ["__y"], [col(c) for c in cols], "feature", "gap")
    long = gaps.groupBy("feature").agg(F.abs(F.avg(F.when(F.col("gap"), F.col("__y")))
                                             - F.avg(F.when(~F.col("gap"), F.col("__y")))).alias("delta"))
    return long.filter(F.col("delta") > DEFAULT.missingness_delta).withColumn(
        "severity", banded(F.col("delta"), [(0.30, "high")], "medium"))


def _gram(filled: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Uncentred sums of products over complete columns."""
    d = len(cols)
    out = np.zeros((d, d))
    if d <= GRAM_SQL_COLUMNS:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = filled.agg(*[F.sum(col(cols[i]) * col(cols[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            out[i, j] = out[j, i] = row[f"g{i}_{j}"]
    else:
        for r in co_moments(filled, cols).collect():  # d x d / 2 rows
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["cxy"] + r["n"] * r["mx"] * r["my"]
    return out


def vif(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(feature, vif): variance inflation without an intercept, from one Gram matrix.

    Infinite values are missing, missing values take the median, columns without values or without
    spread are dropped.  The data are read for the medians and for the sums of products only; the
    inverse is of a matrix with one row per column.  A singular matrix gives 999.
    """
    cols = list(cols or numeric_columns(df))
    finite = df.select(*[F.when(F.abs(number(df, c)) < float("inf"), number(df, c)).alias(c) for c in cols])
    stats = {r["feature"]: r for r in moments(finite, cols, fields=("n", "nulls", "min", "max")).collect()}
    cols = [c for c in cols if stats[c]["n"] > 0]
    gaps = [c for c in cols if stats[c]["nulls"] > 0]
    # a column with gaps keeps its spread when filled with its own median, unless it had none
    cols = [c for c in cols if stats[c]["min"] != stats[c]["max"]]
    schema = "feature string, vif double"
    if not cols:
        return local_frame(df.sparkSession, [], schema)
    fills = median(finite, [c for c in gaps if c in cols]) if gaps else {}
    filled = finite.select(*[(F.coalesce(col(c), F.lit(fills[c])) if fills.get(c) is not None else col(c)).alias(c)
                             for c in cols])
    gram = _gram(filled, cols)
    rms = np.sqrt(np.diag(gram))
    scaled = gram / np.outer(rms, rms)
    # singular or so close to it that the inverse is noise
    if np.linalg.matrix_rank(scaled, tol=1e-13) < len(cols):
        scores = [_vif_by_regression(scaled, i) for i in range(len(cols))]
    else:
        scores = list(np.diag(scaled) * np.diag(np.linalg.inv(scaled)))
    return local_frame(df.sparkSession, [(c, round(float(s), 4)) for c, s in zip(cols, scores)], schema)


def _vif_by_regression(scaled: np.ndarray, i: int) -> float:
    """One column on the others from the scaled Gram matrix, for a singular system."""
    rest = [k for k in range(len(scaled)) if k != i]
    if not rest:
        return 1.0
    weights, *_ = np.linalg.lstsq(scaled[np.ix_(rest, rest)], scaled[rest, i], rcond=1e-13)
    left = scaled[i, i] - scaled[rest, i] @ weights
    return 999.0 if left <= 1e-12 else float(scaled[i, i] / left)


def vif_table(scores: DataFrame) -> DataFrame:
    """(feature, vif_score, rank) for scores above 2."""
    return scores.filter("vif > 2").select("feature", F.round("vif", 2).alias("vif_score")).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("vif_score"), "feature")).cast("bigint"))


# Advice per multicollinearity band.
VIF_ADVICE = {
    "critical": ("critical_multicollinearity", "Coefficient estimates unstable under small perturbations.",
                 ["Investigate redundant features", "Apply PCA or feature reduction", "Use L1 regularization"]),
    "high": ("high_multicollinearity", "Model predictions may become unstable.",
             ["Consider Ridge regression", "Document feature correlations"]),
}


def vif_bands(scores: DataFrame) -> DataFrame:
    """(band, features, n_features): critical above 10, high above 5, moderate above 2."""
    band = banded(F.col("vif"), [(10, "critical"), (5, "high"), (2, "moderate")], None)
    return (scores.withColumn("band", band).filter("band is not null").groupBy("band")
            .agg(F.array_sort(F.collect_list("feature")).alias("features"), F.count(F.lit(1)).alias("n_features")))


def vif_recommendations(bands: DataFrame) -> DataFrame:
    """(recommendation_id, severity, issue, features, impact, actions) for the two upper bands."""
    advice = F.create_map(*[x for k, (i, m, a) in VIF_ADVICE.items() for x in (F.lit(k), F.struct(
        F.lit(i).alias("recommendation_id"), F.lit(m).alias("impact"),
        F.array(*[F.lit(s) for s in a]).alias("actions")))])
    limit = F.when(F.col("band") == "critical", F.lit(10)).otherwise(F.lit(5))
    return (bands.filter(F.col("band").isin(*VIF_ADVICE)).withColumn("a", F.element_at(advice, F.col("band")))
            .select("a.recommendation_id", F.col("band").alias("severity"),
                    F.format_string("%d features exceed VIF > %d", F.col("n_features"), limit).alias("issue"),
                    "features", "a.impact", "a.actions"))


def integrity_issues(overlap: DataFrame | None = None, drift: DataFrame | None = None, vifs: DataFrame | None = None,
                     ratios: DataFrame | None = None, missingness: DataFrame | None = None) -> DataFrame:
    """Split, drift, collinearity, variance and missingness findings as issues."""
    from .checks import issues
    fmt, parts = F.format_string, []
    if missingness is not None:
        d = F.col("delta")
        parts.append(issues(missingness, "informative_missingness", F.col("feature"), F.col("severity"),
                            fmt("Missingness appears target-correlated (delta=%.3f).", d), d))
    if ratios is not None:
        r = F.col("ratio")
        parts.append(issues(ratios.filter("severity is not null"), "variance_instability", F.col("feature"),
                            F.col("severity"), fmt("Variance instability detected (ratio=%.2f).", r), r))
    if overlap is not None:
        p = F.col("overlap_pct")
        parts.append(issues(overlap.filter("overlap_pct > 0"), "split_overlap", F.lit("dataset_wide"),
                            banded(p, [(5, "critical")], "high"),
                            fmt("Potential train/test overlap detected (%.2f%% overlap).", p), p))
    if drift is not None:
        s = F.col("psi_score")
        parts.append(issues(drift.filter(F.col("drift_severity").isin("MEDIUM", "HIGH")), "feature_drift",
                            F.col("feature"), F.lower("drift_severity"),
                            fmt("Distribution drift detected (PSI: %.2f).", s), s))
    if vifs is not None:
        v = F.col("vif")
        parts.append(issues(vifs.filter("vif > 5"), "multicollinearity", F.col("feature"),
                            banded(v, [(10, "critical")], "high"),
                            fmt("High multicollinearity detected (VIF: %.2f).", v), v))
    if not parts:
        raise ValueError("at least one finding table is needed")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
