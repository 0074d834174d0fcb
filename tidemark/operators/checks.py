"""Column checks: missing, constant, skewed, imbalanced, correlated, leaking and outlying data."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import AuditConfig
from ..functions.selection import exact_quantiles
from ..functions.stats import cardinality, correlations, finite, moments, unbiased_skew
from ..schema import (banded, categorical_columns, col, comparable, flat_columns, local_frame, materialise, number,
                      numeric_columns, run_together, text_columns, value)

DEFAULT = AuditConfig()


def _explode_columns(wide: DataFrame, cols: Sequence[str], made: dict[str, Sequence[Column]]) -> DataFrame:
    """One row per audited column from a one-row wide aggregate."""
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), *made[c]) for c in cols])).alias("m")).select("m.*")


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, skew: bool = True) -> DataFrame:
    """(feature, total, present, all_missing, constant, skew): one row per column, no shuffle of rows.

    Missing, constant and skewed columns are all read off this table.  Constant means smallest equals
    largest, which needs no distinct count.  Numbers and text are read by separate scans of their own
    columns, as text ranges would take the whole aggregate off the code-generated path.
    """
    cols = list(cols or flat_columns(df))
    numeric = [c for c in cols if c in set(numeric_columns(df))]
    other = [c for c in cols if c not in numeric]
    parts = []
    if numeric:
        g1 = unbiased_skew(F.col("skew"), F.col("n")) if skew else F.lit(None).cast("double")
        parts.append(moments(df, numeric, fields=("n", "nulls", "min", "max", *(["skew"] if skew else []))).select(
            "feature", (F.col("n") + F.col("nulls")).alias("total"), F.col("n").alias("present"),
            F.col("min").isNull().alias("all_missing"),
            (F.col("min").isNull() | (F.col("min") == F.col("max"))).alias("constant"), g1.alias("skew")))
    if other:
        wide = df.agg(F.count(F.lit(1)).alias("total"), *[
            f(value(df, c)).alias(f"{f.__name__}{k}") for k, c in enumerate(other) for f in (F.count, F.min, F.max)])
        made = {c: [F.col("total"), F.col(f"count{k}").alias("present"), F.col(f"min{k}").isNull().alias("all_missing"),
                    (F.col(f"min{k}").isNull() | (F.col(f"min{k}") == F.col(f"max{k}"))).alias("constant"),
                    F.lit(None).cast("double").alias("skew")] for k, c in enumerate(other)}
        parts.append(_explode_columns(wide, other, made))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def missing_values(df: DataFrame, cols: Sequence[str] | None = None, profile: DataFrame | None = None) -> DataFrame:
    """(feature, missing_pct) for columns with at least one missing cell."""
    profile = column_profile(df, cols, skew=False) if profile is None else profile
    pct = (F.col("total") - F.col("present")) / F.col("total") * 100
    return (profile.filter("total > 0").select("feature", pct.alias("missing_pct")).filter("missing_pct > 0"))


def constant_features(df: DataFrame, cols: Sequence[str] | None = None, profile: DataFrame | None = None
                      ) -> DataFrame:
    """(feature, all_missing) for columns with at most one distinct value."""
    profile = column_profile(df, cols, skew=False) if profile is None else profile
    return profile.filter("constant").select("feature", "all_missing")


def near_constant(df: DataFrame, cols: Sequence[str] | None = None, share: float = DEFAULT.near_constant_share
                  ) -> DataFrame:
    """(feature, top_share) where one value holds more than ``share`` of the present cells, but not all.

    A value above half of the rows is always the first item of a frequent-items sketch, so the sketch
    names one candidate per column and a second pass counts it exactly: two scans, no shuffle.
    """
    if not 0.5 <= share < 1:
        raise ValueError("share must be at least 0.5 and below 1")
    cols = list(cols or flat_columns(df))
    picks = df.select(*[comparable(df, c).alias(f"v{k}") for k, c in enumerate(cols)]).agg(*[
        F.expr(f"approx_top_k(v{k}, 1, 1000) FILTER (WHERE v{k} IS NOT NULL)").alias(f"t{k}")
        for k in range(len(cols))])
    top = picks.select(*[F.try_element_at(F.col(f"t{k}"), F.lit(1)).getField("item").alias(f"c{k}")
                         for k in range(len(cols))]).first()
    present = [(k, c) for k, c in enumerate(cols) if top[f"c{k}"] is not None]
    if not present:
        return local_frame(df.sparkSession, [], "feature string, top_share double")
    hits = df.select(*[(comparable(df, c) == F.lit(top[f"c{k}"])).cast("int").alias(c) for k, c in present])
    return (hits.unpivot([], [col(c) for _, c in present], "feature", "hit").groupBy("feature")
            .agg((F.sum("hit") / F.count("hit")).alias("top_share"))
            .filter((F.col("top_share") > share) & (F.col("top_share") < 1)))


def high_cardinality(df: DataFrame, cols: Sequence[str] | None = None, limit: int = DEFAULT.cardinality_limit
                     ) -> DataFrame:
    """(feature, n_unique) for non-numeric columns with more than ``limit`` values."""
    cols = list(categorical_columns(df) if cols is None else cols)
    if not cols:
        return local_frame(df.sparkSession, [], "feature string, n_unique bigint")
    return cardinality(df, cols).filter(F.col("n_unique") > limit).select("feature", "n_unique")


def high_cardinality_text(df: DataFrame, cols: Sequence[str] | None = None,
                          limit: int = DEFAULT.cardinality_limit_text) -> DataFrame:
    """(feature, n_unique, severity) for text columns; high above three times the limit."""
    cols = list(text_columns(df) if cols is None else cols)
    if not cols:
        return local_frame(df.sparkSession, [], "feature string, n_unique bigint, severity string")
    return high_cardinality(df, cols, limit).withColumn(
        "severity", banded(F.col("n_unique"), [(3 * limit, "high")], "medium"))


def skewness(df: DataFrame, target: str | None = None, cols: Sequence[str] | None = None,
             limit: float = DEFAULT.skew_limit, profile: DataFrame | None = None) -> DataFrame:
    """(feature, skew): bias-corrected skewness beyond ``limit`` on either side."""
    if profile is None:
        profile = column_profile(df, cols or numeric_columns(df))
    if target is not None:
        profile = profile.filter(F.col("feature") != target)
    return profile.select("feature", "skew").filter(F.abs("skew") > limit)


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, cnt, share) over present target values."""
    counts = (df.select(value(df, target).alias("class")).filter("class is not null")
              .groupBy("class").agg(F.count(F.lit(1)).alias("cnt")))
    total = counts.agg(F.sum("cnt")).scalar()
    return counts.select(F.col("class").cast("string").alias("class"), "cnt", (F.col("cnt") / total).alias("share"))


def class_imbalance(df: DataFrame, target: str, task: str = "classification",
                    minority_pct: float = DEFAULT.minority_pct) -> DataFrame:
    """(minority_class_percentage, is_imbalanced, num_classes); no row for regression or a missing target."""
    if task == "regression" or target not in df.columns:
        return local_frame(df.sparkSession, [],
                           "minority_class_percentage double, is_imbalanced boolean, num_classes bigint")
    counts = (df.select(value(df, target).alias("class")).filter("class is not null")
              .groupBy("class").agg(F.count(F.lit(1)).alias("cnt")))
    pct = F.min("cnt") / F.sum("cnt") * 100
    return counts.agg(pct.alias("minority_class_percentage"), (pct < minority_pct).alias("is_imbalanced"),
                      F.count(F.lit(1)).alias("num_classes")).filter("num_classes > 0")


def _varying(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with more than one value, in the given order."""
    spread = {r["feature"]: r for r in moments(df, cols, fields=("min", "max")).collect()} if cols else {}
    return [c for c in cols if spread[c]["min"] is not None and spread[c]["min"] != spread[c]["max"]]


def name_suffix_pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    """Columns named ``<x>_correlated`` next to ``<x>`` count as a pair whatever their values say."""
    pairs = [(c.replace("_correlated", ""), c) for c in cols if c.endswith("_correlated")]
    return [(a, b) for a, b in pairs if a in cols]


def high_correlation(df: DataFrame, target: str | None = None, cols: Sequence[str] | None = None,
                     limit: float = DEFAULT.correlation_limit) -> DataFrame:
    """(feature_a, feature_b, corr, rule) for pairs with an absolute correlation of at least ``limit``."""
    cols = list(cols or numeric_columns(df))
    drop = target or ("target" if "target" in cols else None)
    cols = _varying(df, [c for c in cols if c != drop])
    schema = "feature_a string, feature_b string, corr double, rule string"
    named = local_frame(df.sparkSession, [(a, b, 1.0, "name_suffix") for a, b in name_suffix_pairs(cols)], schema)
    if len(cols) < 2:
        return local_frame(df.sparkSession, [], schema)
    found = (correlations(df, cols)
             .select("feature_a", "feature_b", F.abs("corr").alias("corr"), F.lit("pearson").alias("rule"))
             .filter(F.col("corr") >= limit))
    return named.unionByName(found)


def target_leakage(df: DataFrame, target: str, cols: Sequence[str] | None = None,
                   limit: float = DEFAULT.leakage_limit) -> DataFrame:
    """(feature, corr) for numeric features almost equal to a numeric target."""
    cols = list(cols or numeric_columns(df))
    if target not in numeric_columns(df):
        return local_frame(df.sparkSession, [], "feature string, corr double")
    return correlations_with(df, target, [c for c in cols if c != target]).filter(F.col("corr") > limit)


def correlations_with(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """(feature, corr): absolute correlation of each column with the target, rows with both present."""
    y = number(df, target)
    long = (df.select(y.alias("__y"), *[number(df, c).alias(c) for c in cols])
            .unpivot(["__y"], [col(c) for c in cols], "feature", "x").filter("x is not null and __y is not null"))
    return long.groupBy("feature").agg(finite(F.abs(F.try_divide(
        F.covar_pop("x", "__y"), F.stddev_pop("x") * F.stddev_pop("__y")))).alias("corr"))


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every given numeric column is present, as doubles."""
    rows = df.select(*[number(df, c).alias(c) for c in cols])
    return rows.filter(reduce(and_, [col(c).isNotNull() for c in cols], F.lit(True)))


def iqr_outliers(df: DataFrame, target: str | None = None, cols: Sequence[str] | None = None,
                 factor: float = DEFAULT.iqr_factor) -> DataFrame:
    """(feature, q1, q3, lower, upper, outliers) on rows complete in every numeric column.

    Columns with at most two values or no interquartile range are skipped.
    """
    cols = list(cols or numeric_columns(df))
    schema = "feature string, q1 double, q3 double, lower double, upper double, outliers bigint"
    rows = complete_rows(df, cols)
    wanted = [c for c in cols if c != target]
    if not wanted:
        return local_frame(df.sparkSession, [], schema)
    ends = {r["feature"]: r for r in moments(rows, wanted, fields=("n", "min", "max")).collect()}
    bounds = {}
    for c, q in exact_quantiles(rows, wanted, [0.25, 0.75], stats=ends).items():
        if q and q[1] > q[0]:
            span = factor * (q[1] - q[0])
            bounds[c] = (q[0], q[1], q[0] - span, q[1] + span)
    if not bounds:
        return local_frame(df.sparkSession, [], schema)
    keep = list(bounds)
    # at most two distinct values <=> nothing strictly between the smallest and the largest
    limits = F.broadcast(local_frame(df.sparkSession, [(c, *bounds[c]) for c in keep],
                                     "feature string, q1 double, q3 double, lower double, upper double"))
    sides = [(*bounds[c][2:], ends[c]["min"], ends[c]["max"]) for c in keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, len(keep)), np.int64)
        for batch in batches:
            for k, (lower, upper, lo, hi) in enumerate(sides):
                x = batch.column(k).to_numpy()
                found[:, k] += np.count_nonzero((x < lower) | (x > upper)), np.count_nonzero((x > lo) & (x < hi))
        yield pa.RecordBatch.from_arrays([pa.array(keep), *map(pa.array, found)], names=["feature", "outliers", "inner"])

    counted = (rows.select(*[col(c).alias(f"x{k}") for k, c in enumerate(keep)])
               .mapInArrow(count, "feature string, outliers bigint, inner bigint").groupBy("feature")
               .agg(F.sum("outliers").alias("outliers"), F.sum("inner").alias("inner")))
    return (counted.join(limits, "feature").filter("outliers > 0 and inner > 0")
            .select("feature", "q1", "q3", "lower", "upper", "outliers"))


def outlier_contamination(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(complete_rows, contamination): expected outlier share, 100 rows but between 1 % and 5 %."""
    rows = complete_rows(df, list(cols or numeric_columns(df)))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("complete_rows")).filter("complete_rows >= 50").select(
        "complete_rows", F.least(F.lit(0.05), F.greatest(F.lit(0.01), F.lit(100.0) / F.col("complete_rows")))
        .alias("contamination"))


def issues(df: DataFrame, kind: str, column: Column, severity: Column | str, description: Column, metric: Column
           ) -> DataFrame:
    """Rows of a check as issues."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(kind).alias("type"), column.alias("column"), sev.alias("severity"),
                     description.alias("description"), metric.cast("double").alias("metric"))


def strong_pairs(df: DataFrame, cols: Sequence[str], target: str | None, limit: float) -> DataFrame:
    """(feature_a, feature_b, corr): absolute correlations of at least ``limit`` and all those of the target."""
    if len(cols) < 2:
        return local_frame(df.sparkSession, [], "feature_a string, feature_b string, corr double")
    keep = F.col("corr") >= limit
    if target is not None:
        keep = keep | (F.col("feature_a") == target) | (F.col("feature_b") == target)
    return (correlations(df, cols).select("feature_a", "feature_b", F.abs("corr").alias("corr"))
            .filter(F.col("corr").isNotNull() & keep))


def column_checks(df: DataFrame, target: str, task: str = "classification", exclude: Sequence[str] = (),
                  config: AuditConfig = DEFAULT, more: Mapping[str, Callable[[], DataFrame]] | None = None
                  ) -> dict[str, DataFrame]:
    """Every column check of one table, each run once; results are a few rows per column.

    One scan gives missing, constant and skewed columns, and one pass over column pairs gives both the
    high correlations and the target leakage.  ``more`` adds checks to run alongside.
    """
    cols, numeric = flat_columns(df, exclude), numeric_columns(df, exclude)
    profile = materialise(column_profile(df, cols))
    fixed = {r["feature"] for r in profile.filter("constant").collect()}
    varying = [c for c in numeric if c not in fixed]
    y = target if target in varying else None
    from .rows import duplicates
    tasks: dict[str, Callable[[], DataFrame]] = {
        "outliers": lambda: iqr_outliers(df, target, numeric, config.iqr_factor),
        "pairs": lambda: strong_pairs(df, varying, y, config.correlation_limit),
        "duplicates": lambda: duplicates(df, cols),
        "near_constant_features": lambda: near_constant(df, [c for c in cols if c not in fixed],
                                                        config.near_constant_share),
        "high_cardinality": lambda: high_cardinality(df, categorical_columns(df, exclude), config.cardinality_limit),
        "class_imbalance": lambda: class_imbalance(df, target, task, config.minority_pct),
        **(more or {}),
    }
    out = run_together(tasks)
    pairs = out.pop("pairs")
    named = local_frame(df.sparkSession, [(a, b, 1.0, "name_suffix") for a, b in name_suffix_pairs(varying)],
                        "feature_a string, feature_b string, corr double, rule string")
    every = named.unionByName(pairs.filter(F.col("corr") >= config.correlation_limit)
                              .withColumn("rule", F.lit("pearson")))

    def without(name: str | None) -> DataFrame:
        return every if name is None else every.filter((F.col("feature_a") != name) & (F.col("feature_b") != name))

    other = F.when(F.col("feature_a") == target, F.col("feature_b")).otherwise(F.col("feature_a"))
    leaks = pairs.filter((F.col("feature_a") == target) | (F.col("feature_b") == target))
    out.update({
        "profile": profile,
        "missing_values": missing_values(df, cols, profile),
        "constant_features": constant_features(df, cols, profile),
        "skewed_features": skewness(df, target, numeric, config.skew_limit, profile),
        "high_correlation": without(target),
        # the issue list names no target here: only a column called "target" is left out
        "summary_correlation": without("target" if "target" in numeric else None),
        "target_leakage": leaks.filter(F.col("corr") > config.leakage_limit).select(other.alias("feature"), "corr"),
    })
    return out


def summarise(found: Mapping[str, DataFrame], target: str) -> DataFrame:
    """The tables of ``column_checks`` as issues (type, column, severity, description, metric)."""
    fmt = F.format_string
    pct, share, unique, skew = F.col("missing_pct"), F.col("top_share"), F.col("n_unique"), F.col("skew")
    dup, minority, corr, p = (F.col(c) for c in ("duplicate_percentage", "minority_class_percentage", "corr", "pct"))
    feature, whole = F.col("feature"), F.lit("dataset_wide")
    parts = [
        issues(found["missing_values"], "missing_values", feature,
               banded(pct, [(50, "critical"), (30, "high"), (10, "medium")], "low"),
               fmt("%.1f%% missing values detected.", pct), pct),
        issues(found["constant_features"], "constant_feature", feature, "high",
               F.lit("Feature contains only one unique value."), F.lit(1.0)),
        issues(found["near_constant_features"], "near_constant_feature", feature, "medium",
               fmt("Highly imbalanced feature (%.1f%% dominant value).", share * 100), share),
        issues(found["high_cardinality"], "high_cardinality", feature, "high",
               fmt("Categorical feature with excessive cardinality (%d unique values).", unique), unique),
        issues(found["skewed_features"], "high_skewness", feature, "medium",
               fmt("High numerical skewness detected (Skew: %.2f).", skew), skew),
        issues(found["duplicates"].filter("has_duplicates"), "duplicate_rows", whole,
               banded(dup, [(5, "high")], "medium"),
               fmt("%d duplicate rows (%.1f%%).", F.col("total_duplicates"), dup), dup),
        issues(found["class_imbalance"].filter("is_imbalanced"), "class_imbalance", F.lit(target),
               F.when(minority < 5, "critical").when(minority < 10, "high").otherwise("medium"),
               fmt("Severe target imbalance (%.1f%%).", minority), minority),
        issues(found["summary_correlation"], "high_correlation", F.concat_ws(" ↔ ", "feature_a", "feature_b"),
               banded(corr, [(0.95, "high")], "medium"),
               fmt("Strong multicollinearity detected (%.3f).", corr), corr),
        issues(found["target_leakage"], "target_leakage", feature, "critical",
               fmt("Potential target leakage detected (%.3f).", corr), corr),
    ]
    if "multivariate_outliers" in found:
        m = F.col("percentage")
        parts.append(issues(found["multivariate_outliers"].filter("outlier_count > 0"), "multivariate_outliers", whole,
                            banded(m, [(3, "high")], "medium"),
                            fmt("Detected %d multivariate anomalies (%.1f%%).", F.col("outlier_count"), m), m))
    total = found["profile"].agg(F.max("total")).scalar()
    worst = (found["outliers"].orderBy(F.desc("outliers"), "feature").limit(5)
             .select("feature", "outliers", (F.col("outliers") / total * 100).alias("pct")))
    parts.append(issues(worst, "outliers", feature, banded(p, [(10, "high"), (5, "medium")], "low"),
                        fmt("%d univariate outliers detected (%.1f%%).", F.col("outliers"), p), p))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def issue_summary(df: DataFrame, target: str, task: str = "classification", exclude: Sequence[str] = (),
                  config: AuditConfig = DEFAULT) -> DataFrame:
    """All column checks as one issue table."""
    return summarise(column_checks(df, target, task, exclude, config), target)
