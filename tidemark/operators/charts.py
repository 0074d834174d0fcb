"""The tables behind the charts; drawing them is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.stats import correlations, moments
from ..schema import col, numeric_columns


def top_importance(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, max_features: int = 20) -> DataFrame:
    """(feature_a, feature_b, corr): signed, every ordered pair; the widest tables keep the columns of
    largest variance.  Fewer than two numeric columns give no rows."""
    cols = list(cols or numeric_columns(df))
    if len(cols) > max_features:
        spread = {r["feature"]: r["var_samp"] for r in moments(df, cols, fields=("var_samp",)).collect()}
        ranked = sorted((c for c in cols if spread[c] is not None), key=lambda c: (-spread[c], cols.index(c)))
        cols = [c for c in cols if c in set(ranked[:max_features])]
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double")
    pairs = correlations(df, cols).select("feature_a", "feature_b", "corr")
    return pairs.select(F.explode(F.array(
        F.struct(F.col("feature_a").alias("a"), F.col("feature_b").alias("b"), "corr"),
        F.struct(F.col("feature_b").alias("a"), F.col("feature_a").alias("b"), "corr"))).alias("p")).select(
            F.col("p.a").alias("feature_a"), F.col("p.b").alias("feature_b"), "p.corr").unionByName(
        moments(df, cols, fields=("var_samp",)).select(
            F.col("feature").alias("feature_a"), F.col("feature").alias("feature_b"),
            F.when(F.col("var_samp") > 0, F.lit(1.0)).alias("corr")))


def missing_top(missing: DataFrame, threshold: float = 0.05, n: int = 10) -> DataFrame:
    """The columns with most missing cells, from ``missing_values``."""
    return missing.filter(F.col("missing_pct") >= threshold).orderBy(F.desc("missing_pct"), "feature").limit(n)


def drift_bars(psi: DataFrame) -> DataFrame | None:
    """The PSI rows a drift chart needs, or ``None`` when a needed column is absent."""
    needed = ["feature", "psi_score", "drift_severity"]
    return psi.select(*[col(c) for c in needed]) if set(needed) <= set(psi.columns) else None
