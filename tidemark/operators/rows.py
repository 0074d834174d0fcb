"""Whole-row operators: repeated rows inside a table and rows shared by two splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import col, value


def _digests(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """128 bits for a row's values: what stands for the row in a shuffle, whatever its width.

    The hashes skip missing values, so which ones are missing is hashed too.
    """
    gaps = F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(F.lit(k), gaps, *map(col, cols)).alias(f"__h{k}") for k in (1, 2)]


def _clean(df: DataFrame, cols: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    return df.select(*[value(df, c).alias(c) for c in cols], *extra)


def duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(total_duplicates, duplicate_percentage, has_duplicates): rows equal to an earlier row.

    One scan; equal rows, compared by their digests, are counted by each task before the shuffle.  Missing equals missing.
    """
    cols = list(cols or df.columns)
    rows = _clean(df, cols)
    n, dup = F.coalesce(F.sum("__cnt"), F.lit(0)).cast("bigint"), F.coalesce(F.sum(F.col("__cnt") - 1), F.lit(0)).cast("bigint")
    return rows.groupBy(*_digests(rows, cols)).agg(F.count(F.lit(1)).alias("__cnt")).agg(
        dup.alias("total_duplicates"),
        (dup / F.greatest(n, F.lit(1)) * 100).alias("duplicate_percentage"),
        (dup > 0).alias("has_duplicates"))


def row_overlap(df: DataFrame, cols: Sequence[str], split: str = "split") -> DataFrame:
    """(overlap_count, test_rows, overlap_pct): test rows whose feature values also occur in train.

    One grouping on the digests of the feature values counts both splits, so a value held by a third of the rows is
    combined before the shuffle and there is no join of the two splits.  Missing equals missing.
    """
    flags = [F.when(col(split) == "train", 1).otherwise(0).alias("__train"),
             F.when(col(split) == "test", 1).otherwise(0).alias("__test")]
    rows = _clean(df, cols, flags)
    hit = F.coalesce(F.sum(F.when(F.col("__a") > 0, F.col("__b"))), F.lit(0)).cast("bigint")
    n = F.coalesce(F.sum("__b"), F.lit(0)).cast("bigint")
    return rows.groupBy(*_digests(rows, cols)).agg(F.sum("__train").alias("__a"), F.sum("__test").alias("__b")).agg(
        hit.alias("overlap_count"), n.alias("test_rows"),
        (hit / F.greatest(n, F.lit(1)) * 100).alias("overlap_pct"))


def leakage_risk(overlap: DataFrame) -> DataFrame:
    """Overlap read as a leakage signal: above 0.1 % it is one, above 1 % it is critical."""
    pct = F.col("overlap_pct")
    return overlap.select(
        F.when(pct > 0.1, F.lit("row_overlap")).alias("signal_id"),
        F.when(pct > 1.0, F.lit("critical")).when(pct > 0.1, F.lit("high")).alias("severity"),
        pct.alias("row_overlap_pct"), (pct > 1.0).alias("is_high_leakage_risk"))
