"""What a table looks like: size, types, missing cells, distinct values, a stable preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import AuditConfig
from ..functions.stats import cardinality
from ..schema import col, flat_columns, local_frame, nested_columns, numeric_columns, text_columns, value
from .rows import duplicates


def basic_info(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(metric, value): rows, columns, repeated rows, missing cells."""
    cols = list(cols or flat_columns(df))
    missing = sum((F.count(F.lit(1)) - F.count(value(df, c)) for c in cols), F.lit(0))
    size = df.agg(F.count(F.lit(1)).alias("num_rows"), missing.cast("bigint").alias("missing_cells"))
    long = size.select(F.explode(F.array(
        F.struct(F.lit("num_rows").alias("metric"), F.col("num_rows").alias("value")),
        F.struct(F.lit("num_columns").alias("metric"), F.lit(len(cols)).cast("bigint").alias("value")),
        F.struct(F.lit("missing_cells").alias("metric"), F.col("missing_cells").alias("value")),
    )).alias("m")).select("m.*")
    dup = duplicates(df, cols).select(F.lit("duplicate_rows").alias("metric"),
                                      F.col("total_duplicates").alias("value"))
    return long.unionByName(dup)


def feature_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, missing share, distinct values; most missing first (``position``)."""
    from pyspark.sql import Window
    cols = list(cols or flat_columns(df))
    numeric, text = set(numeric_columns(df)), set(text_columns(df))
    types = dict(df.dtypes)
    info = F.create_map(*[x for c in cols for x in (F.lit(c), F.struct(
        F.lit(types[c]).alias("dtype"), F.lit(c in numeric).alias("is_numeric"),
        F.lit(c in text).alias("is_categorical")))])
    counts = cardinality(df, cols)
    missing = F.round((F.col("total") - F.col("non_null")) / F.col("total") * 100, 2)
    rows = counts.withColumn("info", F.element_at(info, F.col("feature"))).select(
        "feature", "info.dtype", missing.alias("missing_pct"), F.col("n_unique").alias("unique_values"),
        "info.is_numeric", "info.is_categorical")
    # one row per column of the audited table
    by_missing = Window.orderBy(F.desc("missing_pct"), F.asc("feature"))
    return rows.withColumn("position", F.row_number().over(by_missing).cast("bigint"))


def preview(df: DataFrame, key: str, rows: int = AuditConfig.preview_rows) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(col(key)).limit(rows)


def data_types(df: DataFrame) -> DataFrame:
    """(feature, dtype, kind) from the schema, no job."""
    numeric, nested = set(numeric_columns(df)), set(nested_columns(df))
    return local_frame(df.sparkSession, [
        (name, kind, "numeric" if name in numeric else "unsupported" if name in nested else "categorical")
        for name, kind in df.dtypes], "feature string, dtype string, kind string")
