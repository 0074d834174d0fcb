"""The four aggregates most checks are projections of.

* ``moments``       counts, means, spread and range of all numeric columns, no shuffle of rows;
* ``value_counts``  rows per distinct (feature, value), combined map-side before the shuffle;
* ``co_moments``    means and centred co-moments of every column pair in one vectorised pass;
* ``histogram``     rows per (feature, split, bin) for given edges, again combined map-side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..schema import col, comparable, local_frame, number

MOMENT_FIELDS = ("n", "nulls", "mean", "var_pop", "var_samp", "skew", "min", "max")


def unbiased_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population skewness; missing below three values."""
    n = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def finite(x: Column) -> Column:
    """Infinite numbers and NaN as missing: neither can be compared with a threshold."""
    return F.when(F.abs(x) < float("inf"), x)


def long_numbers(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """([keep], feature, x): one row per cell of the numeric columns, missing cells included."""
    narrow = df.select(*[col(k) for k in keep], *[number(df, c).alias(c) for c in cols])
    return narrow.unpivot([col(k) for k in keep], [col(c) for c in cols], "feature", "x")


def moments(df: DataFrame, cols: Sequence[str], by: str | None = None,
            fields: Sequence[str] = MOMENT_FIELDS) -> DataFrame:
    """Long table (feature, [by], n, nulls, mean, ...): no row is shuffled, only partial aggregates.

    Columns become rows and one short aggregate is grouped by column name.  Without ``by`` every column has its row,
    also on an empty table, where the counts are 0.  Statistics that are no numbers (of infinite values) are missing.
    """
    x = F.col("x")
    made = {"n": F.count(x), "nulls": F.count(F.lit(1)) - F.count(x), "mean": finite(F.avg(x)),
            "var_pop": finite(F.var_pop(x)), "var_samp": finite(F.var_samp(x)), "skew": finite(F.skewness(x)),
            "min": F.min(x), "max": F.max(x)}
    found = (long_numbers(df, cols, [by] if by else []).groupBy(*([col(by)] if by else []), "feature")
             .agg(*[made[f].alias(f) for f in fields]))
    if by:
        return found
    every = local_frame(df.sparkSession, [(c,) for c in cols], "feature string")
    return every.join(F.broadcast(found), "feature", "left").na.fill(0, [f for f in ("n", "nulls") if f in fields])


def _families(df: DataFrame, cols: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Columns by the widest type that keeps their values distinct."""
    whole, real, text = [], [], []
    for name in cols:
        kind = df.schema[name].dataType
        if isinstance(kind, T.IntegralType):
            whole.append(name)
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            real.append(name)
        else:
            text.append(name)
    return [(t, c) for t, c in (("bigint", whole), ("double", real), ("string", text)) if c]


def value_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per ([by], feature, value), missing cells included as a null value.

    One unpivot per type family, so numbers are not turned into text before they are grouped.
    """
    out = None
    for kind, names in _families(df, cols):
        narrow = df.select(*[col(b) for b in by], *[comparable(df, n).cast(kind).alias(n) for n in names])
        part = (narrow.unpivot([col(b) for b in by], [col(n) for n in names], "feature", "value")
                .groupBy(*[col(b) for b in by], "feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
                .withColumn("value", F.col("value").cast("string")))
        out = part if out is None else out.unionByName(part)
    return out


def cardinality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, total, non_null, n_unique, top_count) with exact distinct counts."""
    present = F.col("value").isNotNull()
    return (value_counts(df, cols).groupBy("feature").agg(
        F.sum("cnt").alias("total"),
        F.coalesce(F.sum(F.when(present, F.col("cnt"))), F.lit(0)).cast("bigint").alias("non_null"),
        F.count("value").alias("n_unique"),
        F.coalesce(F.max(F.when(present, F.col("cnt"))), F.lit(0)).cast("bigint").alias("top_count"),
    ))


CO_MOMENT_SCHEMA = "i int, j int, n double, mx double, my double, cxx double, cyy double, cxy double"


def _pair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: count, means and centred sums for every pair i <= j over rows where both are present."""
    shift = None
    n = sx = sxx = sxy = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
        mask = ~np.isnan(x)
        if shift is None:
            d = x.shape[1]
            shift = np.full(d, np.nan)
            n, sx, sxx, sxy = (np.zeros((d, d)) for _ in range(4))
        for k in np.flatnonzero(np.isnan(shift)):  # a column is shifted by the first mean that exists
            if mask[:, k].any():
                shift[k] = x[mask[:, k], k].mean()
        x = np.where(mask, x - np.where(np.isnan(shift), 0.0, shift), 0.0)
        m = mask.astype(float)
        n += m.T @ m
        sx += x.T @ m
        sxx += (x * x).T @ m
        sxy += x.T @ x
    if shift is None:
        return
    i, j = np.triu_indices(len(shift))
    keep = n[i, j] > 0
    i, j = i[keep], j[keep]
    cnt = n[i, j]
    dx, dy = sx[i, j] / cnt, sx[j, i] / cnt
    yield pa.RecordBatch.from_arrays(
        [pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(cnt),
         pa.array(dx + shift[i]), pa.array(dy + shift[j]),
         pa.array(sxx[i, j] - cnt * dx * dx), pa.array(sxx[j, i] - cnt * dy * dy),
         pa.array(sxy[i, j] - cnt * dx * dy)],
        names=["i", "j", "n", "mx", "my", "cxx", "cyy", "cxy"])


def co_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, mx, my, cxx, cyy, cxy) per column pair, pairwise complete.

    Each task returns one d x d block, so the shuffle carries tasks x d^2 numbers and never a row.
    Blocks are merged around the overall mean, which keeps large offsets from cancelling.
    """
    blocks = (df.select(*[number(df, c).alias(f"x{k}") for k, c in enumerate(cols)])
              .mapInArrow(_pair_blocks, CO_MOMENT_SCHEMA))
    pair = Window.partitionBy("i", "j")
    total = F.sum("n").over(pair)
    centred = blocks.select("*", (F.sum(F.col("n") * F.col("mx")).over(pair) / total).alias("gx"),
                            (F.sum(F.col("n") * F.col("my")).over(pair) / total).alias("gy"))
    dx, dy, n = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy"), F.col("n")
    return centred.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.first("gx").alias("mx"), F.first("gy").alias("my"),
        F.sum(F.col("cxx") + n * dx * dx).alias("cxx"),
        F.sum(F.col("cyy") + n * dy * dy).alias("cyy"),
        F.sum(F.col("cxy") + n * dx * dy).alias("cxy"))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, i, j, n, corr) for i < j; missing when a side does not vary."""
    names = F.array(*[F.lit(c) for c in cols])
    # rounding can leave a constant column with a tiny spread: relative to its mean it is still none
    def spread(c: str, m: str) -> Column:
        floor = F.col("n") * F.pow(F.abs(F.col(m)) * F.lit(1e-15), F.lit(2.0))
        return F.when(F.col(c) > floor, F.sqrt(c))

    return (co_moments(df, cols).filter("i < j")
            .select(F.element_at(names, F.col("i") + 1).alias("feature_a"),
                    F.element_at(names, F.col("j") + 1).alias("feature_b"), "i", "j",
                    F.col("n").cast("bigint").alias("n"),
                    F.try_divide(F.col("cxy"), spread("cxx", "mx") * spread("cyy", "my")).alias("r"))
            .select("feature_a", "feature_b", "i", "j", "n",
                    F.when(finite(F.col("r")).isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "r"))).alias("corr")))


def uniform_bin(x: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    """Index of the equal-width bin of each value; the last bin is closed, -1 outside.

    The quotient is corrected against the true edges ``lo + i * step``, as integer-valued columns
    often sit exactly on one.
    """
    with np.errstate(all="ignore"):
        step = (hi - lo) / float(bins)
        raw = np.clip(np.nan_to_num(np.floor((x - lo) / step), nan=0.0), 0, bins - 1).astype(np.int64)
        down = (raw > 0) & (x < lo + raw * step)
        up = (raw < bins - 1) & (x >= lo + (raw + 1) * step)
    return np.where((x < lo) | (x > hi), -1, raw - down + up)


def histogram(df: DataFrame, edges: dict[str, tuple[float, float]], bins: int, split: str) -> DataFrame:
    """(feature, bin, train, test): rows per equal-width bin and side, only for bins that hold rows.

    ``edges`` maps a numeric column to its (low, high) bounds.  Each task counts its rows.  Present values outside the
    bounds are counted under bin -1.
    """
    names, bounds = list(edges), list(edges.values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(names), bins + 1, 3), np.int64)
        for batch in batches:
            side = batch.column(0).to_numpy()
            for k, (lo, hi) in enumerate(bounds):
                x = batch.column(k + 1).to_numpy(zero_copy_only=False)
                present = np.flatnonzero(~np.isnan(x))
                at = uniform_bin(x[present], lo, hi, bins)
                counts[k] += np.bincount((at + 1) * 3 + side[present], minlength=counts[k].size).reshape(counts[k].shape)
        k, at = np.nonzero(counts.sum(axis=2))
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in k], pa.string()), pa.array((at - 1).astype(np.int32)),
                                          pa.array(counts[k, at, 1]), pa.array(counts[k, at, 2])], names=["feature", "bin", "train", "test"])

    side = F.when(col(split) == "train", 1).when(col(split) == "test", 2).otherwise(0).cast("int")
    rows = df.select(side.alias("side"), *[number(df, c).alias(f"x{k}") for k, c in enumerate(names)])
    return (rows.mapInArrow(count, "feature string, bin int, train bigint, test bigint")
            .groupBy("feature", "bin").agg(F.sum("train").alias("train"), F.sum("test").alias("test")))


def widened(lo: float, hi: float) -> tuple[float, float]:
    """A range without width grows by half a unit on both sides."""
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
