"""Exact order statistics, ranks and prefix sums that never put a whole column into one task."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import col, number
from ..sources.scratch import checkpointed
from .stats import long_numbers, moments

# Up to this many values one task may hold and sort them; above, intervals are narrowed first.
SMALL = 200_000
NARROW_BINS = 2048
# Bins of all intervals together that a task counts, and the fewest of one interval.
SENT_BINS, MIN_BINS = 2 ** 17, 16
# Up to this many rows one task may sort for a running total or a numbering.
SORT_ROWS = 1_000_000
# Most buckets an ordered column is cut into; a broadcast offset table has one row per bucket.
MAX_BUCKETS = 10_000
# A rank of all rows; other numbers name the fold that is left out.
ALL = -1
Target = tuple[int, str, int]


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], small: int = SMALL,
                    stats: dict | None = None) -> dict[str, list[float] | None]:
    """Linear-interpolated exact quantiles per column (``None`` for a column without values).

    Small columns use the built-in ``percentile``.  Larger ones are narrowed: a fixed-width histogram
    of the current interval tells which bin holds the wanted rank, the next pass looks only inside
    that bin, and when an interval holds few enough rows its values are ranked.  The driver sees bin
    counts and bounds only.  ``stats`` may bring n, min and max per column from an earlier scan.
    """
    if not cols:
        return {}
    if stats is None:
        stats = {r["feature"]: r for r in moments(df, cols, fields=("n", "min", "max")).collect()}
    quick, big = _by_size(cols, stats, small)
    out: dict[str, list[float] | None] = {c: None for c in cols}
    out.update(_percentiles(df, quick, probs))
    if big:
        sizes = {(ALL, c): stats[c]["n"] for c in big}
        start = {c: (float(stats[c]["min"]), float(stats[c]["max"]), int(stats[c]["n"])) for c in big}
        found = select_ranks(df, _ranks(sizes, probs), start, small)
        out.update({c: q for (_, c), q in _interpolated(sizes, probs, found).items()})
    return out


def fold_quantiles(df: DataFrame, cols: Sequence[str], fold: str, folds: int, probs: Sequence[float],
                   small: int = SMALL) -> dict[tuple[int, str], list[float] | None]:
    """As ``exact_quantiles`` of the rows outside each fold, by (fold, column).

    The folds share their histograms: a cell is counted once under its own fold, and what a fold leaves is the total
    minus its own count.  Rows without a fold take no part.
    """
    df = df.filter(col(fold).isNotNull())
    sizes = {(r[fold], r["feature"]): r for r in moments(df, cols, by=fold, fields=("n", "min", "max")).collect()} if cols else {}
    sides = {c: [r for (_, name), r in sizes.items() if name == c and r["n"]] for c in cols}
    stats = {c: {"n": sum(r["n"] for r in own), "min": min((r["min"] for r in own), default=None),
                 "max": max((r["max"] for r in own), default=None)} for c, own in sides.items()}
    quick, big = _by_size(cols, stats, small)
    out: dict[tuple[int, str], list[float] | None] = {(k, c): None for k in range(folds) for c in cols}
    names = {f"{k}|{c}": (k, c) for k in range(folds) for c in quick}
    narrow = df.select(*[F.when(col(fold) != k, number(df, c)).alias(name) for name, (k, c) in names.items()])
    out.update({names[name]: q for name, q in _percentiles(narrow, list(names), probs).items()})
    if big:
        own = {(k, c): sizes[(k, c)]["n"] if (k, c) in sizes else 0 for k in range(folds) for c in big}
        left = {(k, c): stats[c]["n"] - n for (k, c), n in own.items() if stats[c]["n"] > n}
        start = {c: (float(stats[c]["min"]), float(stats[c]["max"]), int(stats[c]["n"])) for c in big}
        out.update(_interpolated(left, probs, select_ranks(df, _ranks(left, probs), start, small, fold)))
    return out


def _by_size(cols: Sequence[str], stats: dict, small: int) -> tuple[list[str], list[str]]:
    """Columns with values that the built-in aggregate takes (few or infinite ones), and the others."""
    filled = [c for c in cols if stats[c]["n"] > 0]
    quick = [c for c in filled if stats[c]["n"] <= small or math.isinf(stats[c]["min"]) or math.isinf(stats[c]["max"])]
    return quick, [c for c in filled if c not in quick]


def _percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float] | None]:
    if not cols:
        return {}
    wide = F.array(*[F.lit(float(p)) for p in probs])
    found = long_numbers(df, cols).groupBy("feature").agg(F.percentile("x", wide).alias("q")).collect()
    return {r["feature"]: (list(r["q"]) if r["q"] is not None else None) for r in found}


def _ranks(sizes: dict[tuple[int, str], int], probs: Sequence[float]) -> list[Target]:
    """The ranks between which the quantiles lie, each once."""
    return list(dict.fromkeys((k, c, f(p * (n - 1))) for (k, c), n in sizes.items() for p in probs for f in (math.floor, math.ceil)))


def _interpolated(sizes: dict[tuple[int, str], int], probs: Sequence[float], found: dict[Target, float]) -> dict[tuple[int, str], list[float]]:
    out: dict[tuple[int, str], list[float]] = {}
    for (k, c), n in sizes.items():
        for p in probs:
            pos = p * (n - 1)
            lo, hi = found[(k, c, math.floor(pos))], found[(k, c, math.ceil(pos))]
            out.setdefault((k, c), []).append(lo + (hi - lo) * (pos - math.floor(pos)))
    return out


class Spans:
    """Disjoint intervals of numeric columns, and the cells of a batch that lie in them."""

    def __init__(self, spans: Sequence[tuple[str, float, float]], cols: Sequence[str]):
        self.own = []
        for c in cols:
            at = np.array(sorted((i for i, s in enumerate(spans) if s[0] == c), key=lambda i: spans[i][1]))
            self.own.append((at, np.array([spans[i][1] for i in at]), np.array([spans[i][2] for i in at])))

    def inside(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """Per column: the rows whose value lies in a span, the value, the span's number and its ends."""
        for k, (at, lo, hi) in enumerate(self.own):
            x = batch.column(k).to_numpy(zero_copy_only=False)
            place = np.searchsorted(lo, x, side="right") - 1  # missing cells are NaN and lie behind the last
            rows = np.flatnonzero((place >= 0) & (x <= hi[place]))
            if len(rows):
                place = place[rows]
                yield rows, x[rows], at[place], lo[place], hi[place]


def _bin_of(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bins: int) -> np.ndarray:
    """Equal-width bins that rise with the value; the two ends never share one."""
    with np.errstate(over="ignore"):
        half = np.where(np.isinf(hi - lo), 0.5, 1.0)
    return np.minimum((x * half - lo * half) / (hi * half - lo * half) * bins, bins - 1).astype(np.int64)


def _cells_of(df: DataFrame, cols: Sequence[str], fold: str | None) -> DataFrame:
    return df.select(*[number(df, c).alias(f"x{k}") for k, c in enumerate(cols)],
                     *([col(fold).cast("int").alias("fold")] if fold is not None else []))


def select_ranks(df: DataFrame, targets: Sequence[Target], start: dict[str, tuple[float, float, int]],
                 small: int = SMALL, fold: str | None = None) -> dict[Target, float]:
    """The value at each zero-based rank (fold left out or ``ALL``, column, rank), by narrowing intervals.

    ``start`` gives (min, max, count) per column.  An interval is ``[lo, hi]`` with the number of values below it that the
    target sees and the number of all values inside it.  Intervals of a column are equal or apart, so a cell is
    looked up among them.
    """
    found: dict[Target, float] = {}
    state = {t: (start[t[1]][0], start[t[1]][1], 0, start[t[1]][2]) for t in targets}
    while True:
        for t, (lo, hi, _, _) in state.items():
            if t not in found and lo == hi:
                found[t] = lo
        wide = sorted({(t[1], *s[:2]) for t, s in state.items() if t not in found and s[3] > small})
        if not wide:
            break
        cols, bins = sorted({s[0] for s in wide}), max(MIN_BINS, min(NARROW_BINS, SENT_BINS // len(wide)))
        spans = Spans(wide, cols)

        def count(batches: Iterator[pa.RecordBatch], spans=spans, bins=bins, n=len(wide) * bins) -> Iterator[pa.RecordBatch]:
            counts: dict[int, np.ndarray] = {}
            least, most = np.full(n, np.inf), np.full(n, -np.inf)
            for batch in batches:
                folds = batch.column(batch.num_columns - 1).to_numpy() if fold is not None else None
                for rows, x, at, lo, hi in spans.inside(batch):
                    key = at * bins + _bin_of(x, lo, hi, bins)
                    np.minimum.at(least, key, x)
                    np.maximum.at(most, key, x)
                    for k in [ALL] if folds is None else np.unique(folds[rows]).tolist():
                        if k not in counts:
                            counts[k] = np.zeros(n, np.int64)
                        counts[k] += np.bincount(key if folds is None else key[folds[rows] == k], minlength=n)
            for k, own in counts.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array((at // bins).astype(np.int32)), pa.array((at % bins).astype(np.int32)), pa.array(np.full(len(at), k, np.int32)),
                    pa.array(own[at]), pa.array(least[at]), pa.array(most[at])], names=["span", "bin", "fold", "cnt", "lo", "hi"])

        # at most SENT_BINS rows a fold come back, or MIN_BINS per span
        rows = (_cells_of(df, cols, fold).mapInArrow(count, "span int, bin int, fold int, cnt bigint, lo double, hi double")
                .groupBy("span", "bin", "fold").agg(F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow())
        span, at, k, cnt, lo, hi = (rows[c].to_numpy() for c in ("span", "bin", "fold", "cnt", "lo", "hi"))
        number_of = {s: i for i, s in enumerate(wide)}
        counts, least, most = {ALL: np.zeros((len(wide), bins), np.int64)}, np.full((len(wide), bins), np.inf), np.full((len(wide), bins), -np.inf)
        np.add.at(counts[ALL], (span, at), cnt)
        np.minimum.at(least, (span, at), lo)
        np.maximum.at(most, (span, at), hi)
        for own in sorted({t[0] for t in targets} - {ALL}):
            counts[own] = counts[ALL].copy()
            np.subtract.at(counts[own], (span[k == own], at[k == own]), cnt[k == own])
        upto = {own: np.cumsum(c, axis=1) for own, c in counts.items()}
        for t, (lo_, hi_, below, inside) in list(state.items()):
            if t in found or inside <= small:
                continue
            i = number_of[(t[1], lo_, hi_)]
            b = int(np.searchsorted(upto[t[0]][i], t[2] - below, side="right"))
            before = int(upto[t[0]][i][b - 1]) if b else 0
            state[t] = (float(least[i, b]), float(most[i, b]), below + before, int(counts[ALL][i, b]))
    rest = [t for t in targets if t not in found]
    if rest:
        # what is left holds at most `small` rows per interval
        last = sorted({(t[1], *state[t][:2]) for t in rest})
        cols = sorted({s[0] for s in last})
        spans, number_of = Spans(last, cols), {s: i for i, s in enumerate(last)}
        wanted: dict[int, list[tuple[int, int, int]]] = {}
        for i, t in enumerate(rest):
            wanted.setdefault(number_of[(t[1], *state[t][:2])], []).append((i, t[0], t[2] - state[t][2]))

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                folds = batch.column(batch.num_columns - 1).to_numpy() if fold is not None else None
                for rows, x, at, _, _ in spans.inside(batch):
                    own = np.full(len(rows), ALL) if folds is None else folds[rows]
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(x)], names=["span", "fold", "x"])

        def ranked(table: pa.Table) -> pa.Table:
            x, folds = table["x"].to_numpy(), table["fold"].to_numpy()
            order = np.argsort(x, kind="stable")
            x, folds = x[order], folds[order]
            seen = {k: x if k == ALL else x[folds != k] for k in {k for _, k, _ in wanted[table["span"][0].as_py()]}}
            own = wanted[table["span"][0].as_py()]
            return pa.table({"t": pa.array([i for i, _, _ in own], pa.int32()), "v": pa.array([float(seen[k][need]) for _, k, need in own], pa.float64())})

        inside = _cells_of(df, cols, fold).mapInArrow(values, "span int, fold int, x double")
        for r in inside.groupBy("span").applyInArrow(ranked, "t int, v double").collect():
            found[rest[r["t"]]] = r["v"]
    return found


def median(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: (v[0] if v else None) for c, v in exact_quantiles(df, cols, [0.5]).items()}


def _bucketed(df: DataFrame, order: str, edges: Sequence[float]) -> DataFrame:
    splits = [-math.inf, *sorted(set(edges)), math.inf]
    return Bucketizer(splits=splits, inputCol="__o", outputCol="__bucket", handleInvalid="keep").transform(
        df.withColumn("__o", col(order).cast("double"))).drop("__o")


def _edges(df: DataFrame, order: str, rows: int) -> list[float]:
    """No cut points for a table of at most ``rows``; else approximate ones for buckets of about that size."""
    n = df.count()
    buckets = min(MAX_BUCKETS, math.ceil(n / rows))
    if buckets < 2:
        return []
    shares = [k / buckets for k in range(1, buckets)]
    return df.agg(F.percentile_approx(col(order).cast("double"), shares, 10 * MAX_BUCKETS)).first()[0] or []


def prefix_sums(distinct: DataFrame, order: str, totals: Sequence[str], small: int = SORT_ROWS) -> DataFrame:
    """Adds ``before_<x>``: the sum of ``x`` over all rows with a smaller ``order`` value.

    ``distinct`` has one row per order value (group first, so hot values are one row).  Above
    ``small`` rows the order values are cut into buckets; sums run inside a bucket and a bucket
    table of at most ``MAX_BUCKETS`` rows carries the offsets.
    """
    edges = _edges(distinct, order, small)
    if not edges:
        w = Window.orderBy(col(order)).rowsBetween(Window.unboundedPreceding, -1)
        return distinct.select("*", *[F.coalesce(F.sum(x).over(w), F.lit(0)).alias(f"before_{x}") for x in totals])
    cut = _bucketed(distinct, order, edges)
    per = cut.groupBy("__bucket").agg(*[F.sum(x).alias(f"__t_{x}") for x in totals])
    up = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("__bucket", *[F.coalesce(F.sum(f"__t_{x}").over(up), F.lit(0)).alias(f"__o_{x}")
                                       for x in totals])
    inside = Window.partitionBy("__bucket").orderBy(col(order)).rowsBetween(Window.unboundedPreceding, -1)
    return (cut.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"__b_{x}") for x in totals])
            .join(F.broadcast(offsets), "__bucket")  # at most MAX_BUCKETS rows
            .select(*[col(c) for c in distinct.columns],
                    *[(F.col(f"__b_{x}") + F.col(f"__o_{x}")).alias(f"before_{x}") for x in totals]))


def group_numbers(df: DataFrame, group: str, order: str, out: str, small: int = SORT_ROWS) -> DataFrame:
    """Numbers the rows of each group from 1 by a unique numeric ``order`` column.

    A group may hold most of the table, so above ``small`` rows the order values are cut into
    buckets, numbered inside (group, bucket), and shifted by the counts of the buckets before.
    """
    edges = _edges(df, order, small)
    if not edges:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(col(group)).orderBy(col(order))).cast("bigint"))
    cut = _bucketed(df, order, edges)
    per = cut.groupBy(col(group), "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    up = Window.partitionBy(col(group)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(col(group).alias("__g"), F.col("__bucket").alias("__b"),
                         F.coalesce(F.sum("__n").over(up), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(col(group), F.col("__bucket")).orderBy(col(order))
    ranked = cut.withColumn("__r", F.row_number().over(inside))
    # the join keys are (group, bucket): no key holds more rows than a bucket does
    joined = ranked.join(offsets, ranked[group].eqNullSafe(offsets["__g"]) & (ranked["__bucket"] == offsets["__b"]))
    return joined.select(*[col(c) for c in df.columns], (F.col("__r") + F.col("__off")).cast("bigint").alias(out))


def hash_key(key: str | Column) -> Column:
    """A portable 32-bit number from a key: the first eight hex digits of its md5."""
    k = col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint")


def range_numbers(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Numbers all rows from 0 in the order of ``order``: rows go to ranges once, are numbered inside and shifted by the
    counts of the ranges before.  The table is written to the shared folder, so that the ranges stay as they are."""
    keys = [col(c) for c in order]
    cut = checkpointed(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    counts = cut.groupBy("__range").count()  # one row a range
    before = F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("__range", F.coalesce(before, F.lit(0)).alias("__offset")))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return (cut.withColumn("__inside", inside).join(offsets, "__range")
            .select(*[col(c) for c in df.columns], (F.col("__inside") - 1 + F.col("__offset")).alias(out)))
