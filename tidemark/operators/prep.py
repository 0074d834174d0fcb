"""Feature preparation: everything is fitted on train rows and applied to all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import AuditConfig
from ..functions.selection import exact_quantiles, fold_quantiles, range_numbers
from ..functions.stats import moments, value_counts
from ..schema import categorical_columns, col, local_frame, model_categorical_columns, number, numeric_columns, value
from ..sources.scratch import checkpointed
from .forest import category_id

DEFAULT = AuditConfig()
# Values above this share of the rows are looked up in the expression itself; a column has at most a hundred of them.
HOT_SHARE = 0.01
# Keys over which rows without a partner in a lookup are spread.
SPREAD = 4096


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent present value per column as text, the smallest on ties."""
    if not cols:
        return {}
    best = (value_counts(df, cols).filter("value is not null").groupBy("feature")
            .agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode")))
    found = {r["feature"]: r["mode"] for r in best.collect()}  # one row per column
    return {c: found.get(c) for c in cols}


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: (q[0] if q else None) for c, q in exact_quantiles(df, cols, [0.5]).items()} if cols else {}


def impute(df: DataFrame, fit_on: DataFrame | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric gaps take the median, other gaps the mode, or ``missing`` when a column has no value.

    Fitted on ``fit_on`` (for instance the train rows), by default on the table itself.
    """
    fit = df if fit_on is None else fit_on
    numeric = numeric_columns(df, exclude)
    other = categorical_columns(df, exclude)
    med, mode = medians(fit, numeric), modes(fit, other)
    out = []
    for name in df.columns:
        if name in numeric and med[name] is not None:
            out.append(F.coalesce(number(df, name), F.lit(med[name])).alias(name))
        elif name in numeric:
            out.append(number(df, name).alias(name))
        elif name in other:
            kind = df.schema[name].dataType
            fill = F.lit(mode[name] if mode[name] is not None else "missing")
            if isinstance(kind, T.BinaryType):  # bytes are counted as hex text
                fill = F.unhex(fill) if mode[name] is not None else F.encode(fill, "UTF-8")
            out.append(F.coalesce(value(df, name), fill.try_cast(kind)).alias(name))
        else:
            out.append(col(name))
    return df.select(*out)


def gap_columns(fit: DataFrame, cols: Sequence[str]) -> list[str]:
    """Numeric columns with at least one missing train value."""
    if not cols:
        return []
    nulls = {r["feature"]: r["nulls"] for r in moments(fit, cols, fields=("nulls",)).collect()}
    return [c for c in cols if nulls[c] > 0]


def missing_indicators(df: DataFrame, fit_on: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds a 0/1 column ``<x>__missing_indicator`` per numeric column that has gaps in the train rows."""
    gaps = gap_columns(fit_on, cols)
    return df.select("*", *[number(df, c).isNull().cast("int").alias(f"{c}__missing_indicator") for c in gaps])


def _scaled(x: Column, q: Sequence[float] | None) -> Column:
    if not q:
        return x
    span = q[2] - q[0]
    return (x - F.lit(q[1])) / F.lit(span if span else 1.0)


def robust_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Replaces each column by (x - median) / (q3 - q1); a column without spread keeps its unit."""
    q = exact_quantiles(df if fit_on is None else fit_on, cols, [0.25, 0.5, 0.75])
    return df.select(*[_scaled(number(df, c), q[c]).alias(c) if c in q else col(c) for c in df.columns])


def category_table(counts: DataFrame) -> DataFrame:
    """(feature, value, cnt, index): every category of ``value_counts``, numbered within its column by value."""
    numbered = range_numbers(counts.filter("value is not null"), ["feature", "value"], "number")
    first = F.broadcast(numbered.groupBy("feature").agg(F.min("number").alias("first")))  # one row per column
    return numbered.join(first, "feature").select("feature", "value", "cnt", (F.col("number") - F.col("first")).alias("index"))


def frequent(counts: DataFrame, cols: Sequence[str], total: int, share: float) -> dict[str, dict[str, int]]:
    """Per column the values that at least ``share`` of the rows hold, with their counts: at most 1 / share of them."""
    out: dict[str, dict[str, int]] = {c: {} for c in cols}
    for r in counts.filter(F.col("value").isNotNull() & (F.col("cnt") >= F.lit(share * total))).collect():
        out[r["feature"]][r["value"]] = r["cnt"]
    return out


def looked_up(df: DataFrame, x: Column, table: DataFrame, hot: Mapping[str, Column], out: str) -> DataFrame:
    """Adds ``out``: what ``table`` (value, found) holds for the text ``x``, null where it holds nothing.

    Hot values come from the expression and take no part in the join; rows without a value to look for are spread over
    many keys, so that no key of the join holds more rows than a rare value has.
    """
    known = None
    for v, found in hot.items():
        known = F.when(F.col("__x") == v, found) if known is None else known.when(F.col("__x") == v, found)
    asked = F.col("__x").isNotNull() & (~F.col("__x").isin(list(hot)) if hot else F.lit(True))
    spread = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(SPREAD)).cast("string")
    keyed = df.withColumn("__x", x).withColumn("__k", F.when(asked, F.concat(F.lit("v"), F.col("__x"))).otherwise(F.concat(F.lit("n"), spread)))
    right = table.select(F.concat(F.lit("v"), F.col("value")).alias("__k"), F.col("found").alias("__found"))
    joined = keyed.join(right, "__k", "left")
    found = F.col("__found") if known is None else F.coalesce(known, F.col("__found"))
    return joined.select(*[col(c) for c in df.columns], found.alias(out))


def own_categories(counts: DataFrame, cols: Sequence[str], total: int, min_share: float, fill: bool = False
                   ) -> tuple[dict[str, list[str]], dict[str, bool], dict[str, str | None]]:
    """Per column: its own categories (sorted), whether rarer ones are pooled, and its mode.

    Only categories at or above ``min_share`` of the rows are a column's own, so their number is limited by
    1 / min_share.  With ``fill`` missing cells count towards the mode.
    """
    own = frequent(counts, cols, total, min_share)
    # one row per column
    sums = {r["feature"]: r for r in counts.groupBy("feature").agg(
        F.min_by("value", F.struct(F.col("value").isNull(), -F.col("cnt"), F.col("value"))).alias("mode"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("gaps")).collect()}
    gaps = {c: sums[c]["gaps"] if c in sums else 0 for c in cols}
    mode = {c: sums[c]["mode"] if c in sums else None for c in cols}
    pooled = {c: sum(own[c].values()) + gaps[c] < total for c in cols}
    if fill:
        for c in cols:
            if mode[c] is None:
                own[c]["missing"] = gaps[c]
            elif gaps[c] and mode[c] not in own[c] and gaps[c] >= min_share * total:  # filling lifts the mode over the share
                own[c][mode[c]] = gaps[c]
    return {c: sorted(own[c]) for c in cols}, pooled, mode


def _pooled(df: DataFrame, x: Column, own: Sequence[str], rare: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: 1 for a value that the train rows hold, but not as a category of its own, else 0."""
    found = looked_up(df, x, rare.select("value", F.lit(1).alias("found")), {v: F.lit(0) for v in own}, out)
    return found.withColumn(out, F.coalesce(col(out), F.lit(0)))


def one_hot(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None, min_share: float = 0.0) -> DataFrame:
    """Replaces each column by 0/1 columns ``<x>_<category>``; a category unseen in train gives all zeros.

    With ``min_share`` the rare train categories share the column ``<x>_infrequent_sklearn``.  A table column per category
    is the result here; ``one_hot_long`` has rows instead, for any number of categories.
    """
    fit = df if fit_on is None else fit_on
    counts = checkpointed(value_counts(fit, cols))
    known, pooled, _ = own_categories(counts, cols, fit.count(), min_share)
    base, made = df, []
    for i, c in enumerate(cols):
        made += [F.coalesce((col(c).cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in known[c]]
        if pooled[c]:
            rare = counts.filter((F.col("feature") == c) & F.col("value").isNotNull() & ~F.col("value").isin(known[c]))
            base = _pooled(base, col(c).cast("string"), known[c], rare, f"__rare{i}")
            made.append(col(f"__rare{i}").alias(f"{c}_infrequent_sklearn"))
    return base.select(*[col(c) for c in df.columns if c not in cols], *made)


def one_hot_long(df: DataFrame, key: str, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(key, feature, index): the cells that are 1 of a one-hot table, one row for each value that the train rows hold.

    ``feature`` is ``<column>_<category>``, ``index`` its place within its column.  Categories are a table; values of over a
    hundredth of the rows are looked up without a join, so that no hot value meets in one task.
    """
    fit = df if fit_on is None else fit_on
    counts = checkpointed(value_counts(fit, cols))
    table = checkpointed(category_table(counts))
    total = fit.count()
    out = None
    for c in cols:
        own = table.filter(F.col("feature") == c).select("value", F.col("index").alias("found"), "cnt")
        hot = {r["value"]: F.lit(r["found"]) for r in own.filter(F.col("cnt") >= F.lit(HOT_SHARE * total)).collect()}
        found = looked_up(df.select(col(key).alias("key"), col(c).cast("string").alias("value")), F.col("value"), own, hot, "index")
        part = found.filter("index is not null").select("key", F.concat_ws("_", F.lit(c), F.col("value")).alias("feature"), "index")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class FittedPrep:
    """Train statistics of the full preparation; ``transform`` is one projection."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float | None]
    quartiles: dict[str, list[float] | None]
    indicators: list[str]
    modes: dict[str, str | None]
    categories: dict[str, list[str]]
    rare: dict[str, DataFrame] = field(default_factory=dict)  # (value) of the categories that are pooled
    table: DataFrame | None = None  # (feature, value, cnt, index): all categories, where none are pooled
    sizes: dict[str, int] = field(default_factory=dict)
    rows: int = 0

    def named(self) -> dict[str, list[str]]:
        """The categories that have a feature each; from a table they are collected, for naming the features of a model."""
        if self.table is None:
            return self.categories
        out: dict[str, list[str]] = {c: [] for c in self.categorical}
        for r in self.table.orderBy("feature", "index").select("feature", "value").toLocalIterator():
            out[r["feature"]].append(r["value"])
        return {c: v or ["missing"] for c, v in out.items()}

    @property
    def feature_names(self) -> list[str]:
        categories = self.named()
        names = list(self.numeric) + [f"{c}__missing_indicator" for c in self.indicators]
        for c in self.categorical:
            names += [f"{c}_{v}" for v in categories[c]]
            names += [f"{c}_infrequent_sklearn"] if c in self.rare else []
        return names

    def origin(self) -> list[str]:
        """The input column of each feature, in feature order."""
        out = list(self.numeric) + list(self.indicators)
        for c in self.categorical:
            out += [c] * ((len(self.categories[c]) if self.table is None else self.sizes[c]) + (c in self.rare))
        return out

    def filled(self, name: str) -> Column:
        fill = self.modes[name] if self.modes[name] is not None else "missing"
        return F.coalesce(col(name).cast("string"), F.lit(fill))

    def numeric_features(self, df: DataFrame) -> list[Column]:
        made = []
        for c in self.numeric:
            filled = F.coalesce(number(df, c), F.lit(self.medians[c] if self.medians[c] is not None else 0.0))
            made.append(_scaled(filled, self.quartiles[c]).alias(c))
        return made + [number(df, c).isNull().cast("double").alias(f"{c}__missing_indicator") for c in self.indicators]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The kept columns and one column per feature."""
        if self.table is not None:
            raise ValueError("features without a share are rows of a table; see one_hot_long and vectors")
        made, base = self.numeric_features(df), df
        for i, c in enumerate(self.categorical):
            made += [(self.filled(c) == v).cast("double").alias(f"{c}_{v}") for v in self.categories[c]]
            if c in self.rare:
                base = _pooled(base, self.filled(c), self.categories[c], self.rare[c], f"__rare{i}")
                made.append(col(f"__rare{i}").cast("double").alias(f"{c}_infrequent_sklearn"))
        return base.select(*[col(k) for k in keep], *made)

    def vectors(self, df: DataFrame, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        """The features as one ML vector column, sparse: a category's place comes from the fitted table.

        Unseen categories are all zeros.
        """
        from pyspark.ml.feature import OneHotEncoder, VectorAssembler
        numbers = self.numeric_features(df)
        plain = df.select(*[col(k) for k in keep], *[c.alias(f"__n{i}") for i, c in enumerate(numbers)],
                          *[self.filled(c).alias(f"__c{i}") for i, c in enumerate(self.categorical)])
        inputs, used = [f"__n{i}" for i in range(len(numbers))], []
        for i, c in enumerate(self.categorical):
            size = self.sizes[c] if self.table is not None else len(self.categories[c])
            if size:
                if self.table is not None:
                    own = self.table.filter(F.col("feature") == c).select("value", F.col("index").alias("found"), "cnt")
                    hot = {r["value"]: F.lit(r["found"]) for r in own.filter(F.col("cnt") >= F.lit(HOT_SHARE * self.rows)).collect()}
                    if self.modes[c] is None:
                        hot = {"missing": F.lit(0)}
                    elif self.modes[c] not in hot:  # gaps take the mode, however rare it is
                        hot |= {r["value"]: F.lit(r["found"]) for r in own.filter(F.col("value") == self.modes[c]).collect()}
                    plain = looked_up(plain, F.col(f"__c{i}"), own, hot, f"__i{i}")
                else:
                    place = None
                    for n, v in enumerate(self.categories[c]):
                        hit = F.col(f"__c{i}") == v
                        place = F.when(hit, n) if place is None else place.when(hit, n)
                    plain = plain.withColumn(f"__i{i}", place)
                # The index of unseen values comes last and is the one that the encoder leaves out.
                index = F.coalesce(F.col(f"__i{i}"), F.lit(size)).cast("double")
                plain = plain.withColumn(f"__i{i}", index.alias(f"__i{i}", metadata={"ml_attr": {"type": "nominal", "num_vals": size + 1}}))
                plain = OneHotEncoder(inputCol=f"__i{i}", outputCol=f"__v{i}", dropLast=True).fit(plain).transform(plain)
                inputs.append(f"__v{i}")
                used.append(f"__i{i}")
            if c in self.rare:
                plain = _pooled(plain, F.col(f"__c{i}"), self.categories[c], self.rare[c], f"__r{i}").withColumn(f"__r{i}", F.col(f"__r{i}").cast("double"))
                inputs.append(f"__r{i}")
            used.append(f"__c{i}")
        return VectorAssembler(inputCols=inputs, outputCol=out).transform(plain).drop(*inputs, *used)


def fit_prep(fit: DataFrame, exclude: Sequence[str] = (), indicators: bool = True,
             min_share: float = DEFAULT.min_category_share) -> FittedPrep:
    """Fits the full preparation on train rows: medians, quartiles, gaps, modes, categories.

    A gap of a train column moves its quartiles, as in the row-wise pipeline: scaling is fitted on the
    filled column.  Without a share every category is a feature, and the categories stay a table.
    """
    numeric = sorted(numeric_columns(fit, exclude))
    cats = sorted(model_categorical_columns(fit, exclude))
    stats = {r["feature"]: r for r in moments(fit, numeric, fields=("n", "nulls", "min", "max")).collect()} \
        if numeric else {}
    raw = exact_quantiles(fit, numeric, [0.25, 0.5, 0.75], stats=stats)
    med = {c: (q[1] if q else None) for c, q in raw.items()}
    gaps = [c for c in numeric if stats[c]["nulls"] > 0]
    refit = [c for c in gaps if med[c] is not None]
    filled = fit.select(*[F.coalesce(number(fit, c), F.lit(med[c])).alias(c) for c in refit])
    again = exact_quantiles(filled, refit, [0.25, 0.5, 0.75], stats={
        c: {"n": stats[c]["n"] + stats[c]["nulls"], "min": stats[c]["min"], "max": stats[c]["max"]} for c in refit})
    rows = max((r["n"] + r["nulls"] for r in stats.values()), default=0) or fit.count()
    prep = FittedPrep(numeric, cats, med, {**raw, **again}, gaps if indicators else [], {}, {}, rows=rows)
    if cats:
        counts = checkpointed(value_counts(fit, cats))
        prep.categories, pooled, prep.modes = own_categories(counts, cats, rows, max(min_share, HOT_SHARE), True)
        if min_share > 0:
            for c in cats:
                rare = counts.filter((F.col("feature") == c) & F.col("value").isNotNull() & ~F.col("value").isin(prep.categories[c])).select("value")
                if pooled[c] and not rare.isEmpty():
                    prep.rare[c] = rare
        else:
            prep.table = checkpointed(category_table(counts))
            found = {r["feature"]: r["count"] for r in prep.table.groupBy("feature").count().collect()}
            prep.sizes = {c: found.get(c, 1) for c in cats}
    return prep


@dataclass
class SparsePrep:
    """Train statistics of the sparse preparation: a row becomes its numbers and one category id per text column.

    ``table`` holds the fitted categories as rows (feature, value, cnt); it is never collected.
    """

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float | None]
    modes: dict[str, str | None]
    edges: list[np.ndarray]
    sizes: list[int]  # categories of each text column
    table: DataFrame | None

    def cells(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The kept columns, ``x array<double>`` with gaps filled, and ``c array<bigint>``; unseen categories are ids no split has."""
        x, c = self.arrays(df)
        return df.select(*[col(k) for k in keep], x.alias("x"), c.alias("c"))

    def arrays(self, df: DataFrame, named: Mapping[str, str] | None = None) -> tuple[Column, Column]:
        """Numbers and category ids of the input columns, which the table may hold under other names."""
        at = named or {}
        x = [F.coalesce(number(df, at.get(c, c)), F.lit(float(self.medians[c] or 0.0))) for c in self.numeric]
        c = [category_id(k, F.coalesce(col(at.get(name, name)).cast("string"), F.lit(self.fill(name)))) for k, name in enumerate(self.categorical)]
        return (F.array(*x) if x else F.array().cast("array<double>")), (F.array(*c) if c else F.array().cast("array<bigint>"))

    def fill(self, name: str) -> str:
        return self.modes[name] if self.modes[name] is not None else "missing"

    def category_names(self) -> DataFrame:
        """(kind, f, column, feature): every category with its id and one-hot name."""
        place = F.element_at(F.create_map(*[F.lit(v) for k, c in enumerate(self.categorical) for v in (c, k)]), F.col("feature"))
        filled = [(c, self.fill(c)) for c in self.categorical if self.modes[c] is None]
        known = self.table.filter("value is not null").select("feature", "value")
        if filled:
            known = known.unionByName(local_frame(known.sparkSession, filled, "feature string, value string"))
        return known.select(place.alias("kind"), "feature", "value").select(
            "kind", F.xxhash64(F.col("kind"), F.col("value")).alias("f"), F.col("feature").alias("column"),
            F.concat_ws("_", "feature", "value").alias("feature"))


def fit_sparse(fit: DataFrame, exclude: Sequence[str], bins: int) -> SparsePrep:
    """Medians and bin edges of the numeric columns (exact quantiles), modes and numbers of categories of the others."""
    numeric = sorted(numeric_columns(fit, exclude))
    cats = sorted(model_categorical_columns(fit, exclude))
    cut = exact_quantiles(fit, numeric, [i / bins for i in range(1, bins)])
    edges = [np.unique(np.array(cut[c], float)) if cut[c] else np.empty(0) for c in numeric]
    med = {c: (cut[c][bins // 2 - 1] if cut[c] else None) for c in numeric}
    mode, size, counts = {c: None for c in cats}, {c: 0 for c in cats}, None
    if cats:
        counts = checkpointed(value_counts(fit, cats))
        # one row per column
        for r in (counts.filter("value is not null").groupBy("feature")
                  .agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"), F.count(F.lit(1)).alias("n")).collect()):
            mode[r["feature"]], size[r["feature"]] = r["mode"], r["n"]
    return SparsePrep(numeric, cats, med, mode, edges, [max(size[c], 1) for c in cats], counts)


def fit_sparse_folds(df: DataFrame, fold: str, folds: int, exclude: Sequence[str], bins: int) -> list[SparsePrep]:
    """For each fold the preparation fitted on all others, in as many scans as one fit takes.

    Numbers and values are counted per fold, and what a fit sees of them is the total minus its own fold.
    """
    skip = [*exclude, fold]
    numeric, cats = sorted(numeric_columns(df, skip)), sorted(model_categorical_columns(df, skip))
    cut = fold_quantiles(df, numeric, fold, folds, [i / bins for i in range(1, bins)])
    found = {}
    if cats:
        per = value_counts(df, cats, [fold]).filter("value is not null")
        kept = per.groupBy("feature", "value").agg(*[F.sum(F.when(col(fold) != k, F.col("cnt"))).alias(f"n{k}") for k in range(folds)])
        # one row per column
        found = {r["feature"]: r for r in kept.groupBy("feature").agg(*[x for k in range(folds) for x in (
            F.min_by("value", F.when(F.col(f"n{k}").isNotNull(), F.struct(-F.col(f"n{k}"), F.col("value")))).alias(f"mode{k}"),
            F.count(f"n{k}").alias(f"size{k}"))]).collect()}
    out = []
    for k in range(folds):
        own = {c: cut[(k, c)] for c in numeric}
        out.append(SparsePrep(
            numeric, cats, {c: (q[bins // 2 - 1] if q else None) for c, q in own.items()},
            {c: (found[c][f"mode{k}"] if c in found and found[c][f"size{k}"] else None) for c in cats},
            [np.unique(np.array(own[c], float)) if own[c] else np.empty(0) for c in numeric],
            [max(found[c][f"size{k}"], 1) if c in found else 1 for c in cats], None))
    return out


def preprocess(df: DataFrame, target: str, key: str, split: str = "split", min_share: float = DEFAULT.min_category_share
               ) -> tuple[DataFrame, FittedPrep]:
    """Fits on the train rows of ``df`` and returns (key, split, target, features...) for all rows."""
    skip = [key, split, target]
    prep = fit_prep(df.filter(col(split) == "train"), skip, indicators=True, min_share=min_share)
    return prep.transform(df, skip), prep
