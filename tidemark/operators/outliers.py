"""Multivariate outliers by isolation forest (Liu, Ting and Zhou, 2008).

Trees see at most 256 sampled rows each, so fitting is bounded whatever the size of the table; scoring,
the part that grows with the data, is a vectorised column expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.selection import exact_quantiles
from ..schema import col, local_frame, number, numeric_columns
from ..sources.scratch import checkpointed

TREES = 100
SAMPLE = 256
MIN_ROWS = 50
FIT_TASKS = 32
# A table this small often sits in one file, hence one task; scoring spreads it over all cores.
SPREAD_BELOW = 2_000_000
NODE_SCHEMA = "tree int, node int, feature int, cut double, size int"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of n keys."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out = np.where(n == 2, 1.0, out)
    big = n > 2
    safe = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe, out)


def _grow(x: np.ndarray, seed: Sequence[int]) -> list[tuple[int, int, float, int]]:
    """Nodes (heap position, feature or -1, cut, size) of one isolation tree."""
    rng = np.random.default_rng(list(seed))
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    nodes, todo = [], [(1, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        sub = x[rows]
        spread = np.flatnonzero(sub.min(axis=0) < sub.max(axis=0)) if len(rows) > 1 else np.array([], int)
        if depth >= limit or len(spread) == 0:
            nodes.append((node, -1, 0.0, len(rows)))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(sub[:, f].min(), sub[:, f].max()))
        left = sub[:, f] < cut
        if not left.any():  # the draw hit the minimum itself
            cut = float(np.nextafter(sub[:, f].min(), np.inf))
            left = sub[:, f] < cut
        nodes.append((node, f, cut, len(rows)))
        todo += [(2 * node, rows[left], depth + 1), (2 * node + 1, rows[~left], depth + 1)]
    return nodes


def fit_forest(rows: DataFrame, key: str, cols: Sequence[str], n: int, trees: int = TREES, sample: int = SAMPLE,
               seed: int = 42) -> pd.DataFrame:
    """Node table of the forest: at most trees x 2 x sample rows.

    A hash threshold thins the table to a pool a few times as large as all samples together, every pool
    row joins a tree by another hash, and each tree keeps the ``sample`` rows of smallest hash.
    """
    pool_size = min(n, trees * sample)
    span = 2 ** 62
    h = F.abs(F.shiftright(F.xxhash64(col(key), F.lit(seed)), 1))
    pool = rows if pool_size >= n else rows.filter(h < F.lit(int(span * min(1.0, 1.1 * pool_size / n))))
    share = min(1.0, 1.5 * sample / max(pool_size, 1) + 20 / max(pool_size, 1))

    def draw(tree) -> Column:
        return F.abs(F.shiftright(F.xxhash64(F.col("k"), tree, F.lit(seed + 1)), 1))

    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < F.lit(int(span * share)))
    chosen = (pool.select(col(key).alias("k"), F.array(*[col(c) for c in cols]).alias("x"))
              .select("k", "x", F.explode(drawn).alias("tree")).withColumn("h", draw(F.col("tree")))
              .repartition(FIT_TASKS, "tree")  # a handful of small trees per task, not all in one
              .withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy("h", "k")))
              .filter(F.col("r") <= sample))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        tree = int(pdf["tree"].iloc[0])
        nodes = _grow(np.stack(pdf["x"].to_numpy()), (seed, tree))
        return pd.DataFrame([(tree, *v) for v in nodes], columns=["tree", "node", "feature", "cut", "size"])

    # a group is one tree sample: at most `sample` rows
    return chosen.groupBy("tree").applyInPandas(fit, NODE_SCHEMA).toPandas()


def _packed(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per tree, dense arrays by heap position: feature (-1 in a leaf), cut, path length at a leaf."""
    order = {t: i for i, t in enumerate(sorted(nodes["tree"].unique()))}
    top = int(nodes["node"].max()) + 1
    feature = np.full((len(order), top), -1, dtype=np.int32)
    cut = np.zeros((len(order), top))
    path = np.zeros((len(order), top))
    t, p = nodes["tree"].map(order).to_numpy(), nodes["node"].to_numpy()
    feature[t, p] = nodes["feature"].to_numpy()
    cut[t, p] = nodes["cut"].to_numpy()
    depth = np.floor(np.log2(p))
    path[t, p] = depth + average_path(nodes["size"].to_numpy())
    return feature, cut, path


def anomaly_scores(rows: DataFrame, key: str, cols: Sequence[str], nodes: pd.DataFrame, sample: int = SAMPLE
                   ) -> DataFrame:
    """(key, score): 2 ^ (-mean path / expected path); higher is more unusual."""
    sizes = nodes[nodes["node"] == 1]["size"]
    norm = float(average_path(float(min(sample, sizes.max()))))
    shared = rows.sparkSession.sparkContext.broadcast(_packed(nodes))

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        feature, cut, path = shared.value
        cells = np.concatenate([s.to_numpy(dtype=float) for s in series])  # column by column
        n = len(series[0])
        at_row, total = np.arange(n), np.zeros(n)
        # A leaf follows itself: no value reaches its cut.
        inner = feature >= 0
        place, cut = np.where(inner, feature, 0).astype(np.int64) * n, np.where(inner, cut, np.nan)
        left = np.where(inner, 2, 1) * np.arange(feature.shape[1])
        for t in range(len(feature)):
            node = np.ones(n, dtype=np.int64)
            for _ in range(int(math.log2(np.flatnonzero(inner[t]).max(initial=0) or 0.5)) + 1):  # levels with a split
                right = cells.take(place[t].take(node) + at_row) >= cut[t].take(node)
                node = left[t].take(node) + right
            total += path[t].take(node)
        return pd.Series(2.0 ** (-(total / len(feature)) / max(norm, 1e-12)))

    return rows.select(col(key), score(*[col(c) for c in cols]).alias("score"))


def multivariate_outliers(df: DataFrame, key: str, cols: Sequence[str] | None = None, seed: int = 42,
                          first_ids: int = 10) -> DataFrame:
    """(complete_rows, contamination, outlier_count, percentage, has_outliers, indices).

    On rows complete in all numeric columns, at least 50 of them.  Rows whose score lies above the
    (1 - contamination) quantile are outliers; the first keys are listed.
    """
    cols = list(cols or numeric_columns(df, [key]))
    key_type = df.schema[key].dataType.simpleString()
    schema = (f"complete_rows bigint, contamination double, outlier_count bigint, percentage double, "
              f"has_outliers boolean, indices array<{key_type}>")
    scored, n, contamination = scored_rows(df, key, cols, seed)
    if scored is None:
        return local_frame(df.sparkSession, [(n, None, 0, 0.0, False, [])], schema)
    cut = exact_quantiles(scored, ["score"], [1.0 - contamination])["score"][0]
    flagged = scored.filter(F.col("score") > cut)
    count = flagged.count()
    first = [r[0] for r in flagged.orderBy(col(key)).limit(first_ids).select(col(key)).collect()]
    return local_frame(df.sparkSession, [(n, contamination, count, count / n * 100, count > 0, first)], schema)


def scored_rows(df: DataFrame, key: str, cols: Sequence[str], seed: int = 42
                ) -> tuple[DataFrame | None, int, float | None]:
    """Checkpointed (key, score) of the complete rows, their number and the expected outlier share."""
    rows = (df.select(col(key), *[number(df, c).alias(f"__x{i}") for i, c in enumerate(cols)])
            .na.drop(subset=[f"__x{i}" for i in range(len(cols))]))
    names = [f"__x{i}" for i in range(len(cols))]
    n = rows.count()
    if n < MIN_ROWS:
        return None, n, None
    contamination = min(0.05, max(0.01, 100.0 / n))
    nodes = fit_forest(rows, key, names, n, seed=seed)
    if n < SPREAD_BELOW:
        rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism)
    # the scores are read twice (cut, then flags): written once to the shared folder
    return checkpointed(anomaly_scores(rows, key, names, nodes)), n, contamination
