"""Train/test splits and samples from a stable hash of the row key: the same rows on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import AuditConfig
from ..functions.selection import hash_key
from ..schema import col, quoted, value
from ..sources.scratch import checkpointed

DEFAULT = AuditConfig()


def split_hash(df: DataFrame, key: str, test_fraction: float = DEFAULT.test_fraction) -> DataFrame:
    """Adds ``split``: a row is test when its key hash falls in the last share.  No shuffle."""
    parts = round(1 / test_fraction)
    if abs(parts * test_fraction - 1) < 1e-9:
        is_test = hash_key(key) % parts == 0
    else:
        is_test = hash_key(key) < F.lit(int(test_fraction * 2 ** 32))
    return df.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def stratify_rule(df: DataFrame, target: str, below: int = DEFAULT.stratify_below_classes) -> DataFrame:
    """(n_classes, stratify): few classes (a missing target is one) of a discrete type."""
    discrete = isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType, T.IntegralType))
    y = value(df, target)
    n = F.count_distinct(y) + F.max(F.when(y.isNull(), 1).otherwise(0))
    return df.agg(n.cast("bigint").alias("n_classes"),
                  (F.lit(discrete) & (n < below)).alias("stratify"))


def _md5(key: str) -> Column:
    return F.md5(col(key).cast("string"))


def split_stratified(df: DataFrame, key: str, target: str, test_fraction: float = DEFAULT.test_fraction,
                     broadcast_classes: int = 10_000) -> DataFrame:
    """Adds ``split`` so that every class gives exactly the first ceil(fraction x size) rows by key hash.

    A class may be most of the table, so it is never sorted: counts per hash prefix find the prefix in
    which the cut falls, only the rows of that prefix (a millionth of the class) are ranked, and the
    full table is then split by comparing each hash with the cut of its class.
    """
    y = value(df, target).cast("string")
    keyed = df.select(y.alias("__y"), _md5(key).alias("__h"), col(key).alias("__k"))
    prefix = F.substring("__h", 1, 5)
    counts = keyed.groupBy("__y", prefix.alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("__y").orderBy("__p")
    cuts = (counts.withColumn("upto", F.sum("n").over(up))
            .withColumn("take", F.ceil(F.sum("n").over(Window.partitionBy("__y")) * F.lit(float(test_fraction))))
            .filter((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("n") < F.col("take")))
            .select(F.col("__y").alias("y2"), F.col("__p").alias("p2"),
                    (F.col("take") - F.col("upto") + F.col("n")).alias("need")))
    edge = (keyed.join(cuts, F.col("__y").eqNullSafe(F.col("y2")) & (prefix == F.col("p2")))
            .withColumn("r", F.row_number().over(Window.partitionBy("__y").orderBy("__h", "__k")))
            .filter("r = need").select(F.col("__y").alias("__cy"), F.col("__h").alias("__ch"),
                                       F.col("__k").alias("__ck")))
    last = checkpointed(edge)  # one row per class
    # A checked number of classes is broadcast, so that a class with most of the rows is never moved.
    few = last.limit(broadcast_classes + 1).count() <= broadcast_classes
    cut_table = F.broadcast(last) if few else last
    tagged = df.withColumn("__y", y).withColumn("__h", _md5(key))
    joined = tagged.join(cut_table, tagged["__y"].eqNullSafe(cut_table["__cy"]), "left")
    is_test = (F.col("__h") < F.col("__ch")) | ((F.col("__h") == F.col("__ch")) & (col(key) <= F.col("__ck")))
    return joined.select(*[tagged[quoted(c)] for c in df.columns],
                         F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias("split"))


def dev_sample(df: DataFrame, key: str, rows: int = DEFAULT.dev_rows, seed: int = DEFAULT.seed) -> DataFrame:
    """Exactly ``rows`` rows (or all of a smaller table), the first by seeded key hash.

    Planned as a top-k: every task keeps its own best rows, so nothing is sorted in full.
    """
    order = F.md5(F.concat(col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(order, col(key)).limit(rows)


def fold_of(key: str, folds: int = DEFAULT.cv_folds) -> Column:
    """Cross-validation fold of a row from its key, independent of the hash digits the split uses."""
    return F.conv(F.substring(_md5(key), 9, 8), 16, 10).cast("bigint") % folds


def stratified_folds(df: DataFrame, key: str, target: str, folds: int = DEFAULT.cv_folds) -> DataFrame:
    """Adds ``fold``: every class is dealt out in turn by the hash of its keys, so fold sizes differ by one per class.

    A class is ranked within hash prefixes, whose counts give the rank before; none of its tasks grows with the class
    alone.  Missing target values are a class of their own.
    """
    spread = df.withColumns({"__y": value(df, target).cast("string"), "__h": F.md5(F.concat(col(key).cast("string"), F.lit(":fold")))})
    spread = spread.withColumn("__p", F.substring("__h", 1, 3))
    counts = spread.groupBy("__y", "__p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__y").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("__y").alias("y2"), F.col("__p").alias("p2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    ranked = spread.withColumn("__r", F.row_number().over(Window.partitionBy("__y", "__p").orderBy("__h", col(key))) - 1)
    dealt = ranked.join(first, F.col("__y").eqNullSafe(F.col("y2")) & (F.col("__p") == F.col("p2")))
    return dealt.select(*map(col, df.columns), F.pmod(F.col("__first") + F.col("__r"), F.lit(folds)).alias("fold"))
