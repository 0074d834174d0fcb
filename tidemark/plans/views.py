"""Tables derived from the given ones, with planted problems for the checks to find.

The given tables have no missing cells and no repeated rows, so each view adds some by arithmetic on the
row key.  Every view grows with its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.split import split_hash
from ..sources.tables import table

NUMERIC = ["price", "price_info", "const_col", "near_const", "y", "leak", "price_correlated", "y_rare", "heavy"]
KEY = "o_orderkey"


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0).cast("bigint")


def orders_dirty(spark: SparkSession, d: str) -> DataFrame:
    """Orders with customer columns: gaps, a constant, a near-constant, a leak, a copy, a heavy tail."""
    k, total = F.col(KEY), F.col("o_totalprice")
    y = _flag(total > 250000)
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        KEY, "o_orderstatus", "o_orderpriority", "c_name",
        F.when(k % 11 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(k % 7 != 0, total).alias("price"),
        F.when(~((total > 400000) & (k % 2 == 0)), total).alias("price_info"),
        F.lit(1).cast("bigint").alias("const_col"), _flag(k % 500 == 0).alias("near_const"), y.alias("y"),
        (y * 10 + (k % 10) / 1000.0).alias("leak"), (total * 2 + k % 13).alias("price_correlated"),
        _flag(total > 420000).alias("y_rare"),
        F.when(k % 50 == 0, F.lit(1000.0)).otherwise((k % 20).cast("double")).alias("heavy"))


def orders_dup(spark: SparkSession, d: str) -> DataFrame:
    """Orders with every fiftieth row repeated."""
    orders = table(spark, d, "orders")
    return orders.unionByName(orders.filter(F.col(KEY) % 50 == 0))


def orders_split(spark: SparkSession, d: str) -> DataFrame:
    return split_hash(orders_dirty(spark, d), KEY)


def orders_drift(spark: SparkSession, d: str) -> DataFrame:
    """Split orders whose test prices are halved, bent, unchanged, constant or out of range."""
    rows = split_hash(table(spark, d, "orders").select(KEY, "o_totalprice"), KEY)
    total, test = F.col("o_totalprice"), F.col("split") == "test"
    return rows.select(
        KEY, "split", F.when(F.col(KEY) % 7 != 0, F.when(test, total * 0.5).otherwise(total)).alias("half"),
        F.when(test, total * total / 500000.0).otherwise(total).alias("curved"), total.alias("same"),
        F.lit(1).cast("bigint").alias("flat"), F.when(test, total + 10000000.0).otherwise(total).alias("away"),
        (F.col(KEY) % 10).alias("digit"))


DRIFT_COLUMNS = ["half", "curved", "same", "flat", "away", "digit"]


def overlap_pair(spark: SparkSession, d: str) -> DataFrame:
    """Split orders reduced to coarse columns with gaps, so that train and test rows coincide."""
    rows = split_hash(table(spark, d, "orders"), KEY)
    k = F.col(KEY)
    return rows.select(
        KEY, "split", "o_orderstatus", F.when(k % 11 != 0, F.col("o_orderpriority")).alias("priority"),
        (k % 500 == 0).alias("near_const"), F.floor(F.col("o_totalprice") / 2000.0).cast("bigint").alias("price_band"),
        F.year("o_orderdate").cast("bigint").alias("year"))


OVERLAP_COLUMNS = ["o_orderstatus", "priority", "near_const", "price_band", "year"]


def preds(spark: SparkSession, d: str) -> DataFrame:
    """Line items read as stored predictions: binary, probability, multi-class, regression."""
    flag = F.col("l_returnflag")
    rotated = F.when(flag == "A", "N").when(flag == "N", "R").otherwise("A")
    return table(spark, d, "lineitem").select(
        _flag(F.col("l_discount") >= 0.05).alias("y_true"), _flag(F.col("l_tax") >= 0.04).alias("y_pred"),
        (F.col("l_discount") * 10).alias("p"), flag.alias("flag"),
        F.when(F.col("l_linestatus") == "O", flag).otherwise(rotated).alias("flag_pred"),
        F.col("l_extendedprice").alias("amount"), (F.col("l_quantity") * 1000).alias("amount_pred"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """One candidate model per order, its scores and counts from whole-number sums over the order's lines."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.round(F.col("l_discount") * 100).cast("bigint").alias("d"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("t"), F.col("l_quantity").cast("bigint").alias("q"))
    n = F.count(F.lit(1))
    return li.groupBy("run_id").agg(
        ((F.max("d") * 45 + 550) / 1000.0).alias("train_score"),
        ((F.floor(F.sum("d") * 45 / n) + 500) / 1000.0).alias("test_score"),
        ((F.floor(F.sum("t") * 50 / n) + 500) / 1000.0).alias("cv_mean"),
        ((F.max("t") - F.min("t")) / 50.0).alias("cv_std"),
        F.count_if(F.col("q") > 45).alias("n_critical_vif"), F.count_if(F.col("q").between(35, 45)).alias("n_high_vif"),
        F.count_if(F.col("d") >= 6).alias("n_severe_drift"), F.count_if(F.col("t") == 8).alias("n_critical"),
        F.count_if(F.col("t") >= 2).alias("n_high")).select(
            "*", F.col("test_score").alias("performance"), F.lit("f1").alias("metric_name"))


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, split, metric, value): candidates report different metrics."""
    c = candidates(spark, d)
    name = (F.when(F.col("run_id") % 5 == 0, "f1").when(F.col("run_id") % 5 == 1, "accuracy")
            .when(F.col("run_id") % 5 == 2, "rmse").when(F.col("run_id") % 5 == 3, "zeta").otherwise("r2"))
    rows = F.array(
        F.struct(F.lit("train").alias("split"), name.alias("metric"), F.col("train_score").alias("value")),
        F.struct(F.lit("holdout").alias("split"), name.alias("metric"), F.col("test_score").alias("value")),
        F.struct(F.lit("holdout").alias("split"), F.lit("mae").alias("metric"), F.col("cv_mean").alias("value")))
    return c.select("run_id", F.explode(rows).alias("r")).select("run_id", "r.*")


def issues_raw(spark: SparkSession, d: str) -> DataFrame:
    """Events read as issue rows with messy types and severities."""
    k = F.col("event_id")

    def pick(mod: int, values: dict[int, str | None], otherwise: str) -> Column:
        out = None
        for i, v in values.items():
            out = F.when(k % mod == i, F.lit(v)) if out is None else out.when(k % mod == i, F.lit(v))
        return out.otherwise(F.lit(otherwise))

    return table(spark, d, "events").select(
        k.alias("issue_id"), F.col("user_id").alias("run_id"),
        pick(7, {0: "Feature Drift", 1: " split-overlap ", 2: "missing/values", 3: "multicollinearity",
                 4: "Target Leakage", 5: None}, "high_cardinality").alias("type"),
        F.when(k % 13 != 0, F.concat(F.lit("col_"), (F.col("user_id") % 40).cast("string"))).alias("column"),
        pick(9, {0: "warn", 1: "SEVERE", 2: "danger", 3: None, 4: "bogus", 5: "High", 6: " critical ", 7: "low"},
             "info").alias("severity"),
        F.when(k % 4 != 0, F.col("event_type")).alias("description"))


def flags_raw(spark: SparkSession, d: str) -> DataFrame:
    """Events read as observability flags of the same runs."""
    k = F.col("event_id")
    label = (F.when(k % 40 == 0, "High Overfit Risk").when(k % 40 == 1, "Fold Instability")
             .when(k % 40 == 2, "Generalization Decay"))
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), label.alias("flag")).filter(
        "flag is not null")


def user_metrics(spark: SparkSession, d: str) -> DataFrame:
    """One holdout metric per user from whole-number event counts."""
    per = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") % 3 == 0).alias("hit"))
    return per.select("run_id", F.when(F.col("run_id") % 3 == 0, "rmse").otherwise("f1").alias("metric"),
                      ((F.floor(F.col("hit") * 1000 / F.col("n")) + 350) / 1000.0).alias("value"))


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Events as stored report documents, some with missing or wrongly typed sections."""
    k = F.col("event_id").cast("string")
    m = F.col("event_id") % 6
    body = F.concat(
        F.lit('{"pipeline_status": "success", "dataset": {"rows": "'), k, F.lit(' ", "overlap_pct": '),
        F.when(m == 1, '"none"').otherwise((F.col("event_id") % 100).cast("string")),
        F.lit('}, "metrics": '),
        F.when(m == 2, F.concat(F.lit('{"metrics": {"holdout": {"f1": 0.'), k, F.lit('}, "observability_flags": [1, 2]}}')))
        .when(m == 3, "{}").otherwise(F.concat(F.lit('{"holdout": {"f1": 0.'), k, F.lit('}}'))),
        F.lit(', "issues": '), F.when(m == 4, '"broken"').when(m == 5, '{"a": 1}').otherwise('[{"type": "x"}, {"type": "y"}]'),
        F.lit(', "psi_table": [1, 2, 3], "feature_importance": '), F.when(m == 0, "[]").otherwise('{"a": 1.0, "b": 2.0}'),
        F.lit("}"))
    return table(spark, d, "events").select("event_id", body.alias("report"))


def messy_text(spark: SparkSession, d: str) -> DataFrame:
    """Orders with padded text and missing tokens."""
    k = F.col(KEY)
    messy = (F.when(k % 6 == 0, " ? ").when(k % 6 == 1, "-").when(k % 6 == 2, " NA ")
             .when(k % 6 == 3, F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")))
             .otherwise(F.col("o_orderpriority")))
    return table(spark, d, "orders").select(KEY, messy.alias("priority"), F.concat(
        F.lit(" "), F.col("o_orderstatus")).alias("status"), "o_totalprice")


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
