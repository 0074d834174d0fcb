"""The registered queries: each operator over whole derived tables.

Every callable takes (spark, folder) and returns a DataFrame.  Doubles are rounded to six digits for
comparison with other engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import charts, checks, drift, metrics, models, observe, prep, profile, recommend, rows, split
from ..operators.outliers import multivariate_outliers
from ..schema import col, local_frame
from ..sources import csv
from ..sources.report import report_rows
from ..sources.scratch import scratch_path, stored
from ..sources.tables import table
from . import views as v
from .audit import audit, run_all_checks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits of a sum do not depend on the order of its rows."""
    return df.select(*[F.round(col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else col(f.name) for f in df.schema.fields])


def joined(df: DataFrame, *arrays: str) -> DataFrame:
    return df.select(*[F.concat_ws(",", col(c)).alias(c) if c in arrays else col(c) for c in df.columns])


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, d: rounded(fn(spark, d))
        return fn
    return add


def _train(df: DataFrame) -> DataFrame:
    return df.filter("split = 'train'")


# --- sources ---------------------------------------------------------------------------------------

@query("csv_scan")
def csv_scan(spark, d):
    path = scratch_path(spark, "csv") + ".csv"
    dirty = v.orders_dirty(spark, d)
    token = F.when(F.col(v.KEY) % 2 == 0, "?").otherwise(" NA ")
    dirty.select(F.col(v.KEY).alias(f" {v.KEY} "), F.coalesce("segment", token).alias("segment"),
                 F.coalesce(F.col("price").cast("string"), token).alias("price"),
                 F.col("y").alias(" price "), F.col("c_name")).write.option("header", True).csv(path)
    df = csv.load_csv(spark, path, "price__duplicate_1")
    return df.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("n_price"),
                                     F.avg("price").alias("avg_price"), F.sum("price__duplicate_1").alias("sum_y"),
                                     F.max(v.KEY).alias("max_key"), F.count_distinct("c_name").alias("n_names"))


@query("header_normalize")
def header_normalize(spark, d):
    o = table(spark, d, "orders")
    return csv.rename_all(o.select(F.col(v.KEY).alias(f" {v.KEY} "), F.col("o_totalprice").alias("price"),
                                   F.col("o_custkey").alias(" price"), F.col("o_orderstatus").alias("price ")))


@query("normalize_strings")
def normalize_strings(spark, d):
    return csv.normalize_strings(v.messy_text(spark, d))


@query("infer_types")
def infer_types(spark, d):
    text = csv.normalize_strings(v.as_text(v.orders_dirty(spark, d)))
    found = csv.infer_types(text)
    return local_frame(spark, list(found.items()), "feature string, dtype string")


@query("dev_sample")
def dev_sample(spark, d):
    return split.dev_sample(table(spark, d, "orders").select(v.KEY, "o_totalprice"), v.KEY)


@query("report_table")
def report_table(spark, d):
    dirty = v.orders_dirty(spark, d)
    return report_rows({"missing_values": checks.missing_values(dirty), "feature_audit": profile.feature_audit(dirty),
                        "class_distribution": checks.class_distribution(dirty, "y_rare")})


# --- profile ---------------------------------------------------------------------------------------

@query("basic_info")
def basic_info(spark, d):
    return profile.basic_info(v.orders_dup(spark, d))


@query("feature_audit")
def feature_audit(spark, d):
    return profile.feature_audit(v.orders_dirty(spark, d))


@query("preview")
def preview(spark, d):
    return profile.preview(v.orders_dirty(spark, d), v.KEY)


@query("data_types")
def data_types(spark, d):
    dirty = v.orders_dirty(spark, d)
    present = checks.column_profile(dirty, skew=False).select("feature", "present")
    return profile.data_types(dirty).join(present, "feature")


# --- checks ----------------------------------------------------------------------------------------

@query("missing_values")
def missing_values(spark, d):
    return checks.missing_values(v.orders_dirty(spark, d))


@query("constant_features")
def constant_features(spark, d):
    return checks.constant_features(v.orders_dirty(spark, d).withColumn("void", F.lit(None).cast("string")))


@query("near_constant")
def near_constant(spark, d):
    return checks.near_constant(v.orders_dirty(spark, d))


@query("high_cardinality")
def high_cardinality(spark, d):
    return checks.high_cardinality(v.orders_dirty(spark, d))


@query("high_cardinality_adv")
def high_cardinality_adv(spark, d):
    rows_ = v.orders_dirty(spark, d)
    return checks.high_cardinality_text(rows_.select("c_name", "segment", F.concat(
        F.lit("k"), (F.col(v.KEY) % 100).cast("string")).alias("code")))


@query("duplicates")
def duplicates(spark, d):
    return rows.duplicates(v.orders_dup(spark, d))


@query("skewness")
def skewness(spark, d):
    return checks.skewness(v.orders_dirty(spark, d), "y", v.NUMERIC)


@query("class_imbalance")
def class_imbalance(spark, d):
    return checks.class_imbalance(v.orders_dirty(spark, d), "y_rare")


@query("class_distribution")
def class_distribution(spark, d):
    return checks.class_distribution(v.orders_dirty(spark, d), "segment")


@query("high_correlation")
def high_correlation(spark, d):
    return checks.high_correlation(v.orders_dirty(spark, d), "y", v.NUMERIC)


@query("target_leakage")
def target_leakage(spark, d):
    return checks.target_leakage(v.orders_dirty(spark, d), "y", v.NUMERIC)


@query("iqr_outliers_wide")
def iqr_outliers_wide(spark, d):
    """Twelve columns, of which every row misses one."""
    price, at = F.col("o_totalprice"), F.col("o_orderkey") % 12
    return checks.iqr_outliers(table(spark, d, "orders").select(*[F.when(at != i, price).alias(f"c{i}") for i in range(12)]))


@query("iqr_outliers")
def iqr_outliers(spark, d):
    return checks.iqr_outliers(v.orders_dirty(spark, d), "y", v.NUMERIC)


@query("iqr_outliers_lineitem")
def iqr_outliers_lineitem(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_quantity", "l_discount", (F.col("l_extendedprice") / (F.col("l_discount") + 0.01)).alias("ratio"))
    return checks.iqr_outliers(li)


@query("multivariate_outliers")
def multivariate(spark, d):
    return joined(multivariate_outliers(v.orders_dirty(spark, d), v.KEY, v.NUMERIC), "indices")


@query("outlier_contamination")
def outlier_contamination(spark, d):
    return checks.outlier_contamination(v.orders_dirty(spark, d), v.NUMERIC)


@query("run_all_checks")
def all_checks(spark, d):
    return report_rows(run_all_checks(v.orders_dirty(spark, d), "y_rare", key=v.KEY))


@query("issue_summary")
def issue_summary(spark, d):
    return checks.issue_summary(v.orders_dirty(spark, d), "y_rare", exclude=[v.KEY]).drop("description")


# --- split, overlap, drift -------------------------------------------------------------------------

@query("split_hash")
def split_hash(spark, d):
    return split.split_hash(table(spark, d, "orders").select(v.KEY, "o_orderstatus"), v.KEY)


@query("split_stratified")
def split_stratified(spark, d):
    return split.split_stratified(v.orders_dirty(spark, d).select(v.KEY, "segment"), v.KEY, "segment")


@query("stratify_rule")
def stratify_rule(spark, d):
    dirty = v.orders_dirty(spark, d)
    parts = [split.stratify_rule(dirty, t).select(F.lit(t).alias("target"), "n_classes", "stratify")
             for t in ("segment", "y_rare", "c_name", "leak")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("row_overlap")
def row_overlap(spark, d):
    return rows.row_overlap(v.overlap_pair(spark, d), v.OVERLAP_COLUMNS)


@query("leakage_risk")
def leakage_risk(spark, d):
    return rows.leakage_risk(rows.row_overlap(v.overlap_pair(spark, d), v.OVERLAP_COLUMNS))


@query("psi")
def psi(spark, d):
    return drift.psi(v.orders_drift(spark, d), v.DRIFT_COLUMNS)


@query("psi_table")
def psi_table(spark, d):
    return drift.psi_table(drift.psi(v.orders_drift(spark, d), v.DRIFT_COLUMNS))


@query("drift_bands")
def drift_bands(spark, d):
    return joined(drift.drift_bands(drift.psi(v.orders_drift(spark, d), v.DRIFT_COLUMNS)), "features")


@query("drift_impact")
def drift_impact(spark, d):
    return drift.drift_impact(drift.psi(v.orders_drift(spark, d), v.DRIFT_COLUMNS))


@query("variance_ratio")
def variance_ratio(spark, d):
    return drift.variance_ratio(v.orders_drift(spark, d), v.DRIFT_COLUMNS).drop("train_var", "test_var")


@query("feature_stability")
def feature_stability(spark, d):
    return drift.feature_stability(v.orders_drift(spark, d), v.DRIFT_COLUMNS)


@query("informative_missingness")
def informative_missingness(spark, d):
    return drift.informative_missingness(v.orders_dirty(spark, d), "y")


def _vif_rows(spark, d):
    return table(spark, d, "lineitem").select(
        "l_quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", F.lit(3.0).alias("flat"))


@query("vif")
def vif(spark, d):
    return drift.vif(_vif_rows(spark, d))


@query("vif_table")
def vif_table(spark, d):
    return drift.vif_table(drift.vif(_vif_rows(spark, d)))


@query("vif_bands")
def vif_bands(spark, d):
    return joined(drift.vif_bands(drift.vif(_vif_rows(spark, d))), "features")


@query("integrity_issues")
def integrity_issues(spark, d):
    pair = v.overlap_pair(spark, d)
    moved = v.orders_drift(spark, d)
    return drift.integrity_issues(
        rows.row_overlap(pair, v.OVERLAP_COLUMNS), drift.psi_table(drift.psi(moved, v.DRIFT_COLUMNS)),
        drift.vif(_vif_rows(spark, d)), drift.variance_ratio(moved, v.DRIFT_COLUMNS),
        drift.informative_missingness(v.orders_dirty(spark, d), "y")).drop("description")


# --- preparation -----------------------------------------------------------------------------------

@query("impute")
def impute(spark, d):
    dirty = v.orders_dirty(spark, d).select(v.KEY, "segment", "price", "price_info",
                                            F.lit(None).cast("string").alias("void"))
    return prep.impute(dirty, exclude=[v.KEY])


@query("impute_train_fit")
def impute_train_fit(spark, d):
    rows_ = v.orders_split(spark, d).select(v.KEY, "split", "segment", "price", "price_info")
    return prep.impute(rows_, _train(rows_), exclude=[v.KEY, "split"])


@query("missing_indicator")
def missing_indicator(spark, d):
    rows_ = v.orders_split(spark, d).select(v.KEY, "split", "price", "price_info", "heavy")
    return prep.missing_indicators(rows_, _train(rows_), ["price", "price_info", "heavy"]).select(
        v.KEY, "price__missing_indicator", "price_info__missing_indicator")


@query("robust_scale")
def robust_scale(spark, d):
    rows_ = v.orders_split(spark, d).select(v.KEY, "price", "heavy", "near_const", "split")
    return prep.robust_scale(rows_, ["price", "heavy", "near_const"], _train(rows_))


def _one_hot_rows(spark, d):
    k = F.col(v.KEY)
    return v.orders_split(spark, d).select(
        v.KEY, "split", "segment", F.when((F.col("split") == "test") & (k % 3 == 0), "unseen")
        .when(k % 300 == 0, "rare_a").when(k % 301 == 0, "rare_b").otherwise(F.col("o_orderstatus")).alias("status"))


@query("one_hot")
def one_hot(spark, d):
    rows_ = _one_hot_rows(spark, d)
    return prep.one_hot(rows_, ["segment", "status"], _train(rows_))


@query("one_hot_min_freq")
def one_hot_min_freq(spark, d):
    rows_ = _one_hot_rows(spark, d)
    return prep.one_hot(rows_, ["segment", "status"], _train(rows_), 0.01)


@query("one_hot_long")
def one_hot_long(spark, d):
    """Every category of every text column, the customers' names included, as rows."""
    rows_ = v.orders_split(spark, d)
    return prep.one_hot_long(rows_, v.KEY, ["c_name", "segment", "o_orderstatus"], _train(rows_))


@query("permutation_pairs")
def permutation_pairs(spark, d):
    return models.permutation_pairs(v.orders_dirty(spark, d), v.KEY, 3)


@query("feature_names")
def feature_names(spark, d):
    rows_ = v.orders_split(spark, d)
    fitted = prep.fit_prep(_train(rows_), [v.KEY, "split", "y_rare"])
    return local_frame(spark, [(i + 1, n, o) for i, (n, o) in enumerate(zip(fitted.feature_names, fitted.origin()))],
                       "position bigint, feature string, origin string")


@query("preprocess")
def preprocess(spark, d):
    """The cells that are not zero, one row each: which categories are features depends on the data."""
    wide, fitted = prep.preprocess(v.orders_split(spark, d), "y_rare", v.KEY)
    long = wide.unpivot([v.KEY, "split", "y_rare"], [col(c) for c in fitted.feature_names], "feature", "value")
    return long.filter(F.round("value", 6) != 0)


# --- models and metrics ----------------------------------------------------------------------------

def _model(spark, d, task="classification", target="y_rare"):
    rows_ = stored(v.orders_split(spark, d), "model-rows")
    return rows_, models.train(_train(rows_), target, task, [v.KEY, "split"])


@query("rf_classify")
def rf_classify(spark, d):
    rows_, fitted = _model(spark, d)
    return fitted.predict(rows_, [v.KEY, "split"]).select(v.KEY, "split", "prediction",
                                                          F.element_at("probability", 2).alias("p1"))


@query("rf_regress")
def rf_regress(spark, d):
    rows_, fitted = _model(spark, d, "regression", "price_correlated")
    return fitted.predict(rows_, [v.KEY, "split"])


@query("classification_metrics")
def classification_metrics(spark, d):
    p = v.preds(spark, d)
    parts = [metrics.classification_metrics(p, a, b).select(F.lit(n).alias("run"), "metric", "value")
             for n, a, b in (("binary", "y_true", "y_pred"), ("flags", "flag", "flag_pred"))]
    return parts[0].unionByName(parts[1])


@query("confusion_matrix")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(v.preds(spark, d), "flag", "flag_pred")


@query("label_metrics")
def label_metrics(spark, d):
    return metrics.classification_metrics(table(spark, d, "labels"), "quality", "toxic")


@query("roc_auc")
def roc_auc(spark, d):
    rows_ = v.preds(spark, d).withColumn("r", (F.col("flag") == "R").cast("int"))
    parts = [metrics.roc_auc(rows_, y, s).select(F.lit(n).alias("run"), "*")
             for n, y, s in (("ties", "y_pred", "p"), ("continuous", "r", "amount"))]
    return parts[0].unionByName(parts[1])


@query("regression_metrics")
def regression_metrics(spark, d):
    return metrics.regression_metrics(v.preds(spark, d), "amount", "amount_pred")


@query("cv_folds")
def cv_folds(spark, d):
    return models.cv_fold_sizes(v.orders_dirty(spark, d), v.KEY, "y_rare")


@query("cv_folds_stratified")
def cv_folds_stratified(spark, d):
    return models.cv_stratified_sizes(v.orders_dirty(spark, d), v.KEY, "y_rare")


@query("cross_validate")
def cross_validate(spark, d):
    rows_ = stored(v.orders_dirty(spark, d), "model-rows")
    return models.cross_validate(rows_, "y_rare", "classification", v.KEY)


@query("feature_importance")
def feature_importance(spark, d):
    return models.feature_importance(_model(spark, d)[1])


@query("permutation_importance")
def permutation_importance(spark, d):
    rows_, fitted = _model(spark, d)
    return models.permutation_importance(fitted, _train(rows_), v.KEY)


@query("calibration_curve")
def calibration_curve(spark, d):
    return metrics.calibration_curve(v.preds(spark, d), "y_pred", "p")


@query("calibration_ece")
def calibration_ece(spark, d):
    return metrics.calibration_error(metrics.calibration_curve(v.preds(spark, d), "y_pred", "p"))


@query("confidence_spread")
def confidence_spread(spark, d):
    return metrics.confidence_spread(v.preds(spark, d), "p")


# --- observability ---------------------------------------------------------------------------------

@query("generalization_flags")
def generalization_flags(spark, d):
    return observe.generalization_flags(v.candidates(spark, d)).select("run_id", "flag_id", "severity")


@query("runner_flags")
def runner_flags(spark, d):
    return observe.runner_flags(v.candidates(spark, d)).select("run_id", "flag")


@query("deployment_readiness")
def deployment_readiness(spark, d):
    return joined(observe.deployment_readiness(v.candidates(spark, d)), "blocking_issues", "warnings")


@query("deployability_score")
def deployability_score(spark, d):
    issues = v.issues_raw(spark, d)
    return observe.deployability_score(recommend.issue_normalize(issues), v.flags_raw(spark, d),
                                       v.user_metrics(spark, d))


@query("primary_metric")
def primary_metric(spark, d):
    return observe.primary_metric(v.run_metrics(spark, d).filter("split = 'holdout'"))


@query("metric_gap")
def metric_gap(spark, d):
    return observe.metric_gap(v.run_metrics(spark, d))


@query("report_normalize")
def report_normalize(spark, d):
    return observe.report_normalize(v.reports(spark, d))


# --- issues and recommendations --------------------------------------------------------------------

@query("issue_normalize")
def issue_normalize(spark, d):
    return recommend.issue_normalize(v.issues_raw(spark, d))


@query("severity_normalize")
def severity_normalize(spark, d):
    s = F.col("severity")
    return v.issues_raw(spark, d).select("issue_id", recommend.severity_normalize(s).alias("severity"),
                                         recommend.severity_normalize(s, danger=False).alias("score_severity"))


@query("recommendations")
def recommendations(spark, d):
    return joined(recommend.recommendations(recommend.issue_normalize(v.issues_raw(spark, d))), "affected_columns")


@query("recommendations_by_run")
def recommendations_by_run(spark, d):
    issues = recommend.issue_normalize(v.issues_raw(spark, d))
    return joined(recommend.recommendations(issues, ["run_id"]), "affected_columns").drop("recommendation")


@query("critical_issues")
def critical_issues(spark, d):
    return recommend.critical_issues(recommend.issue_normalize(v.issues_raw(spark, d)))


@query("severity_distribution")
def severity_distribution(spark, d):
    return recommend.severity_distribution(recommend.issue_normalize(v.issues_raw(spark, d)))


@query("severity_filter")
def severity_filter(spark, d):
    return recommend.severity_filter(v.issues_raw(spark, d), "Critical").select("issue_id", "severity")


@query("issues_by_type")
def issues_by_type(spark, d):
    return recommend.issues_by_type(recommend.issue_normalize(v.issues_raw(spark, d)), "issue_id").select(
        "issue_id", "type", "number")


# --- chart tables and the whole audit --------------------------------------------------------------

@query("top_importance")
def top_importance(spark, d):
    return charts.top_importance(models.feature_importance(_model(spark, d)[1]))


@query("correlation_matrix")
def correlation_matrix(spark, d):
    return charts.correlation_matrix(v.orders_dirty(spark, d), v.NUMERIC)


@query("missing_top10")
def missing_top10(spark, d):
    return charts.missing_top(checks.missing_values(v.orders_dirty(spark, d)))


@query("audit_report")
def audit_report(spark, d):
    return report_rows(audit(v.orders_dirty(spark, d), "y_rare", "classification", v.KEY).tables)
