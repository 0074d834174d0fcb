"""The end-to-end audit: profile, split, drift, train-only checks, recommendations, model, report."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import AuditConfig
from ..operators import checks, drift, models, observe, profile, recommend, rows
from ..operators.outliers import multivariate_outliers
from ..operators.split import dev_sample, split_hash, split_stratified, stratify_rule
from ..schema import col, flat_columns, materialise, numeric_columns, require_columns, run_together
from ..sources.csv import load_csv, require_rows
from ..sources.report import to_plain, write_report
from ..sources.scratch import checkpointed, stored


@dataclass
class AuditResult:
    """Result tables of one audit (a few rows per audited column each) and its stage times."""

    dataset: dict[str, Any]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    telemetry: dict[str, float] = field(default_factory=dict)
    model: models.TrainedModel | None = None

    def report(self) -> dict[str, Any]:
        """The audit as one JSON-ready document."""
        def listed(name: str) -> list[dict[str, Any]]:
            return [to_plain(r) for r in self.tables[name].collect()] if name in self.tables else []

        sections: dict[str, dict[str, float]] = {"train": {}, "holdout": {}, "cv": {}}
        for r in listed("metrics"):
            sections[r["split"]][r["metric"]] = r["value"] if r["value"] is not None else 0.0
        issues = listed("issues")
        # The names of the report's sections.
        return {
            "pipeline_status": "success", "dataset": self.dataset, "feature_audit": listed("feature_audit"),
            "psi_table": listed("psi_table"), "vif_table": listed("vif_table"), "telemetry": self.telemetry,
            "issues": issues, "metrics": {**sections, "observability_flags": listed("flags")},
            "recommendations": listed("recommendations"),
            "critical_issues": sum(1 for i in issues if i["severity"] == "critical"),
            "feature_importance": {r["feature"]: r["importance"] for r in listed("feature_importance")},
        }


def failure_report(error: str, telemetry: dict[str, float]) -> dict[str, Any]:
    """The same sections, empty, with the error."""
    # The names of the report's sections.
    return {"pipeline_status": "failure", "error": error, "dataset": {}, "feature_audit": [], "telemetry": telemetry,
            "issues": [], "recommendations": [], "metrics": {}, "psi_table": [], "vif_table": [],
            "feature_importance": {}, "critical_issues": 0}


@contextmanager
def _timed(telemetry: dict[str, float], stage: str):
    start = time.perf_counter()
    try:
        yield
    finally:
        telemetry[f"{stage}_seconds"] = time.perf_counter() - start


def run_all_checks(df: DataFrame, target: str, task: str = "classification", key: str | None = None,
                   exclude: Sequence[str] = (), config: AuditConfig = AuditConfig()) -> dict[str, DataFrame]:
    """Every column check as a table, and ``issues`` as their summary.

    ``key`` names the row identity; with it the multivariate outliers are looked for too.
    """
    skip = [*exclude, *([key] if key else [])]
    out = _checks(df, target, task, skip, key, config)
    out["issues"] = checks.summarise(out, target)
    out["data_types"] = profile.data_types(df)
    out.pop("summary_correlation")
    return out


def _checks(df: DataFrame, target: str, task: str, skip: Sequence[str], key: str | None, config: AuditConfig,
            more: dict[str, Callable[[], DataFrame]] | None = None) -> dict[str, DataFrame]:
    numeric = numeric_columns(df, skip)
    tasks = dict(more or {})
    if key and numeric:
        tasks["multivariate_outliers"] = lambda: multivariate_outliers(df, key, numeric, config.seed)
    return checks.column_checks(df, target, task, skip, config, tasks)


def split_for(df: DataFrame, key: str, target: str, task: str, config: AuditConfig) -> DataFrame:
    """Stratified for a classification target with few classes, by key hash otherwise."""
    if task == "classification" and stratify_rule(df, target, config.stratify_below_classes).first()["n_classes"] \
            < config.stratify_below_classes:
        return split_stratified(df, key, target, config.test_fraction)
    return split_hash(df, key, config.test_fraction)


def audit(df: DataFrame, target: str, task: str, key: str, exclude: Sequence[str] = (),
          config: AuditConfig = AuditConfig(), dev: bool = False, estimator: Estimator | None = None,
          with_model: bool = True) -> AuditResult:
    """Audits a table before and after model training.

    The source is read once and kept as Parquet in the shared folder, then once more with a folder per split; all
    stages scan that, column-pruned, by aggregates.  What else is kept between stages are result tables of a few rows
    per column.  Scaling, imputation, checks and multicollinearity see train rows only.
    """
    task = models.check_task(task)
    telemetry: dict[str, float] = {}
    begin = time.perf_counter()
    result = AuditResult({"target": target, "task_type": task}, telemetry=telemetry)
    skip = [key, *exclude]
    with _timed(telemetry, "data_loading"):
        require_columns(df, [target, key])
        if dev:
            df = dev_sample(df, key, config.dev_rows, config.seed)
        df = stored(df, "audit-source")
        require_rows(df)
        cols = flat_columns(df, skip)
        info = {r["metric"]: r["value"] for r in profile.basic_info(df, cols).collect()}
        result.tables["feature_audit"] = materialise(profile.feature_audit(df, cols))
    with _timed(telemetry, "split"):
        tagged = stored(split_for(df, key, target, task, config), "audit-split", "split")
        train, test = (tagged.filter(col("split") == s).drop("split") for s in ("train", "test"))
    features = [c for c in cols if c != target]
    numeric = [c for c in numeric_columns(df, skip) if c != target]
    with _timed(telemetry, "integrity_checks"):
        found = run_together({
            "overlap": lambda: rows.row_overlap(tagged, features),
            "psi_table": lambda: drift.psi_table(drift.psi(tagged, numeric)),
            "variance_ratio": lambda: drift.variance_ratio(tagged, numeric)})
        first = found["overlap"].first()
        result.dataset.update(rows=info["num_rows"], columns=info["num_columns"], overlap_pct=first["overlap_pct"],
                              overlap_count=first["overlap_count"])
        result.tables.update(psi_table=found["psi_table"], variance_ratio=found["variance_ratio"])
    with _timed(telemetry, "diagnostics"):
        more = {"missingness": lambda: drift.informative_missingness(train, target, cols)}
        if numeric:
            more["vif"] = lambda: drift.vif(train, numeric)
        done = _checks(train, target, task, skip, key, config, more)
        extra = drift.integrity_issues(found["overlap"], found["psi_table"], done.get("vif"), found["variance_ratio"],
                                       done["missingness"])
        issues = materialise(checks.summarise(done, target).unionByName(extra))
        result.tables["issues"] = issues
        if "vif" in done:
            result.tables["vif_table"] = materialise(drift.vif_table(done["vif"]))
    with _timed(telemetry, "recommendations"):
        normal = recommend.issue_normalize(issues)
        recs = recommend.with_issues(recommend.recommendations(normal), normal).orderBy("rank")
        result.tables["recommendations"] = materialise(recs)
    if with_model:
        try:
            _model_stages(result, train, test, target, task, key, exclude, config, dev, estimator)
        except Exception as error:
            # What is finished goes with the error, for a report that still holds the checks.
            error.finished = result
            raise
    telemetry["total_pipeline_seconds"] = time.perf_counter() - begin
    return result


def _model_stages(result: AuditResult, train: DataFrame, test: DataFrame, target: str, task: str, key: str,
                  exclude: Sequence[str], config: AuditConfig, dev: bool, estimator: Estimator | None) -> None:
    skip = [key, *exclude]
    spark = train.sparkSession
    with _timed(result.telemetry, "training"):
        fitted = models.train(train, target, task, skip, estimator, config, dev)
        result.model = fitted
    with _timed(result.telemetry, "evaluation"):
        labelled = test.filter(col(target).isNotNull())
        scores = [(split, r["metric"], float(r["value"]) if r["value"] is not None else None)
                  for split, part in (("train", train.filter(col(target).isNotNull())), ("holdout", labelled))
                  for r in fitted.evaluate(part).collect()]
        cv = models.cross_validate(train, target, task, key, exclude, config.cv_folds, estimator, config, dev).first()
        scores += [("cv", f"cv_mean_{cv['metric']}", cv["cv_mean"]), ("cv", f"cv_std_{cv['metric']}", cv["cv_std"]),
                   ("cv", "cv_folds", float(cv["cv_folds"]))]
        result.tables["metrics"] = spark.createDataFrame(scores, "split string, metric string, value double")
        main = "f1" if task == "classification" else "r2"
        at = {(s, m): v for s, m, v in scores}
        # for regression the folds are scored by RMSE, which no flag compares with R2
        same = task == "classification"
        run = spark.createDataFrame([("audit", main, at[("train", main)] or 0.0, at[("holdout", main)] or 0.0,
                                      cv["cv_mean"] if same else 0.0, cv["cv_std"] if same else 0.0)],
                                    "run_id string, metric_name string, train_score double, test_score double, "
                                    "cv_mean double, cv_std double")
        result.tables["flags"] = materialise(observe.runner_flags(run).drop("run_id"))
    with _timed(result.telemetry, "importance"):
        result.tables["feature_importance"] = models.feature_importance(fitted, train, key).orderBy("rank")


def with_row_key(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds a row key to a table without one; written to the shared folder once, so that it stays the same
    when a task runs again."""
    return checkpointed(df.withColumn(name, F.monotonically_increasing_id()))


def run_audit(spark: SparkSession, source: DataFrame | str, target: str, task: str, key: str | None = None,
              report_path: str | None = None, **options: Any) -> dict[str, Any]:
    """Audit of a CSV path or a table as one report; any error becomes a failure report.

    Where only the model stages fail, the failure report holds the finished checks.
    """
    telemetry: dict[str, float] = {}
    try:
        df = load_csv(spark, source, target) if isinstance(source, str) else source
        if key is None:
            key = "row_id"
            df = with_row_key(df, key)
        result = audit(df, target, task, key, **options)
        telemetry = result.telemetry
        report = result.report()
        if report_path is not None:
            write_report(spark, report, report_path)
        return report
    except Exception as error:  # the job boundary: callers read pipeline_status
        finished = getattr(error, "finished", None)
        if finished is None:
            return failure_report(str(error), telemetry)
        return {**finished.report(), "pipeline_status": "failure", "error": str(error)}
