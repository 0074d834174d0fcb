"""Reading model scores: generalisation flags, readiness, deployability.

Every operator takes a table with one row (or one row per issue, flag or metric) per ``run_id``, so one
job scores a whole fleet of models; a single audit is the one-run case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import EPSILON, ERROR_METRICS, PRIMARY_METRICS
from .drift import impact_severity
from .recommend import severity_normalize

# Label, severity, meaning and remedies of each generalisation flag.
FLAGS = {
    "high_overfit_risk": ("High Overfit Risk", "high",
                          "Model appears to memorize training distribution and may fail on unseen data.",
                          ["Increase regularization", "Reduce model complexity", "Perform feature selection",
                           "Use early stopping"]),
    "mild_overfit": ("Mild Overfit", "medium", "Moderate memorization behavior detected.",
                     ["Monitor production behavior", "Track retraining cadence"]),
    "high_fold_variance": ("High Fold Variance", "high",
                           "Model performance varies heavily across validation folds.",
                           ["Investigate feature instability", "Validate stratification logic",
                            "Consider ensemble methods"]),
    "generalization_decay": ("Generalization Decay", "high",
                             "Potential covariate shift or validation leakage detected.",
                             ["Inspect train/test split", "Verify preprocessing isolation", "Analyze PSI drift"]),
}


def _gap() -> Column:
    return F.col("train_score") - F.col("test_score")


def _stability() -> Column:
    ratio = F.col("cv_std") / (F.col("cv_mean") + F.lit(EPSILON))
    return F.when(F.col("cv_mean") <= 0, F.lit(float("inf"))).otherwise(ratio)


def _decay() -> Column:
    return F.col("cv_mean") - F.col("test_score")


def _rich_conditions() -> dict[str, Column]:
    return {
        "high_overfit_risk": _gap() > 0.15,
        "mild_overfit": (_gap() > 0.08) & ~(_gap() > 0.15),
        "high_fold_variance": _stability() > 0.10,
        "generalization_decay": _decay() > 0.10,
    }


def generalization_flags(runs: DataFrame) -> DataFrame:
    """(run_id, flag_id, flag, severity, detail, interpretation, remediation), one row per raised flag.

    ``runs`` has run_id, metric_name, train_score, test_score, cv_mean and cv_std.
    """
    name, fmt = F.upper("metric_name"), F.format_string
    details = {
        "high_overfit_risk": fmt("Train %s (%.3f) exceeds test (%.3f) by %.3f", name, F.col("train_score"),
                                 F.col("test_score"), _gap()),
        "mild_overfit": fmt("Train/test gap: %.3f", _gap()),
        "high_fold_variance": fmt("CV std=%.3f (relative std: %.3f)", F.col("cv_std"), _stability()),
        "generalization_decay": fmt("CV mean (%.3f) exceeds holdout (%.3f) by %.3f", F.col("cv_mean"),
                                    F.col("test_score"), _decay()),
    }
    made = []
    for flag_id, cond in _rich_conditions().items():
        label, severity, meaning, remedies = FLAGS[flag_id]
        made.append(F.when(cond, F.struct(
            F.lit(flag_id).alias("flag_id"), F.lit(label).alias("flag"), F.lit(severity).alias("severity"),
            details[flag_id].alias("detail"), F.lit(meaning).alias("interpretation"),
            F.array(*[F.lit(r) for r in remedies]).alias("remediation"))))
    return runs.select("run_id", F.explode(F.array_compact(F.array(*made))).alias("f")).select("run_id", "f.*")


def runner_flags(runs: DataFrame) -> DataFrame:
    """(run_id, flag, detail): the absolute-threshold flags stored with an audit report."""
    name, fmt = F.col("metric_name"), F.format_string
    made = [
        F.when(_gap() > 0.15, F.struct(F.lit("High Overfit Risk").alias("flag"), fmt(
            "Train %s (%.3f) significantly exceeds holdout (%.3f).", name, F.col("train_score"),
            F.col("test_score")).alias("detail"))),
        F.when(F.col("cv_std") > 0.08, F.struct(F.lit("Fold Instability").alias("flag"), fmt(
            "Cross-validation variance is high (std: %.3f).", F.col("cv_std")).alias("detail"))),
        F.when(_decay() > 0.10, F.struct(F.lit("Generalization Decay").alias("flag"), fmt(
            "CV mean (%.3f) exceeds holdout (%.3f).", F.col("cv_mean"), F.col("test_score")).alias("detail"))),
    ]
    return runs.select("run_id", F.explode(F.array_compact(F.array(*made))).alias("f")).select("run_id", "f.*")


def deployment_readiness(runs: DataFrame) -> DataFrame:
    """(run_id, readiness_score, can_deploy, recommendation, blocking_issues, warnings, approval_rationale).

    ``runs`` adds to the score columns: performance, n_critical_vif, n_high_vif, n_severe_drift,
    n_critical and n_high (counts of issues by severity).
    """
    conditions = _rich_conditions()
    high_risk = conditions["high_overfit_risk"] | conditions["high_fold_variance"] | conditions["generalization_decay"]
    mild = conditions["mild_overfit"]
    drift = impact_severity(F.col("n_severe_drift"))
    perf = F.col("performance")
    # (blocks?, condition, points lost, message); the first of a group that holds applies
    groups = [
        [(True, high_risk, 25, "High generalization risk detected."),
         (False, mild, 10, "Moderate generalization concerns.")],
        [(True, F.col("n_critical_vif") > 0, 30, "Critical multicollinearity detected."),
         (False, F.col("n_high_vif") > 0, 15, "High multicollinearity detected.")],
        [(True, drift == "critical", 40, "Critical feature drift detected."),
         (False, drift == "high", 20, "Significant feature drift detected.")],
        [(True, perf < 0.65, 30, "Performance below acceptable threshold."),
         (False, perf < 0.75, 15, "Model performance is modest.")],
    ]
    lost, blocks, warns = F.lit(0), [], []
    for (_, first, a, block), (_, second, b, warn) in groups:
        lost = lost + F.when(first, a).when(second, b).otherwise(0)
        blocks.append(F.when(first, F.lit(block)))
        warns.append(F.when(second & ~first, F.lit(warn)))
    lost = (lost + F.least(F.lit(30), F.col("n_critical") * 10)
            + F.greatest(F.lit(0), (F.col("n_high") - 3) * 5))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - lost))
    scored = runs.select("run_id", F.round(score, 2).alias("readiness_score"),
                         F.array_compact(F.array(*blocks)).alias("blocking_issues"),
                         F.array_compact(F.array(*warns)).alias("warnings"))
    s, blocked, warned = F.col("readiness_score"), F.size("blocking_issues") > 0, F.size("warnings") > 0
    rationale = (F.when(blocked, F.concat(F.lit("DEPLOYMENT BLOCKED: "), F.concat_ws(", ", "blocking_issues")))
                 .when(warned, "Conditional deployment approved. Enhanced monitoring recommended.")
                 .when(s >= 85, "Model passed deployment readiness audit.")
                 .otherwise("Model satisfies minimum deployment criteria."))
    return scored.select("run_id", "readiness_score", ((s >= 75) & ~blocked).alias("can_deploy"),
                         F.when(s >= 85, "green").when(s >= 70, "yellow").otherwise("red").alias("recommendation"),
                         "blocking_issues", "warnings", rationale.alias("approval_rationale"))


def _metric_priority(metric: Column) -> Column:
    table = F.create_map(*[x for i, m in enumerate(PRIMARY_METRICS) for x in (F.lit(m), F.lit(i))])
    return F.coalesce(F.try_element_at(table, metric), F.lit(len(PRIMARY_METRICS)))


def primary_metric(metrics: DataFrame) -> DataFrame:
    """(run_id, metric, value): the preferred holdout metric per run, by name among unknown ones."""
    pick = F.min_by(F.struct("metric", "value"), F.struct(_metric_priority(F.col("metric")), F.col("metric")))
    return metrics.groupBy("run_id").agg(pick.alias("m")).select("run_id", "m.metric", "m.value")


# Status, message and action per deployability band (lower bound first).
STATUS_BANDS = (
    (85, "DEPLOYMENT READY", "Pipeline passed reliability audit.", "Deploy with standard monitoring."),
    (70, "CONDITIONAL DEPLOYMENT", "Pipeline has moderate concerns.", "Resolve high-severity issues."),
    (50, "DEPLOYMENT BLOCKED", "Critical reliability gaps detected.", "Investigate critical issues."),
    (None, "SEVERE ISSUES DETECTED", "Pipeline exhibits severe failures.", "Rebuild validation workflow."),
)


def status_band(score: Column) -> Column:
    """Struct of status, message and action."""
    def band(row: tuple) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(("status", "message", "action"), row[1:])])

    out = None
    for row in STATUS_BANDS[:-1]:
        out = F.when(score >= row[0], band(row)) if out is None else out.when(score >= row[0], band(row))
    return out.otherwise(band(STATUS_BANDS[-1]))


def deployability_score(issues: DataFrame, flags: DataFrame, metrics: DataFrame) -> DataFrame:
    """(run_id, integrity, stability, feature_quality, performance, overall_score, status, message, action).

    ``issues`` has run_id, type, severity; ``flags`` run_id, flag; ``metrics`` run_id, metric, value of
    the holdout.  The three tables are stacked as counters and grouped once, so a run with most of the
    issues is combined before the shuffle and nothing is joined.
    """
    sev = severity_normalize(F.col("severity"), danger=False)
    kind, flag = F.col("type"), F.lower("flag")
    critical = sev == "critical"

    def one(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    counters = {
        "leak": one(critical & kind.contains("leakage")), "overlap": one(critical & kind.contains("overlap")),
        "drift": one(critical & kind.contains("drift")), "high": one(sev == "high"),
        "vif": one(kind == "multicollinearity"), "card": one(kind == "high_cardinality"),
    }
    marks = {"overfit": one(flag.contains("overfit")), "fold": one(flag.contains("fold")),
             "decay": one(flag.contains("decay"))}
    none = {n: F.lit(0) for n in [*counters, *marks]}
    no_metric = [F.lit(None).cast("int").alias("error_style"), F.lit(None).cast("double").alias("value")]
    # one row per run, so that the counters below stay numbers in a hash aggregate
    chosen = primary_metric(metrics)

    def rows(df: DataFrame, made: dict[str, Column], extra: list[Column]) -> DataFrame:
        return df.select("run_id", *[(made.get(n) if n in made else z).alias(n) for n, z in none.items()], *extra)

    stacked = (rows(issues, counters, no_metric).unionByName(rows(flags, marks, no_metric))
               .unionByName(rows(chosen, {}, [F.col("metric").isin(*ERROR_METRICS).cast("int").alias("error_style"),
                                              F.col("value").cast("double").alias("value")])))
    per = stacked.groupBy("run_id").agg(*[F.sum(n).alias(n) for n in none],
                                        F.max("error_style").alias("error_style"), F.max("value").alias("value"))

    def minus(*rules: tuple[Column, int]) -> Column:
        out = F.lit(100)
        for cond, points in rules:
            out = out - F.when(cond, points).otherwise(0)
        return F.greatest(out, F.lit(0)).cast("double")

    c = F.col
    v = F.coalesce(c("value"), F.lit(0.0))
    perf = F.when(c("error_style") == 1, F.when(v > 1.0, 50.0).when(v > 0.5, 75.0).otherwise(95.0)).otherwise(
        F.when(v < 0.65, 50.0).when(v < 0.75, 75.0).otherwise(95.0))
    parts = per.select(
        "run_id",
        minus((c("leak") > 0, 40), (c("overlap") > 0, 35), (c("drift") > 2, 25), (c("high") > 5, 15)).alias("integrity"),
        minus((c("overfit") > 0, 20), (c("fold") > 0, 15), (c("decay") > 0, 25)).alias("stability"),
        minus((c("vif") > 3, 20), ((c("vif") > 0) & (c("vif") <= 3), 10), (c("card") > 2, 15)).alias("feature_quality"),
        perf.alias("performance"))
    score = (c("integrity") * 0.35 + c("stability") * 0.35 + c("feature_quality") * 0.20 + c("performance") * 0.10)
    return (parts.withColumn("__s", score).withColumn("__b", status_band(c("__s")))
            .select("run_id", "integrity", "stability", "feature_quality", "performance",
                    F.bround("__s", 1).alias("overall_score"), "__b.status", "__b.message", "__b.action"))


def metric_gap(metrics: DataFrame) -> DataFrame:
    """(run_id, metric, train, holdout, gap, status) for every holdout metric; OK below 0.1.

    ``metrics`` has run_id, split, metric, value; a metric missing in train counts as 0.
    """
    per = metrics.groupBy("run_id", "metric").agg(
        F.coalesce(F.max(F.when(F.col("split") == "train", F.col("value"))), F.lit(0.0)).alias("train"),
        F.max(F.when(F.col("split") == "holdout", F.col("value"))).alias("holdout"))
    gap = F.abs(F.col("train") - F.col("holdout"))
    return per.filter("holdout is not null").select(
        "run_id", "metric", "train", "holdout", gap.alias("gap"),
        F.when(gap < 0.1, "OK").otherwise("WARNING").alias("status"))


def safe_float(text: Column, default: float = 0.0) -> Column:
    """A number from text that may be padded, missing or no number."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default))


def report_normalize(reports: DataFrame, text: str = "report") -> DataFrame:
    """Stored JSON reports as flat columns; missing or wrongly typed sections are empty, never an error."""
    j = F.col(text)

    def at(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object(j, p) for p in paths])

    def length(*paths: str) -> Column:
        body = at(*paths)
        return F.when(body.startswith("["), F.coalesce(F.json_array_length(body), F.lit(0))).otherwise(0).cast("bigint")

    def keys(path: str) -> Column:
        body = at(path)
        return F.when(body.startswith("{"), F.coalesce(F.size(F.json_object_keys(body)), F.lit(0))).otherwise(0).cast("bigint")

    others = [c for c in reports.columns if c != text]
    return reports.select(
        *others, F.coalesce(at("$.pipeline_status"), F.lit("unknown")).alias("pipeline_status"),
        safe_float(at("$.dataset.rows")).alias("rows"), safe_float(at("$.dataset.overlap_pct")).alias("overlap_pct"),
        safe_float(at("$.metrics.metrics.holdout.f1", "$.metrics.holdout.f1")).alias("holdout_f1"),
        length("$.metrics.metrics.observability_flags", "$.metrics.observability_flags").alias("n_flags"),
        length("$.issues").alias("n_issues"), length("$.recommendations").alias("n_recommendations"),
        length("$.psi_table").alias("n_psi"), length("$.vif_table").alias("n_vif"),
        length("$.feature_audit").alias("n_audited"), keys("$.feature_importance").alias("n_importances"),
        keys("$.telemetry").alias("n_timings"))
