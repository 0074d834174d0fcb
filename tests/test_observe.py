import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import observe, recommend

RUN = ("run_id string, metric_name string, train_score double, test_score double, cv_mean double, cv_std double, "
       "performance double, n_critical_vif int, n_high_vif int, n_severe_drift int, n_critical int, n_high int")


def runs(spark, *data):
    return spark.createDataFrame(list(data), RUN)


def test_flags_at_their_limits(spark):
    df = runs(spark, ("over", "f1", 0.96, 0.80, 0.8, 0.0, .9, 0, 0, 0, 0, 0), ("mild", "f1", 0.90, 0.80, 0.8, 0.0, .9, 0, 0, 0, 0, 0),
              ("folds", "f1", 0.8, 0.8, 0.8, 0.09, .9, 0, 0, 0, 0, 0), ("decay", "f1", 0.8, 0.6, 0.75, 0.0, .9, 0, 0, 0, 0, 0),
              ("zero", "f1", 0.1, 0.1, 0.0, 0.0, .9, 0, 0, 0, 0, 0), ("fine", "f1", 0.85, 0.80, 0.8, 0.02, .9, 0, 0, 0, 0, 0))
    got = {(r["run_id"], r["flag_id"]) for r in observe.generalization_flags(df).collect()}
    assert got == {("over", "high_overfit_risk"), ("mild", "mild_overfit"), ("folds", "high_fold_variance"),
                   ("decay", "high_overfit_risk"), ("decay", "generalization_decay"), ("zero", "high_fold_variance")}
    detail = {r["run_id"]: r["detail"] for r in observe.generalization_flags(df).collect()}
    assert detail["mild"] == "Train/test gap: 0.100"
    stored = {(r["run_id"], r["flag"]) for r in observe.runner_flags(df).collect()}
    assert ("folds", "Fold Instability") in stored and ("zero", "Fold Instability") not in stored


def test_readiness(spark):
    df = runs(spark, ("good", "f1", 0.85, 0.82, 0.82, 0.01, 0.82, 0, 0, 0, 0, 3), ("weak", "f1", 0.75, 0.70, 0.7, 0.01, 0.70, 0, 1, 0, 0, 0),
              ("bad", "f1", 0.99, 0.50, 0.7, 0.2, 0.50, 2, 0, 6, 9, 9), ("many", "f1", 0.8, 0.8, 0.8, 0.0, 0.8, 0, 0, 3, 0, 5))
    got = {r["run_id"]: r for r in observe.deployment_readiness(df).collect()}
    assert (got["good"]["readiness_score"], got["good"]["can_deploy"], got["good"]["recommendation"]) == (100.0, True, "green")
    assert got["good"]["approval_rationale"] == "Model passed deployment readiness audit."
    assert (got["weak"]["readiness_score"], got["weak"]["recommendation"]) == (70.0, "yellow")
    assert list(got["weak"]["warnings"]) == ["High multicollinearity detected.", "Model performance is modest."]
    assert got["bad"]["readiness_score"] == 0.0 and len(got["bad"]["blocking_issues"]) == 4
    assert got["many"]["readiness_score"] == 70.0 and not got["many"]["can_deploy"]


def test_deployability(spark):
    issues = spark.createDataFrame(
        [("a", "target_leakage", "critical"), ("a", "split_overlap", "SEVERE"), ("a", "x", "danger")]
        + [("a", "multicollinearity", "high")] * 4 + [("b", "high_cardinality", "high")] * 3, "run_id string, type string, severity string")
    flags = spark.createDataFrame([("a", "High Overfit Risk"), ("b", "Fold Instability")], "run_id string, flag string")
    metrics = spark.createDataFrame([("a", "f1", 0.6), ("a", "rmse", 9.0), ("b", "rmse", 0.7), ("c", "f1", 0.9)],
                                    "run_id string, metric string, value double")
    got = {r["run_id"]: r for r in observe.deployability_score(issues, flags, metrics).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["integrity"], a["stability"], a["feature_quality"], a["performance"]) == (25.0, 80.0, 80.0, 50.0)
    assert a["overall_score"] == pytest.approx(57.8, abs=0.05) and a["status"] == "DEPLOYMENT BLOCKED"
    assert (b["stability"], b["feature_quality"], b["performance"]) == (85.0, 85.0, 75.0)
    assert c["overall_score"] == 99.5 and c["status"] == "DEPLOYMENT READY"


def test_primary_metric_and_gap(spark):
    df = spark.createDataFrame([("a", "train", "f1", 0.9), ("a", "holdout", "f1", 0.75), ("a", "holdout", "accuracy", 0.8),
                                ("b", "holdout", "zz", 1.0), ("b", "holdout", "mm", 2.0)],
                               "run_id string, split string, metric string, value double")
    assert sorted(rows(observe.primary_metric(df.filter("split = 'holdout'")))) == [("a", "f1", 0.75), ("b", "mm", 2.0)]
    gap = {(r["run_id"], r["metric"]): r for r in observe.metric_gap(df).collect()}
    assert gap[("a", "f1")]["status"] == "WARNING" and gap[("a", "accuracy")]["train"] == 0.0


def test_stored_reports_of_any_shape(spark):
    texts = ['{"issues": [1,2], "dataset": {"rows": " 7 "}, "metrics": {"holdout": {"f1": "0.5"}}}',
             '{"issues": {"a": 1}, "dataset": null, "metrics": {"metrics": {"holdout": {"f1": 0.25}}}}', '{}', 'no json', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, report string")
    got = {r["id"]: r for r in observe.report_normalize(df).collect()}
    assert (got[0]["n_issues"], got[0]["rows"], got[0]["holdout_f1"]) == (2, 7.0, 0.5)
    assert (got[1]["n_issues"], got[1]["rows"], got[1]["holdout_f1"]) == (0, 0.0, 0.25)
    assert all(got[i]["n_issues"] == 0 and got[i]["pipeline_status"] == "unknown" for i in (2, 3, 4))


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(
        [(1, " Feature Drift ", "b", "HIGH", None), (2, "feature-drift", "a", "warn", "d"), (3, "Feature/Drift", None, "danger", "d"),
         (4, None, "x", None, "d"), (5, "unseen type", "y", "bogus", "d"), (6, "missing_values", "f", "low", "d")],
        "id long, type string, column string, severity string, description string")


def test_normalise_and_recommend(messy):
    normal = recommend.issue_normalize(messy)
    got = {r["id"]: r for r in normal.collect()}
    assert [got[i]["type"] for i in (1, 2, 3, 4)] == ["feature_drift"] * 3 + ["unknown_issue"]
    assert [got[i]["severity"] for i in range(1, 7)] == ["high", "medium", "critical", "medium", "medium", "low"]
    assert got[3]["column"] == "unknown" and got[1]["description"] == "No description provided."
    recs = recommend.recommendations(normal).orderBy("rank").collect()
    assert [r["recommendation_id"] for r in recs] == ["rec_feature_drift", "rec_unknown_issue", "rec_unseen_type", "rec_missing_values"]
    assert list(recs[0]["affected_columns"]) == ["a", "b", "unknown"] and recs[0]["issue_count"] == 3
    assert recs[0]["recommendation"].startswith("Immediate attention recommended. Detected train/test distribution drift.")
    assert recs[0]["recommendation"].endswith("for: a, b, unknown.")
    full = recommend.with_issues(recommend.recommendations(normal), normal)
    assert {r["recommendation_id"]: len(r["issues"]) for r in full.collect()}["rec_feature_drift"] == 3
    assert recommend.critical_issues(normal).first()[0] == 1


def test_filter_reads_danger_as_unknown(messy):
    assert recommend.severity_filter(messy, "All").count() == 6
    assert recommend.severity_filter(messy, "Critical").count() == 0
    assert recommend.severity_filter(messy, "Medium").count() == 4


def test_numbering_inside_type(messy):
    got = {r["id"]: r["number"] for r in recommend.issues_by_type(recommend.issue_normalize(messy), "id").collect()}
    assert (got[1], got[2], got[3], got[4]) == (1, 2, 3, 1)
