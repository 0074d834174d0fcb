"""Every flat Spark type passes the checks."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from conftest import by
from tidemark.operators import charts, checks, drift, prep, profile


@pytest.fixture(scope="module")
def typed(spark):
    day = datetime.date(2024, 1, 1)
    data = [(decimal.Decimal(i) / 4, day + datetime.timedelta(days=i % 3), datetime.datetime(2024, 1, 1, i % 24), i % 2 == 0,
             b"x" if i else b"y", float(i), i % 5, None) for i in range(200)]
    return spark.createDataFrame(data, "dec decimal(12,2), day date, at timestamp, flag boolean, raw binary, f float, s short, nothing double")


def test_checks(typed):
    assert {r["feature"] for r in checks.constant_features(typed).collect()} == {"nothing"}
    assert set(by(checks.near_constant(typed))) == {"raw"}
    audit = by(profile.feature_audit(typed))
    assert (audit["dec"]["unique_values"], audit["day"]["unique_values"], audit["raw"]["unique_values"]) == (200, 3, 2)
    found = {(r["type"], r["column"]) for r in checks.issue_summary(typed, "flag").collect()}
    assert ("high_correlation", "dec ↔ f") in found and ("missing_values", "nothing") in found


def test_preparation_and_drift(typed):
    out = prep.impute(typed.withColumn("day", F.when(F.col("flag"), F.col("day"))))
    assert dict(out.dtypes)["day"] == "date" and out.filter("day is null").count() == 0
    split = typed.withColumn("split", F.when(F.col("s") == 0, "test").otherwise("train"))
    got = by(drift.psi(split))
    assert set(got) == {"dec", "f", "s", "nothing"} and got["nothing"]["psi"] == 0.0


def test_drift_chart_needs_its_columns(spark):
    rows = spark.createDataFrame([("a", 0.6, "HIGH", 1)], "feature string, psi_score double, drift_severity string, rank int")
    assert charts.drift_bars(rows).columns == ["feature", "psi_score", "drift_severity"]
    assert charts.drift_bars(rows.drop("psi_score")) is None
    top = charts.top_importance(spark.range(30).select(F.col("id").cast("string").alias("feature"),
                                                       F.col("id").cast("double").alias("importance")))
    assert [r["feature"] for r in top.collect()][:2] == ["29", "28"] and top.count() == 15
