import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import by, rows
from tidemark.operators import charts, checks, profile, rows as whole_rows


def test_missing_and_constant(orchard_df):
    assert by(checks.missing_values(orchard_df))["height"]["missing_pct"] == pytest.approx(12.5)
    assert rows(checks.constant_features(orchard_df), "feature") == [("site",)]
    nothing = orchard_df.select(F.lit(None).cast("string").alias("void"), F.lit(float("nan")).alias("nan"))
    assert by(checks.constant_features(nothing)) == {
        c: {"feature": c, "all_missing": True} for c in ("void", "nan")}


def test_near_constant_counts_present_cells_only(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, F.when(F.col("id") == 0, "rare").otherwise("common")).alias("mostly"),
        F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("ninety_eight"), F.lit("same").alias("all_same"),
        (F.col("id") < 1990).alias("flag"))
    got = by(checks.near_constant(df))
    assert set(got) == {"mostly", "flag"}
    assert got["mostly"]["top_share"] == pytest.approx(0.999) and got["flag"]["top_share"] == pytest.approx(0.995)


def test_skew_matches_pandas(orchard_pdf, orchard_df):
    want = {c: orchard_pdf[c].skew() for c in orchard_pdf if abs(orchard_pdf[c].skew()) > 2 and c != "blight"}
    got = by(checks.skewness(orchard_df, "blight"))
    assert set(got) == set(want) and all(got[c]["skew"] == pytest.approx(want[c]) for c in want)


def test_duplicates_narrow_and_wide(spark, orchard_df):
    assert whole_rows.duplicates(orchard_df).first()["total_duplicates"] == 3
    narrow = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a")], "a int, b string")
    assert rows(whole_rows.duplicates(narrow)) == [(2, 50.0, True)]
    assert rows(whole_rows.duplicates(narrow.limit(0))) == [(0, 0.0, False)]


def test_imbalance(spark, orchard_df):
    df = spark.range(100).select((F.col("id") < 10).cast("int").alias("target"))
    assert rows(checks.class_imbalance(df, "target")) == [(10.0, True, 2)]
    assert checks.class_imbalance(df, "target", "regression").count() == 0
    assert checks.class_imbalance(df, "absent").count() == 0


def test_correlation_name_rule_and_leak(orchard_pdf, orchard_df):
    got = rows(checks.high_correlation(orchard_df, "blight"), "feature_a", "feature_b", "rule")
    assert sorted(got) == [("weight", "weight_correlated", "name_suffix"),
                           ("weight", "weight_correlated", "pearson")]
    assert rows(checks.target_leakage(orchard_df, "blight"), "feature") == [("grade",)]
    # without a target a column of that name is left out
    named = orchard_df.withColumn("target", F.col("age") * 2)
    assert "target" not in {x for r in checks.high_correlation(named).collect() for x in r[:2]}


def test_iqr_outliers_match_numpy(orchard_pdf, orchard_df):
    clean = orchard_pdf.dropna()
    want = {}
    for c in clean.columns.drop("blight"):
        q1, q3 = np.quantile(clean[c], [0.25, 0.75])
        n = int(((clean[c] < q1 - 1.5 * (q3 - q1)) | (clean[c] > q3 + 1.5 * (q3 - q1))).sum())
        if clean[c].nunique() > 2 and q3 > q1 and n:
            want[c] = n
    assert {f: r["outliers"] for f, r in by(checks.iqr_outliers(orchard_df, "blight")).items()} == want


def test_contamination_bounds(spark):
    def share(n):
        return rows(checks.outlier_contamination(spark.range(n)), "contamination")
    assert share(49) == [] and share(1000) == [(0.05,)] and share(4000) == [(0.025,)] and share(20000) == [(0.01,)]


def test_summary_equals_single_checks(orchard_df):
    got = {(r["type"], r["column"]): r for r in checks.issue_summary(orchard_df, "blight").collect()}
    assert got[("missing_values", "height")]["severity"] == "medium"
    assert got[("missing_values", "height")]["description"] == "12.5% missing values detected."
    assert got[("constant_feature", "site")]["severity"] == "high"
    assert got[("target_leakage", "grade")]["severity"] == "critical"
    assert got[("duplicate_rows", "dataset_wide")]["severity"] == "medium"
    assert ("high_correlation", "weight ↔ weight_correlated") in got
    assert len([1 for t, _ in got if t == "outliers"]) <= 5


def test_summary_lists_target_pairs_unless_named_target(spark):
    df = spark.range(200).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    kinds = {r["type"] for r in checks.issue_summary(df, "y").collect()}
    assert {"high_correlation", "target_leakage"} <= kinds
    same = df.withColumnRenamed("y", "target")
    assert "high_correlation" not in {r["type"] for r in checks.issue_summary(same, "target").collect()}


def test_text_only_table(spark):
    df = spark.range(300).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("s"), F.lit("a").alias("y"))
    got = {(r["type"], r["column"]) for r in checks.issue_summary(df, "y").collect()}
    assert ("high_cardinality", "s") in got and ("constant_feature", "y") in got


def test_profile_tables(orchard_df):
    audit = by(profile.feature_audit(orchard_df))
    assert audit["height"]["position"] == 1 and audit["height"]["missing_pct"] == 12.5
    assert audit["blight"]["unique_values"] == 2
    info = {r["metric"]: r["value"] for r in profile.basic_info(orchard_df).collect()}
    assert info == {"num_rows": 240, "num_columns": 8, "missing_cells": 30, "duplicate_rows": 3}


def test_nested_columns_are_unsupported(spark):
    df = spark.range(3).select("id", F.array("id").alias("list"))
    assert by(profile.data_types(df))["list"]["kind"] == "unsupported"
    assert {r["feature"] for r in profile.feature_audit(df).collect()} == {"id"}


def test_correlation_matrix_keeps_widest_columns(spark):
    df = spark.range(50).select(*[(F.sin(F.col("id") * (k + 1)) * (k + 1)).alias(f"c{k}") for k in range(23)])
    got = charts.correlation_matrix(df)
    names = {r["feature_a"] for r in got.collect()}
    assert names == {f"c{k}" for k in range(3, 23)} and got.count() == 400
    assert charts.correlation_matrix(df.select("c0")).count() == 0


def test_row_overlap_counts_multiplicity_and_nulls(spark):
    data = [("train", 1, None), ("train", 2, "b"), ("test", 1, None), ("test", 1, None), ("test", 3, "c")]
    df = spark.createDataFrame(data, "split string, a int, b string")
    assert rows(whole_rows.row_overlap(df, ["a", "b"])) == [(2, 3, pytest.approx(200 / 3))]
    wide = df.select("*", *[F.lit(k).alias(f"k{k}") for k in range(5)])
    assert whole_rows.row_overlap(wide, ["a", "b", *[f"k{k}" for k in range(5)]]).first()["overlap_count"] == 2
    risk = whole_rows.leakage_risk(whole_rows.row_overlap(df, ["a", "b"])).first()
    assert risk["severity"] == "critical" and risk["is_high_leakage_risk"]
