"""Tables without complete rows, with infinite values, with very many columns, and files that are hard to read."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import load_csv
from tidemark.operators import checks, drift, models, rows as checks_rows
from tidemark.operators.split import stratified_folds
from tidemark.sources import scratch

INF = float("inf")


def frame(spark, width, rows):
    schema = ", ".join(f"c{i} double" for i in range(width))
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("width", [3, 30])
def test_no_complete_row_gives_no_outliers_at_any_width(spark, width):
    holed = frame(spark, width, [tuple(None if i == r % width else float(r) for i in range(width)) for r in range(60)])
    empty = frame(spark, width, [tuple([None] * width)]).filter("c0 is not null")
    for df in (holed, empty):
        assert checks.iqr_outliers(df).count() == 0
        assert isinstance(checks.issue_summary(df, "c0").count(), int)
    assert drift.vif(empty).count() == 0 and drift.vif(holed).count() == width
    assert checks.high_correlation(empty).count() == 0


def test_infinite_values_are_never_over_a_limit(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "y": rng.normal(size=200), "split": ["train"] * 150 + ["test"] * 50})
    pdf.loc[3, "a"], pdf.loc[160, "a"] = INF, -INF
    df = spark.createDataFrame(pdf)
    assert checks.skewness(df).count() == 0
    assert checks.target_leakage(df, "y").count() == 0
    assert checks.high_correlation(df).count() == 0
    assert {r["feature"]: r["psi"] for r in drift.psi(df, ["a"]).collect()} == {"a": 0.0}
    assert drift.variance_ratio(df, ["a"]).filter("ratio is null or isnan(ratio)").isEmpty()
    assert checks.issue_summary(df, "y").filter("type in ('high_skewness', 'target_leakage')").isEmpty()


def test_vif_of_more_than_a_hundred_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 110))
    x[:, 109] = x[:, 0] + 0.1 * x[:, 109]
    found = {r["feature"]: r["vif"] for r in drift.vif(spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(110)]))).collect()}
    assert len(found) == 110
    rest = x[:, :109]
    left = x[:, 109] - rest @ np.linalg.lstsq(rest, x[:, 109], rcond=None)[0]
    assert found["c109"] == pytest.approx((x[:, 109] ** 2).sum() / (left ** 2).sum(), rel=1e-3)


def test_a_forest_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": range(600), "a": rng.normal(size=600), "b": rng.normal(size=600)})
    pdf["y"] = (pdf.a + 0.3 * pdf.b + 0.5 * rng.normal(size=600) > 0).astype(int)
    df = spark.createDataFrame(pdf)
    found = [sorted(tuple(r) for r in models.feature_importance(models.train(df.repartition(n), "y", "classification", ["k"], dev=True)).collect())
             for n in (1, 7)]
    assert found[0] == found[1]


def test_permutation_does_not_depend_on_the_batches(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": range(500), "a": rng.normal(size=500), "b": rng.normal(size=500)})
    pdf["y"] = (pdf.a > 0).astype(int)
    df = spark.createDataFrame(pdf)
    fitted = models.train(df, "y", "classification", ["k"], dev=True)
    found = []
    for size in ("10000", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(tuple(r) for r in models.permutation_importance(fitted, df.repartition(int(size) % 7 + 1), "k").collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and found[0][0][2] > 0.2


def test_stratified_folds_share_out_rare_classes(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 7, "rare").when(F.col("id") < 900, "common").alias("y"))
    sizes = {(r["y"], r["fold"]): r["count"] for r in stratified_folds(df, "id", "y", 5).groupBy("y", "fold").count().collect()}
    for label, total in (("rare", 7), ("common", 893), (None, 100)):
        per = [sizes.get((label, k), 0) for k in range(5)]
        assert sum(per) == total and max(per) - min(per) <= 1


def test_rows_are_combined_before_they_are_shuffled(spark):
    hot = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("a"), F.lit(None).cast("int").alias("b"),
                                   F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    swapped = hot.select(F.col("b").alias("a"), F.col("a").cast("int").alias("b"), "split")
    both = hot.select(F.col("a").cast("int").alias("a"), "b", "split").union(swapped)
    assert checks_rows.duplicates(both, ["a", "b"]).first()["total_duplicates"] == 2 * 1499
    assert checks_rows.row_overlap(both, ["a", "b"]).first()["overlap_count"] == 2 * 500
    plan = checks_rows.duplicates(hot, ["a", "b"])._jdf.queryExecution().sparkPlan().toString()
    assert "partial_count" in plan and "Join" not in plan


# --- files ------------------------------------------------------------------------------------------

def written(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_quoted_cells(spark, tmp_path):
    path = written(tmp_path, a='id,note,target\n1,"He said ""hi"", then left",0\n2,"two\nlines",1\n3,"path C:\\",0\n4,plain,1\n')
    got = [tuple(r) for r in load_csv(spark, path, "target").orderBy("id").collect()]
    assert got == [(1, 'He said "hi", then left', 0), (2, "two\nlines", 1), (3, "path C:\\", 0), (4, "plain", 1)]


def test_ragged_rows(spark, tmp_path):
    short = written(tmp_path, a="a,b\n1,x\n2\n")
    assert sorted(tuple(r) for r in load_csv(spark, short).collect()) == [(1, "x"), (2, None)]
    (tmp_path / "long").mkdir()
    with pytest.raises(ValueError, match="more fields"):
        load_csv(spark, written(tmp_path / "long", a="a,b\n1,2\n3,4,5\n"))


def test_files_are_matched_by_column_name(spark, tmp_path):
    path = written(tmp_path, a="a,b\n1,x\n", b="b,a\ny,2\n")
    assert sorted(tuple(r) for r in load_csv(spark, path).select("a", "b").collect()) == [(1, "x"), (2, "y")]
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError, match="other columns"):
        load_csv(spark, written(tmp_path / "other", a="a,b\n1,2\n", b="a,c\n1,2\n"))


def test_long_integers_stay_whole(spark, tmp_path):
    path = written(tmp_path, a="id\n1234567890123456789\n1234567890123456788\n")
    assert sorted(r[0] for r in load_csv(spark, path).collect()) == [1234567890123456788, 1234567890123456789]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.checkpoint_dir(Session())
