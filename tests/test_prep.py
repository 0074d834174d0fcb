import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.functions.selection import range_numbers
from tidemark.operators import prep


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, 20.0, "rome", "train"), (2, None, "oslo", "train"), (3, 40.0, None, "train"), (4, 70.0, "oslo", "train"),
         (5, None, "paris", "test"), (6, 90.0, "rome", "test")], "id long, age double, city string, split string")


def test_impute_exact_median_and_smallest_mode(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, "b"), (10.0, "a"), (None, None)], "x double, s string")
    got = rows(prep.impute(df.withColumn("void", F.lit(None).cast("string"))).filter("x = 3.0"))
    assert got == [(3.0, "a", "missing")]


def test_impute_uses_train_statistics(people):
    train = people.filter("split = 'train'")
    got = {r["id"]: r for r in prep.impute(people, train, ["id", "split"]).collect()}
    assert got[5]["age"] == 40.0 and got[3]["city"] == "oslo"


def test_indicators_only_for_train_gaps(people):
    train = people.filter("split = 'train'").withColumn("full", F.lit(1.0))
    out = prep.missing_indicators(train, train, ["age", "full"])
    assert out.columns[-1] == "age__missing_indicator"
    assert [r[0] for r in out.orderBy("id").select("age__missing_indicator").collect()] == [0, 1, 0, 0]


def test_robust_scale_without_spread(spark):
    df = spark.createDataFrame([(float(x), 5.0) for x in (1, 2, 3, 4, 5)], "x double, flat double")
    got = [tuple(r) for r in prep.robust_scale(df, ["x", "flat"]).orderBy("x").collect()]
    assert got == [(-1.0, 0.0), (-0.5, 0.0), (0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]


def test_one_hot_unseen_and_infrequent(spark):
    values = ["a"] * 150 + ["b"] * 148 + ["c", "d"]
    train = spark.createDataFrame([(v,) for v in values], "s string")
    new = spark.createDataFrame([("a",), ("c",), ("never",), (None,)], "s string")
    plain = prep.one_hot(new, ["s"], train)
    assert plain.columns == ["s_a", "s_b", "s_c", "s_d"] and sorted(rows(plain))[0] == (0, 0, 0, 0)
    pooled = prep.one_hot(new, ["s"], train, 0.01)
    assert pooled.columns == ["s_a", "s_b", "s_infrequent_sklearn"]
    assert sorted(rows(pooled)) == [(0, 0, 0), (0, 0, 0), (0, 0, 1), (1, 0, 0)]


def test_many_categories_are_encoded_sparsely(spark):
    df = spark.range(3000).select("id", F.col("id").cast("string").alias("s"), F.lit("x").alias("t"))
    fitted = prep.fit_prep(df, ["id"], min_share=0.0)
    assert len(fitted.feature_names) == 3001
    unseen = spark.createDataFrame([(1, "17", "x"), (2, "never", None)], "id bigint, s string, t string")
    got = {r["id"]: [fitted.feature_names[i] for i in r["features"].indices] for r in fitted.vectors(unseen, ["id"]).collect()}
    assert got == {1: ["s_17", "t_x"], 2: ["t_x"]}


def test_categories_are_joined_from_a_table(spark):
    values = ["hot"] * 400 + [f"v{i}" for i in range(300)] + [None] * 20
    train = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, s string")
    new = spark.createDataFrame([(1, "hot"), (2, "v17"), (3, "never"), (4, None), (5, "v17")], "id int, s string")
    order = sorted(set(values) - {None})
    long = {(r["key"], r["feature"], r["index"]) for r in prep.one_hot_long(new, "id", ["s"], train).collect()}
    assert long == {(1, "s_hot", order.index("hot")), (2, "s_v17", order.index("v17")), (5, "s_v17", order.index("v17"))}
    fitted = prep.fit_prep(train, ["id"], min_share=0.0)
    assert fitted.feature_names == [f"s_{v}" for v in order] and fitted.origin() == ["s"] * 301
    got = {r["id"]: [order[i] for i in r["features"].indices] for r in fitted.vectors(new, ["id"]).collect()}
    assert got == {1: ["hot"], 2: ["v17"], 3: [], 4: ["hot"], 5: ["v17"]}
    names = {r["feature"]: r["f"] for r in prep.fit_sparse(train, ["id"], 32).category_names().collect()}
    cells = {r["id"]: list(r["c"]) for r in prep.fit_sparse(train, ["id"], 32).cells(new, ["id"]).collect()}
    assert cells[2] == cells[5] == [names["s_v17"]] and cells[4] == [names["s_hot"]] and len(names) == 301


def test_ranges_number_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("a").alias("s"))
    got = rows(range_numbers(df, ["s", "x"], "n"), "x", "n")
    assert len(got) == 1000 and all(x == n for x, n in got)


def test_full_preparation(people):
    out, fitted = prep.preprocess(people, "id", "id")
    assert fitted.feature_names == ["age", "age__missing_indicator", "city_oslo", "city_rome"]
    assert fitted.origin() == ["age", "age", "city", "city"]
    got = {r["id"]: r for r in out.collect()}
    # filled train ages 20 40 40 70: quartiles 35, 40, 47.5
    assert got[1]["age"] == pytest.approx((20 - 40) / 12.5) and got[5]["age"] == 0.0
    assert got[5]["age__missing_indicator"] == 1.0
    assert (got[5]["city_oslo"], got[5]["city_rome"]) == (0.0, 0.0) and got[3]["city_oslo"] == 1.0


def test_fill_lifts_mode_over_the_share(spark):
    df = spark.createDataFrame([(None,)] * 150 + [(f"v{i:03d}",) for i in range(150)], "s string")
    fitted = prep.fit_prep(df, min_share=0.01)
    assert fitted.categories["s"] == ["v000"] and fitted.rare["s"].count() == 149
    assert fitted.feature_names == ["s_v000", "s_infrequent_sklearn"]


def test_vectors_match_columns(people):
    fitted = prep.fit_prep(people, ["id", "split"])
    flat = [list(r)[1:] for r in fitted.transform(people, ["id"]).orderBy("id").collect()]
    vec = [list(r["features"].toArray()) for r in fitted.vectors(people, ["id"]).orderBy("id").collect()]
    assert np.allclose(flat, vec)
