import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import by
from tidemark.functions import selection, stats


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.lognormal(sigma=3, size=5000), "b": rng.integers(0, 7, 5000).astype(float),
                        "c": 1e9 + rng.normal(size=5000), "d": rng.normal(size=5000)})
    pdf.loc[rng.random(5000) < 0.3, "a"] = np.nan
    pdf.loc[rng.random(5000) < 0.2, "d"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_moments_match_pandas(numbers):
    pdf, df = numbers
    got = by(stats.moments(df, list(pdf.columns)))
    for c in pdf:
        assert got[c]["n"] == pdf[c].count() and got[c]["nulls"] == pdf[c].isna().sum()
        assert got[c]["var_samp"] == pytest.approx(pdf[c].var(), rel=1e-6)
        n, g1 = got[c]["n"], got[c]["skew"]
        assert g1 * np.sqrt(n * (n - 1)) / (n - 2) == pytest.approx(pdf[c].skew(), rel=1e-4, abs=1e-6)


def test_wide_and_long_moments_agree(numbers):
    _, df = numbers
    wide = by(stats.moments(df, ["a", "b"], fields=("n", "min", "max")))
    long = by(stats.moments(df, ["a", "b"], fields=("n", "min", "max", "var_pop")))
    assert all(wide[c][f] == long[c][f] for c in "ab" for f in ("n", "min", "max"))


def test_correlation_with_gaps_and_large_offset(numbers):
    pdf, df = numbers
    want = pdf.corr()
    for r in stats.correlations(df, list(pdf.columns)).collect():
        assert r["corr"] == pytest.approx(want.loc[r["feature_a"], r["feature_b"]], abs=1e-6)


def test_correlation_of_a_constant_is_missing(spark):
    df = spark.range(20).select(F.col("id").alias("x"), F.lit(0.1).alias("k"))
    assert stats.correlations(df, ["x", "k"]).first()["corr"] is None


def test_value_counts_keep_types_apart(spark):
    df = spark.createDataFrame([(9007199254740993, 0.0, "x"), (9007199254740992, -0.0, None)], "i long, f double, s string")
    got = by(stats.cardinality(df, ["i", "f", "s"]))
    assert got["i"]["n_unique"] == 2 and got["f"]["n_unique"] == 1
    assert (got["s"]["n_unique"], got["s"]["total"], got["s"]["non_null"]) == (1, 2, 1)


@pytest.mark.parametrize("small", [20, 200, 10 ** 9])
def test_exact_quantiles_at_any_size(numbers, small):
    pdf, df = numbers
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = selection.exact_quantiles(df, list(pdf.columns), probs, small=small)
    for c in pdf:
        assert got[c] == pytest.approx(list(np.nanquantile(pdf[c], probs)), rel=1e-12)


def test_quantiles_of_hot_value_and_of_nothing(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 7.0).alias("x"),
                                  F.lit(None).cast("double").alias("void"))
    want = np.quantile([5.0 if i % 3 == 0 else i / 7.0 for i in range(3000)], [0.01, 0.5])
    got = selection.exact_quantiles(df, ["x", "void"], [0.01, 0.5], small=10)
    assert got["x"] == pytest.approx(list(want), rel=1e-12) and got["void"] is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.floats(0, 1))
def test_quantile_property(spark, xs, p):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = selection.exact_quantiles(df, ["x"], [p], small=3)["x"][0]
    assert got == pytest.approx(float(np.quantile(np.array(xs), p)), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("small", [16, 10 ** 6])
def test_prefix_sums(spark, small):
    df = spark.range(300).select((F.col("id") * 0.5).alias("s"), (F.col("id") % 4).alias("x"))
    got = {r["s"]: r["before_x"] for r in selection.prefix_sums(df, "s", ["x"], small).collect()}
    total = 0
    for i in range(300):
        assert got[i * 0.5] == total
        total += i % 4


@pytest.mark.parametrize("small", [25, 10 ** 6])
def test_group_numbers_with_a_hot_group(spark, small):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 < 4, "hot").otherwise("cold").alias("g"))
    got = {r["id"]: r["n"] for r in selection.group_numbers(df, "g", "id", "n", small).collect()}
    seen = {"hot": 0, "cold": 0}
    for i in range(500):
        g = "hot" if i % 5 < 4 else "cold"
        seen[g] += 1
        assert got[i] == seen[g]


def test_uniform_bin_matches_numpy_on_edges(spark):
    rng = np.random.default_rng(3)
    xs = np.concatenate([rng.integers(0, 31, 400).astype(float), np.linspace(0, 30, 11)])
    df = spark.createDataFrame([(float(x), "train") for x in xs], "x double, split string")
    got = {r["bin"]: r["train"] for r in stats.histogram(df, {"x": (0.0, 30.0)}, 10, "split").collect()}
    want, _ = np.histogram(xs, bins=10, range=(0.0, 30.0))
    assert [got.get(i, 0) for i in range(10)] == list(want)


@pytest.mark.parametrize("small", [10, 10 ** 9])
def test_quantiles_without_a_fold_are_those_of_the_other_rows(spark, small):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"f": rng.integers(0, 3, 900), "x": rng.lognormal(0, 4, 900), "hot": np.where(rng.random(900) < 0.7, 2.0, rng.random(900)),
                        "one": rng.random(900), "far": rng.choice([-1.7e308, 1.7e308, 5e-324, 0.0], 900), "void": np.nan})
    pdf.loc[pdf["f"] != 1, "one"] = np.nan
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5).withColumn("f", F.when(F.col("x") < 200, F.col("f")))
    pdf["f"] = pdf["f"].where(pdf["x"] < 200)
    probs, cols = [0.0, 0.03, 0.5, 0.97, 1.0], ["x", "hot", "one", "far", "void"]
    got = selection.fold_quantiles(df, cols, "f", 3, probs, small)
    for k in range(3):
        rest = pdf[pdf["f"].notna() & (pdf["f"] != k)]
        for c in cols:
            if rest[c].notna().any() and c != "far":
                assert got[(k, c)] == pytest.approx(list(np.nanquantile(rest[c], probs)), rel=1e-12)
            elif c == "far":
                want = np.sort(rest[c].to_numpy())
                assert (got[(k, c)][0], got[(k, c)][4]) == (want[0], want[-1])
            else:
                assert got[(k, c)] is None


def test_narrowing_ends_between_neighbours(spark):
    tiny = float(np.nextafter(1.0, 2.0))
    xs = [1.0] * 40 + [tiny] * 40 + [-1.7e308, 1.7e308, 0.0, 5e-324]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = selection.select_ranks(df, [(selection.ALL, "x", i) for i in range(len(xs))], {"x": (-1.7e308, 1.7e308, len(xs))}, small=3)
    assert [got[(selection.ALL, "x", i)] for i in range(len(xs))] == sorted(xs)
