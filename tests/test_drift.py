import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import by, rows
from tidemark.operators import drift, split


def brute_psi(a, b, bins=10):
    a, b = a[~np.isnan(a)], b[~np.isnan(b)]
    if not len(a) or not len(b):
        return 0.0
    edges = np.histogram_bin_edges(a, bins=bins)
    p, q = np.histogram(a, edges)[0], np.histogram(b, edges)[0]
    p, q = (p + 1e-8) / (p.sum() + 1e-8), (q + 1e-8) / (q.sum() + 1e-8)
    return float(((p - q) * np.log(p / q)).sum())


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(5)
    def side(n, name, age, salary):
        return pd.DataFrame({"split": name, "age": rng.normal(age, 6, n).round(), "salary": rng.normal(salary, 9000, n),
                             "gaps": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n)), "flat": 2.0,
                             "void": np.nan if name == "test" else 1.0})
    pdf = pd.concat([side(400, "train", 30, 50000), side(200, "test", 36, 70000)], ignore_index=True)
    return pdf, spark.createDataFrame(pdf)


def test_psi_matches_brute_force(pair):
    pdf, df = pair
    got = by(drift.psi(df))
    for c in ["age", "salary", "gaps", "flat", "void"]:
        a, b = (pdf[pdf["split"] == s][c].to_numpy() for s in ("train", "test"))
        assert got[c]["psi"] == pytest.approx(brute_psi(a, b), rel=1e-9, abs=1e-12)
        if c == "salary":
            assert got[c]["out_of_range_pct"] == pytest.approx(((b < a.min()) | (b > a.max())).mean() * 100)


def test_psi_of_equal_sides_is_zero(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("x"), F.explode(F.array(F.lit("train"), F.lit("test"))).alias("split"))
    assert drift.psi(df).first()["psi"] == pytest.approx(0.0, abs=1e-12)


def test_bands_and_impact(spark):
    scores = spark.createDataFrame([("a", 0.09), ("b", 0.1), ("c", 0.25), ("d", 0.5), ("e", 3.0)], "feature string, psi double")
    assert {r["band"]: list(r["features"]) for r in drift.drift_bands(scores).collect()} == {
        "low": ["a"], "medium": ["b"], "high": ["c"], "critical": ["d", "e"]}
    assert drift.drift_impact(scores).first()["severity"] == "high"
    assert [r["drift_severity"] for r in drift.psi_table(scores).orderBy("rank").collect()] == ["HIGH", "HIGH", "MEDIUM", "LOW", "LOW"]


def test_stability_matches_brute_force(pair):
    pdf, df = pair
    got = by(drift.feature_stability(df))
    for c in ["age", "salary", "gaps", "flat"]:
        a, b = (pdf[pdf["split"] == s][c].dropna().to_numpy() for s in ("train", "test"))
        edges = np.histogram_bin_edges(np.concatenate([a, b]), bins=30)
        p, q = np.histogram(a, edges)[0], np.histogram(b, edges)[0]
        p, q = (p + 1e-8) / (p.sum() + 1e-8), (q + 1e-8) / (q.sum() + 1e-8)
        kl = ((p * np.log(p / q)).sum() + (q * np.log(q / p)).sum()) / 2
        assert got[c]["kl_divergence"] == pytest.approx(kl, rel=1e-9, abs=1e-12)
    assert "void" not in got and got["flat"]["rank"] == 1


def test_variance_ratio(pair):
    pdf, df = pair
    got = by(drift.variance_ratio(df, ["age", "salary"]))
    a, b = (pdf[pdf["split"] == s]["age"].var(ddof=0) for s in ("train", "test"))
    assert got["age"]["ratio"] == pytest.approx(max(a, b) / (min(a, b) + 1e-8))


def test_missingness(spark):
    df = spark.range(100).select(F.when(F.col("id") < 50, F.col("id")).alias("x"), (F.col("id") < 50).cast("int").alias("y"),
                                 F.lit(1).alias("full"), F.lit(None).cast("int").alias("void"), F.lit("t").alias("text"))
    assert rows(drift.informative_missingness(df, "y")) == [("x", 1.0, "high")]
    assert drift.informative_missingness(df, "text").count() == 0


def brute_vif(pdf):
    x = pdf.to_numpy(float)
    out = {}
    for i, c in enumerate(pdf):
        rest = np.delete(x, i, 1)
        fit = rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        out[c] = (x[:, i] ** 2).sum() / ((x[:, i] - fit) ** 2).sum()
    return out


@pytest.mark.parametrize("width", [3, 14])
def test_vif_matches_regression(spark, width):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({f"c{k}": rng.normal(k, 1 + k, 300) for k in range(width)})
    pdf["c1"] = pdf["c0"] * 2 + rng.normal(size=300)
    pdf.loc[::9, "c2"] = np.nan
    got = by(drift.vif(spark.createDataFrame(pdf)))
    want = brute_vif(pdf.fillna(pdf.median()))
    assert all(got[c]["vif"] == pytest.approx(want[c], rel=1e-3) for c in want)


def test_vif_edge_cases(spark):
    df = spark.range(60).select(F.col("id").cast("double").alias("a"), (F.col("id") * 3).alias("copy"),
                                F.sin("id").alias("free"), F.lit(4).alias("flat"), F.lit(None).cast("double").alias("void"))
    got = by(drift.vif(df))
    assert set(got) == {"a", "copy", "free"} and got["a"]["vif"] == got["copy"]["vif"] == 999.0
    assert by(drift.vif(df.select("a")))["a"]["vif"] == 1.0
    assert drift.vif(df.select("flat", "void")).count() == 0
    wide = drift.vif_bands(spark.createDataFrame([("a", 10.0), ("b", 10.1), ("c", 5.0), ("d", 2.0)], "feature string, vif double"))
    assert {r["band"]: list(r["features"]) for r in wide.collect()} == {"critical": ["b"], "high": ["a"], "moderate": ["c"]}
    assert {r["severity"] for r in drift.vif_recommendations(wide).collect()} == {"critical", "high"}


@pytest.mark.parametrize("fraction", [0.2, 0.3])
def test_stratified_split_takes_the_same_rows_as_sorting(spark, fraction):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 7 == 0, None).otherwise("b").alias("y"))
    got = split.split_stratified(df, "id", "y", fraction).toPandas()
    assert len(got) == 4000
    import hashlib
    for y, part in got.fillna("none").groupby("y"):
        ordered = sorted(part["id"], key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k))
        take = set(ordered[:int(np.ceil(fraction * len(part) - 1e-9))])
        assert set(part[part["split"] == "test"]["id"]) == take


def test_hash_split_and_sample_are_stable(spark):
    df = spark.range(6000)
    a = {r["id"] for r in split.split_hash(df, "id").filter("split = 'test'").collect()}
    assert a == {r["id"] for r in split.split_hash(df.repartition(7), "id").filter("split = 'test'").collect()}
    assert 0.17 < len(a) / 6000 < 0.23
    s = split.dev_sample(df, "id")
    assert s.count() == 5000 and {r["id"] for r in s.collect()} == {r["id"] for r in split.dev_sample(df.repartition(3), "id").collect()}
    assert split.dev_sample(df.limit(10), "id").count() == 10
