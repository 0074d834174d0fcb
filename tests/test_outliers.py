import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import outliers


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2))
    x[17] = (15.0, -15.0)
    pdf = pd.DataFrame({"id": np.arange(3000), "a": x[:, 0], "b": x[:, 1]})
    pdf.loc[5, "a"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def brute_score(nodes, row, sample=256):
    """Walks every tree with plain loops."""
    total, trees = 0.0, nodes["tree"].unique()
    for t in trees:
        part = {r.node: r for r in nodes[nodes["tree"] == t].itertuples()}
        node, depth = 1, 0
        while part[node].feature >= 0:
            node = 2 * node + (row[part[node].feature] >= part[node].cut)
            depth += 1
        n = part[node].size
        total += depth + (0 if n <= 1 else 1 if n == 2 else
                          2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n)
    c = 2 * (math.log(sample - 1) + np.euler_gamma) - 2 * (sample - 1) / sample
    return 2 ** (-total / len(trees) / c)


def test_planted_outlier_ranks_first_and_scores_match_brute_force(cloud):
    pdf, df = cloud
    rows = df.na.drop()
    nodes = outliers.fit_forest(rows, "id", ["a", "b"], 2999)
    assert nodes["tree"].nunique() == 100 and nodes[nodes["node"] == 1]["size"].max() == 256
    scored = outliers.anomaly_scores(rows, "id", ["a", "b"], nodes)
    got = {r["id"]: r["score"] for r in scored.collect()}
    assert max(got, key=got.get) == 17 and 0 < min(got.values()) and max(got.values()) < 1
    for i in (0, 17, 400):
        assert got[i] == pytest.approx(brute_score(nodes, pdf.loc[i, ["a", "b"]].to_numpy()))


def test_share_and_repeatability(cloud):
    _, df = cloud
    first = outliers.multivariate_outliers(df, "id").first()
    assert first["complete_rows"] == 2999 and first["contamination"] == pytest.approx(100 / 2999)
    assert first["outlier_count"] == pytest.approx(100, abs=3) and 17 in first["indices"] and len(first["indices"]) == 10
    assert first == outliers.multivariate_outliers(df.repartition(7), "id").first()


def test_below_fifty_rows_nothing_is_flagged(cloud):
    _, df = cloud
    got = outliers.multivariate_outliers(df.limit(30), "id").first()
    assert got["outlier_count"] == 0 and not got["has_outliers"] and got["indices"] == []
