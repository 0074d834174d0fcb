import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from conftest import by
from tidemark.config import AuditConfig
from tidemark.functions import selection
from tidemark.operators import forest, metrics, models, prep, split

SMALL = AuditConfig(num_trees=8, max_depth=4)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    n = 400
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "x1": np.where(rng.random(n) < 0.1, np.nan, x1), "x2": x2,
                        "label": rng.choice(["k", "m"], n), "y": np.where(x1 + 0.2 * rng.normal(size=n) > 0, "yes", "no"),
                        "z": 3 * x1 + x2})
    return spark.createDataFrame(pdf)


def test_classifier_scores_and_importance(labelled):
    train, test = labelled.filter("id % 5 > 0").drop("z"), labelled.filter("id % 5 = 0").drop("z")
    fitted, table = models.train_and_summarise(train, test, "y", "classification", ["id"], config=SMALL)
    got = {(r["split"], r["metric"]): r["value"] for r in table.collect()}
    assert got[("holdout", "f1")] > 0.8 and got[("train", "roc_auc")] > 0.9
    assert got[("train", "f1")] != got[("holdout", "f1")]
    again = models.train(train, "y", "classification", ["id"], config=SMALL)
    a, b = (sorted(m.predict(test, ["id"]).select("id", "prediction").collect()) for m in (fitted, again))
    assert a == b and {r["prediction"] for r in a} <= {"yes", "no"}
    imp = models.feature_importance(fitted).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0) and imp[0]["feature"] == "x1"
    assert [r["rank"] for r in imp] == sorted(r["rank"] for r in imp)
    whole = by(models.feature_importance(fitted, by_column=True))
    assert set(whole) == {"x1", "x2", "label"}


def test_regressor_and_custom_estimator(labelled):
    rows = labelled.drop("y")
    fitted = models.train(rows, "z", "regression", ["id"], config=SMALL)
    got = {r["metric"]: r["value"] for r in fitted.evaluate(rows).collect()}
    assert set(got) == {"rmse", "mae", "r2"} and got["r2"] > 0.7
    linear = models.train(rows, "z", "regression", ["id"], LinearRegression())
    assert models.feature_importance(linear).first()["feature"] == "x1"
    with pytest.raises(AttributeError):
        linear.predict_probability(rows)


def test_forest_is_as_good_as_that_of_dense_vectors(spark):
    rng = np.random.default_rng(12)
    n = 6000
    x, s = rng.normal(size=(n, 3)), rng.choice(list("abcdef"), n)
    y = (x[:, 0] + (s == "b") * 1.5 - (s == "e") + 0.5 * x[:, 1] ** 2 + 0.4 * rng.normal(size=n) > 0.7)
    pdf = pd.DataFrame({"id": range(n), "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "s": s, "y": np.where(y, "yes", "no"), "z": x[:, 0] + (s == "b")})
    df = spark.createDataFrame(pdf)
    config = AuditConfig(num_trees=20, max_depth=6)
    for target, task, metric, slack in (("y", "classification", "f1", 0.01), ("z", "regression", "r2", 0.05)):
        rows = df.drop("z" if target == "y" else "y")
        fit, held = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
        score = []
        for estimator in (None, models.default_estimator(task, config)):
            fitted = models.train(fit, target, task, ["id"], estimator, config)
            score.append(next(r["value"] for r in fitted.evaluate(held, auc=False).collect() if r["metric"] == metric))
        assert score[0] > score[1] - slack


def test_forest_does_not_depend_on_layout_and_takes_any_number_of_categories(spark, monkeypatch):
    df = spark.range(4000).select("id", F.concat(F.lit("name"), F.col("id")).alias("s"), (F.col("id") % 7).alias("x"),
                                  F.when(F.col("id") % 7 < 3, "a").otherwise("b").alias("y"))
    a = models.train(df, "y", "classification", ["id"], config=SMALL)
    # trees grown whole in a task are those of a pass per level
    monkeypatch.setattr(forest, "WHOLE_ROWS", 0)
    b = models.train(df.repartition(7, "x"), "y", "classification", ["id"], config=SMALL)
    assert [g.__dict__ for g in a.model.trees] == [g.__dict__ for g in b.model.trees]
    assert a.prep.sizes == [4000] and a.predict(df, ["id"]).count() == 4000
    names = models.feature_importance(a)
    assert names.count() == 4001 and names.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_splits_are_those_of_brute_force(spark):
    """One tree that draws every row once and every feature: each split has the largest fall in Gini impurity."""
    rng = np.random.default_rng(6)
    n = 200
    bins, cats = rng.integers(0, 6, (n, 2)), rng.integers(0, 4, (n, 1)) + 100
    y = (bins[:, 0] > 2) ^ (cats[:, 0] == 101) ^ (rng.random(n) < 0.1)
    edges = [np.arange(5) + 0.5] * 2
    rows = spark.createDataFrame([(i, float(b), [float(v) for v in x], [int(v) for v in c]) for i, (b, x, c) in enumerate(zip(y, bins, cats))],
                                 "h bigint, y double, x array<double>, c array<bigint>")
    grown = forest.grow(rows, edges, [4], 2, trees=1, max_depth=3, seed=1, drawn=3).trees[0]
    weight = forest.bootstrap(np.arange(n), 0, 1)
    gini = lambda m: 1 - sum((weight[m & (y == k)].sum() / weight[m].sum()) ** 2 for k in (True, False))
    members = {0: weight > 0}
    for i in range(len(grown.left)):
        own = members[i]
        if grown.left[i] < 0:
            continue
        best = 0.0
        for right in [bins[:, j] > b for j in range(2) for b in range(5)] + [cats[:, 0] == v for v in range(100, 104)]:
            r, l = own & right, own & ~right
            if weight[r].sum() and weight[l].sum():
                best = max(best, gini(own) - (weight[r].sum() * gini(r) + weight[l].sum() * gini(l)) / weight[own].sum())
        right = bins[:, grown.feature[i]] > grown.cut[i] if grown.kind[i] < 0 else cats[:, 0] == grown.feature[i]
        members[grown.left[i]], members[grown.left[i] + 1] = own & ~right, own & right
        assert grown.gain[i] == pytest.approx(best)
    assert sum(l >= 0 for l in grown.left) > 3


def test_permutation_is_that_of_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n) * 3, "x1": rng.normal(size=n), "s": rng.choice(["p", "q", None], n), "x2": rng.normal(size=n)})
    pdf["y"] = np.where(pdf.x1 + (pdf.s == "p") > 0.3, "yes", "no")
    df = spark.createDataFrame(pdf)
    digest = lambda k, t: hashlib.md5((f"{k}|{t}" if t else str(k)).encode()).hexdigest()
    first = sorted(pdf.id, key=lambda k: digest(k, 0))
    partner = {t: dict(zip(first, sorted(pdf.id, key=lambda k, t=t: digest(k, t)))) for t in (1, 2)}
    pairs = {(r["key"], r["repeat"]): r["donor"] for r in models.permutation_pairs(df, "id", 2).collect()}
    assert pairs == {(k, t): d for t in (1, 2) for k, d in partner[t].items()}
    for estimator in (None, LogisticRegression()):
        fitted = models.train(df, "y", "classification", ["id"], estimator, SMALL)
        got = by(models.permutation_importance(fitted, df, "id", 2))
        base = (fitted.predict(df, ["id", "y"]).toPandas().eval("prediction == y")).mean()
        for c in ("x1", "s", "x2"):
            drops = []
            for t in (1, 2):
                value = pdf.set_index("id")[c]
                swapped = pdf.assign(**{c: [value[partner[t][k]] for k in pdf.id]})
                scored = fitted.predict(spark.createDataFrame(swapped, df.schema), ["y"]).toPandas()
                drops.append(base - (scored.prediction == scored.y).mean())
            assert got[c]["importance"] == pytest.approx(np.mean(drops)) and got[c]["importance_std"] == pytest.approx(np.std(drops))


def test_permutation_importance_is_seeded_and_finds_the_driver(labelled):
    rows = labelled.drop("z", "label")
    fitted = models.train(rows, "y", "classification", ["id"], LogisticRegression())
    a = by(models.permutation_importance(fitted, rows, "id"))
    b = by(models.permutation_importance(fitted, rows.repartition(5), "id"))
    assert a == b and a["x1"]["importance"] > 0.2 > abs(a["x2"]["importance"])


def test_importance_without_model_importances_permutes(labelled):
    rows = labelled.select("id", "y", "label", F.abs("x2").alias("x2"))
    # a model with neither importances nor coefficients
    fitted = models.train(rows, "y", "classification", ["id"], NaiveBayes(modelType="gaussian"))
    with pytest.raises(ValueError, match="importances"):
        models.feature_importance(fitted)
    assert models.feature_importance(fitted, rows, "id").count() == 2  # input columns


def test_cross_validation(labelled):
    got = models.cross_validate(labelled.drop("z"), "y", "classification", "id", config=SMALL).first()
    assert got["metric"] == "f1_weighted" and got["cv_mean"] > 0.8 and 0 <= got["cv_std"] < 0.2
    got = models.cross_validate(labelled.drop("y"), "z", "regression", "id", config=SMALL, folds=2).first()
    assert got["metric"] == "root_mean_squared_error" and got["cv_folds"] == 2


def test_folds_are_fitted_together_as_alone(labelled):
    tagged = labelled.withColumn("f", (F.col("id") % 3).cast("int")).withColumn("label", F.when(F.col("id") == 6, "only here").otherwise(F.col("label")))
    together = prep.fit_sparse_folds(tagged, "f", 3, ["id", "y"], 32)
    for k, got in enumerate(together):
        alone = prep.fit_sparse(tagged.filter(F.col("f") != k), ["id", "y", "f"], 32)
        assert (got.numeric, got.categorical, got.medians, got.modes, got.sizes) == (
            alone.numeric, alone.categorical, alone.medians, alone.modes, alone.sizes)
        assert all((a == b).all() for a, b in zip(got.edges, alone.edges))
    assert [p.sizes for p in together] == [[2], [3], [3]]


def test_input_checks(labelled):
    with pytest.raises(ValueError, match="unsupported task"):
        models.train(labelled, "y", "ranking")
    with pytest.raises(ValueError, match="empty"):
        models.train(labelled.limit(0), "y", "classification")
    with pytest.raises(ValueError, match="not found"):
        models.train(labelled, "absent", "classification")
    estimator = models.default_estimator("Classification ", dev=True)
    assert (estimator.getNumTrees(), estimator.getMaxDepth()) == (10, 5)


def test_auc_brute_force(spark):
    rng = np.random.default_rng(9)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 10
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    for small in (5, 10 ** 6):
        assert metrics.roc_auc(df, "y", "s", small).first()["roc_auc"] == pytest.approx(want)
    assert metrics.roc_auc(df.filter("y = 1"), "y", "s").first()["roc_auc"] is None


def test_metrics_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    got = {r["metric"]: r["value"] for r in metrics.classification_metrics(df, "y", "p").collect()}
    assert got["accuracy"] == 0.5 and got["recall"] == 0.5
    assert got["precision"] == pytest.approx((2 * 1 + 1 / 3) / 4)
    assert got["f1"] == pytest.approx((2 * 2 / 3 + 0.5) / 4)


def test_calibration_and_confidence(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (1, 1.2), (0, -0.1), (1, 0.55)], "y int, p double")
    curve = {r["bin"]: r for r in metrics.calibration_curve(df, "y", "p").collect()}
    assert len(curve) == 10 and curve[9]["n"] == 2 and curve[3]["n"] == 0
    ece = metrics.calibration_error(metrics.calibration_curve(df, "y", "p")).first()
    assert ece["expected_calibration_error"] == pytest.approx(0.45 / 3, abs=1e-6) and not ece["is_well_calibrated"]
    got = metrics.confidence_spread(spark.createDataFrame([(0.8,), (0.81,), (0.5,), (0.2,)], "p double"), "p").first()
    assert (got["high_confidence_pct"], got["medium_confidence_pct"], got["low_confidence_pct"]) == (25.0, 50.0, 25.0)


def test_bootstrap_weights_are_those_of_the_whole_hash():
    rows = np.random.default_rng(1).integers(-2 ** 62, 2 ** 62, 300_000)
    want = np.searchsorted(forest._POISSON, forest.uniform(forest.mixed(42, 3, rows)), side="right")
    assert (forest.bootstrap(rows, 3, 42) == want).all() and want.max() > 5


def _some_forest(rng):
    """A random forest over two numbers (one of them with a few values) and a text column."""
    trees = []
    for _ in range(5):
        g = forest.Grown()
        g.add([1.0, 0.0], 0)
        for i in range(40):
            if g.left[i] < 0 and g.depth[i] < 7:
                kind = int(rng.integers(-1, 1))
                g.kind[i], g.feature[i], g.cut[i] = kind, int(rng.integers(0, 2) if kind < 0 else rng.integers(0, 9) * 1000), int(rng.integers(0, 6))
                g.left[i] = len(g.left)
                for _ in range(2):
                    g.add(rng.integers(1, 50, 2).astype(float).tolist(), g.depth[i] + 1)
        trees.append(g)
    return forest.Forest(trees, [np.arange(6) + 0.5, np.arange(6) * 10 + 5.0], 1, 2)


def _leaf(g, x, c, edges):
    i = 0
    while g.left[i] >= 0:
        f = g.feature[i]
        right = (edges[f] < x[f]).sum() > g.cut[i] if g.kind[i] < 0 else c[g.kind[i]] == f
        i = g.left[i] + int(right)
    return i


@pytest.mark.parametrize("few", [4, 10 ** 6])
def test_rows_come_to_their_leaf_and_closed_nodes_drop_them(monkeypatch, few):
    monkeypatch.setattr(forest, "FEW", few)
    rng = np.random.default_rng(5)
    model = _some_forest(rng)
    x, c = np.stack([rng.integers(0, 7, 400), rng.integers(0, 70, 400)], 1).astype(float), rng.integers(0, 12, (400, 1)) * 1000
    batch = pa.RecordBatch.from_pydict({"h": pa.array(np.arange(400)), "y": pa.array(np.zeros(400)), "x": pa.array(list(x)), "c": pa.array(list(c))})
    block = forest.Block.unpacked(forest.Block.of([batch.slice(0, 150), batch.slice(150)], model.edges, 1).packed(2), 0)
    for g in model.trees:
        want = np.array([_leaf(g, a, b, model.edges) for a, b in zip(x, c)])
        walk = forest.Walk(g, 2, block.ids)
        rows_, leaf = walk.down(block.cells)
        assert sorted(rows_) == list(range(400)) and (want[rows_] == leaf).all()
        open_node = np.arange(len(g.left)) == want[0]
        rows_, leaf = walk.down(block.cells, np.arange(0, 400, 2), walk.leads_to(open_node))
        assert set(rows_) == set(np.flatnonzero(want == want[0])) & set(range(0, 400, 2)) and set(leaf) <= {want[0]}


def test_shuffled_scores_are_those_of_rows_with_the_donors_value():
    rng = np.random.default_rng(8)
    model = _some_forest(rng)
    arrays = lambda n: (np.stack([rng.integers(0, 7, n), rng.integers(0, 70, n)], 1).astype(float), rng.integers(0, 12, (n, 1)) * 1000)
    (x, c), (dx, dc) = arrays(300), arrays(300)
    got = dict(model.shuffled(*(pa.array(list(v)) for v in (x, c, dx, dc))))
    leaf_values = [model.leaf_values(t) for t in range(5)]
    for source in (-1, 0, 1, 2):
        sx, sc = x.copy(), c.copy()
        if source >= 0:
            (sx if source < 2 else sc)[:, source % 2] = (dx if source < 2 else dc)[:, source % 2]
        want = np.mean([[v[_leaf(g, a, b, model.edges)] for a, b in zip(sx, sc)] for g, v in zip(model.trees, leaf_values)], axis=0)
        assert np.allclose(got[source], want)


def test_a_large_table_is_dealt_to_few_large_tasks(spark, monkeypatch):
    """Each task sends counts of all open nodes, so their number must not grow with every few rows."""
    dealt = []
    whole = models.grow
    monkeypatch.setattr(models, "grow", lambda rows, *a, **k: dealt.append(rows.rdd.getNumPartitions()) or whole(rows, *a, **k))
    table = lambda n: spark.range(n).select("id", (F.col("id") % 7).alias("x"), F.when(F.col("id") % 7 < 3, "a").otherwise("b").alias("y"))
    models.train(table(40_000), "y", "classification", ["id"], config=SMALL)
    monkeypatch.setattr(models, "FOREST_ROWS", 100)
    models.train(table(6000), "y", "classification", ["id"], config=SMALL)
    assert dealt == [1, 48]  # 3 and 60 before


@pytest.mark.parametrize("classes", [0, 3])
def test_counts_are_the_same_however_rows_of_a_node_are_held(monkeypatch, classes):
    """Rows that are marked, listed or walk in groups, and nodes that are counted alone or together."""
    rng = np.random.default_rng(12)
    x, c = np.stack([rng.integers(0, 7, 3000), rng.integers(0, 70, 3000)], 1).astype(float), rng.integers(0, 60, (3000, 1)) * 1000
    y = (x[:, 0] > 3).astype(float) + (rng.random(3000) < 0.3)
    batch = pa.RecordBatch.from_pydict({"h": pa.array(rng.integers(-2 ** 62, 2 ** 62, 3000)), "y": pa.array(y), "x": pa.array(list(x)), "c": pa.array(list(c))})
    edges = [np.arange(6) + 0.5, np.arange(6) * 10 + 5.0]
    block = forest.Block.of([batch], edges, 1)
    found = []
    for few, marked, hashed, held in ((10 ** 6, 32, 16_384, 2_000_000), (4, 2, 100, 1), (4, 10 ** 6, 16_384, 2_000_000)):
        for name, value in (("FEW", few), ("MARKED", marked), ("HASHED", hashed), ("HELD_CELLS", held)):
            monkeypatch.setattr(forest, name, value)
        trees = [forest.Grown() for _ in range(4)]
        for g in trees:
            g.add([], 0)
        sums = {}
        for _ in range(4):
            cells = pa.Table.from_batches(forest._histogram(forest._growing(trees, classes), 2, [60], classes, 7, 2)(block))
            for r in cells.to_pylist():
                sums[tuple(r[n] for n in ("t", "node", "kind", "f", "bin", *(["s"] if classes else [])))] = [r[n] for n in (["v"] if classes else ["n", "y", "yy"])]
            forest._advance(trees, forest._best_splits(classes)(cells), classes, 10)
        found.append((sums, [(g.kind, g.feature, g.cut, g.left) for g in trees]))
    assert len(found[0][0]) > 200 and max(len(t[3]) for t in found[0][1]) > 6
    for sums, trees in found[1:]:
        assert trees == found[0][1] and set(sums) == set(found[0][0])
        assert all(sums[k] == pytest.approx(v) for k, v in found[0][0].items())


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_folds_that_are_dealt_once_score_as_folds_dealt_alone(labelled, monkeypatch, task):
    monkeypatch.setattr(forest, "WHOLE_ROWS", 10)
    monkeypatch.setattr(models, "FOREST_ROWS", 150)
    target, metric = ("y", "f1") if task == "classification" else ("z", "rmse")
    df = labelled.drop("z" if target == "y" else "y").withColumn(target, F.when(F.col("id") % 17 > 0, F.col(target)))
    got = models.cross_validate(df, target, task, "id", folds=2, config=SMALL).first()
    tagged = (split.stratified_folds(df, "id", target, 2).withColumnRenamed("fold", "__fold") if task == "classification"
              else df.withColumn("__fold", split.fold_of("id", 2)))
    alone = []
    for k in range(2):
        fitted = models._train_forest(tagged.filter(F.col("__fold") != k), target, task, ["id", "__fold"], SMALL, False)
        held = tagged.filter((F.col("__fold") == k) & F.col(target).isNotNull())
        alone.append(next(r["value"] for r in fitted.evaluate(held, auc=False).collect() if r["metric"] == metric))
    assert got["cv_mean"] == pytest.approx(np.mean(alone), rel=1e-9) and got["cv_std"] == pytest.approx(np.std(alone), rel=1e-6)


def test_folds_share_their_scans(labelled, monkeypatch):
    """Rows are dealt once for all folds, and a cell is read once for the quantiles of all of them."""
    dealt, read = [], []
    deal, cells = models._dealt, selection._cells_of
    monkeypatch.setattr(models, "_dealt", lambda *a: dealt.append(a) or deal(*a))
    monkeypatch.setattr(selection, "_cells_of", lambda df, cols, fold: read.append((sorted(cols), fold)) or cells(df, cols, fold))
    monkeypatch.setattr(selection.fold_quantiles, "__defaults__", (50,))
    models.cross_validate(labelled.drop("z"), "y", "classification", "id", folds=3, config=SMALL)
    assert len(dealt) == 1 and read and all(len(cols) <= 2 and fold == "__fold" for cols, fold in read)
