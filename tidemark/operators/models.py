"""Model training, scoring, cross-validation and importance on pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F

from ..config import AuditConfig
from ..schema import col, local_frame, materialise, require_columns
from ..sources.scratch import stored
from .forest import BINS, Forest, grow, merged
from .metrics import classification_metrics, metrics_from_confusion, regression_metrics, roc_auc
from .prep import FittedPrep, SparsePrep, fit_prep, fit_sparse, fit_sparse_folds
from .split import fold_of, stratified_folds

DEFAULT = AuditConfig()
TASKS = ("classification", "regression")
# Training rows are dealt to tasks by their content, so that a model does not depend on the files' layout: to so many tasks
# for an estimator that reads vectors.
TRAIN_PARTITIONS = 32
# For a forest: at least so many rows to a task, up to so many tasks, and beyond that so many bytes of cells to a task.  Every
# task sends its counts of all open nodes, so fewer and larger tasks send less.
FOREST_ROWS, FOREST_TASKS, FOREST_BYTES = 65_536, 48, 64_000_000
IMPORTANCE = "feature string, importance double, rank int"


def check_task(task: str) -> str:
    name = task.lower().strip()
    if name not in TASKS:
        raise ValueError(f"unsupported task type {task!r}; expected one of {sorted(TASKS)}")
    return name


def default_estimator(task: str, config: AuditConfig = DEFAULT, dev: bool = False) -> Estimator:
    """A seeded random forest; MLlib bounds the tree depth, so quality is comparable, not identical."""
    kind = RandomForestClassifier if check_task(task) == "classification" else RandomForestRegressor
    return kind(featuresCol="features", labelCol="label", seed=config.seed,
                maxMemoryInMB=1024,  # more nodes per pass over the data
                numTrees=config.dev_num_trees if dev else config.num_trees,
                maxDepth=config.dev_max_depth if dev else config.max_depth)


@dataclass
class TrainedModel:
    """Fitted preparation and estimator; ``predict`` keeps the asked-for columns."""

    task: str
    target: str
    prep: FittedPrep | SparsePrep
    model: Model | Forest
    labels: list[str] | None

    def inputs(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return self.prep.cells(df, keep) if isinstance(self.prep, SparsePrep) else self.prep.vectors(df, keep)

    def score(self, inputs: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Prediction columns for rows that already carry the features."""
        if isinstance(self.model, Forest):
            raw = self.model.score(inputs, keep)
            kept = [col(k) for k in keep]
            if self.task == "regression":
                return raw.select(*kept, F.element_at("raw", 1).alias("prediction"))
            names = F.array(*[F.lit(x) for x in self.labels])
            # The first of equally likely classes.
            return raw.select(*kept, F.element_at(names, F.array_position("raw", F.array_max("raw")).cast("int")).alias("prediction"),
                              F.col("raw").alias("probability"))
        out = self.model.transform(inputs)
        cols = [col(k) for k in keep]
        if self.task == "regression":
            return out.select(*cols, F.col("prediction"))
        names = F.array(*[F.lit(x) for x in self.labels])
        cols.append(F.element_at(names, F.col("prediction").cast("int") + 1).alias("prediction"))
        if "probability" in out.columns:
            cols.append(vector_to_array("probability").alias("probability"))
        return out.select(*cols)

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return self.score(self.inputs(df, keep), keep)

    def predict_probability(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Class probabilities by label order; an estimator without them is an error."""
        out = self.predict(df, keep)
        if "probability" not in out.columns:
            raise AttributeError("the estimator does not give class probabilities")
        return out

    def evaluate(self, df: DataFrame, auc: bool = True) -> DataFrame:
        """(metric, value) on labelled rows; ROC-AUC is added for two classes with probabilities."""
        scored = self.predict(df, [self.target])
        if self.task == "regression":
            return regression_metrics(scored, self.target, "prediction")
        if not (auc and len(self.labels) == 2 and "probability" in scored.columns):
            return classification_metrics(scored, self.target, "prediction")
        # scored once, read by the counts and by the ranking
        narrow = scored.select(col(self.target).cast("string").alias("y"), "prediction",
                               F.element_at("probability", 2).alias("p")).persist()
        try:
            counts = classification_metrics(narrow, "y", "prediction")
            ranked = roc_auc(narrow.withColumn("y", (F.col("y") == self.labels[1]).cast("int")), "y", "p")
            return materialise(counts.unionByName(
                ranked.select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))))
        finally:
            narrow.unpersist()


def _labelled(df: DataFrame, task: str, target: str, names: Sequence[str] | None = None) -> tuple[DataFrame, list[str] | None]:
    """The table with a numeric ``__label`` and, for classes, their names in sorted order, which ``names`` may bring."""
    present = df.filter(col(target).isNotNull())
    if task == "regression":
        return present.withColumn("__label", col(target).cast("double")), None
    text = present.withColumn("__target", col(target).cast("string"))
    if names:
        fitted = StringIndexerModel.from_labels(list(names), "__target", "__label", "error")
    else:
        fitted = StringIndexer(inputCol="__target", outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="error").fit(text)
    return fitted.transform(text).drop("__target"), list(fitted.labels)


def train(df: DataFrame, target: str, task: str, exclude: Sequence[str] = (), estimator: Estimator | None = None,
          config: AuditConfig = DEFAULT, dev: bool = False, partitions: int = TRAIN_PARTITIONS) -> TrainedModel:
    """Fits preparation and estimator on the given (train) rows.

    Rows are dealt to ``partitions`` tasks by the hash of their values; a large table wants more of them.

    ``estimator`` may be any ``pyspark.ml`` estimator with ``features`` and ``label`` inputs.
    """
    task = check_task(task)
    require_columns(df, [target])
    if df.isEmpty():
        raise ValueError("the training table is empty")
    if estimator is None:
        return _train_forest(df, target, task, exclude, config, dev)
    prep = fit_prep(df, [*exclude, target], indicators=False, min_share=0.0)
    rows, labels = _labelled(df, task, target)
    vectors = prep.vectors(rows, ["__label"]).withColumnRenamed("__label", "label")
    # The same rows in the same order on any layout; written down once, as the estimator reads them many times.
    order = F.xxhash64("label", "features")
    dealt = vectors.withColumn("__order", order).repartition(partitions, "__order").sortWithinPartitions("__order").drop("__order").persist()
    try:
        model = estimator.fit(dealt)
    finally:
        dealt.unpersist()
    return TrainedModel(task, target, prep, model, labels)


def _forest_tasks(count: int, columns: int) -> int:
    """To how many tasks the rows of a forest are dealt."""
    return max(min(-(-count // FOREST_ROWS), FOREST_TASKS), -(-count * (16 + 4 * columns) // FOREST_BYTES), 1)


def _dealt(rows: DataFrame, by: str, tasks: int, task: str) -> DataFrame:
    """Rows by their hash; in its order where the order of sums can show (counts of classes are whole numbers)."""
    out = rows.repartition(tasks, by)
    return out if task == "classification" else out.sortWithinPartitions(by)


def _train_forest(df: DataFrame, target: str, task: str, exclude: Sequence[str], config: AuditConfig, dev: bool,
                  prep: SparsePrep | None = None, told: tuple[int, list[str]] | None = None) -> TrainedModel:
    """The default: a forest over sparse cells, whatever the number of categories.

    Rows that are dealt already bring their hash as ``__h``, and as ``told`` the number of labelled ones and the classes.
    """
    prep = prep or fit_sparse(df, [*exclude, target], BINS)
    rows, labels = _labelled(df, task, target, told and told[1])
    count = rows.count() if told is None else told[0]
    # Whole rows, their key included, decide which trees draw them.
    hashed = rows if told is not None else rows.withColumn("__h", F.xxhash64(*[col(c) for c in df.columns]))
    dealt = prep.cells(hashed, ["__h", "__label"]).select(F.col("__h").alias("h"), F.col("__label").alias("y"), "x", "c")
    if told is None:
        dealt = _dealt(dealt, "h", _forest_tasks(count, len(prep.numeric) + len(prep.categorical)), task)
    forest = grow(dealt, prep.edges, prep.sizes, len(labels) if labels is not None else 0,
                  config.dev_num_trees if dev else config.num_trees, config.dev_max_depth if dev else config.max_depth, config.seed, count=count)
    return TrainedModel(task, target, prep, forest, labels)


def cross_validate(df: DataFrame, target: str, task: str, key: str, exclude: Sequence[str] = (),
                   folds: int = DEFAULT.cv_folds, estimator: Estimator | None = None,
                   config: AuditConfig = DEFAULT, dev: bool = False, parallelism: int = 5) -> DataFrame:
    """(metric, cv_mean, cv_std, cv_folds): weighted F1 over stratified folds or RMSE over hashed ones, population deviation.

    No fold's preparation sees its own rows; for the default forest all are fitted together from counts and quantiles
    that leave one fold out each, and the rows are dealt to tasks once for all folds.  Folds are independent and run side by side, as in Spark's own cross-validator.
    """
    task = check_task(task)
    metric = "f1" if task == "classification" else "rmse"
    used = [c for c in df.columns if c not in exclude]
    narrow = df.select(*[col(c) for c in used])
    # Classes are shared out evenly; numbers have no classes.
    tagged = (stratified_folds(narrow, key, target, folds).withColumnRenamed("fold", "__fold") if task == "classification"
              else narrow.withColumn("__fold", fold_of(key, folds)))
    if estimator is None:
        hashed = tagged.withColumn("__h", F.xxhash64(*[col(c) for c in tagged.columns]))
        tagged = _dealt(hashed, "__h", _forest_tasks(narrow.count(), len(used)), task)
    tagged = tagged.persist()

    preps, told = None, {}
    if estimator is None:
        preps = fit_sparse_folds(tagged, "__fold", folds, [key, target, "__h"], BINS)
        label = col(target).cast("string") if task == "classification" else F.lit("")
        # a row per fold and class
        sizes = tagged.filter(col(target).isNotNull()).groupBy("__fold", label.alias("label")).count().collect()
        for k in range(folds):
            rest = [r for r in sizes if r["__fold"] not in (None, k)]
            # in the order of Java's strings
            told[k] = sum(r["count"] for r in rest), sorted({r["label"] for r in rest}, key=lambda x: x.encode("utf-16-be", "surrogatepass"))

    def score(k: int) -> float:
        rest = tagged.filter(F.col("__fold") != k)
        if preps is not None:
            fitted = _train_forest(rest, target, task, [key, "__fold", "__h"], config, dev, preps[k], told[k])
        else:
            fitted = train(rest, target, task, [key, "__fold"], estimator.copy(), config, dev)
        held = tagged.filter(F.col("__fold") == k).filter(col(target).isNotNull())
        return float(next(r["value"] for r in fitted.evaluate(held, auc=False).collect() if r["metric"] == metric))

    try:
        with ThreadPool(min(parallelism, folds)) as pool:
            scores = pool.map(inheritable_thread_target(df.sparkSession)(score), range(folds))
    finally:
        tagged.unpersist()
    name = "f1_weighted" if task == "classification" else "root_mean_squared_error"
    return local_frame(df.sparkSession, [(name, float(np.mean(scores)), float(np.std(scores)), folds)],
                       "metric string, cv_mean double, cv_std double, cv_folds int")


def cv_fold_sizes(df: DataFrame, key: str, target: str, folds: int = DEFAULT.cv_folds) -> DataFrame:
    """(fold, class, n): how the key-hash folds share out the classes."""
    return (df.select(fold_of(key, folds).alias("fold"), col(target).cast("string").alias("class"))
            .groupBy("fold", "class").agg(F.count(F.lit(1)).alias("n")))


def cv_stratified_sizes(df: DataFrame, key: str, target: str, folds: int = DEFAULT.cv_folds) -> DataFrame:
    """(fold, class, n): how the stratified folds share out the classes."""
    return (stratified_folds(df.select(col(key), col(target)), key, target, folds)
            .groupBy("fold", col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n")))


def _raw_importance(trained: TrainedModel) -> np.ndarray | None:
    model = trained.model
    if hasattr(model, "featureImportances"):
        return np.asarray(model.featureImportances.toArray())
    if hasattr(model, "coefficientMatrix"):
        return np.abs(np.asarray(model.coefficientMatrix.toArray())).mean(axis=0)
    if hasattr(model, "coefficients"):
        return np.abs(np.asarray(model.coefficients.toArray()))
    return None


def feature_importance(trained: TrainedModel, df: DataFrame | None = None, key: str | None = None,
                       by_column: bool = False) -> DataFrame:
    """(feature, importance, rank), summing to 1 where the total is positive.

    Taken from the model, else from its coefficients, else by permutation on ``df`` (then per input column).
    ``by_column`` adds one-hot parts back to their input column.  Categories that no split of a forest uses share the
    rank behind the last one.
    """
    spark = (df.sparkSession if df is not None else None) or _active()
    if isinstance(trained.model, Forest):
        return _forest_importance(trained, spark, by_column)
    raw = _raw_importance(trained)
    if raw is None:
        if df is None or key is None:
            raise ValueError("this model has no importances of its own; pass rows and their key")
        drops = permutation_importance(trained, df, key).collect()  # one row per input column
        names, raw = [r["feature"] for r in drops], np.array([r["importance"] for r in drops])
    else:
        names = trained.prep.origin() if by_column else trained.prep.feature_names
    total = float(raw.sum())
    scaled = raw / total if total > 0 else raw
    merged: dict[str, float] = {}
    for name, v in zip(names, scaled):
        merged[name] = merged.get(name, 0.0) + float(v)
    return _ranked(spark, merged)


def _ranked(spark, importance: dict[str, float]) -> DataFrame:
    ordered = sorted(importance.items(), key=lambda x: (-x[1], x[0]))
    return local_frame(spark, [(n, v, i + 1) for i, (n, v) in enumerate(ordered)], IMPORTANCE)


def _forest_importance(trained: TrainedModel, spark, by_column: bool) -> DataFrame:
    prep, found = trained.prep, trained.model.importances()
    numeric = {c: found.get((-1, j), 0.0) for j, c in enumerate(prep.numeric)}
    if by_column:
        text = dict.fromkeys(prep.categorical, 0.0)
        for (kind, _), v in found.items():
            if kind >= 0:
                text[prep.categorical[kind]] += v
        return _ranked(spark, numeric | text)
    if not prep.categorical:
        return _ranked(spark, numeric)
    # At most one row per split of the forest.
    used = F.broadcast(local_frame(spark, [(k, f, v) for (k, f), v in found.items() if k >= 0], "kind int, f bigint, importance double"))
    names = prep.category_names()
    named = {r["feature"]: r["importance"] for r in names.join(used, ["kind", "f"]).collect()}
    rest = names.join(used, ["kind", "f"], "left_anti").select(
        "feature", F.lit(0.0).alias("importance"), F.lit(len(numeric) + len(named) + 1).cast("int").alias("rank"))
    return _ranked(spark, numeric | named).unionByName(rest)


def _active():
    from pyspark.sql import SparkSession
    return SparkSession.active()


def permutation_pairs(keys: DataFrame, key: str, repeats: int = DEFAULT.permutation_repeats) -> DataFrame:
    """(key, repeat, donor): every row's partner in each of ``repeats`` shuffles of the whole table.

    Rows are numbered by the digest of their key, and once more for each repeat by that of key and repeat; equal numbers
    meet.  Numbers come from counts per digest prefix and ranks within a prefix, so no task sorts the table.  Repeated
    keys count as one row.
    """
    rows = keys.select(col(key).alias("key")).distinct()
    text = F.col("key").cast("string")
    own = rows.select("key", F.explode(F.sequence(F.lit(0), F.lit(repeats))).alias("repeat")).select(
        "key", "repeat", F.md5(F.when(F.col("repeat") == 0, text).otherwise(F.concat_ws("|", text, F.col("repeat").cast("string")))).alias("digest"))
    own = own.withColumn("prefix", F.substring("digest", 1, 3))
    counts = own.groupBy("repeat", "prefix").count()  # at most 4096 rows a repeat
    before = F.sum("count").over(Window.partitionBy("repeat").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("repeat", "prefix", F.coalesce(before, F.lit(0)).alias("offset")))
    inside = F.row_number().over(Window.partitionBy("repeat", "prefix").orderBy("digest", "key"))
    numbered = own.withColumn("inside", inside).join(offsets, ["repeat", "prefix"]).select(
        "key", "repeat", (F.col("inside") + F.col("offset")).alias("number"))
    first = numbered.filter("repeat = 0").select("key", "number")
    return first.join(numbered.filter("repeat > 0").select(F.col("key").alias("donor"), "repeat", "number"), "number").select("key", "repeat", "donor")


def _shuffled_scores(trained: TrainedModel, met: DataFrame, used: list[str]) -> DataFrame:
    """(f, t, y, p, n, e2, y1, y2): rows as scored with column ``f`` taken from their donors (-1: none), counted by class
    label and prediction, or summed up for regression.  A forest walks again only with rows that the donor's value turns off their way."""
    named = {c: f"__d{j}" for j, c in enumerate(used)}
    classify = trained.task == "classification"
    if not isinstance(trained.model, Forest):
        # One copy per input column: a model of any kind scores rows of the table's own shape.
        copies = met.withColumn("__f", F.explode(F.sequence(F.lit(-1), F.lit(len(used) - 1)))).filter("__f >= 0 or __t = 1")
        swapped = copies.select("__f", "__t", "__y", *[F.when(F.col("__f") == j, col(named[c])).otherwise(col(c)).alias(c) for j, c in enumerate(used)])
        scored = trained.predict(swapped, ["__f", "__t", "__y"]).select(
            F.col("__f").alias("f"), F.col("__t").alias("t"), F.col("__y").alias("y"), F.col("prediction").alias("p"))
        if classify:
            return scored.groupBy("f", "t", "y", "p").agg(F.count(F.lit(1)).alias("n"), *[F.lit(0.0).alias(n) for n in ("e2", "y1", "y2")])
        y, e = F.col("y").cast("double"), F.col("y").cast("double") - F.col("p")
        return scored.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("e2"), F.sum(y).alias("y1"), F.sum(y * y).alias("y2"))
    (x, c), (dx, dc) = trained.prep.arrays(met), trained.prep.arrays(met, named)
    shared = met.sparkSession.sparkContext.broadcast((trained.model, trained.labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, labels = shared.value
        walks = forest.walks()
        for batch in merged(batches):
            runs, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            y = batch.column(1).to_pandas()
            codes, actual = pd.factorize(y) if labels is not None else (y.astype(float).to_numpy(), None)
            parts = []
            for f, raw in forest.shuffled(*batch.columns[2:], walks):
                if labels is not None:
                    keys = (of * len(actual) + codes) * len(labels) + raw.argmax(axis=1)
                    n = np.bincount(keys, minlength=len(runs) * len(actual) * len(labels))
                    at = np.flatnonzero(n)
                    pair = at // len(labels)
                    part = {"f": f, "t": runs[pair // len(actual)], "y": np.array(actual, object)[pair % len(actual)],
                            "p": np.array(labels, object)[at % len(labels)], "n": n[at], "e2": 0.0, "y1": 0.0, "y2": 0.0}
                else:
                    sums = [np.bincount(of, v) for v in ((codes - raw[:, 0]) ** 2, codes, codes ** 2)]
                    part = {"f": f, "t": runs, "y": "", "p": "", "n": np.bincount(of), **dict(zip(("e2", "y1", "y2"), sums))}
                pdf = pd.DataFrame(part)
                parts.append(pdf if f >= 0 else pdf[pdf["t"] == 1])
            yield pa.RecordBatch.from_pandas(pd.concat(parts)[["f", "t", "y", "p", "n", "e2", "y1", "y2"]], preserve_index=False)

    scored = met.select("__t", "__y", x.alias("x"), c.alias("c"), dx.alias("dx"), dc.alias("dc")).mapInArrow(
        score, "f bigint, t bigint, y string, p string, n bigint, e2 double, y1 double, y2 double")
    return scored.groupBy("f", "t", "y", "p").agg(*[F.sum(n).alias(n) for n in ("n", "e2", "y1", "y2")])


def permutation_importance(trained: TrainedModel, df: DataFrame, key: str,
                           repeats: int = DEFAULT.permutation_repeats) -> DataFrame:
    """(position, feature, importance, importance_std): score lost when one input column is shuffled over the whole table.

    The partners of ``permutation_pairs`` lend their values; rows of a repeated or missing key take no part.  Accuracy for
    classes, R2 for numbers.
    """
    prep, target = trained.prep, trained.target
    used = [*prep.numeric, *prep.categorical]
    rows = df.filter(col(target).isNotNull() & col(key).isNotNull()).select(
        col(key).alias("__key"), col(target).cast("string").alias("__y"), *[col(c) for c in used])
    rows = stored(rows, "permuted")
    donors = rows.select(col("__key").alias("__donor"), *[col(c).alias(f"__d{j}") for j, c in enumerate(used)])
    pairs = permutation_pairs(rows, "__key", repeats).select(F.col("key").alias("__key"), F.col("repeat").cast("bigint").alias("__t"), F.col("donor").alias("__donor"))
    met = rows.join(pairs, "__key").join(donors, "__donor")
    counted = _shuffled_scores(trained, met, used)
    if trained.task == "classification":
        matrix = counted.select("f", "t", F.col("y").alias("actual"), F.col("p").alias("predicted"), F.col("n").alias("cnt"))
        scores = metrics_from_confusion(matrix, ("f", "t")).filter("metric = 'accuracy'").select("f", "t", "value")
    else:
        whole = counted.groupBy("f", "t").agg(*[F.sum(n).alias(n) for n in ("n", "e2", "y1", "y2")])
        spread = F.col("y2") - F.col("y1") * F.col("y1") / F.col("n")
        scores = whole.select("f", "t", (1 - F.try_divide("e2", spread)).alias("value"))
    found = scores.collect()  # input columns x repeats numbers
    base = next((r["value"] for r in found if r["f"] == -1), None)
    drops: dict[int, list[float]] = {}
    for r in sorted(found, key=lambda r: (r["f"], r["t"])):
        if r["f"] >= 0:
            drops.setdefault(r["f"], []).append(base - r["value"])
    return local_frame(df.sparkSession, [(f, used[f], float(np.mean(v)), float(np.std(v))) for f, v in sorted(drops.items())],
                       "position int, feature string, importance double, importance_std double")


def train_and_summarise(train_rows: DataFrame, holdout_rows: DataFrame, target: str, task: str,
                        exclude: Sequence[str] = (), estimator: Estimator | None = None,
                        config: AuditConfig = DEFAULT, dev: bool = False) -> tuple[TrainedModel, DataFrame]:
    """The trained model and its (split, metric, value) table, scored on each split's own rows."""
    fitted = train(train_rows, target, task, exclude, estimator, config, dev)
    parts = [fitted.evaluate(rows).select(F.lit(name).alias("split"), "metric", "value")
             for name, rows in (("train", train_rows), ("holdout", holdout_rows))]
    return fitted, parts[0].unionByName(parts[1])
