"""Scores of stored predictions, from grouped counts rather than row lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import EPSILON
from ..functions.selection import SORT_ROWS, prefix_sums
from ..schema import col


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, cnt)."""
    return (df.select(col(actual).cast("string").alias("actual"), col(predicted).cast("string").alias("predicted"))
            .groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("cnt")))


def metrics_from_confusion(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """([by], metric, value): accuracy and support-weighted precision, recall and F1; 0 where undefined."""
    keys = [col(b) for b in by]
    sides = matrix.select(*keys, F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("cnt").alias("support"), F.lit(0).cast("bigint").alias("called"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("cnt")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("cnt").alias("called"), F.lit(0).cast("bigint").alias("hit")))).alias("s")).select(*keys, "s.*")
    per = sides.groupBy(*keys, "label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"),
                                            F.sum("hit").alias("hit"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    precision, recall = ratio(F.col("hit"), F.col("called")), ratio(F.col("hit"), F.col("support"))
    f1 = ratio(2 * F.col("hit"), F.col("called") + F.col("support"))
    n = F.sum("support")
    wide = per.groupBy(*keys).agg(
        (F.sum("hit") / n).alias("accuracy"), (F.sum(precision * F.col("support")) / n).alias("precision"),
        (F.sum(recall * F.col("support")) / n).alias("recall"), (F.sum(f1 * F.col("support")) / n).alias("f1"))
    return wide.unpivot(keys, ["accuracy", "precision", "recall", "f1"], "metric", "value")


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(metric, value): accuracy, precision, recall, f1."""
    return metrics_from_confusion(confusion_matrix(df, actual, predicted))


def roc_auc(df: DataFrame, label: str, score: str, small: int = SORT_ROWS) -> DataFrame:
    """(positives, negatives, roc_auc): chance that a positive outranks a negative, ties count half.

    Rows are grouped by distinct score first; running totals over scores are taken bucket by bucket.
    """
    grouped = (df.select(col(score).cast("double").alias("s"), col(label).cast("int").alias("y"))
               .filter("s is not null and y is not null").groupBy("s")
               .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    ranked = prefix_sums(grouped, "s", ["neg"], small)
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    total = F.sum("pos") * F.sum("neg")
    return ranked.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
                      F.try_divide(wins, total.cast("double")).alias("roc_auc"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(metric, value): rmse, mae, r2."""
    y, e = col(actual).cast("double"), col(actual).cast("double") - col(predicted).cast("double")
    wide = df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                  (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"))
    return wide.unpivot([], ["rmse", "mae", "r2"], "metric", "value")


def calibration_curve(df: DataFrame, label: str, probability: str, bins: int = 10) -> DataFrame:
    """(bin, n, predicted, actual) for all equal-width bins of the clipped probability."""
    p = F.least(F.greatest(col(probability).cast("double"), F.lit(0.0)), F.lit(1.0))
    rows = df.select(p.alias("p"), col(label).cast("double").alias("y")).filter("p is not null")
    counts = (rows.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("bigint").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy")))
    grid = df.sparkSession.range(0, bins, 1, 1).withColumnRenamed("id", "bin")
    full = grid.join(F.broadcast(counts), "bin", "left").na.fill(0)  # `bins` rows on both sides
    size = F.col("n") + F.lit(EPSILON)
    return full.select("bin", "n", (F.col("sp") / size).alias("predicted"), (F.col("sy") / size).alias("actual"))


def calibration_error(curve: DataFrame) -> DataFrame:
    """(expected_calibration_error, is_well_calibrated): unweighted mean gap over filled bins."""
    ece = F.avg(F.when(F.col("n") > 0, F.abs(F.col("predicted") - F.col("actual"))))
    return curve.agg(ece.alias("expected_calibration_error"), (ece < 0.05).alias("is_well_calibrated"))


def confidence_spread(df: DataFrame, probability: str) -> DataFrame:
    """Shares of confident, middling and unsure predictions, their mean and population deviation."""
    p = col(probability).cast("double")
    return df.agg(
        (F.avg((p > 0.8).cast("double")) * 100).alias("high_confidence_pct"),
        (F.avg(((p >= 0.5) & (p <= 0.8)).cast("double")) * 100).alias("medium_confidence_pct"),
        (F.avg((p < 0.5).cast("double")) * 100).alias("low_confidence_pct"),
        F.avg(p).alias("mean_confidence"), F.stddev_pop(p).alias("confidence_std"))


def max_probability(df: DataFrame, vector: str = "probability", out: str = "confidence") -> DataFrame:
    """The largest class probability of an ML probability vector."""
    from pyspark.ml.functions import vector_to_array
    return df.withColumn(out, F.array_max(vector_to_array(col(vector))))
