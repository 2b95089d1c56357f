"""Evaluation of predictions. Input columns: ``label``, ``pred`` (0/1) and optionally ``p`` = P(label 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.numeric import ratio

_EPS = 1e-15


def _f1(precision, recall):
    return ratio(2 * precision * recall, precision + recall)


def _cells() -> list[Column]:
    label, pred = F.col("label"), F.col("pred")
    return [
        F.count_if((label == 0) & (pred == 0)).alias("tn"), F.count_if((label == 0) & (pred == 1)).alias("fp"),
        F.count_if((label == 1) & (pred == 0)).alias("fn"), F.count_if((label == 1) & (pred == 1)).alias("tp"),
    ]


def confusion(df: DataFrame) -> DataFrame:
    """tn, fp, fn, tp and their share of all rows in percent."""
    counts = df.agg(*_cells())
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return counts.select("*", *[(ratio(F.col(c), total) * 100).alias(f"{c}_pct") for c in ("tn", "fp", "fn", "tp")])


def binary_metrics(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1, error rates and specificity; 0 on empty divisors."""
    return _rates(df.agg(*_cells()))


def _rates(cells: DataFrame, *more: str) -> DataFrame:
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    out = cells.select(
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(fp, fp + tn).alias("false_positive_rate"), ratio(fn, fn + tp).alias("false_negative_rate"),
        ratio(tn, tn + fp).alias("specificity"), *more,
    )
    f1 = _f1(F.col("precision"), F.col("recall")).alias("f1")
    return out.select(*[c for c in out.columns if c not in more], f1, *more)


def evaluation(df: DataFrame) -> DataFrame:
    """Binary metrics, log loss and the number of rows in one row, by one aggregate: the rows are scored once."""
    return _rates(df.agg(*_cells(), _loss().alias("log_loss"), F.count("*").alias("rows")), "log_loss", "rows")


def weighted_metrics(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class, averaged by the class's number of rows."""
    cells = df.groupBy("label", "pred").agg(F.count("*").alias("n"))
    votes = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("claimed"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("claimed"),
                 F.lit(0).cast("bigint").alias("hit")),
    )
    classes = cells.select(F.inline(votes)).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("actual", "claimed", "hit")])
    classes = classes.withColumn("precision", ratio(F.col("hit"), F.col("claimed")))
    classes = classes.withColumn("recall", ratio(F.col("hit"), F.col("actual")))
    classes = classes.withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    return classes.agg(*[
        ratio(F.sum(F.col(c) * F.col("actual")), F.sum("actual")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")
    ])


def log_loss(df: DataFrame) -> DataFrame:
    """Mean negative log probability of the true class; from the accuracy where probabilities are missing."""
    return df.agg(_loss().alias("log_loss"))


def _loss() -> Column:
    right = F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p"))
    loss = F.avg(-F.ln(F.greatest(F.lit(_EPS), F.least(F.lit(1 - _EPS), right))))
    accuracy = F.avg((F.col("label") == F.col("pred")).cast("int"))
    broken = F.count_if(F.col("p").isNull() | F.isnan("p")) > 0
    fallback = -F.ln(F.greatest(F.lit(0.001), accuracy))
    return F.when(broken, fallback).otherwise(loss)


def listing(predictions: DataFrame, labels: DataFrame, on: str = "id") -> DataFrame:
    """Prediction next to the true label, with a match flag."""
    return predictions.join(labels, on).withColumn("match", F.col("pred") == (F.col("label") == 1).cast("int"))


def latency(df: DataFrame, column: str) -> DataFrame:
    """Average, extremes and the throughput the average allows (milliseconds in, per second out)."""
    stats = df.agg(
        F.count(column).alias("n"), F.avg(column).alias("avg_ms"), F.min(column).alias("min_ms"), F.max(column).alias("max_ms")
    )
    return stats.withColumn("per_second", ratio(F.lit(1000.0), F.col("avg_ms")))
