"""Evaluation and progressive rounds: what they give, and how often they read their rows."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
import pytest

from flowquarry.operators import metrics, prepare, training


def counted(spark, df):
    """``df`` with its labels passing a function, and the number of rows that passed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def passed(label):
        seen.add(1)
        return label

    return df.withColumn("label", passed.asNondeterministic()("label")), seen


def test_evaluation_scores_its_rows_once(spark):
    rows = spark.createDataFrame([(i % 2, int(i % 3 == 0), 0.1 + i / 25) for i in range(20)], "label int, pred int, p double").coalesce(1)
    scored, seen = counted(spark, rows)
    found = training.evaluate_scored(scored).first()
    assert seen.value == 20
    parts = {**metrics.binary_metrics(rows).first().asDict(), **metrics.log_loss(rows).first().asDict(), "rows": 20}
    assert list(found.asDict()) == list(parts) and found.asDict() == pytest.approx(parts)
    none = training.evaluate_scored(rows.where("false")).first()
    assert none["rows"] == 0 and none["accuracy"] == 0 and none["log_loss"] is None


def test_rounds_read_the_ranked_rows_once(spark):
    rows = spark.range(80).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.col("id") % 7 / 10.0).alias("a"))
    ranked = spark.createDataFrame(prepare.ranked_in_class(rows, ["id"]).collect()).coalesce(2)
    watched, seen = counted(spark, ranked)
    forest = training.random_forest(numTrees=3)
    found = training.train_progressively(watched, rows, ["a"], forest, rounds=3)
    assert seen.value == 80
    assert [(r["round"], r["train_size"]) for r in found.rounds] == [(0, 16), (1, 48), (2, 80)]
    # All rounds are right, and the first of the best is kept.
    assert [r["val_accuracy"] for r in found.rounds] == [1.0] * 3 and found.best_round == 0
    assert isinstance(found.best, PipelineModel)


def test_fits_run_together_and_keep_their_names(spark):
    done = training.side_by_side(spark, [lambda n=n: spark.range(n).count() for n in range(6)])
    assert done == list(range(6)) and training.side_by_side(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        training.side_by_side(spark, [lambda: 1 // 0, lambda: 1])
