"""Combining model answers. Models appear as columns ``pred_<name>`` (0/1) and ``p_<name>``;

NULL means the model gave no answer for the row. A scorer is any function from
DataFrame to DataFrame that adds such a pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Model weights and the alert confidence.
WEIGHTS = {"knn": 0.3, "mlp": 0.35, "xgb": 0.35}
ALERT_CONFIDENCE = 0.7


def _sum(columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + c
    return total


def _answered(name: str, value: str, weight: float) -> tuple[Column, Column]:
    """Weighted value and weight of one model, both 0 when it did not answer."""
    c = F.col(f"{value}_{name}")
    return (
        F.coalesce(c.cast("double") * F.lit(float(weight)), F.lit(0.0)),
        F.when(c.isNotNull(), F.lit(float(weight))).otherwise(F.lit(0.0)),
    )


def majority(weights: dict[str, float] = WEIGHTS) -> Column:
    """Most frequent vote; a tie, or no vote at all, gives 0."""
    ones = _sum([_answered(n, "pred", 1.0)[0] for n in weights])
    votes = _sum([_answered(n, "pred", 1.0)[1] for n in weights])
    return F.when(ones > votes - ones, 1).otherwise(0)


def weighted(weights: dict[str, float] = WEIGHTS) -> Column:
    """1 when the answering models' weighted vote is strictly above one half."""
    top = _sum([_answered(n, "pred", w)[0] for n, w in weights.items()])
    bottom = _sum([_answered(n, "pred", w)[1] for n, w in weights.items()])
    return F.when(bottom > 0, F.when(top / bottom > 0.5, 1).otherwise(0)).otherwise(majority(weights))


def mean_probability(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean P(attack) over the models that answered, NULL when none did."""
    top = _sum([_answered(n, "p", w)[0] for n, w in weights.items()])
    bottom = _sum([_answered(n, "p", w)[1] for n, w in weights.items()])
    return F.when(bottom > 0, top / bottom)


def soft(weights: dict[str, float] = WEIGHTS, threshold: float = 0.5) -> Column:
    p = mean_probability(weights)
    return F.when(p.isNull(), majority(weights)).when(p > threshold, 1).otherwise(0)


def stacked(weights: dict[str, float] = WEIGHTS) -> Column:
    """Vote of a stacking model that added ``pred_stack``; the weighted vote where it is missing."""
    return F.coalesce(F.col("pred_stack").cast("int"), weighted(weights))


STRATEGIES: dict[str, Callable[..., Column]] = {
    "majority_voting": majority, "weighted_voting": weighted, "soft_voting": soft, "stacking": stacked,
}


def vote(strategy: str = "weighted_voting", weights: dict[str, float] = WEIGHTS) -> Column:
    """Vote column by strategy name; an unknown name means the weighted vote."""
    return STRATEGIES.get(strategy, weighted)(weights)


def hybrid(ensemble: Column, is_anomaly: Column, mode: str = "hybrid") -> Column:
    """An anomaly is an attack whatever the ensemble says; without a detector the ensemble decides."""
    if mode == "ensemble_only":
        return ensemble
    if mode == "anomaly_only":
        return F.when(is_anomaly, 1).otherwise(0)
    return F.when(is_anomaly, 1).otherwise(ensemble)


def score(df: DataFrame, strategy: str = "weighted_voting", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds prediction, is_attack, attack_probability, confidence and the votes of each model."""
    probability = F.coalesce(mean_probability(weights), F.lit(0.5))
    votes = F.create_map(*[
        x for n in weights for x in (F.lit(n), F.coalesce(F.col(f"pred_{n}").cast("double"), F.lit(0.0)))
    ])
    out = df.withColumn("prediction", vote(strategy, weights)).withColumn("attack_probability", probability)
    out = out.withColumn("is_attack", F.col("prediction") == 1)
    out = out.withColumn("confidence", F.greatest("attack_probability", 1 - F.col("attack_probability")))
    return out.withColumn("votes", votes)


def labelled(scored: DataFrame, valid: Column, strategy: str = "weighted_voting") -> DataFrame:
    """Attack / Normal / Error record; invalid input is an error, never a silent Normal."""
    return scored.select(
        "id",
        F.when(valid, F.col("prediction")).otherwise(-1).alias("prediction"),
        F.when(~valid, "Error").when(F.col("prediction") == 1, "Attack").otherwise("Normal").alias("label"),
        F.when(valid, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(valid, F.struct(
            (1 - F.col("attack_probability")).alias("normal"), F.col("attack_probability").alias("attack")
        )).alias("probabilities"),
        F.lit(strategy).alias("strategy"),
        F.when(valid, "success").otherwise("error").alias("status"),
    )


def prediction_details(scored: DataFrame) -> DataFrame:
    """Everything behind a decision in one struct."""
    return scored.select("id", F.struct(
        F.col("prediction").alias("ensemble_prediction"),
        F.col("attack_probability").alias("ensemble_probability"),
        F.col("is_anomaly"),
        hybrid(F.col("prediction"), F.col("is_anomaly")).alias("hybrid_prediction"),
        F.col("confidence"),
    ).alias("details"))


def batch_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("total_logs"), F.count_if("is_attack").alias("attacks_detected"))


def alert_rows(scored: DataFrame, timestamp: Column, confidence: float = ALERT_CONFIDENCE) -> DataFrame:
    """Alerts of confident attacks."""
    chosen = scored.filter(F.col("is_attack") & (F.col("confidence") >= confidence))
    return chosen.select(
        F.lit("intrusion").alias("type"), timestamp.alias("timestamp"), F.col("id").alias("log_id"),
        F.lit("Intrusion détectée").alias("message"), "attack_probability", "confidence", F.col("votes").alias("models"),
    )
