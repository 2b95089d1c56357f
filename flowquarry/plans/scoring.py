"""Queries of evaluation metrics and ensemble scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import ensemble as H
from flowquarry.operators import metrics as G
from flowquarry.plans.registry import query
from flowquarry.plans.views import HEALTH_SQL, SCORES_SQL, health, scores
from flowquarry.sources import records as R

_VOTE_SQL = SCORES_SQL + """,
w0 AS (SELECT *,
    coalesce(pred_knn, 0) + coalesce(pred_mlp, 0) + coalesce(pred_xgb, 0) AS ones,
    (pred_knn IS NOT NULL)::INT + (pred_mlp IS NOT NULL)::INT + (pred_xgb IS NOT NULL)::INT AS votes,
    0.0::DOUBLE + coalesce(pred_knn * 0.3::DOUBLE, 0) + coalesce(pred_mlp * 0.35::DOUBLE, 0)
      + coalesce(pred_xgb * 0.35::DOUBLE, 0) AS top,
    CASE WHEN pred_knn IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN pred_mlp IS NOT NULL THEN 0.35::DOUBLE ELSE 0 END
      + CASE WHEN pred_xgb IS NOT NULL THEN 0.35::DOUBLE ELSE 0 END AS bottom,
    coalesce(p_knn * 0.3::DOUBLE, 0) + coalesce(p_mlp * 0.35::DOUBLE, 0) + coalesce(p_xgb * 0.35::DOUBLE, 0) AS ptop,
    CASE WHEN p_knn IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN p_mlp IS NOT NULL THEN 0.35::DOUBLE ELSE 0 END
      + CASE WHEN p_xgb IS NOT NULL THEN 0.35::DOUBLE ELSE 0 END AS pbottom
  FROM sc),
w1 AS (SELECT *, CASE WHEN ones > votes - ones THEN 1 ELSE 0 END AS majority,
    CASE WHEN pbottom > 0 THEN ptop / pbottom END AS p FROM w0),
w2 AS (SELECT *, CASE WHEN bottom > 0 THEN CASE WHEN top / bottom > 0.5 THEN 1 ELSE 0 END ELSE majority END AS weighted,
    CASE WHEN p IS NULL THEN majority WHEN p > 0.5 THEN 1 ELSE 0 END AS soft,
    coalesce(p, 0.5) AS attack_probability, greatest(coalesce(p, 0.5), 1 - coalesce(p, 0.5)) AS confidence FROM w1)"""
# Rows with every answer, as label, pred and p.
_EVAL_SQL = _VOTE_SQL + ", ev AS (SELECT id, truth AS label, weighted AS pred, coalesce(p, 0.5) AS p FROM w2)"
_CELLS_SQL = _EVAL_SQL + """, cm AS (SELECT count(*) FILTER (label = 0 AND pred = 0) AS tn,
  count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn,
  count(*) FILTER (label = 1 AND pred = 1) AS tp FROM ev)"""


def _scored(spark, folder):
    return H.score(scores(spark, folder))


def _evaluated(spark, folder):
    return _scored(spark, folder).select(
        "id", F.col("truth").alias("label"), F.col("prediction").alias("pred"), F.col("attack_probability").alias("p")
    )


@query("accuracy", "G01", f"WITH {_EVAL_SQL} SELECT round(avg((label = pred)::INT), 6) AS accuracy FROM ev")
def _(spark, folder):
    return G.binary_metrics(_evaluated(spark, folder)).select(F.round("accuracy", 6).alias("accuracy"))


@query("precision_recall_f1", "G02", f"""WITH {_CELLS_SQL}, q AS (SELECT coalesce(tp / nullif(tp + fp, 0), 0) AS pr,
  coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM cm)
SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM q""")
def _(spark, folder):
    m = G.binary_metrics(_evaluated(spark, folder))
    return m.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("weighted_precision_recall_f1", "G03", f"""WITH {_EVAL_SQL}, k AS (
  SELECT c.class, count(*) FILTER (label = c.class) AS actual, count(*) FILTER (pred = c.class) AS claimed,
    count(*) FILTER (label = c.class AND pred = c.class) AS hit FROM ev, (VALUES (0), (1)) c(class) GROUP BY c.class),
q AS (SELECT actual, coalesce(hit / nullif(claimed, 0), 0) AS pr, coalesce(hit / nullif(actual, 0), 0) AS re FROM k),
z AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f FROM q)
SELECT round(sum(pr * actual) / sum(actual), 6) AS weighted_precision, round(sum(re * actual) / sum(actual), 6) AS weighted_recall,
  round(sum(f * actual) / sum(actual), 6) AS weighted_f1 FROM z""")
def _(spark, folder):
    m = G.weighted_metrics(_evaluated(spark, folder))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("log_loss", "G04", f"""WITH {_EVAL_SQL} SELECT round(avg(-ln(greatest(1e-15, least(1 - 1e-15,
  CASE WHEN label = 1 THEN p ELSE 1 - p END)))), 6) AS log_loss FROM ev""")
def _(spark, folder):
    return G.log_loss(_evaluated(spark, folder)).select(F.round("log_loss", 6).alias("log_loss"))


@query("log_loss_fallback", "G04", f"""WITH {_EVAL_SQL}
SELECT round(-ln(greatest(0.001, avg((label = pred)::INT))), 6) AS log_loss FROM ev""")
def _(spark, folder):
    broken = _evaluated(spark, folder).withColumn("p", F.when(F.col("id") % 5 != 0, F.col("p")))
    return G.log_loss(broken).select(F.round("log_loss", 6).alias("log_loss"))


_PCT = ", ".join(f"round({c} / (tn + fp + fn + tp) * 100, 6) AS {c}_pct" for c in ("tn", "fp", "fn", "tp"))


@query("confusion_matrix", "G05", f"WITH {_CELLS_SQL} SELECT tn, fp, fn, tp, {_PCT} FROM cm")
def _(spark, folder):
    m = G.confusion(_evaluated(spark, folder))
    return m.select("tn", "fp", "fn", "tp", *[F.round(f"{c}_pct", 6).alias(f"{c}_pct") for c in ("tn", "fp", "fn", "tp")])


@query("error_rates", "G06 G07", f"""WITH {_CELLS_SQL}
SELECT round(fp / (fp + tn), 6) AS false_positive_rate, round(fn / (fn + tp), 6) AS false_negative_rate,
  round(tn / (tn + fp), 6) AS specificity FROM cm""")
def _(spark, folder):
    m = G.binary_metrics(_evaluated(spark, folder))
    return m.select(*[F.round(c, 6).alias(c) for c in ("false_positive_rate", "false_negative_rate", "specificity")])


@query("prediction_listing", "G08", f"""WITH {_EVAL_SQL}
SELECT id, pred, l.quality AS label, pred = (l.quality = 1)::INT AS match FROM ev JOIN labels l ON l.doc_id = ev.id""")
def _(spark, folder):
    from flowquarry.runtime import table

    truth = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return G.listing(_evaluated(spark, folder).select("id", "pred"), truth)


@query("latency_statistics", "G09", f"""WITH {HEALTH_SQL} SELECT count(response_ms) AS n, round(avg(response_ms), 6) AS avg_ms,
  min(response_ms) AS min_ms, max(response_ms) AS max_ms, round(1000 / avg(response_ms), 6) AS per_second FROM hl""")
def _(spark, folder):
    t = G.latency(health(spark, folder), "response_ms")
    return t.select("n", F.round("avg_ms", 6).alias("avg_ms"), "min_ms", "max_ms", F.round("per_second", 6).alias("per_second"))


@query("model_votes", "H01", f"""WITH {SCORES_SQL} SELECT id, coalesce(pred_knn, 0)::DOUBLE AS knn,
  coalesce(pred_mlp, 0)::DOUBLE AS mlp, coalesce(pred_xgb, 0)::DOUBLE AS xgb FROM sc""")
def _(spark, folder):
    return _scored(spark, folder).select("id", *[F.col("votes")[n].alias(n) for n in H.WEIGHTS])


@query("majority_vote", "H02", f"WITH {_VOTE_SQL} SELECT id, majority AS prediction FROM w2")
def _(spark, folder):
    return scores(spark, folder).select("id", H.majority().alias("prediction"))


@query("weighted_vote", "H03", f"WITH {_VOTE_SQL} SELECT id, weighted AS prediction FROM w2")
def _(spark, folder):
    return scores(spark, folder).select("id", H.weighted().alias("prediction"))


@query("soft_vote", "H04", f"WITH {_VOTE_SQL} SELECT id, soft AS prediction FROM w2")
def _(spark, folder):
    return scores(spark, folder).select("id", H.soft().alias("prediction"))


@query("mean_probability", "H05", f"WITH {_VOTE_SQL} SELECT id, round(p, 9) AS p FROM w2")
def _(spark, folder):
    return scores(spark, folder).select("id", F.round(H.mean_probability(), 9).alias("p"))


@query("vote_by_strategy", "H07", f"""WITH {_VOTE_SQL}
SELECT id, majority AS majority_voting, weighted AS weighted_voting, soft AS soft_voting, weighted AS something_else FROM w2""")
def _(spark, folder):
    names = ["majority_voting", "weighted_voting", "soft_voting", "something_else"]
    return scores(spark, folder).select("id", *[H.vote(n).alias(n) for n in names])


@query("hybrid_decision", "H08", f"""WITH {_VOTE_SQL}
SELECT id, CASE WHEN is_anomaly THEN 1 ELSE weighted END AS hybrid, weighted AS ensemble_only,
  CASE WHEN is_anomaly THEN 1 ELSE 0 END AS anomaly_only FROM w2""")
def _(spark, folder):
    anomaly = F.col("is_anomaly")
    modes = ["hybrid", "ensemble_only", "anomaly_only"]
    return scores(spark, folder).select("id", *[H.hybrid(H.weighted(), anomaly, m).alias(m) for m in modes])


@query("prediction_details", "H09", f"""WITH {_VOTE_SQL}
SELECT id, weighted AS ensemble_prediction, round(attack_probability, 9) AS ensemble_probability, is_anomaly,
  CASE WHEN is_anomaly THEN 1 ELSE weighted END AS hybrid_prediction, round(confidence, 9) AS confidence FROM w2""")
def _(spark, folder):
    d = H.prediction_details(_scored(spark, folder)).select("id", "details.*")
    return d.withColumns({c: F.round(c, 9) for c in ("ensemble_probability", "confidence")})


@query("scored_records", "H10 H13", f"""WITH {_VOTE_SQL}
SELECT id, weighted = 1 AS is_attack, round(confidence, 9) AS confidence, round(attack_probability, 9) AS attack_probability,
  weighted AS prediction FROM w2""")
def _(spark, folder):
    s = _scored(spark, folder)
    return s.select("id", "is_attack", F.round("confidence", 9).alias("confidence"),
                    F.round("attack_probability", 9).alias("attack_probability"), "prediction")


@query("labelled_records", "H11 H12", f"""WITH {_VOTE_SQL}
SELECT id, CASE WHEN votes > 0 THEN weighted ELSE -1 END AS prediction,
  CASE WHEN votes = 0 THEN 'Error' WHEN weighted = 1 THEN 'Attack' ELSE 'Normal' END AS label,
  CASE WHEN votes > 0 THEN round(confidence, 9) ELSE 0.0 END AS confidence,
  CASE WHEN votes > 0 THEN round(1 - attack_probability, 9) END AS normal,
  CASE WHEN votes > 0 THEN round(attack_probability, 9) END AS attack,
  'weighted_voting' AS strategy, CASE WHEN votes > 0 THEN 'success' ELSE 'error' END AS status FROM w2""")
def _(spark, folder):
    s = _scored(spark, folder)
    answered = F.coalesce(*[F.col(f"pred_{n}") for n in H.WEIGHTS]).isNotNull()
    out = H.labelled(s, answered)
    return out.select(
        "id", "prediction", "label", F.round("confidence", 9).alias("confidence"),
        F.round("probabilities.normal", 9).alias("normal"), F.round("probabilities.attack", 9).alias("attack"),
        "strategy", "status",
    )


@query("scoring_summary", "H14", f"""WITH {_VOTE_SQL}
SELECT count(*) AS total_logs, count(*) FILTER (weighted = 1) AS attacks_detected FROM w2""")
def _(spark, folder):
    return H.batch_summary(_scored(spark, folder))


@query("alert_gate", "H16", f"""WITH {_VOTE_SQL} SELECT id AS log_id, 'intrusion' AS type, 'Intrusion détectée' AS message,
  round(attack_probability, 9) AS attack_probability, round(confidence, 9) AS confidence, coalesce(pred_knn, 0)::DOUBLE AS knn
FROM w2 WHERE weighted = 1 AND confidence >= 0.7""")
def _(spark, folder):
    found = H.alert_rows(_scored(spark, folder), F.lit("2024-01-01T00:00:00"))
    return found.select(
        "log_id", "type", "message", F.round("attack_probability", 9).alias("attack_probability"),
        F.round("confidence", 9).alias("confidence"), F.col("models")["knn"].alias("knn"),
    )


@query("alert_log_round_trip", "A14", f"""WITH {_VOTE_SQL} SELECT id AS log_id, '2024-01-01 00:00:00,000' AS logged,
  '2024-01-01T00:00:00' AS timestamp, round(attack_probability, 9) AS attack_probability,
  coalesce(pred_xgb, 0)::DOUBLE AS xgb FROM w2 WHERE weighted = 1 AND confidence >= 0.7""")
def _(spark, folder):
    found = H.alert_rows(_scored(spark, folder), F.lit("2024-01-01T00:00:00"))
    payload = F.struct("timestamp", "log_id", "attack_probability", "confidence", "models")
    lines = found.select(R.alert_line(F.to_timestamp("timestamp"), payload).alias("value"))
    # Every line twice, as an appender registered twice would write it.
    back = R.parse_alert_log(lines.unionByName(lines))
    return back.select(
        "log_id", "logged", "timestamp", F.round("attack_probability", 9).alias("attack_probability"),
        F.col("models")["xgb"].alias("xgb"),
    )
