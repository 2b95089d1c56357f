"""Published numbers: sample flows, their scores, the sample vote and the alert log."""

from pyspark.sql import functions as F

from flowquarry.operators import checks, ensemble, flows
from flowquarry.schemas import FEATURES, FLOW
from flowquarry.sources import records

# The seven published sample flows
# (proto, service, state, spkts, dpkts, sbytes, dbytes, dur, rate, swin, sttl, score, dwin).
SAMPLE = [
    ("udp", "-", "INT", 90, 113, 25628, 39383, 3.282564163208008, 61.84189856066993, 0, 54, 5),
    ("tcp", "https", "FIN", 3, 2, 207, 108, 0.05644106864929199, 88.58797538134, 10, 56, 3),
    ("tcp", "https", "INT", 1, 1, 66, 55, 0.07635807991027832, 26.192382028856994, 297, 54, 6),
    ("tcp", "https", "FIN", 3, 2, 192, 108, 0.07114410400390625, 70.27989276139411, 290, 54, 2),
    ("tcp", "https", "FIN", 3, 2, 192, 108, 0.07432699203491211, 67.27031275060145, 290, 54, 2),
    ("tcp", "https", "INT", 1, 1, 66, 55, 0.07294797897338867, 27.416797944869693, 299, 54, 6),
    ("tcp", "https", "INT", 2, 1, 148, 96, 0.05382895469665527, 55.73208725501052, 11, 56, 7),
]
NAMES = "proto service state spkts dpkts sbytes dbytes dur rate swin sttl wanted".split()


def sample(spark):
    df = spark.createDataFrame(SAMPLE, NAMES).withColumn("dttl", F.lit(128))
    return df.withColumn("tcprtt", F.lit(0.0)).withColumn("synack", F.lit(0.0)).withColumn("ackdat", F.lit(0.0))


def test_suspicion_scores(spark):
    rows = checks.suspicion(sample(spark)).select("score", "wanted", "verdict").collect()
    assert [r["score"] for r in rows] == [5, 3, 6, 2, 2, 6, 7]
    assert all(r["score"] == r["wanted"] for r in rows)
    assert {r["verdict"] for r in rows} == {"justified", "borderline"}


def test_rate_formula(spark):
    rows = sample(spark).select(((F.col("spkts") + F.col("dpkts")) / F.col("dur") - F.col("rate")).alias("d")).collect()
    assert all(abs(r["d"]) < 1e-9 for r in rows)


def test_tracking_surrogates(spark):
    rows = flows.tracking_surrogates(sample(spark)).select(*flows.SURROGATES).collect()
    assert tuple(rows[0]) == (9, 1, 3, 3, 3, 3, 5, 5)
    assert all(tuple(r) == (1, 1, 1, 1, 1, 1, 1, 1) for r in rows[1:])


def test_packet_conservation_of_sample(spark):
    row = checks.aggregation_ratio(sample(spark)).first()
    assert (row["packets"], row["flows"]) == (225, 7)
    assert abs(227 - row["packets"]) <= 2


def test_weighted_vote_of_published_alert(spark):
    df = spark.createDataFrame([(1, 0, 1, 1, 0.2, 0.97, 0.97)], "id int, pred_knn int, pred_mlp int, pred_xgb int, "
                               "p_knn double, p_mlp double, p_xgb double")
    row = ensemble.score(df).first()
    assert row["prediction"] == 1 and row["votes"] == {"knn": 0.0, "mlp": 1.0, "xgb": 1.0}
    assert ensemble.alert_rows(ensemble.score(df), F.lit("t")).count() == 1


def test_no_model_answers(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, None)], "id int, pred_knn int, pred_mlp int, "
                               "pred_xgb int, p_knn double, p_mlp double, p_xgb double")
    row = ensemble.score(df).first()
    assert (row["prediction"], row["is_attack"], row["attack_probability"]) == (0, False, 0.5)


def test_alert_log_written_by_a_growing_number_of_handlers(spark):
    """Alert n is written n times: 1 + 2 + ... + 6 = 21 lines hold 6 alerts."""
    lines = []
    for n in range(1, 7):
        body = ('{"timestamp": "2025-06-05T17:13:%02d.000001", "log_id": %d, "attack_probability": 0.7396952014773599, '
                '"confidence": 0.7396952014773599, "models": {"knn": 0.0, "mlp": 1.0, "xgb": 1.0}}' % (n, n))
        lines += [(f"2025-06-05 17:13:0{n},440 - alerts - WARNING - INTRUSION DETECTEE: {body}",)] * n
    assert len(lines) == 21
    alerts = records.parse_alert_log(spark.createDataFrame([*lines, ("something else",)], "value string")).collect()
    assert len(alerts) == 6
    assert all(a["models"]["mlp"] == 1.0 and a["confidence"] >= 0.7 for a in alerts)


def test_feature_layout():
    assert len(FEATURES) == 42 and FLOW.fieldNames() == FEATURES
