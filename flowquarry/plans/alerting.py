"""Queries of alert management."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import alerts as I
from flowquarry.plans.registry import query
from flowquarry.plans.views import ALERTS_SQL, HEALTH_SQL, SCORES_SQL, alerts, health, scores

NOW = "2024-02-01 00:00:00"
_VALID_SQL = ALERTS_SQL + """,
va AS (SELECT * FROM al WHERE type IS NOT NULL AND message IS NOT NULL AND timestamp IS NOT NULL)"""
_DESCRIPTION_SQL = "CASE type " + " ".join(
    "WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in I.DESCRIPTIONS.items()
) + " ELSE 'Type d''alerte inconnu' END"
_SEVERITY_SQL = "CASE WHEN lower(severity) IN ('low', 'medium', 'high', 'critical') THEN lower(severity) ELSE 'medium' END"
_PRIVATE_SQL = """coalesce(len(string_split(source_ip, '.')) = 4 AND (starts_with(source_ip, '10.')
  OR starts_with(source_ip, '192.168.') OR (starts_with(source_ip, '172.')
    AND TRY_CAST(string_split(source_ip, '.')[2] AS INTEGER) BETWEEN 16 AND 31)), false)"""
# Wide window: with five minutes hardly any test alert repeats.
_WINDOW_MINUTES = 1440


def _repeat_sql(minutes: int, source: str = "va") -> str:
    return f"""rp AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (
    PARTITION BY type, source_ip ORDER BY ts, seq) <= {minutes * 60_000_000}, false) AS repeated FROM {source})"""


_PROCESSED_SQL = _VALID_SQL + ", " + _repeat_sql(5) + f""",
en AS (SELECT * REPLACE ({_SEVERITY_SQL} AS severity), {_DESCRIPTION_SQL} AS type_description FROM rp),
pr AS (SELECT *, least(5, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END
    + CASE WHEN type = 'intrusion' THEN 1 ELSE 0 END + CASE WHEN confidence > 0.9 THEN 1 ELSE 0 END
    + CASE WHEN repeated THEN 1 ELSE 0 END) AS severity_score,
  'alert_1706745600_' || CAST(row_number() OVER (ORDER BY ts, seq) - 1 AS VARCHAR) AS id FROM en)"""


def _valid(spark, folder):
    return I.split_valid(alerts(spark, folder))[0]


def _now():
    return F.lit(NOW).cast("timestamp")


def _processed(spark, folder):
    return I.process(alerts(spark, folder), _now())


@query("alert_validation", "I01", f"""WITH {ALERTS_SQL}
SELECT seq, type IS NOT NULL AND message IS NOT NULL AND timestamp IS NOT NULL AS valid FROM al""")
def _(spark, folder):
    return alerts(spark, folder).select("seq", I.is_complete().alias("valid"))


@query("alert_rejects", "I01 A15", f"WITH {ALERTS_SQL} SELECT seq, type, timestamp FROM al WHERE message IS NULL")
def _(spark, folder):
    return I.split_valid(alerts(spark, folder))[1].select("seq", "type", "timestamp")


@query("alert_stamping", "I02", f"""WITH {_VALID_SQL}
SELECT seq, 'alert_1706745600_' || CAST(row_number() OVER (ORDER BY ts, seq) - 1 AS VARCHAR) AS id, 'new' AS status,
  false AS acknowledged, false AS false_positive FROM va""")
def _(spark, folder):
    return I.stamp(_valid(spark, folder), _now()).select("seq", "id", "status", "acknowledged", "false_positive")


@query("alert_descriptions", "I03", f"WITH {ALERTS_SQL} SELECT seq, {_DESCRIPTION_SQL} AS type_description FROM al")
def _(spark, folder):
    return alerts(spark, folder).select("seq", I.description().alias("type_description"))


@query("severity_normalisation", "I04", f"WITH {ALERTS_SQL} SELECT seq, {_SEVERITY_SQL} AS severity FROM al")
def _(spark, folder):
    return alerts(spark, folder).select("seq", I.normal_severity().alias("severity"))


@query("address_enrichment", "I05", f"""WITH {ALERTS_SQL} SELECT seq, source_ip AS ip,
  CASE WHEN source_ip IS NOT NULL THEN {_PRIVATE_SQL} END AS is_private,
  CASE WHEN source_ip IS NOT NULL THEN 'Unknown' END AS country,
  CASE WHEN source_ip IS NOT NULL THEN 'Unknown' END AS organization FROM al""")
def _(spark, folder):
    return I.enrich(alerts(spark, folder)).select("seq", "source_info.*")


@query("severity_scores", "I06 I18", f"WITH {_PROCESSED_SQL} SELECT seq, severity, repeated, severity_score FROM pr")
def _(spark, folder):
    return _processed(spark, folder).select("seq", "severity", "repeated", "severity_score")


@query("repeated_alerts", "I07", f"WITH {_VALID_SQL}, {_repeat_sql(_WINDOW_MINUTES)} SELECT seq, repeated FROM rp")
def _(spark, folder):
    return I.mark_repeated(_valid(spark, folder), _WINDOW_MINUTES).select("seq", "repeated")


@query("repeated_among_last", "I07", f"""WITH {_VALID_SQL}, rk AS (SELECT *, row_number() OVER (ORDER BY ts, seq) AS r FROM va)
SELECT seq, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {_WINDOW_MINUTES * 60_000_000}
  AND r - lag(r) OVER w <= 50, false) AS repeated FROM rk WINDOW w AS (PARTITION BY type, source_ip ORDER BY ts, seq)""")
def _(spark, folder):
    return I.mark_repeated(_valid(spark, folder), _WINDOW_MINUTES, last=50).select("seq", "repeated")


@query("notification_routing", "I08", f"""WITH {ALERTS_SQL}, n AS (SELECT seq, {_SEVERITY_SQL} AS severity FROM al)
SELECT seq, severity, unnest(CASE severity WHEN 'critical' THEN ['email', 'sms'] WHEN 'high' THEN ['email']
  ELSE ['dashboard'] END) AS method FROM n""")
def _(spark, folder):
    normal = alerts(spark, folder).withColumn("severity", I.normal_severity())
    return I.route(normal).select("seq", "severity", "method")


@query("message_rendering", "I09", f"""WITH {_PROCESSED_SQL} SELECT seq,
  '[IDS ALERT] ' || upper(severity) || ' - ' || type AS subject,
  'IDS ALERT: ' || upper(severity) || ' - ' || type || ' - ' || substring(message, 1, 100) AS sms,
  'ALERTE IDS DÉTECTÉE' || chr(10) || 'ID: ' || id || chr(10) || 'Type: ' || type_description || chr(10)
    || 'Sévérité: ' || upper(severity) || chr(10) || 'Score: ' || CAST(severity_score AS VARCHAR) || '/5' || chr(10)
    || 'Message: ' || message || chr(10) || 'Timestamp: ' || timestamp || chr(10) || 'Traité le: {NOW.replace(" ", "T")}' || chr(10) AS body,
  id, type, type_description, message, timestamp, severity, severity_score, confidence, source_ip, destination_ip,
  CASE WHEN source_ip IS NOT NULL THEN {_PRIVATE_SQL} END AS source_private, true AS destination_private,
  '{NOW.replace(" ", "T")}' AS processed_at, 'new' AS status, false AS acknowledged, false AS false_positive FROM pr""")
def _(spark, folder):
    """The details are read back from the JSON that ends the mail."""
    place = "struct<ip:string,is_private:boolean,country:string,organization:string>"
    special = {"severity_score": "int", "confidence": "double", "source_info": place, "destination_info": place,
               "acknowledged": "boolean", "false_positive": "boolean"}
    schema = ", ".join(f"{c} {special.get(c, 'string')}" for c in I.DETAILS)
    made = _processed(spark, folder).select(
        "seq", I.subject().alias("subject"), I.sms_text().alias("sms"), F.split(I.mail_body(), I.DETAILS_LINE, 2).alias("mail")
    )
    read = made.select("seq", "subject", "sms", F.col("mail")[0].alias("body"), F.from_json(F.col("mail")[1], schema).alias("d"))
    plain = [c for c in I.DETAILS if not c.endswith("_info")]
    return read.select(
        "seq", "subject", "sms", "body", *[f"d.{c}" for c in plain],
        F.col("d.source_info.is_private").alias("source_private"), F.col("d.destination_info.is_private").alias("destination_private"),
    )


def _with_actions(spark, folder):
    """Alerts and an action log taken from the orders of the given tables: one analyst action each."""
    from flowquarry.runtime import table

    rows = _valid(spark, folder).withColumn("severity", I.normal_severity()).withColumn("id", F.col("seq"))
    rows = rows.withColumn("acknowledged", F.lit(False)).withColumn("false_positive", F.lit(False))
    actions = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "false_positive").otherwise("acknowledge").alias("action"),
        F.col("o_orderkey").alias("at"), F.concat(F.lit("user-"), "o_orderpriority").alias("user"),
    )
    return I.apply_actions(rows, actions)


_ACTIONS_SQL = _VALID_SQL + """,
ac AS (SELECT o_custkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'false_positive' ELSE 'acknowledge' END AS action,
  o_orderkey AS act, 'user-' || o_orderpriority AS usr FROM orders),
la AS (SELECT id, max(act) FILTER (action = 'acknowledge') AS a_at,
    arg_max(usr, (act, usr)) FILTER (action = 'acknowledge') AS a_by,
    max(act) FILTER (action = 'false_positive') AS f_at,
    arg_max(usr, (act, usr)) FILTER (action = 'false_positive') AS f_by FROM ac GROUP BY id),
wa AS (SELECT va.* REPLACE (""" + _SEVERITY_SQL + """ AS severity), a_at IS NOT NULL AS acknowledged, a_at, a_by,
  f_at IS NOT NULL AS false_positive, f_at, f_by FROM va LEFT JOIN la ON la.id = va.seq)"""


@query("acknowledged_alerts", "I13", f"""WITH {_ACTIONS_SQL}
SELECT seq, acknowledged, a_at AS acknowledged_at, a_by AS acknowledged_by FROM wa""")
def _(spark, folder):
    return _with_actions(spark, folder).select("seq", "acknowledged", "acknowledged_at", "acknowledged_by")


@query("false_positive_marks", "I14", f"""WITH {_ACTIONS_SQL}
SELECT seq, false_positive, f_at AS marked_fp_at, f_by AS marked_fp_by FROM wa""")
def _(spark, folder):
    return _with_actions(spark, folder).select("seq", "false_positive", "marked_fp_at", "marked_fp_by")


@query("alert_statistics", "I10", f"""WITH {_ACTIONS_SQL} SELECT count(*) AS total_alerts,
  count(*) FILTER (severity = 'critical') AS critical_alerts, count(*) FILTER (severity = 'high') AS high_alerts,
  count(*) FILTER (severity = 'medium') AS medium_alerts, count(*) FILTER (severity = 'low') AS low_alerts,
  count(*) FILTER (false_positive) AS false_positives, count(*) FILTER (acknowledged) AS acknowledged FROM wa""")
def _(spark, folder):
    return I.statistics(_with_actions(spark, folder))


@query("alert_filter", "I11", f"""WITH {_ACTIONS_SQL}
SELECT 'critical new' AS chosen, seq FROM wa WHERE severity = 'critical' AND NOT acknowledged
UNION ALL SELECT 'acknowledged', seq FROM wa WHERE acknowledged
UNION ALL SELECT 'false_positive', seq FROM wa WHERE false_positive""")
def _(spark, folder):
    rows = _with_actions(spark, folder)
    chosen = [("critical new", "critical", "new"), ("acknowledged", None, "acknowledged"),
              ("false_positive", None, "false_positive")]
    parts = [I.select_alerts(rows, s, t).select(F.lit(n).alias("chosen"), "seq") for n, s, t in chosen]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("alert_page", "I12", f"""WITH {ALERTS_SQL}
SELECT seq, timestamp, type FROM al ORDER BY timestamp DESC, seq LIMIT 100 OFFSET 200""")
def _(spark, folder):
    return I.page(alerts(spark, folder), 3, 500).select("seq", "timestamp", "type")


@query("newest_per_severity", "I15", f"""WITH {ALERTS_SQL}, n AS (SELECT seq, ts, {_SEVERITY_SQL} AS severity FROM al),
r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY ts DESC, seq DESC) AS rn FROM n)
SELECT severity, CAST(rn AS INTEGER) AS rn, seq FROM r WHERE rn <= 1000""")
def _(spark, folder):
    normal = alerts(spark, folder).withColumn("severity", I.normal_severity())
    return I.newest_per_severity(normal).select("severity", "rn", "seq")


@query("newest_overall", "I15", f"WITH {ALERTS_SQL} SELECT seq, type FROM al ORDER BY ts DESC, seq DESC LIMIT 10001")
def _(spark, folder):
    return I.newest_overall(alerts(spark, folder), keep_one_more=True).select("seq", "type")


@query("alert_history", "I16", f"WITH {ALERTS_SQL} SELECT seq, type FROM al ORDER BY ts DESC, seq DESC LIMIT 1000")
def _(spark, folder):
    return I.newest(alerts(spark, folder)).select("seq", "type")


@query("channel_multiplex", "I17", f"""WITH {ALERTS_SQL}, {HEALTH_SQL}, {SCORES_SQL}
SELECT 'network' AS channel, type, severity, message FROM al
UNION ALL SELECT 'monitoring', 'service', 'high', 'Service ' || service || ' is unreachable' FROM hl WHERE code IS NULL
UNION ALL SELECT 'ml', 'intrusion', NULL, NULL FROM sc WHERE pred_mlp = 1""")
def _(spark, folder):
    probes = health(spark, folder).filter("code IS NULL")
    monitoring = probes.select(
        F.lit("service").alias("type"), F.lit("high").alias("severity"),
        F.format_string("Service %s is unreachable", "service").alias("message"),
    )
    found = scores(spark, folder).filter("pred_mlp = 1").select(F.lit("intrusion").alias("type"))
    network = alerts(spark, folder).select("type", "severity", "message")
    return I.merge_channels({"network": network, "monitoring": monitoring, "ml": found})


@query("alert_pipeline", "I18 L4", f"""WITH {_PROCESSED_SQL}
SELECT id, seq, type, type_description, severity, severity_score, repeated FROM pr""")
def _(spark, folder):
    return _processed(spark, folder).select(
        "id", "seq", "type", "type_description", "severity", "severity_score", "repeated"
    )


@query("incidents", "I19", f"""WITH {ALERTS_SQL}, g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (
    PARTITION BY source_ip ORDER BY ts, seq) > 20000000000, true) AS starts FROM al),
s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY source_ip ORDER BY ts, seq) AS incident FROM g)
SELECT source_ip, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts,
  count(*) AS alerts, min(seq) AS first_seq FROM s GROUP BY source_ip, incident""")
def _(spark, folder):
    found = I.incidents(alerts(spark, folder), 20_000)
    pattern = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return found.withColumns({c: F.date_format(c, pattern) for c in ("first_ts", "last_ts")})


@query("rate_limited_alerts", "I21", f"""WITH {ALERTS_SQL}, r AS (SELECT *,
    row_number() OVER (PARTITION BY time_bucket(INTERVAL 6 HOUR, ts) ORDER BY ts, seq) AS rn FROM al)
SELECT seq, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 60""")
def _(spark, folder):
    return I.rate_limit(alerts(spark, folder), 60, "6 hours").select("seq", "rn")


@query("alert_retention", "I22", f"WITH {ALERTS_SQL} SELECT seq FROM al WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY")
def _(spark, folder):
    return I.retained(alerts(spark, folder), _now(), 20).select("seq")
