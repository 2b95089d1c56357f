"""Queries of operational metrics, bounded sinks and windowed rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import alerts as I
from flowquarry.operators import flows as L
from flowquarry.operators import monitoring as J
from flowquarry.plans.registry import query
from flowquarry.plans.views import ALERTS_SQL, HEALTH_SQL, PACKETS_SQL, alerts, events, health, packets
from flowquarry.runtime import staging_path
from flowquarry.schemas import SYSTEM_SAMPLE
from flowquarry.sources import sinks

_STATUS_SQL = "CASE WHEN code IS NULL THEN 'unreachable' WHEN code = 200 THEN 'healthy' ELSE 'unhealthy' END"
_UPTIME_SQL = HEALTH_SQL + f""",
hs AS (SELECT *, {_STATUS_SQL} AS status FROM hl),
up AS (SELECT service, arg_max(status, (ts, seq)) AS status, arg_max_null(response_ms, (ts, seq)) AS response_ms,
  max(ts) AS last_check, count(*) FILTER (status <> 'healthy') AS error_count, count(*) AS total_checks,
  round((count(*) - count(*) FILTER (status <> 'healthy')) / count(*) * 100, 6) AS uptime_percentage FROM hs GROUP BY service)"""


@query("health_status", "J01", f"WITH {HEALTH_SQL} SELECT seq, service, {_STATUS_SQL} AS status FROM hl")
def _(spark, folder):
    return health(spark, folder).select("seq", "service", J.health_status(F.col("code")).alias("status"))


@query("service_uptime", "J02", f"""WITH {_UPTIME_SQL} SELECT * REPLACE (epoch_us(last_check) AS last_check) FROM up""")
def _(spark, folder):
    up = J.uptime(health(spark, folder))
    return up.withColumn("last_check", F.unix_micros("last_check")).withColumn(
        "uptime_percentage", F.round("uptime_percentage", 6)
    )


def _samples(spark, folder):
    """Host samples as JSON text, one per event, read through the sample layout."""
    big = (F.col("event_id") * 7_000_003 + 17_179_869_184).cast("bigint")
    text = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_id").cast("double").alias("uptime_seconds"),
        F.struct((F.col("value") / 5).alias("usage_percent"), F.lit(8).alias("cores")).alias("cpu"),
        F.struct(big.alias("total"), (big - 1_000_000_007).alias("used"), (F.col("value") / 6).alias("percent"),
                 F.lit(1_000_000_007).cast("bigint").alias("available")).alias("memory"),
        F.struct((big * 4).alias("total"), (big * 3).alias("used"), big.alias("free")).alias("disk"),
        F.struct((big * 2).alias("bytes_sent"), big.alias("bytes_recv"), F.col("event_id").alias("packets_sent"),
                 F.col("user_id").alias("packets_recv")).alias("network"),
    ))
    parsed = events(spark, folder).select("event_id", F.from_json(text, SYSTEM_SAMPLE).alias("s"))
    return parsed.select("event_id", "s.*")


_SAMPLE_SQL = """sm AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, event_id::DOUBLE AS uptime_seconds,
  value / 5 AS cpu_percent, value / 6 AS memory_percent, event_id * 7000003 + 17179869184 AS big FROM events)"""


@query("system_metrics", "J03", f"""WITH {_SAMPLE_SQL}
SELECT timestamp, uptime_seconds, cpu_percent, 8 AS cpu_cores, round(big / 1073741824.0::DOUBLE, 2) AS memory_total_gb,
  round((big - 1000000007) / 1073741824.0::DOUBLE, 2) AS memory_used_gb, memory_percent,
  round(1000000007 / 1073741824.0::DOUBLE, 2) AS memory_available_gb, round(big * 4 / 1073741824.0::DOUBLE, 2) AS disk_total_gb,
  round(big * 3 / 1073741824.0::DOUBLE, 2) AS disk_used_gb, round(big / 1073741824.0::DOUBLE, 2) AS disk_free_gb,
  75.0::DOUBLE AS disk_percent, big * 2 AS bytes_sent, big AS bytes_recv, event_id AS packets_sent,
  (SELECT user_id FROM events e WHERE e.event_id = sm.event_id) AS packets_recv FROM sm""")
def _(spark, folder):
    return J.system_metrics(_samples(spark, folder))


_DEFAULTS_SQL = ", ".join(f"'{v}' AS {k}" for k, v in J.STORE_DEFAULTS.items() if k != "keyspace_hits")


@query("store_metrics", "J04", f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '0' END
  AS keyspace_hits, {_DEFAULTS_SQL} FROM events""")
def _(spark, folder):
    return _store(spark, folder)


@query("global_counters", "J05", f"""WITH {PACKETS_SQL}, {ALERTS_SQL}
SELECT (SELECT count(*) FROM pk) AS packets_captured,
  (SELECT count(*) FROM (SELECT DISTINCT least((src_ip, src_port), (dst_ip, dst_port)),
    greatest((src_ip, src_port), (dst_ip, dst_port)) FROM pk)) AS features_extracted,
  count(*) AS alerts_generated, count(*) FILTER (type = 'intrusion') AS threats_detected FROM al""")
def _(spark, folder):
    rows = packets(spark, folder)
    return J.global_counters(rows, L.flow_base(L.keyed_packets(rows)), alerts(spark, folder))


@query("threshold_alerts", "J06", f"""WITH {_SAMPLE_SQL}
SELECT 'system' AS type, 'critical' AS severity, timestamp, event_id FROM sm WHERE cpu_percent > 90
UNION ALL SELECT 'system', 'critical', timestamp, event_id FROM sm WHERE memory_percent > 70""")
def _(spark, folder):
    metrics = J.system_metrics(_samples(spark, folder)).withColumn("event_id", F.col("packets_sent"))
    found = J.threshold_alerts(
        metrics.withColumn("timestamp", F.struct("timestamp", "event_id")), {"cpu": 90.0, "memory": 70.0, "disk": 90.0}
    )
    return found.select("type", "severity", "timestamp.timestamp", "timestamp.event_id")


@query("service_alerts", "J07 J08", f"""WITH {_UPTIME_SQL} SELECT 'service' AS type, 'high' AS severity,
  'Service ' || service || ' is ' || status AS message, '2024-02-01T00:00:00' AS timestamp, 'monitoring' AS channel
FROM up WHERE status <> 'healthy'""")
def _(spark, folder):
    return J.stamped(J.service_alerts(J.uptime(health(spark, folder))), F.lit("2024-02-01T00:00:00"))


@query("throughput", "J09", f"""WITH {PACKETS_SQL}, s AS (SELECT count(*) AS n, sum(len) AS b, ceil(count(*) / 100.0) AS k,
    max(t) - min(t) AS up FROM pk)
SELECT n AS packets, CAST(k AS BIGINT) AS batches, round(n / up, 9) AS packets_per_second, round(b / up, 9) AS bytes_per_second,
  round(k::DOUBLE / up * 60, 9) AS batches_per_minute, round(n / up * 60, 9) AS packets_per_minute FROM s""")
def _(spark, folder):
    t = J.throughput(packets(spark, folder))
    rates = ["packets_per_second", "bytes_per_second", "batches_per_minute", "packets_per_minute"]
    return t.withColumns({c: F.round(c, 9) for c in rates})


def _store(spark, folder):
    info = F.when(
        F.col("event_id") % 2 == 0, F.create_map(F.lit("keyspace_hits"), F.col("user_id").cast("string"))
    ).otherwise(F.create_map().cast("map<string,string>"))
    return events(spark, folder).select("event_id", *J.store_metrics(info))


@query("snapshot", "J10", f"""WITH {_UPTIME_SQL}, {ALERTS_SQL}, {_SAMPLE_SQL}
SELECT count(*) AS services, count(*) FILTER (status = 'healthy') AS healthy, round(avg((total_checks - error_count)
  / total_checks * 100), 6) AS mean_uptime, (SELECT count(*) FROM events) AS packets_captured,
  (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS features_extracted,
  (SELECT count(*) FROM al) AS alerts_generated, (SELECT count(*) FROM al WHERE type = 'intrusion') AS threats_detected,
  (SELECT cpu_percent FROM sm ORDER BY event_id DESC LIMIT 1) AS cpu_percent,
  (SELECT memory_percent FROM sm ORDER BY event_id DESC LIMIT 1) AS memory_percent, 75.0::DOUBLE AS disk_percent,
  (SELECT CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '0' END FROM events ORDER BY event_id DESC LIMIT 1)
    AS keyspace_hits, {_DEFAULTS_SQL}
FROM up""")
def _(spark, folder):
    rows = packets(spark, folder)
    counters = J.global_counters(rows, L.flow_base(L.keyed_packets(rows)), alerts(spark, folder))
    host = J.newest_sample(J.system_metrics(_samples(spark, folder)), "packets_sent")
    store = J.newest_sample(_store(spark, folder), "event_id").drop("event_id")
    record = J.snapshot(
        J.uptime(health(spark, folder)), counters, host.select("cpu_percent", "memory_percent", "disk_percent"), store
    )
    return record.withColumn("mean_uptime", F.round("mean_uptime", 6))


@query("node_counters", "J11", f"""WITH {HEALTH_SQL} SELECT node, count(*) AS checks, count(*) FILTER (code = 200) AS answered,
  count(*) FILTER (code IS NULL) AS errors, round(sum(coalesce(response_ms, 0)), 4) AS busy_ms FROM hl GROUP BY node""")
def _(spark, folder):
    return J.node_counters(health(spark, folder)).withColumn("busy_ms", F.round("busy_ms", 4))


@query("service_counters", "J11", f"""WITH {PACKETS_SQL}, {HEALTH_SQL}
SELECT n.node, captured, bytes, stored, batches, features, api_calls, errors FROM (SELECT 'node-' || CAST(user_id % 4 AS VARCHAR) AS node,
    count(*) AS captured, sum(40 + CAST(floor(value * 10) AS BIGINT))::BIGINT AS bytes, count(*) AS stored,
    CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches, count(DISTINCT (user_id, event_type)) AS features FROM events GROUP BY 1) n
  JOIN (SELECT node, count(*) AS api_calls, count(*) FILTER (code IS NULL) AS errors FROM hl GROUP BY node) c ON c.node = n.node""")
def _(spark, folder):
    client = F.when(F.col("seq") % 3 == 0, F.col("dst_port")).otherwise(F.col("src_port")) - 20000
    rows = packets(spark, folder).withColumn("node", F.concat(F.lit("node-"), (client % 4).cast("string")))
    return J.service_counters(rows, health(spark, folder))


@query("newest_results", "A13", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(spark, folder):
    return I.newest(events(spark, folder), 1000, tie="event_id").select("event_id", "value")


@query("metrics_history", "A18", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1001")
def _(spark, folder):
    return I.newest(events(spark, folder), 1000, keep_one_more=True, tie="event_id").select("event_id", "value")


@query("live_status", "A19", f"""WITH {HEALTH_SQL}
SELECT seq, node, service FROM hl WHERE ts > (SELECT max(ts) FROM hl) - INTERVAL 30000 SECOND""")
def _(spark, folder):
    return J.live_status(health(spark, folder), 30_000).select("seq", "node", "service")


@query("packet_archive", "A16", f"""WITH {PACKETS_SQL}
SELECT seq, src_ip, dst_ip, len FROM pk WHERE ts >= (SELECT max(ts) FROM pk) - INTERVAL 24 HOUR""")
def _(spark, folder):
    path = staging_path(spark, "archive")
    sinks.write_archive(packets(spark, folder), path)
    return sinks.read_archive(spark, path, 24).select("seq", "src_ip", "dst_ip", "len")


@query("tumbling_rates", "K08 J09", f"""WITH {PACKETS_SQL}
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, count(*) AS packets, sum(len)::BIGINT AS bytes FROM pk GROUP BY 1""")
def _(spark, folder):
    rates = J.throughput_by_window(packets(spark, folder), "1 hour")
    return rates.withColumn("window_start", F.unix_micros("window_start"))


@query("sliding_rates", "K08", f"""WITH {PACKETS_SQL}, s AS (
  SELECT len, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM pk)
SELECT epoch_us(w) AS window_start, count(*) AS packets, sum(len)::BIGINT AS bytes FROM s GROUP BY 1""")
def _(spark, folder):
    rates = J.throughput_by_window(packets(spark, folder), "1 hour", "30 minutes")
    return rates.withColumn("window_start", F.unix_micros("window_start"))
