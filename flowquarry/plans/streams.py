"""Queries of sessions, suppression and streaming jobs. Streams read the whole events table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.operators import flows as L
from flowquarry.operators import sessions as S
from flowquarry.plans.detection import detector, shown
from flowquarry.plans.flows import KEYED_SQL, _GROUP, features_sql, rounded, rounded_sql
from flowquarry.plans.registry import query
from flowquarry.plans.views import ALERTS_SQL, PACKETS_SQL, alerts, packets
from flowquarry.runtime import staging_path
from flowquarry.sources import captures
from flowquarry.schemas import FEATURES
from flowquarry.streaming import batches, flow_state, jobs, state

_FIVE = _GROUP + ", ip_proto"
_SESSION_SQL = KEYED_SQL + f""",
pv AS (SELECT *, lag(t) OVER w AS pt, lag(ip_proto = 6 AND flags & 5 > 0) OVER w AS pc
  FROM kd WINDOW w AS (PARTITION BY {_FIVE} ORDER BY seq)),
ss AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > {{pause}} OR pc THEN 1 ELSE 0 END)
    OVER (PARTITION BY {_FIVE} ORDER BY seq) AS session FROM pv)"""
_RECORD_SQL = f"""
SELECT min(seq) AS first_seq, ip_proto,
  CASE WHEN arg_min(fwd, seq) THEN a_ip ELSE b_ip END AS src_ip, CASE WHEN arg_min(fwd, seq) THEN a_port ELSE b_port END AS src_port,
  CASE WHEN arg_min(fwd, seq) THEN b_ip ELSE a_ip END AS dst_ip, CASE WHEN arg_min(fwd, seq) THEN b_port ELSE a_port END AS dst_port,
  count(*) AS packets, sum(len)::BIGINT AS bytes,
  CASE WHEN arg_min(fwd, seq) THEN count(*) FILTER (fwd) ELSE count(*) FILTER (NOT fwd) END AS src2dst_packets,
  CASE WHEN arg_min(fwd, seq) THEN count(*) FILTER (NOT fwd) ELSE count(*) FILTER (fwd) END AS dst2src_packets,
  CAST(round((max(t) - min(t)) * 1000) AS BIGINT) AS duration_ms FROM {{source}} GROUP BY {_FIVE}, {{group}}"""


def _sessions_sql(pause: float) -> str:
    return _SESSION_SQL.format(pause=pause)


@query("timed_flows", "C26", f"WITH {_sessions_sql(15.0)}" + _RECORD_SQL.format(source="ss", group="session"))
def _(spark, folder):
    return S.timed_flows(packets(spark, folder))


@query("timed_flows_wide_pause", "C26", f"WITH {_sessions_sql(40000.0)}" + _RECORD_SQL.format(source="ss", group="session"))
def _(spark, folder):
    return S.timed_flows(packets(spark, folder), inactive=40_000.0)


@query("timed_flows_with_age", "C26", f"""WITH RECURSIVE {_sessions_sql(1e12).replace("OR pc ", "")},
ch AS (SELECT {_FIVE}, min(t) AS head FROM ss GROUP BY {_FIVE}
  UNION ALL SELECT s.a_ip, s.a_port, s.b_ip, s.b_port, s.ip_proto, min(s.t) FROM ss s JOIN ch
    ON s.a_ip = ch.a_ip AND s.a_port = ch.a_port AND s.b_ip = ch.b_ip AND s.b_port = ch.b_port AND s.ip_proto = ch.ip_proto
    AND s.t > ch.head + 200000.0 GROUP BY s.a_ip, s.a_port, s.b_ip, s.b_port, s.ip_proto, ch.head),
cu AS (SELECT s.*, (SELECT max(head) FROM ch WHERE ch.a_ip = s.a_ip AND ch.a_port = s.a_port AND ch.b_ip = s.b_ip
    AND ch.b_port = s.b_port AND ch.ip_proto = s.ip_proto AND ch.head <= s.t) AS head FROM ss s)"""
       + _RECORD_SQL.format(source="cu", group="head"))
def _(spark, folder):
    return S.timed_flows(packets(spark, folder), inactive=1e12, active=200_000.0, close_on_flags=False)


def _aged_sql(pause: float, age: float) -> str:
    """``cu``: packets with the whole timeout rule; a flow is one ``session`` and ``head``."""
    same = " AND ".join(f"s.{c} = ch.{c}" for c in [*L.KEY, "ip_proto", "session"])
    mine = ", ".join(f"s.{c}" for c in [*L.KEY, "ip_proto", "session"])
    return f"""{_sessions_sql(pause)},
ch AS (SELECT {_FIVE}, session, min(t) AS head FROM ss GROUP BY {_FIVE}, session
  UNION ALL SELECT {mine}, min(s.t) FROM ss s JOIN ch ON {same} AND s.t > ch.head + {age} GROUP BY {mine}, ch.head),
cu AS (SELECT s.*, (SELECT max(head) FROM ch WHERE {same} AND ch.head <= s.t) AS head FROM ss s)"""


_TIMED = f"{_FIVE}, session, head"


@query("timed_flows_documented", "C26", f"WITH RECURSIVE {_aged_sql(15.0, 120.0)}" + _RECORD_SQL.format(source="cu", group="session, head"))
def _(spark, folder):
    return S.timed_flows(packets(spark, folder), inactive=15.0, active=120.0)


_SHOWN = ["first_seq", "ip_proto", "packets", *FEATURES]


@query("timed_flow_features", "C26 C23", f"""WITH RECURSIVE {_aged_sql(40000.0, 200000.0)}{features_sql(_TIMED, "cu")}
SELECT {_GROUP}, {rounded_sql(_SHOWN)} FROM fl""")
def _(spark, folder):
    table = S.timed_features(packets(spark, folder), inactive=40_000.0, active=200_000.0)
    return table.select(*L.KEY, *rounded(_SHOWN))


@query("suppressed_alerts", "I20", f"""WITH RECURSIVE {ALERTS_SQL},
ch AS (SELECT type, source_ip, min(ts) AS head FROM al GROUP BY ALL
  UNION ALL SELECT a.type, a.source_ip, min(a.ts) FROM al a JOIN ch ON a.type = ch.type
    AND a.source_ip IS NOT DISTINCT FROM ch.source_ip AND a.ts > ch.head + INTERVAL 100000 SECOND
    GROUP BY a.type, a.source_ip, ch.head)
SELECT seq, ch.head IS NULL AS suppressed FROM al LEFT JOIN ch ON al.type = ch.type
  AND al.source_ip IS NOT DISTINCT FROM ch.source_ip AND al.ts = ch.head""")
def _(spark, folder):
    return S.suppress(alerts(spark, folder), 100_000).select("seq", "suppressed")


@query("flows_per_batch", "C29 K03", f"""WITH {KEYED_SQL} SELECT seq // 1000 AS batch, {_GROUP}, count(*) AS packets,
  sum(len)::BIGINT AS bytes FROM kd GROUP BY ALL""")
def _(spark, folder):
    table = S.per_batch(packets(spark, folder), F.floor(F.col("seq") / 1000).cast("bigint"))
    return table.select("batch", "flow.*", "packets", "bytes")


def _staged(spark, df, label):
    """A table as files of a folder that a stream can watch."""
    path = staging_path(spark, label)
    df.write.parquet(path)
    return jobs.read_stream(spark, path, df.schema)


def _run(spark, stream, label):
    path = staging_path(spark, label)
    jobs.drain(jobs.start(stream, jobs.into_table(path), staging_path(spark, f"{label}-state")))
    return spark.read.parquet(path).drop("batch")


@query("stream_tumbling_rates", "K01 K02 K05 K08", f"""WITH {PACKETS_SQL}
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, count(*) AS packets, sum(len)::BIGINT AS bytes FROM pk
WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 SECOND FROM pk) GROUP BY 1""")
def _(spark, folder):
    stream = _staged(spark, packets(spark, folder).select("ts", "len"), "rates-in")
    return _run(spark, jobs.windowed_counts(stream, "1 hour"), "rates").withColumn(
        "window_start", F.unix_micros("window_start")
    )


@query("stream_late_rows", "K01 K02 K05", f"""WITH {PACKETS_SQL}
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, count(*) AS packets, sum(len)::BIGINT AS bytes FROM pk GROUP BY 1""")
def _(spark, folder):
    """Four waves of files, a restart from the checkpoint before each: the older half, the newer, the oldest again, an end mark.

    The third wave comes after its windows are closed, so it must change nothing; the mark closes the last window.
    """
    rows = packets(spark, folder).select("ts", "len")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    middle = first + (last - first) / 2
    waves = [
        rows.filter(F.col("ts") <= F.lit(middle)), rows.filter(F.col("ts") > F.lit(middle)),
        rows.filter(F.col("ts") <= F.lit(middle) - F.expr("INTERVAL 2 HOURS")),
        rows.limit(1).withColumn("ts", F.lit(last) + F.expr("INTERVAL 2 HOURS")),
    ]
    path, state_path, out = (staging_path(spark, f"late-{n}") for n in ("in", "state", "out"))
    for wave in waves:
        wave.write.mode("append").parquet(path)
        stream = jobs.read_stream(spark, path, rows.schema)
        jobs.drain(jobs.start(jobs.windowed_counts(stream, "1 hour"), jobs.into_table(out), state_path))
    return spark.read.parquet(out).drop("batch").withColumn("window_start", F.unix_micros("window_start"))


@query("stream_sessions", "K08", f"""WITH {PACKETS_SQL}, g AS (SELECT src_ip, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 20000
    SECOND, true) AS starts FROM pk WINDOW w AS (PARTITION BY src_ip ORDER BY ts)),
s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY src_ip ORDER BY ts) AS n FROM g)
SELECT src_ip, epoch_us(min(ts)) AS first_micros, count(*) AS packets FROM s GROUP BY src_ip, n
HAVING max(ts) + INTERVAL 20000 SECOND <= (SELECT max(ts) - INTERVAL 10 SECOND FROM pk)""")
def _(spark, folder):
    stream = _staged(spark, packets(spark, folder).select("ts", "src_ip"), "sessions-in")
    counted = jobs.session_counts(stream, ["src_ip"], "20000 seconds")
    table = _run(spark, counted.select("src_ip", F.col("w.start").alias("start"), "packets"), "sessions")
    return table.select("src_ip", F.unix_micros("start").alias("first_micros"), "packets")


_PACKET_COLUMNS = [*captures.PACKET_COLUMNS, "ts"]


@query("stream_expired_flows", "K04 K05", f"""WITH {_sessions_sql(15.0)}, r AS (SELECT {_FIVE}, min(seq) AS first_seq, count(*) AS packets,
  sum(len)::BIGINT AS bytes, count(*) FILTER (fwd) AS forward_packets, CAST(round((max(t) - min(t)) * 1000) AS BIGINT) AS duration_ms,
  max(t) AS last, bool_or(ip_proto = 6 AND flags & 5 > 0) AS closed FROM ss GROUP BY {_FIVE}, session)
SELECT * EXCLUDE (last, closed) FROM r WHERE closed OR last + 15 <= (SELECT max(t) - 10 FROM pk)""")
def _(spark, folder):
    stream = _staged(spark, packets(spark, folder).select(*_PACKET_COLUMNS), "expiry-in")
    return _run(spark, state.expire_flows(stream, active=None), "expiry")


def waves(rows, number):
    """Consecutive parts of a table by ``seq``."""
    first, end = rows.agg(F.min("seq"), F.max("seq")).first()
    step = (end - first) // number + 1
    return [rows.filter(F.col("seq").between(first + i * step, first + (i + 1) * step - 1)) for i in range(number)]


def run_ended(spark, rows, handle, label, pause=40_000.0, age=200_000.0, number=2):
    """A stream of ended flows over waves of packets: a restart from the checkpoint before each, an end mark at last."""
    path, kept = staging_path(spark, f"{label}-in"), staging_path(spark, f"{label}-state")
    for wave in [*waves(rows, number), flow_state.last_packet(rows, pause + age)]:
        wave.write.mode("append").parquet(path)
        stream = jobs.read_stream(spark, path, rows.schema)
        with flow_state.timers(spark):
            running = jobs.start(flow_state.ended_flows(stream, pause, age), handle, kept)
        jobs.drain(running)


@query("stream_flow_features", "K04 K03 K05", f"""WITH RECURSIVE {_aged_sql(40000.0, 200000.0)}{features_sql(_TIMED, "cu")}
SELECT {_GROUP}, {rounded_sql(_SHOWN)} FROM fl""")
def _(spark, folder):
    out = staging_path(spark, "ended-flows")
    run_ended(spark, packets(spark, folder).select(*_PACKET_COLUMNS), jobs.into_table(out), "ended")
    return spark.read.parquet(out).select(*L.KEY, *rounded(_SHOWN))


@query("stream_packet_batches", "K01 B04", f"""WITH RECURSIVE {PACKETS_SQL},
ln AS (SELECT seq % 4 AS lane, seq, epoch_us(ts) AS micros, row_number() OVER (PARTITION BY seq % 4 ORDER BY ts, seq) AS pos FROM pk),
nx AS (SELECT lane, pos, least(pos + 100, (SELECT coalesce(min(l.pos), 1000000000000) FROM ln l
    WHERE l.lane = ln.lane AND l.micros > ln.micros + 100000000000)) AS follow FROM ln),
ch AS (SELECT lane, 0 AS batch, 1::BIGINT AS pos FROM ln GROUP BY lane
  UNION ALL SELECT nx.lane, batch + 1, follow FROM ch JOIN nx ON nx.lane = ch.lane AND nx.pos = ch.pos
    WHERE follow <= (SELECT max(pos) FROM ln WHERE ln.lane = nx.lane))
SELECT ln.lane, ch.batch::BIGINT AS number, CASE WHEN count(*) = 100 THEN 'size' ELSE 'time' END AS reason, count(*)::INTEGER AS packets,
  sum(seq)::BIGINT AS seq_sum
FROM ch JOIN nx ON nx.lane = ch.lane AND nx.pos = ch.pos JOIN ln ON ln.lane = ch.lane AND ln.pos >= ch.pos AND ln.pos < follow
GROUP BY ln.lane, ch.batch""")
def _(spark, folder):
    """Four lanes of packets in batches of 100, or of 100,000 seconds on the capture clock; an end mark lets the last ones out."""
    rows = packets(spark, folder).select(*_PACKET_COLUMNS)
    path, kept, out = (staging_path(spark, f"batches-{n}") for n in ("in", "state", "out"))
    for wave in [*waves(rows, 2), flow_state.last_packet(rows, 200_000.0)]:
        wave.write.mode("append").parquet(path)
        lanes = jobs.read_stream(spark, path, rows.schema).withColumn("lane", F.when(F.col("ip_proto") == 255, -1).otherwise(F.col("seq") % 4))
        made = batches.packet_batches(lanes.withColumn("lane", F.col("lane").cast("long")), ["lane"], wait=100_000.0, clock="capture")
        with flow_state.timers(spark):
            running = jobs.start(made, jobs.into_table(out), kept)
        jobs.drain(running)
    total = F.aggregate("seqs", F.lit(0).cast("long"), lambda a, b: a + b)
    return spark.read.parquet(out).select("lane", "number", "reason", "packets", total.alias("seq_sum"))


@query("stream_detection", "K06 A17 H13 H16 L1")
def _(spark, folder):
    """Packets to whole flows to verdicts of the fitted detector to alerts; ``alerted`` is read from the alerts written."""
    model, _ = detector(spark, folder)
    out = staging_path(spark, "stream-detection")
    run_ended(spark, packets(spark, folder).select(*_PACKET_COLUMNS), jobs.detection_sink(model, out), "detection")
    raised = spark.read.parquet(f"{out}/alerts").select(F.col("log_id").alias("id"), F.lit(True).alias("alerted"))
    scored = shown(spark.read.parquet(f"{out}/scored")).join(raised, "id", "left")
    return scored.withColumn("alerted", F.coalesce("alerted", F.lit(False)))


@query("stream_repeated_alerts", "K07", f"""WITH {ALERTS_SQL} SELECT seq, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (
    PARTITION BY type, source_ip ORDER BY ts, seq) <= 86400000000, false) AS repeated FROM al""")
def _(spark, folder):
    stream = _staged(spark, alerts(spark, folder).select("seq", "type", "source_ip", "ts"), "repeats-in")
    return _run(spark, state.mark_repeats(stream, 1440), "repeats")


@query("stream_scoring", "K06 A17")
def _(spark, folder):
    stream = _staged(spark, packets(spark, folder).select(*captures.PACKET_COLUMNS), "scoring-in")
    results, found = staging_path(spark, "scoring-results"), staging_path(spark, "scoring-alerts")
    jobs.drain(jobs.start(stream, jobs.scoring_sink(results, found), staging_path(spark, "scoring-state")))
    spark.read.parquet(found).limit(1).collect()
    return spark.read.parquet(results).select(*L.KEY, "spkts", "dpkts", "state", "score", "verdict")


@query("stream_batch_quarantine", "K02 K09 A15", f"""WITH {PACKETS_SQL}
SELECT 'packet' AS kind, count(*) AS n FROM pk UNION ALL SELECT 'quarantine', count(DISTINCT seq // 100) FROM pk""")
def _(spark, folder):
    path = staging_path(spark, "envelopes")
    rows = packets(spark, folder)
    captures.batch_json(rows).write.text(path)
    # One damaged envelope per good one.
    numbers = rows.select(F.floor(F.col("seq") / 100).cast("string").alias("n")).distinct()
    damaged = numbers.select(F.concat(F.lit('{"batch_id": '), "n").alias("value"))
    damaged.write.mode("append").text(path)
    stream = jobs.read_stream(spark, path, T.StructType([T.StructField("value", T.StringType())]), "text")
    out, bad = staging_path(spark, "decoded"), staging_path(spark, "undecodable")
    jobs.drain(jobs.start(stream, jobs.batch_sink(out, bad), staging_path(spark, "envelope-state")))
    good = spark.read.parquet(out).agg(F.count("*").alias("n")).select(F.lit("packet").alias("kind"), "n")
    lost = spark.read.json(bad).agg(F.count("*").alias("n")).select(F.lit("quarantine").alias("kind"), "n")
    return good.unionByName(lost)

