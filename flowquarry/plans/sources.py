"""Queries of the packet sources: frames, capture files, JSON batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.functions import frames
from flowquarry.operators import flows as L
from flowquarry.operators.ordered import arrange, row_numbers
from flowquarry.plans.flows import FLOWS_SQL
from flowquarry.plans.registry import query
from flowquarry.plans.views import ALERTS_SQL, PACKETS_SQL, alerts, packets
from flowquarry.runtime import staging_path
from flowquarry.sources import captures, sinks

_SHOWN = ["seq", "ethertype", "src_ip", "dst_ip", "src_port", "dst_port", "ip_proto", "ttl", "payload"]
_TCP = ["win", "flags", "tcp_seq"]
_SELECT = ", ".join(_SHOWN) + ", " + ", ".join(f"CASE WHEN ip_proto = 6 THEN {c} END AS {c}" for c in _TCP)


@query("frame_decode", "A03", f"""WITH {PACKETS_SQL}
SELECT {_SELECT}, length(payload) + CASE WHEN ip_proto = 6 THEN 54 ELSE 42 END AS len FROM pk""")
def _(spark, folder):
    raw = packets(spark, folder).select("seq", frames.encode_frame().alias("frame"))
    return frames.decode_frames(raw).select(*_SHOWN, *_TCP, "len")


@query("capture_scan", "A01", f"""WITH {PACKETS_SQL}
SELECT {_SELECT}, epoch_us(ts) AS micros, length(payload) + CASE WHEN ip_proto = 6 THEN 54 ELSE 42 END AS len FROM pk""")
def _(spark, folder):
    # Capture files of 1000 packets each, as file contents.
    name = F.format_string("part-%012d.pcap", F.floor(F.col("seq") / 1000).cast("bigint"))
    files = captures.capture_content(packets(spark, folder), name)
    records = captures.number_records(captures.split_captures(files), files)
    decoded = frames.decode_frames(records, "frame", F.col("link_type"))
    position = F.regexp_extract("path", "([0-9]+)", 1).cast("bigint") * 1000 + F.col("pos")
    return decoded.withColumn("seq", position).select(
        *_SHOWN, *_TCP, F.round(F.col("t") * 1e6).cast("bigint").alias("micros"), "len"
    )


@query("capture_ranges", "A01", f"""WITH {PACKETS_SQL}
SELECT {_SELECT}, epoch_us(ts) AS micros, length(payload) + CASE WHEN ip_proto = 6 THEN 54 ELSE 42 END AS len FROM pk""")
def _(spark, folder):
    # Four files in ranges of 16 KB: most ranges begin inside a record, and the order of records tells the numbers.
    path = staging_path(spark, "captures")
    sinks.write_captures(packets(spark, folder).select("seq", "t", frames.encode_frame().alias("frame")), path, 4)
    read = row_numbers(arrange(captures.read_captures(spark, path, 1 << 14)[0], "seq"))
    return read.withColumn("seq", F.col("rn") - 1).select(
        *_SHOWN, *_TCP, F.round(F.col("t") * 1e6).cast("bigint").alias("micros"), "len"
    )


def _batches(spark, folder):
    path = staging_path(spark, "batches")
    captures.batch_json(packets(spark, folder)).write.text(path)
    return captures.read_batches(spark, path)[0]


@query("packet_batches", "A02 A04", f"""WITH {PACKETS_SQL} SELECT {_SELECT}, len, CAST(round(t * 1000000) AS BIGINT) AS micros FROM pk""")
def _(spark, folder):
    return _batches(spark, folder).select(*_SHOWN, *_TCP, "len", F.round(F.col("t") * 1e6).cast("bigint").alias("micros"))


@query("flows_from_batches", "A02 L1", f"""WITH {FLOWS_SQL}
SELECT {", ".join(L.KEY)}, spkts, dpkts, sbytes, dbytes, service, state, trans_depth, round(sjit, 3) AS sjit FROM fl""")
def _(spark, folder):
    table = L.flow_features(_batches(spark, folder))
    return table.select(
        *L.KEY, "spkts", "dpkts", "sbytes", "dbytes", "service", "state", "trans_depth", F.round("sjit", 3).alias("sjit")
    )


@query("restored_times", "A04", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) / 1e6
  WHEN event_id % 3 = 1 THEN 5.5::DOUBLE ELSE 5.5::DOUBLE END AS t FROM events""")
def _(spark, folder):
    from flowquarry.plans.views import events

    n = F.col("event_id")
    micros = F.unix_micros("ts")
    text = F.when(n % 3 == 0, F.format_string("%d.%06d", F.floor(micros / 1_000_000), micros % 1_000_000)).when(n % 3 == 1, "soon")
    rows = events(spark, folder).select("event_id", text.alias("capture_time"), F.lit(5.5).alias("batch_time"))
    return rows.select("event_id", captures.restore_time().alias("t"))


def _mixed_entries(spark, folder):
    """Entries that are objects, text holding an object, or neither."""
    text = F.col("payload")
    item = F.to_json(F.struct(F.col("t").alias("timestamp"), F.col("len").alias("length"), F.lit("eth0").alias("interface")))
    entry = F.when(text == "", F.lit("17")).when(text.startswith("GET"), F.concat(F.lit("  "), item)).otherwise(item)
    return packets(spark, folder).select(
        F.lit("b").alias("batch_id"), F.col("t").alias("batch_time"), F.col("seq").alias("pos"), entry.alias("entry")
    )


@query("entry_normaliser", "A05", f"WITH {PACKETS_SQL} SELECT seq AS pos, len AS length, 'eth0' AS interface FROM pk WHERE payload <> ''")
def _(spark, folder):
    return captures.normalise_entries(_mixed_entries(spark, folder))[0].select("pos", "length", "interface")


@query("entry_rejects", "A05 A15", f"WITH {PACKETS_SQL} SELECT seq AS pos, '17' AS entry FROM pk WHERE payload = ''")
def _(spark, folder):
    path = staging_path(spark, "quarantine")
    sinks.write_quarantine(captures.normalise_entries(_mixed_entries(spark, folder))[1], path, "not a packet")
    return spark.read.json(path).select("pos", "entry")


@query("alert_fan_out", "A17", f"""WITH {ALERTS_SQL}
SELECT 'log' AS target, seq FROM al UNION ALL SELECT 'table', seq FROM al""")
def _(spark, folder):
    table, log = staging_path(spark, "alert-table"), staging_path(spark, "alert-log")
    rows = alerts(spark, folder)
    sinks.fan_out(rows, [
        lambda df: df.write.parquet(table),
        lambda df: df.select(F.to_json(F.struct("seq", "type")).alias("value")).write.text(log),
    ])
    lines = spark.read.text(log).select(F.from_json("value", "seq bigint, type string").alias("a"))
    return spark.read.parquet(table).select(F.lit("table").alias("target"), "seq").unionByName(
        lines.select(F.lit("log").alias("target"), "a.seq")
    )
