"""Packet-level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.functions import net
from flowquarry.operators import packets as P
from flowquarry.plans.registry import query
from flowquarry.plans.views import ALERTS_SQL, MIXED_SQL, PACKETS_SQL, alerts, mixed_packets, packets

_PORT_CASE = "CASE {0} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in net.SERVICE_PORTS.items()) + " END"
PORT_SERVICE_SQL = f"coalesce({_PORT_CASE.format('dst_port')}, {_PORT_CASE.format('src_port')})"
PAYLOAD_SERVICE_SQL = """CASE WHEN lower(payload) LIKE '%http%' OR lower(payload) LIKE '%get %'
  OR lower(payload) LIKE '%post %' THEN 'http'
  WHEN lower(payload) LIKE '%ftp%' THEN 'ftp' WHEN lower(payload) LIKE '%smtp%' THEN 'smtp' END"""
PACKET_SERVICE_SQL = f"""CASE WHEN ip_proto = 6 THEN coalesce({PORT_SERVICE_SQL}, {PAYLOAD_SERVICE_SQL}, '-')
  WHEN ip_proto = 17 THEN coalesce({PORT_SERVICE_SQL}, '-') ELSE '-' END"""
_NAME_CASE = "CASE ip_proto " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in net.PROTOCOL_NAMES.items()) + (
    " ELSE 'Proto-' || CAST(ip_proto AS VARCHAR) END"
)
NAME_SQL = f"""CASE WHEN ethertype = 2048 THEN {_NAME_CASE}
  WHEN ethertype = 34525 THEN CASE ip_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 58 THEN 'ICMPv6'
    ELSE 'IPv6-' || CAST(ip_proto AS VARCHAR) END
  WHEN ethertype = 2054 THEN 'ARP' ELSE 'Unknown' END"""
FLAG_SQL = " || ".join(f"CASE WHEN flags & {bit} > 0 THEN '{letter}' ELSE '' END" for letter, bit in net.TCP_FLAGS)
NAMED_SQL = MIXED_SQL + f""",
nm AS (SELECT *, {NAME_SQL} AS proto_name FROM mx),
ci AS (
  SELECT *,
    CASE WHEN ethertype IN (2048, 34525) THEN src_ip ELSE 'unknown' END AS conn_src_ip,
    CASE WHEN ethertype IN (2048, 34525) THEN dst_ip ELSE 'unknown' END AS conn_dst_ip,
    CASE WHEN (ethertype IN (2048, 34525) AND ip_proto IN (6, 17)) OR (ethertype = 2048 AND ip_proto = 1)
      THEN src_port ELSE 0 END AS conn_src_port,
    CASE WHEN (ethertype IN (2048, 34525) AND ip_proto IN (6, 17)) OR (ethertype = 2048 AND ip_proto = 1)
      THEN dst_port ELSE 0 END AS conn_dst_port,
    CASE WHEN ethertype IN (2048, 34525) AND ip_proto = 6 THEN {FLAG_SQL} ELSE proto_name END AS conn_info
  FROM nm),
sw AS (SELECT *, proto_name IN ('TCP', 'UDP')
    AND (conn_dst_ip, conn_dst_port) < (conn_src_ip, conn_src_port) AS swap FROM ci),
ck AS (
  SELECT *, CASE WHEN swap THEN conn_dst_ip ELSE conn_src_ip END AS a_ip,
    CASE WHEN swap THEN conn_dst_port ELSE conn_src_port END AS a_port,
    CASE WHEN swap THEN conn_src_ip ELSE conn_dst_ip END AS b_ip,
    CASE WHEN swap THEN conn_src_port ELSE conn_dst_port END AS b_port
  FROM sw)"""
SUMMARY_SQL = """proto_name || ' ' || src_ip || ':' || CAST(src_port AS VARCHAR) || ' > ' || dst_ip || ':'
  || CAST(dst_port AS VARCHAR)"""


@query("non_ip_filter", "B01", f"""WITH {MIXED_SQL}
SELECT seq, src_ip, dst_ip, ip_proto, len FROM mx WHERE ethertype = 2048""")
def _(spark, folder):
    return P.only_ip(mixed_packets(spark, folder)).select("seq", "src_ip", "dst_ip", "ip_proto", "len")


@query("protocol_stack_list", "B02", f"""WITH {MIXED_SQL}
SELECT 'Ether' || CASE WHEN ethertype = 2048 THEN '/IP' WHEN ethertype = 34525 THEN '/IPv6'
    WHEN ethertype = 2054 THEN '/ARP' ELSE '' END
  || CASE WHEN ethertype IN (2048, 34525) AND ip_proto = 6 THEN '/TCP'
    WHEN ethertype IN (2048, 34525) AND ip_proto = 17 THEN '/UDP'
    WHEN ethertype = 2048 AND ip_proto = 1 THEN '/ICMP' ELSE '' END
  || CASE WHEN length(payload) > 0 THEN '/Raw' ELSE '' END AS stack,
  count(*) AS packets, sum(len)::BIGINT AS bytes FROM mx GROUP BY 1""")
def _(spark, folder):
    stacks = mixed_packets(spark, folder).withColumn("stack", F.concat_ws("/", P.protocol_stack()))
    return stacks.groupBy("stack").agg(F.count("*").alias("packets"), F.sum("len").alias("bytes"))


@query("packet_basic_info", "B03", f"""WITH {MIXED_SQL}
SELECT seq, CASE WHEN ethertype = 2048 THEN src_ip END AS src_ip, CASE WHEN ethertype = 2048 THEN dst_ip END AS dst_ip,
  CASE WHEN ip_proto IN (6, 17) AND ethertype IN (2048, 34525) THEN src_port END AS src_port,
  CASE WHEN ip_proto IN (6, 17) AND ethertype IN (2048, 34525) THEN dst_port END AS dst_port,
  CASE WHEN ethertype = 2048 THEN ip_proto END AS protocol FROM mx""")
def _(spark, folder):
    return P.basic_info(mixed_packets(spark, folder))


@query("packet_ids", "B04", f"""WITH {NAMED_SQL}
SELECT seq, md5(CAST(epoch_us(ts) AS VARCHAR) || '|' || CAST(len AS VARCHAR) || '|' || {SUMMARY_SQL}) AS packet_id
FROM nm""")
def _(spark, folder):
    return mixed_packets(spark, folder).select("seq", P.packet_id().alias("packet_id"))


@query("batch_ids", "B04 K01", f"""WITH {PACKETS_SQL}
SELECT seq // 100 AS batch_no, count(*) AS packet_count, sum(len)::BIGINT AS bytes,
  md5(CAST(min(epoch_us(ts)) AS VARCHAR) || '|' || CAST(count(*) AS VARCHAR)) AS batch_id FROM pk GROUP BY 1""")
def _(spark, folder):
    return P.batch_ids(packets(spark, folder)).select("batch_no", "packet_count", "bytes", "batch_id")


@query("protocol_naming", "B05", f"""WITH {NAMED_SQL}
SELECT ethertype, ip_proto, proto_name, count(*) AS packets FROM nm GROUP BY ALL""")
def _(spark, folder):
    name = net.protocol_name(F.col("ethertype"), F.col("ip_proto")).alias("proto_name")
    return mixed_packets(spark, folder).groupBy("ethertype", "ip_proto", name).agg(F.count("*").alias("packets"))


@query("connection_info", "B06", f"""WITH {NAMED_SQL}
SELECT seq, conn_src_ip, conn_dst_ip, conn_src_port, conn_dst_port, conn_info FROM ci""")
def _(spark, folder):
    return P.connection_info(mixed_packets(spark, folder)).select(
        "seq", "conn_src_ip", "conn_dst_ip", "conn_src_port", "conn_dst_port", "conn_info"
    )


@query("tcp_flag_strings", "B07", f"""WITH {PACKETS_SQL}
SELECT {FLAG_SQL} AS flag_text, flags, count(*) AS packets FROM pk WHERE ip_proto = 6 GROUP BY ALL""")
def _(spark, folder):
    tcp = packets(spark, folder).filter(net.is_tcp())
    return tcp.groupBy(net.flag_string(F.col("flags")).alias("flag_text"), "flags").agg(F.count("*").alias("packets"))


@query("service_detection", "B08", f"""WITH {PACKETS_SQL}
SELECT seq, {PACKET_SERVICE_SQL} AS service FROM pk""")
def _(spark, folder):
    return packets(spark, folder).select("seq", net.packet_service().alias("service"))


_DNS_MIX = "CASE WHEN seq % 5 = 0 THEN 53 ELSE dst_port END"


@query("dns_override", "B09", f"""WITH {PACKETS_SQL}, re AS (SELECT * REPLACE ({_DNS_MIX} AS dst_port) FROM pk)
SELECT src_ip, dst_ip, max(CASE WHEN ip_proto = 17 AND (src_port = 53 OR dst_port = 53) THEN 1 ELSE 0 END) AS dns_seen,
  CASE WHEN max(CASE WHEN ip_proto = 17 AND (src_port = 53 OR dst_port = 53) THEN 1 ELSE 0 END) = 1 THEN 'dns'
    ELSE coalesce(arg_min({PACKET_SERVICE_SQL}, seq) FILTER ({PACKET_SERVICE_SQL} <> '-'), '-') END AS service
FROM re GROUP BY src_ip, dst_ip""")
def _(spark, folder):
    df = packets(spark, folder)
    df = df.withColumn("dst_port", F.when(F.col("seq") % 5 == 0, 53).otherwise(F.col("dst_port")))
    df = df.withColumn("svc", net.packet_service())
    seen = F.max(F.when(net.is_dns(), 1).otherwise(0))
    first = F.min_by("svc", F.when(F.col("svc") != "-", F.col("seq")))
    return df.groupBy("src_ip", "dst_ip").agg(
        seen.alias("dns_seen"), F.when(seen == 1, "dns").otherwise(F.coalesce(first, F.lit("-"))).alias("service")
    )


@query("http_payload_marks", "B10", f"""WITH {PACKETS_SQL}
SELECT seq, CASE WHEN regexp_matches(payload, '(GET|POST|PUT|DELETE) ') THEN 1 ELSE 0 END AS methods,
  CASE WHEN contains(payload, 'HTTP/1.') THEN 1 ELSE 0 END AS versions,
  coalesce(TRY_CAST(nullif(regexp_extract(payload, 'Content-Length:[ ]*([0-9]+)', 1), '') AS BIGINT), 0) AS body_len
FROM pk""")
def _(spark, folder):
    payload = F.col("payload")
    return packets(spark, folder).select(
        "seq", net.http_method_seen(payload).alias("methods"), net.http_version_seen(payload).alias("versions"),
        net.content_length(payload).alias("body_len"),
    )


@query("ftp_payload_marks", "B11", f"""WITH {PACKETS_SQL}
SELECT src_ip, max(CASE WHEN regexp_matches(payload, '(USER|PASS) ') THEN 1 ELSE 0 END) AS login,
  sum(CASE WHEN regexp_matches(payload, '(USER|PASS|LIST|RETR|STOR|CWD|PWD|QUIT) ') THEN 1 ELSE 0 END)::BIGINT AS commands
FROM pk GROUP BY src_ip""")
def _(spark, folder):
    payload = F.col("payload")
    return packets(spark, folder).groupBy("src_ip").agg(
        F.max(net.ftp_login_seen(payload)).alias("login"), F.sum(net.ftp_command_seen(payload)).alias("commands")
    )


@query("private_addresses", "B12", f"""WITH {ALERTS_SQL}
SELECT seq, source_ip, coalesce(len(string_split(source_ip, '.')) = 4
  AND TRY_CAST(string_split(source_ip, '.')[2] AS INTEGER) IS NOT NULL
  AND (TRY_CAST(string_split(source_ip, '.')[1] AS INTEGER) = 10
    OR (TRY_CAST(string_split(source_ip, '.')[1] AS INTEGER) = 172
      AND TRY_CAST(string_split(source_ip, '.')[2] AS INTEGER) BETWEEN 16 AND 31)
    OR (TRY_CAST(string_split(source_ip, '.')[1] AS INTEGER) = 192
      AND TRY_CAST(string_split(source_ip, '.')[2] AS INTEGER) = 168)), false) AS is_private FROM al""")
def _(spark, folder):
    return alerts(spark, folder).select("seq", "source_ip", net.private_address(F.col("source_ip")).alias("is_private"))


@query("first_packets", "B13", f"""WITH {MIXED_SQL}
SELECT seq + 1 AS packet_num, src_ip, dst_ip, len FROM (SELECT * FROM mx ORDER BY seq LIMIT 10) WHERE ethertype = 2048""")
def _(spark, folder):
    return P.first_packets(mixed_packets(spark, folder)).select("packet_num", "src_ip", "dst_ip", "len")


@query("protocol_aware_keys", "C02", f"""WITH {NAMED_SQL}
SELECT seq, a_ip, a_port, b_ip, b_port, proto_name FROM ck""")
def _(spark, folder):
    return P.connection_key(mixed_packets(spark, folder)).select("seq", "a_ip", "a_port", "b_ip", "b_port", "proto_name")


@query("connection_summary", "C25", f"""WITH {NAMED_SQL}
SELECT a_ip, a_port, b_ip, b_port, arg_min(proto_name, seq) AS proto_name, count(*) AS packets, sum(len)::BIGINT AS bytes
FROM ck GROUP BY ALL""")
def _(spark, folder):
    return P.connection_summary(mixed_packets(spark, folder))


@query("connection_listing", "C25", f"""WITH {NAMED_SQL}, r AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY a_ip, a_port, b_ip, b_port) AS packets FROM ck
  WINDOW w AS (PARTITION BY a_ip, a_port, b_ip, b_port ORDER BY seq))
SELECT a_ip, a_port, b_ip, b_port, CAST(rn AS INTEGER) AS rn, seq, len,
  CASE WHEN packets > 5 THEN packets - 3 ELSE 0 END AS not_shown
FROM r WHERE (packets <= 5) OR rn <= 3""")
def _(spark, folder):
    return P.connection_listing(mixed_packets(spark, folder)).select(
        "a_ip", "a_port", "b_ip", "b_port", "rn", "seq", "len", "not_shown"
    )


@query("protocol_histogram", "C27", f"""WITH {NAMED_SQL}
SELECT proto_name, count(*) AS packets FROM nm GROUP BY proto_name""")
def _(spark, folder):
    return P.protocol_histogram(mixed_packets(spark, folder))
