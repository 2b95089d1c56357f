"""Flow queries: keys, features, sessions and reports on the flow table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import flows as L
from flowquarry.plans.packets import PACKET_SERVICE_SQL, PORT_SERVICE_SQL
from flowquarry.plans.registry import query
from flowquarry.plans.views import PACKETS_SQL, packets
from flowquarry.schemas import FEATURES

KEYED_SQL = PACKETS_SQL + f""",
kd AS (
  SELECT *, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS a_ip, CASE WHEN fwd THEN src_port ELSE dst_port END AS a_port,
    CASE WHEN fwd THEN dst_ip ELSE src_ip END AS b_ip, CASE WHEN fwd THEN dst_port ELSE src_port END AS b_port
  FROM (SELECT *, (src_ip, src_port) < (dst_ip, dst_port) AS fwd, {PACKET_SERVICE_SQL} AS svc,
      ip_proto = 17 AND (src_port = 53 OR dst_port = 53) AS dns,
      CASE WHEN ip_proto = 6 AND regexp_matches(payload, '(GET|POST|PUT|DELETE) ') THEN 1 ELSE 0 END AS m_http,
      CASE WHEN ip_proto = 6 AND contains(payload, 'HTTP/1.') THEN 1 ELSE 0 END AS m_ver,
      CASE WHEN ip_proto = 6 THEN coalesce(TRY_CAST(nullif(
        regexp_extract(payload, 'Content-Length:[ ]*([0-9]+)', 1), '') AS BIGINT), 0) ELSE 0 END AS m_len,
      CASE WHEN ip_proto = 6 AND regexp_matches(payload, '(USER|PASS) ') THEN 1 ELSE 0 END AS m_login,
      CASE WHEN ip_proto = 6 AND regexp_matches(payload, '(USER|PASS|LIST|RETR|STOR|CWD|PWD|QUIT) ')
        THEN 1 ELSE 0 END AS m_cmd
    FROM pk))"""
_GROUP = "a_ip, a_port, b_ip, b_port"


def _surrogate(name: str) -> str:
    cap, source, step = L.SURROGATES[name]
    amount = {"spkts": "spkts", "ttl": "(sttl + dttl)", "packets": "(spkts + dpkts)"}[source]
    return f"CAST(least({cap}, greatest(1, {amount} // {step})) AS INTEGER) AS {name}"


def features_sql(group: str, source: str) -> str:
    """``fl``: the features of the packets of ``source``, one row per ``group``."""
    return f""",
sv AS (
  SELECT *, min(CASE WHEN svc <> '-' THEN seq END) OVER w AS svc_seq, min(CASE WHEN dns THEN seq END) OVER w AS dns_seq,
    arg_min(svc, seq) FILTER (svc <> '-') OVER w AS first_svc
  FROM {source} WINDOW w AS (PARTITION BY {group})),
gp AS (SELECT *, abs(t - lag(t) OVER (PARTITION BY {group}, fwd ORDER BY seq)) AS gap FROM sv),
gm AS (SELECT *, avg(gap) OVER (PARTITION BY {group}, fwd) AS gap_mean,
    count(gap) OVER (PARTITION BY {group}, fwd) AS n_gaps,
    seq >= svc_seq AND (dns_seq IS NULL OR seq < dns_seq) AS counted FROM gp),
f0 AS (
  SELECT {group}, min(seq) AS first_seq, arg_min(t, seq) AS first_time, arg_max(t, seq) AS last_time, count(*) AS packets,
    arg_min(fwd, seq) AS first_fwd,
    arg_max(t, seq) - arg_min(t, seq) AS dur,
    arg_min(CASE ip_proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'other' END, seq) AS proto,
    CASE WHEN bool_or(dns) THEN 'dns' ELSE coalesce(min(first_svc), '-') END AS service,
    count(*) FILTER (fwd) AS spkts, count(*) FILTER (NOT fwd) AS dpkts,
    coalesce(sum(len) FILTER (fwd), 0)::BIGINT AS sbytes, coalesce(sum(len) FILTER (NOT fwd), 0)::BIGINT AS dbytes,
    coalesce(arg_min(ttl, seq) FILTER (fwd AND ttl <> 0), 0) AS sttl,
    coalesce(arg_min(ttl, seq) FILTER (NOT fwd AND ttl <> 0), 0) AS dttl,
    coalesce(arg_min(win, seq) FILTER (fwd AND ip_proto = 6 AND win <> 0), 0) AS swin,
    coalesce(arg_min(win, seq) FILTER (NOT fwd AND ip_proto = 6 AND win <> 0), 0) AS dwin,
    coalesce(arg_max(tcp_seq, seq) FILTER (fwd AND ip_proto = 6), 0) AS stcpb,
    coalesce(arg_max(tcp_seq, seq) FILTER (NOT fwd AND ip_proto = 6), 0) AS dtcpb,
    coalesce(bit_or(flags) FILTER (ip_proto = 6), 0) AS bits,
    CASE WHEN count(*) FILTER (fwd) >= 2 THEN (arg_max(t, seq) FILTER (fwd) - arg_min(t, seq) FILTER (fwd))
      / (count(*) FILTER (fwd) - 1) ELSE 0.0 END AS sinpkt,
    CASE WHEN count(*) FILTER (NOT fwd) >= 2 THEN (arg_max(t, seq) FILTER (NOT fwd) - arg_min(t, seq) FILTER (NOT fwd))
      / (count(*) FILTER (NOT fwd) - 1) ELSE 0.0 END AS dinpkt,
    coalesce(avg(abs(gap - gap_mean)) FILTER (fwd AND n_gaps >= 2), 0.0) AS sjit,
    coalesce(avg(abs(gap - gap_mean)) FILTER (NOT fwd AND n_gaps >= 2), 0.0) AS djit,
    CAST(coalesce(sum(m_http) FILTER (counted AND first_svc = 'http'), 0) AS INTEGER) AS ct_flw_http_mthd,
    CAST(coalesce(sum(m_ver) FILTER (counted AND first_svc = 'http'), 0) AS INTEGER) AS trans_depth,
    coalesce(sum(m_len) FILTER (counted AND first_svc = 'http'), 0)::BIGINT AS response_body_len,
    coalesce(max(m_login) FILTER (counted AND first_svc = 'ftp'), 0) AS is_ftp_login,
    CAST(coalesce(sum(m_cmd) FILTER (counted AND first_svc = 'ftp'), 0) AS INTEGER) AS ct_ftp_cmd
  FROM gm GROUP BY {group}),
f1 AS (
  SELECT *,
    CASE WHEN proto <> 'tcp' THEN 'INT' WHEN bits & 1 > 0 THEN 'FIN' WHEN bits & 4 > 0 THEN 'RST'
      WHEN bits & 2 > 0 AND bits & 16 > 0 THEN 'CON' WHEN bits & 2 > 0 THEN 'REQ' ELSE 'INT' END AS state,
    CASE WHEN dur > 0 THEN packets / dur ELSE 0.0 END AS rate,
    CASE WHEN dur > 0 THEN sbytes / dur ELSE 0.0 END AS sload,
    CASE WHEN dur > 0 THEN dbytes / dur ELSE 0.0 END AS dload,
    CASE WHEN spkts > 0 THEN sbytes / spkts ELSE 0.0 END AS smean,
    CASE WHEN dpkts > 0 THEN dbytes / dpkts ELSE 0.0 END AS dmean,
    CAST(0 AS BIGINT) AS sloss, CAST(0 AS BIGINT) AS dloss,
    0.0::DOUBLE AS tcprtt, 0.0::DOUBLE AS synack, 0.0::DOUBLE AS ackdat, 0 AS is_sm_ips_ports
  FROM f0),
fl AS (SELECT *, {", ".join(_surrogate(n) for n in L.SURROGATES)} FROM f1)"""


FLOWS_SQL = KEYED_SQL + features_sql(_GROUP, "kd")
ROUNDED = ["dur", "rate", "sload", "dload", "sinpkt", "dinpkt", "sjit", "djit", "smean", "dmean"]
_KEYS = ", ".join(L.KEY)


def rounded(columns, digits=6):
    return [F.round(c, digits).alias(c) if c in ROUNDED else F.col(c) for c in columns]


def rounded_sql(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" if c in ROUNDED else c for c in columns)


def base(spark, folder):
    return L.flow_base(L.keyed_packets(packets(spark, folder)))


def flows(spark, folder, **options):
    return L.flow_features(packets(spark, folder), **options)


def _base_query(name, covers, columns, digits=6):
    """A report on columns the plain aggregate provides; Catalyst prunes the rest."""
    @query(name, covers, f"WITH {FLOWS_SQL} SELECT {_KEYS}, {rounded_sql(columns, digits)} FROM fl")
    def _(spark, folder):
        return L.tracking_surrogates(L.compat_constants(base(spark, folder))).select(
            *L.KEY, *rounded(columns, digits)
        )


@query("flow_keys", "C01", f"WITH {KEYED_SQL} SELECT seq, {_KEYS}, fwd FROM kd")
def _(spark, folder):
    return L.keyed_packets(packets(spark, folder)).select("seq", "flow.*", "fwd")


_base_query("flow_counts_and_bytes", "C03", ["spkts", "dpkts", "sbytes", "dbytes"])
_base_query("flow_first_ttl", "C04", ["sttl", "dttl"])
_base_query("flow_first_window", "C05", ["swin", "dwin"])
_base_query("flow_last_sequence", "C06", ["stcpb", "dtcpb"])
_base_query("flow_protocol", "C07", ["proto"])
_base_query("flow_service", "C08", ["service"])
_base_query("flow_state", "C10", ["state"])
_base_query("flow_duration", "C11", ["dur"])
_base_query("flow_rate", "C12", ["packets", "rate"])
_base_query("flow_load", "C13", ["sload", "dload"])
_base_query("flow_mean_gap", "C14", ["sinpkt", "dinpkt"])
_base_query("flow_mean_size", "C16", ["smean", "dmean"])
_base_query("flow_constant_columns", "C17 C20 C21",
            ["sloss", "dloss", "tcprtt", "synack", "ackdat", "is_sm_ips_ports"])
_base_query("flow_tracking_surrogates", "C18", list(L.SURROGATES))

_COUNTERS = ["ct_flw_http_mthd", "trans_depth", "response_body_len", "is_ftp_login", "ct_ftp_cmd"]


@query("flow_payload_counters", "C09", f"WITH {FLOWS_SQL} SELECT {_KEYS}, service, {', '.join(_COUNTERS)} FROM fl")
def _(spark, folder):
    keyed = L.keyed_packets(packets(spark, folder))
    return L.payload_counters(keyed, L.flow_base(keyed)).select(*L.KEY, "service", *_COUNTERS)


@query("flow_jitter", "C15", f"""WITH {FLOWS_SQL}
SELECT {_KEYS}, {rounded_sql(["sjit", "djit"], 4)} FROM fl WHERE spkts >= 3 OR dpkts >= 3""")
def _(spark, folder):
    return L.jitter(L.keyed_packets(packets(spark, folder))).select("flow.*", *rounded(["sjit", "djit"], 4))


@query("flow_feature_table", "C22 C23 L1", f"WITH {FLOWS_SQL} SELECT {_KEYS}, {rounded_sql(FEATURES, 4)} FROM fl")
def _(spark, folder):
    return flows(spark, folder).select(*L.KEY, *rounded(FEATURES, 4))


_SWAP_SQL = "CASE WHEN first_fwd THEN {0} ELSE {1} END AS {0}, CASE WHEN first_fwd THEN {1} ELSE {0} END AS {1}"


@query("flow_initiator_view", "C01", f"""WITH {FLOWS_SQL}
SELECT {_KEYS}, {", ".join(_SWAP_SQL.format(a, b) for a, b in [("spkts", "dpkts"), ("sbytes", "dbytes"), ("sttl", "dttl")])}
FROM fl""")
def _(spark, folder):
    table = flows(spark, folder, orientation="initiator")
    return table.select(*L.KEY, "spkts", "dpkts", "sbytes", "dbytes", "sttl", "dttl")


@query("flow_retransmissions", "C17", f"""WITH {KEYED_SQL}
SELECT {_KEYS}, (count(*) FILTER (fwd) - count(DISTINCT tcp_seq) FILTER (fwd))::BIGINT AS sloss,
  (count(*) FILTER (NOT fwd) - count(DISTINCT tcp_seq) FILTER (NOT fwd))::BIGINT AS dloss
FROM (SELECT * REPLACE (tcp_seq % 7 AS tcp_seq) FROM kd WHERE ip_proto = 6) GROUP BY {_GROUP}""")
def _(spark, folder):
    coarse = packets(spark, folder).withColumn("tcp_seq", F.col("tcp_seq") % 7)
    return L.retransmissions(L.keyed_packets(coarse)).select("flow.*", "sloss", "dloss")


@query("flow_recent_connections", "C19", f"""WITH {FLOWS_SQL}
SELECT {_KEYS}, {", ".join(
    f"CAST(count(*) OVER (PARTITION BY {', '.join(cols)} ORDER BY last_time RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)"
    f" AS INTEGER) AS {name}" for name, cols in L.TRACKING_KEYS.items())} FROM fl""")
def _(spark, folder):
    return L.recent_connections(base(spark, folder)).select(*L.KEY, *L.TRACKING_KEYS)


@query("flow_same_endpoints", "C20", f"""WITH {FLOWS_SQL}
SELECT {_KEYS}, CASE WHEN a_ip = b_ip AND a_port = b_port THEN 1 ELSE 0 END AS is_sm_ips_ports FROM fl""")
def _(spark, folder):
    return base(spark, folder).select(*L.KEY, L.same_endpoints().alias("is_sm_ips_ports"))


@query("flow_handshake_times", "C21", f"""WITH {KEYED_SQL},
h0 AS (SELECT *, min(CASE WHEN ip_proto = 6 AND flags & 18 = 2 THEN seq END) OVER w AS syn,
    arg_min(t, seq) FILTER (ip_proto = 6 AND flags & 18 = 2) OVER w AS syn_t
  FROM kd WINDOW w AS (PARTITION BY {_GROUP})),
h1 AS (SELECT *, min(CASE WHEN ip_proto = 6 AND flags & 18 = 18 AND seq > syn THEN seq END) OVER w AS sa,
    arg_min(t, seq) FILTER (ip_proto = 6 AND flags & 18 = 18 AND seq > syn) OVER w AS sa_t
  FROM h0 WINDOW w AS (PARTITION BY {_GROUP})),
h2 AS (SELECT {_GROUP}, min(syn_t) AS syn_t, min(sa_t) AS sa_t,
    arg_min(t, seq) FILTER (ip_proto = 6 AND flags & 18 = 16 AND seq > sa) AS ack_t FROM h1 GROUP BY {_GROUP})
SELECT {_KEYS}, round(sa_t - syn_t, 4) AS synack, round(coalesce(ack_t - sa_t, 0), 4) AS ackdat,
  round(sa_t - syn_t + coalesce(ack_t - sa_t, 0), 4) AS tcprtt FROM h2 WHERE sa_t IS NOT NULL""")
def _(spark, folder):
    times = L.handshake(L.keyed_packets(packets(spark, folder)))
    return times.select("flow.*", *[F.round(c, 4).alias(c) for c in ("synack", "ackdat", "tcprtt")])


FLOW_ID_SQL = f"CAST('0x' || substr(md5(concat_ws('|', {_KEYS})), 1, 15) AS BIGINT)"


@query("flow_ids", "C24", f"WITH {FLOWS_SQL} SELECT {_KEYS}, {FLOW_ID_SQL} AS id FROM fl")
def _(spark, folder):
    return base(spark, folder).select(*L.KEY, L.flow_id().alias("id"))


@query("flow_extended_table", "C17 C19 C20 C21")
def _(spark, folder):
    return flows(spark, folder, features="extended").select(*L.KEY, *rounded(FEATURES, 4))


@query("flow_five_tuple_counts", "C01", f"""WITH {KEYED_SQL}
SELECT {_KEYS}, ip_proto, count(*) FILTER (fwd) AS spkts, count(*) FILTER (NOT fwd) AS dpkts FROM kd GROUP BY ALL""")
def _(spark, folder):
    keyed = L.keyed_packets(packets(spark, folder))
    return L.flow_base(keyed, L.FIVE_TUPLE).select(*L.KEY, "ip_proto", "spkts", "dpkts")
