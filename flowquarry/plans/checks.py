"""Queries of the flow checks and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import checks as D
from flowquarry.operators import flows as L
from flowquarry.operators import packets as P
from flowquarry.plans.flows import FLOWS_SQL, base
from flowquarry.plans.registry import query
from flowquarry.plans.views import packets

_KEYS = ", ".join(L.KEY)
_SCORED_SQL = FLOWS_SQL + """,
su AS (SELECT *, CASE WHEN state = 'INT' THEN 2 ELSE 0 END + CASE WHEN sttl <> dttl THEN 1 ELSE 0 END
  + CASE WHEN dur < 0.1 AND packets < 5 THEN 2 ELSE 0 END + CASE WHEN swin < 50 THEN 1 ELSE 0 END
  + CASE WHEN tcprtt = 0 AND synack = 0 THEN 1 ELSE 0 END AS score FROM fl)"""


def _flows(spark, folder):
    return L.compat_constants(base(spark, folder))


@query("packet_conservation", "D01", f"""WITH {FLOWS_SQL}
SELECT (SELECT count(*) FROM pk) AS captured, count(*) AS flows, sum(packets)::BIGINT AS in_flows,
  (SELECT count(*) FROM (SELECT DISTINCT {_KEYS} FROM kd)) AS connections,
  abs((SELECT count(*) FROM pk) - sum(packets)) <= 2 AS conserved FROM fl""")
def _(spark, folder):
    rows = packets(spark, folder)
    return D.conservation(rows, base(spark, folder), P.connection_summary(rows))


@query("aggregation_ratio", "D02", f"""WITH {FLOWS_SQL}
SELECT sum(packets)::BIGINT AS packets, count(*) AS flows, round(sum(packets) / count(*), 6) AS ratio,
  round((sum(packets) - count(*)) / sum(packets), 6) AS reduction FROM fl""")
def _(spark, folder):
    return D.aggregation_ratio(base(spark, folder)).select(
        "packets", "flows", F.round("ratio", 6).alias("ratio"), F.round("reduction", 6).alias("reduction")
    )


@query("flow_sanity", "D03", f"""WITH {FLOWS_SQL}
SELECT count(*) AS flows, count(*) FILTER (dur < 0) AS negative_dur,
  count(*) FILTER (proto NOT IN ('tcp', 'udp', 'icmp')) AS unknown_proto FROM fl""")
def _(spark, folder):
    return D.sanity(base(spark, folder))


@query("special_cases", "D04", f"""WITH {FLOWS_SQL}, c AS (SELECT *,
    concat_ws('|', CASE WHEN dpkts = 0 THEN 'possible_scan' END,
      CASE WHEN dur < 0.01 AND packets > 10 THEN 'possible_flood' END,
      CASE WHEN dur > 0 AND (sbytes + dbytes) / dur > 100000000 THEN 'abnormal_transfer' END,
      CASE WHEN state = 'INT' AND packets > 100 THEN 'forced_connection' END) AS cases FROM fl)
SELECT {_KEYS}, cases FROM c""")
def _(spark, folder):
    return _flows(spark, folder).select(*L.KEY, F.concat_ws("|", D.special_cases()).alias("cases"))


@query("suspicion_indicators", "D05", f"""WITH {FLOWS_SQL}, c AS (
  SELECT {_KEYS}, unnest([CASE WHEN state = 'INT' THEN 'interrupted' END,
    CASE WHEN sttl <> dttl THEN 'ttl_differs' END, CASE WHEN dur < 0.1 AND packets < 5 THEN 'very_short' END,
    CASE WHEN swin < 50 OR dwin < 300 THEN 'small_windows' END,
    CASE WHEN tcprtt = 0 AND synack = 0 AND ackdat = 0 THEN 'no_response_times' END,
    CASE WHEN spkts > dpkts * 2 THEN 'one_sided' END]) AS indicator FROM fl)
SELECT * FROM c WHERE indicator IS NOT NULL""")
def _(spark, folder):
    return _flows(spark, folder).select(*L.KEY, F.explode(D.indicators()).alias("indicator"))


@query("suspicion_scores", "D06 L1", f"""WITH {_SCORED_SQL}
SELECT {_KEYS}, spkts, dpkts, sbytes, dbytes, round(dur, 6) AS dur, round(rate, 6) AS rate, state, score,
  CASE WHEN score >= 4 THEN 'justified' WHEN score >= 2 THEN 'borderline' ELSE 'likely_false_positive' END AS verdict,
  concat_ws('|', CASE WHEN state = 'INT' THEN 'interrupted' END, CASE WHEN sttl <> dttl THEN 'ttl_differs' END,
    CASE WHEN dur < 0.1 AND packets < 5 THEN 'very_short' END, CASE WHEN swin < 50 THEN 'small_source_window' END,
    CASE WHEN tcprtt = 0 AND synack = 0 THEN 'no_response_times' END) AS reasons FROM su""")
def _(spark, folder):
    return D.suspicion(_flows(spark, folder)).select(
        *L.KEY, "spkts", "dpkts", "sbytes", "dbytes", F.round("dur", 6).alias("dur"), F.round("rate", 6).alias("rate"),
        "state", "score", "verdict", F.concat_ws("|", "reasons").alias("reasons"),
    )


_OTHERS_SQL = ", ".join(
    f"round((sum({c}) OVER w - {c}) / nullif(count(*) OVER w - 1, 0), 4) AS other_{c}" for c in D.BASELINE
)
_LOW_SQL = ", ".join(
    f"coalesce({c} < (sum({c}) OVER w - {c}) / nullif(count(*) OVER w - 1, 0) / 2, false) AS low_{c}"
    for c in ("dur", "spkts", "swin")
)


@query("service_baseline", "D07", f"""WITH {FLOWS_SQL}
SELECT {_KEYS}, {_OTHERS_SQL}, {_LOW_SQL} FROM fl WINDOW w AS (PARTITION BY service)""")
def _(spark, folder):
    compared = D.service_baseline(_flows(spark, folder), L.KEY)
    return compared.select(
        *L.KEY, *[F.round(f"other_{c}", 4).alias(f"other_{c}") for c in D.BASELINE],
        *[f"low_{c}" for c in ("dur", "spkts", "swin")],
    )


@query("flow_profile_counts", "C28", f"""WITH {FLOWS_SQL}
SELECT 'proto' AS field, proto AS value, count(*) AS flows FROM fl GROUP BY ALL
UNION ALL SELECT 'service', service, count(*) FROM fl GROUP BY ALL
UNION ALL SELECT 'state', state, count(*) FROM fl GROUP BY ALL""")
def _(spark, folder):
    return D.profile_counts(base(spark, folder))


_PROFILED = ["dur", "spkts", "dpkts", "sbytes", "dbytes", "rate", "smean", "dmean"]


@query("flow_profile_summary", "C28", f"WITH {FLOWS_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS field, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(min({c})::DOUBLE, 4) AS lowest, round(max({c})::DOUBLE, 4) AS highest,
  round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
  round(quantile_cont({c}, 0.75), 4) AS q75 FROM fl""" for c in _PROFILED))
def _(spark, folder):
    table = D.profile_summary(base(spark, folder), _PROFILED)
    numbers = ["mean", "std", "lowest", "highest", "q25", "q50", "q75"]
    return table.select("field", "n", *[F.round(c, 4).alias(c) for c in numbers])
