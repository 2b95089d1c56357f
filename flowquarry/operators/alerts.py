"""Alert life cycle: validation, enrichment, scoring, routing, paging, actions, incidents.

Alerts carry ``type, message, ts`` (timestamp) and ``timestamp`` (its text), plus optional
severity, confidence, source_ip and destination_ip; ``seq`` is the arrival number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions import net
from flowquarry.functions.numeric import flag
from flowquarry.operators.ordered import (
    arrange, previous, row_numbers, running_total, top_n_per_group, without_positions,
)

# Severity ranks, type descriptions, routing and limits.
SEVERITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}
DESCRIPTIONS = {
    "intrusion": "Tentative d'intrusion détectée",
    "anomaly": "Comportement anormal détecté",
    "system": "Problème système",
    "network": "Anomalie réseau",
    "malware": "Malware potentiel détecté",
}
UNKNOWN_DESCRIPTION = "Type d'alerte inconnu"
ROUTES = {"critical": ["email", "sms"], "high": ["email"], "medium": ["dashboard"], "low": ["dashboard"]}
MAX_SCORE = 5
REPEAT_MINUTES, REPEAT_CHECK = 5, 50
MAX_PER_PAGE = 100
HISTORY, PER_SEVERITY, OVERALL = 1000, 1000, 10_000
CORRELATION_SECONDS, SUPPRESSION_SECONDS, PER_MINUTE, RETENTION_DAYS = 300, 600, 100, 30


def is_complete() -> Column:
    return F.col("type").isNotNull() & F.col("message").isNotNull() & F.col("timestamp").isNotNull()


def split_valid(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete alerts, and the rejected rest."""
    return alerts.filter(is_complete()), alerts.filter(~is_complete())


def stamp(alerts: DataFrame, processed_at: Column, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Id, processing time and initial status; the id counts alerts in time order."""
    numbered = without_positions(row_numbers(arrange(alerts, *order)))
    identity = F.concat(
        F.lit("alert_"), F.unix_timestamp(processed_at).cast("string"), F.lit("_"), (F.col("rn") - 1).cast("string")
    )
    return (
        numbered.withColumn("id", identity).withColumn("processed_at", processed_at).withColumn("status", F.lit("new"))
        .withColumn("acknowledged", F.lit(False)).withColumn("false_positive", F.lit(False)).drop("rn")
    )


def description() -> Column:
    return F.coalesce(F.try_element_at(net.literal_map(DESCRIPTIONS), F.col("type")), F.lit(UNKNOWN_DESCRIPTION))


def normal_severity() -> Column:
    """Lower case; missing or unknown becomes medium."""
    lowered = F.lower("severity")
    return F.when(lowered.isin(list(SEVERITY)), lowered).otherwise("medium")


def address_info(ip: Column) -> Column:
    """What is known about an address; places are unknown without a geo table."""
    info = F.struct(
        ip.alias("ip"), net.private_address(ip).alias("is_private"),
        F.lit("Unknown").alias("country"), F.lit("Unknown").alias("organization"),
    )
    return F.when(ip.isNotNull(), info)


def with_places(alerts: DataFrame, places: DataFrame) -> DataFrame:
    """Replace the unknown places by a table ``ip, country, organization`` with unique ips."""
    found = places.select(
        F.col("ip").alias("source_ip"), F.col("country").alias("_c"), F.col("organization").alias("_o")
    )
    joined = alerts.join(found, "source_ip", "left")
    info = F.col("source_info").withField("country", F.coalesce("_c", F.col("source_info.country")))
    info = info.withField("organization", F.coalesce("_o", F.col("source_info.organization")))
    return joined.withColumn("source_info", info).drop("_c", "_o")


def enrich(alerts: DataFrame) -> DataFrame:
    return (
        alerts.withColumn("type_description", description()).withColumn("severity", normal_severity())
        .withColumn("source_info", address_info(F.col("source_ip")))
        .withColumn("destination_info", address_info(F.col("destination_ip")))
    )


def severity_score(repeated: Column) -> Column:
    """Base severity plus one each for intrusions, high confidence and repetition, at most 5."""
    base = F.coalesce(F.try_element_at(net.literal_map(SEVERITY), F.col("severity")), F.lit(SEVERITY["medium"]))
    return F.least(
        F.lit(MAX_SCORE),
        base + flag(F.col("type") == "intrusion") + flag(F.col("confidence") > 0.9) + flag(repeated),
    )


def mark_repeated(alerts: DataFrame, minutes: int = REPEAT_MINUTES, last: int | None = None) -> DataFrame:
    """``repeated``: same type and source within the window before this alert.

    The nearest earlier alert of the same key decides, so one sorted pass is enough.
    With ``last`` the earlier alert must also be among that many preceding alerts.
    """
    df = alerts.withColumn("_micros", F.unix_micros("ts"))
    wanted = {"_before": "_micros"}
    if last is not None:
        df = without_positions(row_numbers(arrange(df, "ts", "seq"), name="_rank"))
        wanted["_before_rank"] = "_rank"
    key = ["type", "source_ip"]
    seen = previous(arrange(df, *key, "ts", "seq"), key, wanted)
    near = F.col("_micros") - F.col("_before") <= minutes * 60_000_000
    if last is not None:
        near = near & (F.col("_rank") - F.col("_before_rank") <= last)
    out = seen.withColumn("repeated", F.coalesce(near, F.lit(False)))
    return without_positions(out).drop("_micros", "_before", "_rank", "_before_rank")


def route(alerts: DataFrame, rules: dict[str, list[str]] = ROUTES) -> DataFrame:
    """One row per alert and notification method; no rule means dashboard."""
    table = net.literal_map({k: ",".join(v) for k, v in rules.items()})
    severity = F.coalesce(F.col("severity"), F.lit("medium"))
    methods = F.split(F.coalesce(F.try_element_at(table, severity), F.lit("dashboard")), ",")
    return alerts.withColumn("method", F.explode(methods))


def subject() -> Column:
    return F.format_string("[IDS ALERT] %s - %s", F.upper("severity"), F.col("type"))


def sms_text() -> Column:
    return F.format_string(
        "IDS ALERT: %s - %s - %s", F.upper("severity"), F.col("type"), F.substring("message", 1, 100)
    )


# The lines of a mail and the line before the alert's details.
DETAILS_LINE = "Détails supplémentaires:"
DETAILS = [
    "id", "type", "type_description", "message", "timestamp", "severity", "severity_score", "confidence", "source_ip", "destination_ip",
    "source_info", "destination_info", "processed_at", "status", "acknowledged", "false_positive",
]


def mail_body(details: Sequence[str] = DETAILS) -> Column:
    """The mail's text; its last line is the alert as JSON, missing values as null."""
    processed = F.date_format("processed_at", "yyyy-MM-dd'T'HH:mm:ss")
    shown = [processed.alias(c) if c == "processed_at" else F.col(c) for c in details]
    lines = [
        F.lit("ALERTE IDS DÉTECTÉE"), F.concat(F.lit("ID: "), "id"),
        F.concat(F.lit("Type: "), "type_description"), F.concat(F.lit("Sévérité: "), F.upper("severity")),
        F.concat(F.lit("Score: "), F.col("severity_score").cast("string"), F.lit(f"/{MAX_SCORE}")),
        F.concat(F.lit("Message: "), "message"), F.concat(F.lit("Timestamp: "), "timestamp"),
        F.concat(F.lit("Traité le: "), processed), F.lit(DETAILS_LINE),
        F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}),
    ]
    return F.concat_ws("\n", *lines)


def statistics(alerts: DataFrame) -> DataFrame:
    severity = F.coalesce(F.col("severity"), F.lit("medium"))
    return alerts.agg(
        F.count("*").alias("total_alerts"),
        *[F.count_if(severity == s).alias(f"{s}_alerts") for s in ("critical", "high", "medium", "low")],
        F.count_if("false_positive").alias("false_positives"), F.count_if("acknowledged").alias("acknowledged"),
    )


def select_alerts(alerts: DataFrame, severity: str | None = None, status: str | None = None) -> DataFrame:
    """Filter by severity and by status acknowledged, new or false_positive."""
    if severity:
        alerts = alerts.filter(F.col("severity") == severity)
    if status == "acknowledged":
        alerts = alerts.filter("acknowledged")
    elif status == "new":
        alerts = alerts.filter("NOT acknowledged")
    elif status == "false_positive":
        alerts = alerts.filter("false_positive")
    return alerts


def page(alerts: DataFrame, number: int = 1, per_page: int = 50, tie: str = "seq") -> DataFrame:
    """One page, newest first."""
    size = min(per_page, MAX_PER_PAGE)
    newest = F.desc(F.coalesce(F.col("timestamp"), F.lit("")))
    return alerts.orderBy(newest, tie).offset((number - 1) * size).limit(size)


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply an action log ``id, action, at, user``: acknowledge or mark as false positive; the latest wins."""
    def latest(kind: str, prefix: str) -> list[Column]:
        when = F.when(F.col("action") == kind, F.struct("at", "user"))
        return [F.max(when).alias(prefix)]

    done = actions.groupBy("id").agg(*latest("acknowledge", "_ack"), *latest("false_positive", "_fp"))
    out = alerts.join(done, "id", "left")
    return (
        out.withColumn("acknowledged", F.col("acknowledged") | F.col("_ack").isNotNull())
        .withColumn("acknowledged_at", F.col("_ack.at")).withColumn("acknowledged_by", F.col("_ack.user"))
        .withColumn("false_positive", F.col("false_positive") | F.col("_fp").isNotNull())
        .withColumn("marked_fp_at", F.col("_fp.at")).withColumn("marked_fp_by", F.col("_fp.user"))
        .drop("_ack", "_fp")
    )


def newest_per_severity(alerts: DataFrame, n: int = PER_SEVERITY, keep_one_more: bool = False) -> DataFrame:
    """Bounded list of every severity; ``keep_one_more`` counts like a list trimmed at index n."""
    order = [F.desc("ts"), F.desc("seq")]
    return top_n_per_group(alerts, ["severity"], order, n + int(keep_one_more), F.col("seq"))


def newest_overall(alerts: DataFrame, n: int = OVERALL, keep_one_more: bool = False) -> DataFrame:
    """Bounded list over all severities."""
    return newest(alerts, n, keep_one_more)


def newest(rows: DataFrame, n: int = HISTORY, keep_one_more: bool = False, tie: str = "seq") -> DataFrame:
    """Bounded history; ``keep_one_more`` counts like a list trimmed at index n."""
    return rows.orderBy(F.desc("ts"), F.desc(tie)).limit(n + int(keep_one_more))


def merge_channels(channels: dict[str, DataFrame]) -> DataFrame:
    """Alerts of several channels in one table; columns a channel lacks are NULL."""
    merged = None
    for name, df in channels.items():
        df = df.withColumn("channel", F.lit(name))
        merged = df if merged is None else merged.unionByName(df, allowMissingColumns=True)
    return merged


def process(alerts: DataFrame, processed_at: Column) -> DataFrame:
    """The whole pipeline: validate, mark repeats, enrich, score, stamp."""
    valid, _ = split_valid(alerts)
    scored = enrich(mark_repeated(valid)).withColumn("severity_score", severity_score(F.col("repeated")))
    return stamp(scored, processed_at)


def incidents(alerts: DataFrame, gap_seconds: int = CORRELATION_SECONDS) -> DataFrame:
    """Group the alerts of a source into incidents separated by a pause longer than the gap."""
    df = alerts.withColumn("_micros", F.unix_micros("ts"))
    placed = previous(arrange(df, "source_ip", "ts", "seq"), ["source_ip"], {"_before": "_micros"})
    starts = F.coalesce(F.col("_micros") - F.col("_before") > gap_seconds * 1_000_000, F.lit(True))
    numbered = running_total(placed, flag(starts), "_incident")
    return numbered.groupBy("_incident").agg(
        F.first("source_ip").alias("source_ip"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count("*").alias("alerts"), F.min("seq").alias("first_seq"),
    ).drop("_incident")


def rate_limit(alerts: DataFrame, per_window: int = PER_MINUTE, width: str = "1 minute") -> DataFrame:
    """The first alerts of every time window, up to the limit."""
    windowed = alerts.withColumn("window_start", F.window("ts", width)["start"])
    return top_n_per_group(windowed, ["window_start"], [F.col("ts"), F.col("seq")], per_window, F.col("seq"))


def retained(rows: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return rows.filter(F.col("ts") >= now - F.make_interval(days=F.lit(days)))
