"""Operational metrics: service health, system samples, counters and threshold alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions import net
from flowquarry.functions.numeric import ratio
from flowquarry.operators.skew import one_row

# Alert thresholds in percent and the defaults of missing store metrics.
THRESHOLDS = {"cpu": 90.0, "memory": 90.0, "disk": 90.0}
STORE_DEFAULTS = {
    "connected_clients": "0", "used_memory_human": "0B", "used_memory_peak_human": "0B",
    "total_commands_processed": "0", "instantaneous_ops_per_sec": "0", "keyspace_hits": "0",
    "keyspace_misses": "0", "uptime_in_seconds": "0", "redis_version": "unknown",
}
_GIB = 1024.0 ** 3


def health_status(code: Column) -> Column:
    return F.when(code.isNull(), "unreachable").when(code == 200, "healthy").otherwise("unhealthy")


def uptime(probes: DataFrame) -> DataFrame:
    """Latest state and share of good probes per service, from ``service, code, response_ms, ts, seq``."""
    order = F.struct("ts", "seq")
    status = health_status(F.col("code"))
    out = probes.withColumn("status", status).groupBy("service").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("response_ms", order).alias("response_ms"), F.max("ts").alias("last_check"),
        F.count_if(F.col("status") != "healthy").alias("error_count"), F.count("*").alias("total_checks"),
    )
    good = F.col("total_checks") - F.col("error_count")
    return out.withColumn("uptime_percentage", ratio(good, F.col("total_checks")) * 100)


def system_metrics(samples: DataFrame) -> DataFrame:
    """Nested host samples flattened, capacities in GB with two digits."""
    def gib(path: str) -> Column:
        return F.round(F.col(path) / F.lit(_GIB), 2)

    return samples.select(
        "timestamp", "uptime_seconds",
        F.col("cpu.usage_percent").alias("cpu_percent"), F.col("cpu.cores").alias("cpu_cores"),
        gib("memory.total").alias("memory_total_gb"), gib("memory.used").alias("memory_used_gb"),
        F.col("memory.percent").alias("memory_percent"), gib("memory.available").alias("memory_available_gb"),
        gib("disk.total").alias("disk_total_gb"), gib("disk.used").alias("disk_used_gb"),
        gib("disk.free").alias("disk_free_gb"),
        (ratio(F.col("disk.used"), F.col("disk.total")) * 100).alias("disk_percent"),
        F.col("network.bytes_sent").alias("bytes_sent"), F.col("network.bytes_recv").alias("bytes_recv"),
        F.col("network.packets_sent").alias("packets_sent"), F.col("network.packets_recv").alias("packets_recv"),
    )


def store_metrics(info: Column) -> list[Column]:
    """Metrics of a key-value store from a map, with defaults."""
    return [F.coalesce(F.try_element_at(info, F.lit(k)), F.lit(v)).alias(k) for k, v in STORE_DEFAULTS.items()]


def global_counters(packets: DataFrame, flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Packets captured, flows extracted, alerts raised and threats among them."""
    return one_row(
        packets.agg(F.count("*").alias("packets_captured")),
        flows.agg(F.count("*").alias("features_extracted")),
        alerts.agg(
            F.count("*").alias("alerts_generated"), F.count_if(F.col("type") == "intrusion").alias("threats_detected")
        ),
    )


def threshold_alerts(metrics: DataFrame, limits: dict[str, float] = THRESHOLDS) -> DataFrame:
    """One critical alert per resource above its limit."""
    names = {"cpu": "CPU", "memory": "Memory", "disk": "Disk"}
    found = F.array_compact(F.array(*[
        F.when(
            F.col(f"{c}_percent") > limits[c],
            F.concat(F.lit(f"{names[c]} usage critical: "), F.round(f"{c}_percent", 2).cast("string"), F.lit("%")),
        ) for c in limits
    ]))
    return metrics.select("timestamp", F.explode(found).alias("message")).select(
        F.lit("system").alias("type"), F.lit("critical").alias("severity"), "message", "timestamp"
    )


def service_alerts(services: DataFrame) -> DataFrame:
    """One high alert per service that is not healthy."""
    bad = services.filter(F.col("status").isin("unhealthy", "unreachable"))
    return bad.select(
        F.lit("service").alias("type"), F.lit("high").alias("severity"),
        F.format_string("Service %s is %s", "service", "status").alias("message"),
    )


def stamped(alerts: DataFrame, timestamp: Column, channel: str = "monitoring") -> DataFrame:
    return alerts.withColumn("timestamp", timestamp).withColumn("channel", F.lit(channel))


def throughput(packets: DataFrame, batch_size: int = 100) -> DataFrame:
    """Rates over the whole uptime: packets and bytes per second, batches and packets per minute."""
    sums = packets.agg(
        F.count("*").alias("packets"), F.sum("len").alias("bytes"),
        F.ceil(F.count("*") / F.lit(batch_size)).cast("bigint").alias("batches"),
        (F.max("t") - F.min("t")).alias("uptime"),
    )
    up = F.col("uptime")
    return sums.select(
        "packets", "batches", ratio(F.col("packets"), up).alias("packets_per_second"),
        ratio(F.col("bytes"), up).alias("bytes_per_second"),
        (ratio(F.col("batches"), up) * 60).alias("batches_per_minute"),
        (ratio(F.col("packets"), up) * 60).alias("packets_per_minute"),
    )


def throughput_by_window(packets: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Packets and bytes per time window."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = packets.groupBy(window.alias("w")).agg(F.count("*").alias("packets"), F.sum("len").alias("bytes"))
    return counted.select(F.col("w.start").alias("window_start"), "packets", "bytes")


def snapshot(services: DataFrame, counters: DataFrame, *blocks: DataFrame) -> DataFrame:
    """One record of the state of services and counters, and of further one-row blocks (host, store)."""
    state = services.agg(
        F.count("*").alias("services"), F.count_if(F.col("status") == "healthy").alias("healthy"),
        F.avg("uptime_percentage").alias("mean_uptime"),
    )
    return one_row(state, counters, *blocks)


def newest_sample(rows: DataFrame, order: str) -> DataFrame:
    """The row of greatest ``order`` as one row, by an aggregate; nothing is sorted."""
    fields = F.max_by(F.struct(*rows.columns), order)
    return rows.agg(fields.alias("newest")).select("newest.*")


def node_counters(probes: DataFrame) -> DataFrame:
    """Work and errors per node."""
    return probes.groupBy("node").agg(
        F.count("*").alias("checks"), F.count_if(F.col("code") == 200).alias("answered"),
        F.count_if(F.col("code").isNull()).alias("errors"),
        F.sum(F.coalesce(F.col("response_ms"), F.lit(0.0))).alias("busy_ms"),
    )


def service_counters(packets: DataFrame, probes: DataFrame, batch_size: int = 100) -> DataFrame:
    """Per node: packets captured, bytes, IPv4 packets stored, batches, flows extracted, API calls and failed ones.

    ``packets`` and ``probes`` carry the ``node`` that did the work; a node known to one of them has zeros for the rest.
    """
    work = packets.groupBy("node").agg(
        F.count("*").alias("captured"), F.sum("len").alias("bytes"), F.count_if(F.col("ethertype") == net.IPV4).alias("stored"),
        F.ceil(F.count("*") / F.lit(batch_size)).cast("bigint").alias("batches"),
    )
    ends = [F.struct(F.col(f"{e}_ip").alias("ip"), F.col(f"{e}_port").alias("port")) for e in ("src", "dst")]
    # Distinct flows of a node first, so that a node with most packets is counted from many tasks.
    flows = packets.select("node", F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()
    flows = flows.groupBy("node").agg(F.count("*").alias("features"))
    calls = probes.groupBy("node").agg(F.count("*").alias("api_calls"), F.count_if(F.col("code").isNull()).alias("errors"))
    joined = work.join(flows, "node", "full").join(calls, "node", "full")
    return joined.na.fill(0)


def live_status(rows: DataFrame, seconds: int = 300) -> DataFrame:
    """Status rows that have not outlived their time to live, counted from the newest row."""
    newest = rows.agg(F.max("ts")).scalar()  # a scalar subquery: nothing runs while the plan is made
    return rows.filter(F.col("ts") > newest - F.make_interval(secs=F.lit(seconds)))
