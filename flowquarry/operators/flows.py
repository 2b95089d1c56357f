"""Bidirectional flows and their 42 features.

Three independent parts, joined on the flow key at the end:

* plain features: one partial/final hash aggregate, no packet is shuffled;
* jitter: the only feature that needs neighbouring packets. Packets are exchanged
  on (key, block of the capture), so an elephant flow spreads over many tasks;
* payload counters of the few flows whose service is found inside a payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions import net
from flowquarry.functions.numeric import finite, flag, ratio
from flowquarry.operators.ordered import arrange, running_total
from flowquarry.operators.packets import only_ip
from flowquarry.schemas import FEATURES, FLOW

#: Endpoint columns of a flow; inside the operators they are one struct column ``flow``, which
#: cannot be NULL, so joins on it add no null checks that would be evaluated for every packet.
KEY = ["a_ip", "a_port", "b_ip", "b_port"]
FLOW_KEY = ["flow"]
FIVE_TUPLE = ["flow", "ip_proto"]
#: Packets of the capture per block; bounds the rows of one (flow, block) group.
BLOCK_ROWS = 1 << 20
_COUNTERS = ["http_methods", "http_versions", "body_len", "ftp_login", "ftp_commands"]
#: What the features need of a packet beside its key and block; all of it numbers and marks.
PACKET_FACTS = [
    "seq", "t", "len", "fwd", "ttl", "flags", "win", "tcp_seq", "tcp", "dns", "svc", "proto", "order_sensitive", *_COUNTERS,
]
# Numbers instead of names while aggregating: fixed-width buffers keep the aggregate hash based.
_SERVICES = ["-", *net.SERVICE_PORTS.values(), "smtp"]
_SERVICES = list(dict.fromkeys(_SERVICES))
_PROTOCOLS = ["tcp", "udp", "icmp", "other"]


def _code(name: Column, names: list[str]) -> Column:
    return F.element_at(net.literal_map({n: i for i, n in enumerate(names)}), name)


def _name(code: Column, names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])[code]


def with_endpoints(df: DataFrame) -> DataFrame:
    """Adds the four endpoint columns of the flow struct."""
    return df.withColumns({c: F.col(f"flow.{c}") for c in KEY})


def keyed_packets(packets: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """IPv4 packets with the canonical endpoint pair, direction, service and payload marks."""
    has_ports = F.col("ip_proto").isin(net.TCP, net.UDP)
    df = only_ip(packets).withColumns({
        "src_port": F.when(has_ports, F.col("src_port")).otherwise(0).cast("int"),
        "dst_port": F.when(has_ports, F.col("dst_port")).otherwise(0).cast("int"),
    })
    df = df.withColumn("fwd", F.struct("src_ip", "src_port") < F.struct("dst_ip", "dst_port"))
    text = F.when(net.is_tcp(), F.col("payload"))

    def pair(one: str, two: str) -> Column:
        return F.struct(
            F.col(f"{one}_ip").alias("a_ip"), F.col(f"{one}_port").alias("a_port"),
            F.col(f"{two}_ip").alias("b_ip"), F.col(f"{two}_port").alias("b_port"),
        )

    return df.withColumns({
        "flow": F.when(F.col("fwd"), pair("src", "dst")).otherwise(pair("dst", "src")),
        "block": F.floor(F.col("seq") / F.lit(block_rows)).cast("bigint"),
        "tcp": F.coalesce(net.is_tcp(), F.lit(False)), "dns": F.coalesce(net.is_dns(), F.lit(False)),
        "svc": _code(net.packet_service(), _SERVICES), "proto": _code(net.flow_protocol(F.col("ip_proto")), _PROTOCOLS),
        "order_sensitive": _order_sensitive(F.col("src_port"), F.col("dst_port")),
        "http_methods": F.coalesce(net.http_method_seen(text), F.lit(0)),
        "http_versions": F.coalesce(net.http_version_seen(text), F.lit(0)),
        "body_len": F.coalesce(net.content_length(text), F.lit(0)),
        "ftp_login": F.coalesce(net.ftp_login_seen(text), F.lit(0)),
        "ftp_commands": F.coalesce(net.ftp_command_seen(text), F.lit(0)),
    })


def _order_sensitive(a: Column, b: Column) -> Column:
    """Flows whose payload counters depend on which packet came first; symmetric in the ports.

    With a known port on either side every TCP or UDP packet names the same service
    from the start, so plain sums are exact. Otherwise the service starts at some
    payload, and a mapped web or ftp port opposite port 53 may be taken over by DNS.
    """
    mapped = a.isin(list(net.SERVICE_PORTS)) | b.isin(list(net.SERVICE_PORTS))
    dns_takeover = ((a == 53) & b.isin(80, 21)) | ((b == 53) & a.isin(80, 21))
    return ~mapped | dns_takeover


def _where(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def flow_base(keyed: DataFrame, key: list[str] = FLOW_KEY) -> DataFrame:
    """Every feature that needs no neighbouring packet, in one hash aggregation."""
    aggs = {
        "first_seq": "min(seq)",
        "first_time": "min_by(t, seq)",
        "last_time": "max_by(t, seq)",
        "first_fwd": "min_by(fwd, seq)",
        "spkts": "count_if(fwd)",
        "dpkts": "count_if(NOT fwd)",
        "sbytes": "coalesce(sum(len) FILTER (WHERE fwd), 0L)",
        "dbytes": "coalesce(sum(len) FILTER (WHERE NOT fwd), 0L)",
        "_proto": "min_by(proto, seq)",
        "_svc": "min_by(svc, seq) FILTER (WHERE svc > 0)",
        "_dns": "max(dns)",
        "flag_union": "coalesce(bit_or(flags) FILTER (WHERE tcp), 0)",
        "sttl": "coalesce(min_by(ttl, seq) FILTER (WHERE fwd AND ttl <> 0), 0)",
        "dttl": "coalesce(min_by(ttl, seq) FILTER (WHERE NOT fwd AND ttl <> 0), 0)",
        "swin": "coalesce(min_by(win, seq) FILTER (WHERE tcp AND fwd AND win <> 0), 0)",
        "dwin": "coalesce(min_by(win, seq) FILTER (WHERE tcp AND NOT fwd AND win <> 0), 0)",
        "stcpb": "coalesce(max_by(tcp_seq, seq) FILTER (WHERE tcp AND fwd), 0L)",
        "dtcpb": "coalesce(max_by(tcp_seq, seq) FILTER (WHERE tcp AND NOT fwd), 0L)",
        "_sspan": "max_by(t, seq) FILTER (WHERE fwd) - min_by(t, seq) FILTER (WHERE fwd)",
        "_dspan": "max_by(t, seq) FILTER (WHERE NOT fwd) - min_by(t, seq) FILTER (WHERE NOT fwd)",
        "order_sensitive": "max(order_sensitive)",
        **{f"_{c}": f"sum({c})" for c in _COUNTERS},
    }
    return described(keyed.groupBy(*key).agg(*[F.expr(text).alias(name) for name, text in aggs.items()]))


def described(base: DataFrame) -> DataFrame:
    """Names, rates and means from the sums and firsts of a flow, wherever those were gathered."""
    first_time, last_time = F.col("first_time"), F.col("last_time")
    total = F.col("spkts") + F.col("dpkts")
    elapsed = F.when((first_time != 0) & (last_time != 0), last_time - first_time)
    base = with_endpoints(base).withColumns({
        "dur": finite(elapsed), "packets": total, "proto": _name(F.col("_proto"), _PROTOCOLS),
    })

    def per_second(amount: Column) -> Column:
        return F.when(F.col("dur") > 0, amount / F.col("dur")).otherwise(F.lit(0.0))

    def mean_gap(span: str, count: str) -> Column:
        return finite(F.when(F.col(count) >= 2, ratio(F.col(span), F.col(count) - 1)))

    service = F.when(F.col("_dns"), "dns").otherwise(_name(F.coalesce(F.col("_svc"), F.lit(0)), _SERVICES))
    return base.withColumns({
        "service": service,
        "state": F.when(F.col("proto") == "tcp", net.tcp_state(F.col("flag_union"))).otherwise("INT"),
        "rate": per_second(F.col("packets")), "sload": per_second(F.col("sbytes")), "dload": per_second(F.col("dbytes")),
        "smean": ratio(F.col("sbytes"), F.col("spkts")), "dmean": ratio(F.col("dbytes"), F.col("dpkts")),
        "sinpkt": mean_gap("_sspan", "spkts"), "dinpkt": mean_gap("_dspan", "dpkts"),
    })


def spread_lookup(rows: DataFrame, per_flow: DataFrame, key: list[str]) -> DataFrame:
    """Give each packet row the values of its flow without gathering a flow in one task.

    The values are first copied to the (flow, block) pairs that occur, a small table,
    and then joined on (flow, block): at most one block of packets meets in a task.
    """
    pairs = rows.select(*key, "block").distinct()
    return rows.join(pairs.join(per_flow, key), [*key, "block"])


def late_counters(keyed: DataFrame, key: list[str] = FLOW_KEY) -> DataFrame:
    """Counters of order-sensitive flows: only packets from the one that fixed the service
    onwards count, and none from a DNS takeover onwards.

    Marked packets are summed per (flow, block), once for each way a block can lie to the
    start and the stop; what happened in other blocks then decides which sum is right.
    """
    cell = [*key, "block"]
    marked = F.greatest(*[F.col(c).cast("bigint") for c in _COUNTERS]) > 0
    rows = keyed.filter("order_sensitive").filter(marked | (F.col("svc") > 0) | F.col("dns"))
    inside = Window.partitionBy(*cell)
    rows = rows.select(*cell, "seq", "svc", "dns", *_COUNTERS).withColumns({
        "first": F.min(_where(F.col("svc") > 0, F.col("seq"))).over(inside),
        "stop": F.min(_where(F.col("dns"), F.col("seq"))).over(inside),
    })
    started = F.col("seq") >= F.col("first")
    running = F.col("stop").isNull() | (F.col("seq") < F.col("stop"))
    ways = {"all": F.lit(True), "from": started, "until": running, "both": started & running}
    sums = [F.sum(_where(way, F.col(c))).alias(f"{w}_{c}") for w, way in ways.items() for c in _COUNTERS]
    cells = rows.groupBy(*cell).agg(
        F.min_by("svc", _where(F.col("svc") > 0, F.col("seq"))).alias("svc"), F.min("stop").alias("stop"), *sums
    )
    # One row per flow and block from here on.
    whole = Window.partitionBy(*key)
    cells = cells.withColumns({
        "begin": F.min(_where(F.col("svc").isNotNull(), F.col("block"))).over(whole),
        "end": F.min(_where(F.col("stop").isNotNull(), F.col("block"))).over(whole),
    })
    block, begin, end = F.col("block"), F.col("begin"), F.col("end")
    after, at_end = block > begin, F.coalesce(block == end, F.lit(False))
    kept = cells.filter((block >= begin) & (end.isNull() | (block <= end)))

    def right_sum(c: str) -> Column:
        return (
            F.when(after & ~at_end, F.col(f"all_{c}")).when(after, F.col(f"until_{c}"))
            .when(~at_end, F.col(f"from_{c}")).otherwise(F.col(f"both_{c}"))
        )

    return kept.groupBy(*key).agg(
        F.max(_where(block == begin, F.col("svc"))).alias("late_svc"), *[F.sum(right_sum(c)).alias(f"late_{c}") for c in _COUNTERS]
    )


def payload_counters(keyed: DataFrame, base: DataFrame, key: list[str] = FLOW_KEY) -> DataFrame:
    """HTTP and FTP counters: plain sums where order cannot matter, gated ones elsewhere."""
    return chosen_counters(base.join(late_counters(keyed, key), key, "left"))


def chosen_counters(flows: DataFrame) -> DataFrame:
    """The counters of flows that hold both their plain and their gated sums."""
    def counter(name: str, service: str) -> Column:
        plain = F.when(F.col("service") == service, F.col(f"_{name}"))
        gated = F.when(F.col("late_svc") == _SERVICES.index(service), F.col(f"late_{name}"))
        return F.coalesce(F.when(F.col("order_sensitive"), gated).otherwise(plain), F.lit(0))

    return flows.withColumns({
        "ct_flw_http_mthd": counter("http_methods", "http").cast("int"),
        "trans_depth": counter("http_versions", "http").cast("int"),
        "response_body_len": counter("body_len", "http").cast("bigint"),
        "is_ftp_login": flag(counter("ftp_login", "ftp") > 0),
        "ct_ftp_cmd": counter("ftp_commands", "ftp").cast("int"),
    })


def jitter(keyed: DataFrame, key: list[str] = FLOW_KEY) -> DataFrame:
    """Mean absolute deviation of the absolute packet gaps, per flow and direction.

    Gaps inside a block come from a window on the cell (flow, direction, block). The first
    packet of a cell has none; its gap crosses the block edge and comes from one row per
    cell. The mean gap goes back to the packets on the cell, which is the exchange they
    already have, so packets are moved once and a cell holds at most one block.
    """
    side = [*key, "fwd"]
    cell = F.struct(*side, F.coalesce("block", F.lit(0)).alias("block")).alias("cell")
    gaps = keyed.select(cell, "seq", "t").withColumn(
        "gap", F.abs(F.col("t") - F.lag("t").over(Window.partitionBy("cell").orderBy("seq")))
    )
    cells = gaps.groupBy("cell").agg(
        F.min_by("t", "seq").alias("start"), F.max_by("t", "seq").alias("end"),
        F.count("*").alias("n"), F.sum("gap").alias("gap_sum"),
    )
    cells = cells.select("*", *[F.col(f"cell.{c}").alias(c) for c in side])
    line = Window.partitionBy(*side)
    cells = cells.withColumn("edge", F.abs(F.col("start") - F.lag("end").over(line.orderBy("cell.block"))))
    total = F.sum(F.coalesce("gap_sum", F.lit(0.0)) + F.coalesce("edge", F.lit(0.0))).over(line)
    cells = cells.withColumns({"n_gaps": F.sum("n").over(line) - 1, "total": total})
    # Fewer than two gaps give no jitter.
    means = cells.filter(F.col("n_gaps") >= 2).select("cell", "edge", (F.col("total") / F.col("n_gaps")).alias("mean"))
    spread = gaps.join(means, "cell").select(
        "cell", F.abs(F.coalesce("gap", "edge") - F.col("mean")).alias("dev")
    )
    fwd = F.col("cell.fwd")
    return spread.groupBy(*[F.col(f"cell.{c}").alias(c) for c in key]).agg(
        F.coalesce(F.avg(_where(fwd, F.col("dev"))), F.lit(0.0)).alias("sjit"),
        F.coalesce(F.avg(_where(~fwd, F.col("dev"))), F.lit(0.0)).alias("djit"),
    )


# Cap and divisor of each connection-tracking surrogate, by what it counts.
SURROGATES = {
    "ct_srv_src": (10, "spkts", 10),
    "ct_state_ttl": (5, "ttl", 100),
    "ct_dst_ltm": (3, "packets", 20),
    "ct_src_dport_ltm": (3, "packets", 15),
    "ct_dst_sport_ltm": (3, "packets", 15),
    "ct_dst_src_ltm": (3, "packets", 25),
    "ct_src_ltm": (5, "packets", 10),
    "ct_srv_dst": (5, "packets", 12),
}


def tracking_surrogates(flows: DataFrame) -> DataFrame:
    """The eight connection-tracking columns derived from the flow's own size."""
    sources = {
        "spkts": F.col("spkts"),
        "ttl": (F.col("sttl") + F.col("dttl")).cast("bigint"),
        "packets": F.col("spkts") + F.col("dpkts"),
    }
    return flows.withColumns({
        name: F.least(F.lit(cap), F.greatest(F.lit(1), F.floor(sources[source] / F.lit(step)).cast("int")))
        for name, (cap, source, step) in SURROGATES.items()
    })


def compat_constants(flows: DataFrame) -> DataFrame:
    """Columns that stay 0 in the default feature set: loss, handshake times, same endpoints."""
    zeros = {name: F.lit(0).cast("bigint") for name in ("sloss", "dloss")}
    zeros |= {name: F.lit(0.0) for name in ("tcprtt", "synack", "ackdat")}
    return flows.withColumns(zeros | {"is_sm_ips_ports": F.lit(0)})


def feature_columns() -> list[Column]:
    """The 42 features in order, typed, with NULL turned into 0."""
    columns = []
    for field in FLOW.fields:
        value = F.col(field.name).cast(field.dataType)
        if field.dataType.typeName() == "double":
            value = finite(value)
        elif field.dataType.typeName() != "string":
            value = F.coalesce(value, F.lit(0).cast(field.dataType))
        columns.append(value.alias(field.name))
    return columns


_DIRECTIONAL = [
    ("spkts", "dpkts"), ("sbytes", "dbytes"), ("sttl", "dttl"), ("sload", "dload"), ("sloss", "dloss"),
    ("sinpkt", "dinpkt"), ("sjit", "djit"), ("swin", "dwin"), ("stcpb", "dtcpb"), ("smean", "dmean"),
]


def _initiator_view(flows: DataFrame) -> DataFrame:
    """Swap the two directions of flows whose first packet came from the larger endpoint."""
    swap = ~F.col("first_fwd")
    swapped = {}
    for one, two in _DIRECTIONAL:
        swapped[one] = F.when(swap, F.col(two)).otherwise(F.col(one))
        swapped[two] = F.when(swap, F.col(one)).otherwise(F.col(two))
    return flows.withColumns(swapped)


def flow_features(
    packets: DataFrame,
    key_mode: str = "endpoints",
    orientation: str = "canonical",
    features: str = "compat",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The flow table: key columns, first and last time, packet count and the 42 features."""
    key = {"endpoints": FLOW_KEY, "five_tuple": FIVE_TUPLE}[key_mode]
    return keyed_features(keyed_packets(packets, block_rows), key, orientation, features)


def keyed_features(
    keyed: DataFrame, key: list[str], orientation: str = "canonical", features: str = "compat", extra: list[str] | None = None
) -> DataFrame:
    """The flow table of packets that hold their key; ``extra`` names further columns of ``flow_base`` to return."""
    flows = payload_counters(keyed, flow_base(keyed, key), key)
    flows = flows.join(jitter(keyed, key), key, "left")
    flows = compat_constants(flows)
    if features == "extended":
        flows = extended_features(flows, keyed, key)
    if orientation == "initiator":
        flows = _initiator_view(flows)
    flows = tracking_surrogates(flows)
    if features == "extended":
        flows = recent_connections(flows)
    return flows.select(*KEY, *key[1:], *(extra or []), "first_time", "last_time", "first_fwd", "packets", *feature_columns())


def retransmissions(keyed: DataFrame, key: list[str] = FLOW_KEY) -> DataFrame:
    """Loss per direction: TCP packets whose sequence number was seen before.

    Counting per (key, direction, sequence number) first keeps a hot flow spread out.
    """
    seen = keyed.filter("tcp").groupBy(*key, "fwd", "tcp_seq").agg(F.count("*").alias("n"))
    return seen.groupBy(*key).agg(
        F.coalesce(F.sum(_where(F.col("fwd"), F.col("n") - 1)), F.lit(0)).cast("bigint").alias("sloss"),
        F.coalesce(F.sum(_where(~F.col("fwd"), F.col("n") - 1)), F.lit(0)).cast("bigint").alias("dloss"),
    )


def handshake(keyed: DataFrame, key: list[str] = FLOW_KEY) -> DataFrame:
    """SYN to SYN-ACK, SYN-ACK to the first later ACK, and their sum, in seconds."""
    bits = F.col("flags")
    syn = F.col("tcp") & (bits.bitwiseAND(F.lit(18)) == 2)
    both = F.col("tcp") & (bits.bitwiseAND(F.lit(18)) == 18)
    ack = F.col("tcp") & (bits.bitwiseAND(F.lit(18)) == 16)
    marks = keyed.groupBy(*key).agg(
        F.min(_where(syn, F.col("seq"))).alias("_syn"), F.min_by("t", _where(syn, F.col("seq"))).alias("_syn_t"),
    )
    answers = spread_lookup(keyed.filter(both).select(*key, "block", "seq", "t"), marks, key)
    answers = answers.filter(F.col("seq") > F.col("_syn")).groupBy(*key).agg(
        F.min("_syn_t").alias("_syn_t"), F.min("seq").alias("_sa"), F.min_by("t", "seq").alias("_sa_t")
    )
    acks = spread_lookup(keyed.filter(ack).select(*key, "block", "seq", "t"), answers, key)
    acks = acks.filter(F.col("seq") > F.col("_sa")).groupBy(*key).agg(F.min_by("t", "seq").alias("_ack_t"))
    out = answers.join(acks, key, "left")
    out = out.withColumn("synack", F.col("_sa_t") - F.col("_syn_t"))
    out = out.withColumn("ackdat", F.coalesce(F.col("_ack_t") - F.col("_sa_t"), F.lit(0.0)))
    return out.select(*key, "synack", "ackdat", (F.col("synack") + F.col("ackdat")).alias("tcprtt"))


def extended_features(flows: DataFrame, keyed: DataFrame, key: list[str] = FLOW_KEY) -> DataFrame:
    """Measured loss, handshake times and same-endpoint flag instead of the constants."""
    plain = flows.drop("sloss", "dloss", "tcprtt", "synack", "ackdat", "is_sm_ips_ports")
    out = plain.join(retransmissions(keyed, key), key, "left").join(handshake(keyed, key), key, "left")
    out = out.fillna(0, ["sloss", "dloss"]).fillna(0.0, ["tcprtt", "synack", "ackdat"])
    return out.withColumn("is_sm_ips_ports", same_endpoints())


def same_endpoints() -> Column:
    return flag((F.col("a_ip") == F.col("b_ip")) & (F.col("a_port") == F.col("b_port")))


# Which columns two flows must share for each connection-tracking count.
TRACKING_KEYS = {
    "ct_srv_src": ["service", "a_ip"],
    "ct_state_ttl": ["state", "sttl", "dttl"],
    "ct_dst_ltm": ["b_ip"],
    "ct_src_dport_ltm": ["a_ip", "b_port"],
    "ct_dst_sport_ltm": ["b_ip", "a_port"],
    "ct_dst_src_ltm": ["a_ip", "b_ip"],
    "ct_src_ltm": ["a_ip"],
    "ct_srv_dst": ["service", "b_ip"],
}


def recent_connections(flows: DataFrame, window_seconds: float = 3600.0) -> DataFrame:
    """Real connection tracking: flows with the same key that ended in the last ``window_seconds``.

    Each count is the difference of two ranks on the sorted time line of its key: one
    probe at the window start, one at the flow itself. All eight counts share a single
    range sort, which splits a source that owns a third of all flows like any other.
    """
    names = list(TRACKING_KEYS)
    lines = F.array(*[
        F.struct(F.lit(i).alias("which"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("line"))
        for i, columns in enumerate(TRACKING_KEYS.values())
    ])
    # A probe at the start sorts before the flows of that instant, the end probe after them.
    start, here, end = [
        F.struct(time.alias("at"), F.lit(kind).alias("kind"))
        for kind, time in enumerate([F.col("last_time") - window_seconds, F.col("last_time"), F.col("last_time")])
    ]
    marks = flows.select(*KEY, "last_time", F.inline(lines))
    marks = marks.select(*KEY, "which", "line", F.inline(F.array(start, here, end)))
    placed = arrange(marks, "which", "line", "at", "kind", *KEY)
    ranked = running_total(placed, flag(F.col("kind") == 1), "rank")
    signed = F.when(F.col("kind") == 2, F.col("rank")).when(F.col("kind") == 0, -F.col("rank"))
    counts = ranked.groupBy(*KEY).agg(*[
        F.sum(_where(F.col("which") == i, signed)).cast("int").alias(name) for i, name in enumerate(names)
    ])
    return flows.drop(*names).join(counts, KEY)


def flow_id(buckets: int | None = None) -> Column:
    """Reproducible id of a flow, from its key: 60 bits, or a small number below ``buckets`` where ids may collide."""
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in KEY])
    number = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("bigint")
    return number if buckets is None else F.pmod(number, F.lit(buckets))
