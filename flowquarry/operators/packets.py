"""Packet-level operators. Input: one row per packet with the decoded columns

``seq, t, ethertype, src_ip, dst_ip, src_port, dst_port, ip_proto, len, ttl, win,
flags, tcp_seq, payload`` where ``seq`` is the position in the capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions import net


def only_ip(packets: DataFrame) -> DataFrame:
    """Keep IPv4 packets; ARP and IPv6 never reach a flow."""
    return packets.filter(F.col("ethertype") == net.IPV4)


def protocol_stack() -> Column:
    """Names of the nested layers of a packet, outermost first."""
    number = F.col("ip_proto")
    ip = F.col("ethertype") == net.IPV4
    ip6 = F.col("ethertype") == net.IPV6
    carried = F.coalesce(ip | ip6, F.lit(False))
    return F.array_compact(F.array(
        F.lit("Ether"),
        F.when(ip, "IP").when(ip6, "IPv6").when(F.col("ethertype") == net.ARP, "ARP"),
        F.when(carried & (number == net.TCP), "TCP").when(carried & (number == net.UDP), "UDP")
        .when(ip & (number == net.ICMP), "ICMP"),
        F.when(F.length("payload") > 0, "Raw"),
    ))


def basic_info(packets: DataFrame) -> DataFrame:
    """Addresses, ports and protocol number, NULL where the layer is absent."""
    ip = F.col("ethertype") == net.IPV4
    ports = F.col("ip_proto").isin(net.TCP, net.UDP) & F.col("ethertype").isin(net.IPV4, net.IPV6)
    return packets.select(
        "seq",
        F.when(ip, F.col("src_ip")).alias("src_ip"),
        F.when(ip, F.col("dst_ip")).alias("dst_ip"),
        F.when(ports, F.col("src_port")).alias("src_port"),
        F.when(ports, F.col("dst_port")).alias("dst_port"),
        F.when(ip, F.col("ip_proto")).alias("protocol"),
    )


def summary() -> Column:
    """One-line description of a packet, stable across runs."""
    return F.concat_ws(
        " ", net.protocol_name(F.col("ethertype"), F.col("ip_proto")),
        F.concat_ws(":", "src_ip", F.col("src_port").cast("string")), F.lit(">"),
        F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string")),
    )


def packet_id() -> Column:
    """Digest of time, length and summary."""
    micros = F.round(F.col("t") * 1e6).cast("bigint").cast("string")
    return F.md5(F.concat_ws("|", micros, F.col("len").cast("string"), summary()))


def batch_ids(packets: DataFrame, size: int = 100) -> DataFrame:
    """Consecutive batches of ``size`` packets, each with a digest as id."""
    batches = packets.withColumn("batch_no", F.floor(F.col("seq") / F.lit(size)).cast("bigint"))
    batches = batches.groupBy("batch_no").agg(
        F.min("t").alias("batch_time"), F.count("*").alias("packet_count"), F.sum("len").alias("bytes")
    )
    stamp = F.round(F.col("batch_time") * 1e6).cast("bigint").cast("string")
    return batches.withColumn("batch_id", F.md5(F.concat_ws("|", stamp, F.col("packet_count").cast("string"))))


def connection_info(packets: DataFrame) -> DataFrame:
    """Endpoints per packet: ports for TCP and UDP, type and code for ICMP, 0 otherwise."""
    name = net.protocol_name(F.col("ethertype"), F.col("ip_proto"))
    ip = F.col("ethertype").isin(net.IPV4, net.IPV6)
    v4 = F.col("ethertype") == net.IPV4
    # ICMP type and code travel in the port columns, as pseudo ports.
    has_ports = ip & F.col("ip_proto").isin(net.TCP, net.UDP) | v4 & (F.col("ip_proto") == net.ICMP)
    has_ports = F.coalesce(has_ports, F.lit(False))
    out = packets.withColumn("proto_name", name)
    out = out.withColumn("conn_src_ip", F.when(ip, F.col("src_ip")).otherwise("unknown"))
    out = out.withColumn("conn_dst_ip", F.when(ip, F.col("dst_ip")).otherwise("unknown"))
    out = out.withColumn("conn_src_port", F.when(has_ports, F.col("src_port")).otherwise(0))
    out = out.withColumn("conn_dst_port", F.when(has_ports, F.col("dst_port")).otherwise(0))
    return out.withColumn(
        "conn_info", F.when(ip & (F.col("ip_proto") == net.TCP), net.flag_string(F.col("flags"))).otherwise(name)
    )


def connection_key(packets: DataFrame) -> DataFrame:
    """Symmetric key for TCP and UDP, directional key for everything else."""
    out = connection_info(packets)
    src, dst = F.struct("conn_src_ip", "conn_src_port"), F.struct("conn_dst_ip", "conn_dst_port")
    swap = F.col("proto_name").isin("TCP", "UDP") & (dst < src)
    for side, (one, two) in {"a": ("src", "dst"), "b": ("dst", "src")}.items():
        for part in ("ip", "port"):
            picked = F.when(swap, F.col(f"conn_{two}_{part}")).otherwise(F.col(f"conn_{one}_{part}"))
            out = out.withColumn(f"{side}_{part}", picked)
    return out


CONNECTION_KEY = ["a_ip", "a_port", "b_ip", "b_port"]


def connection_summary(packets: DataFrame) -> DataFrame:
    """Protocol of the first packet, packet count and bytes of each connection."""
    return connection_key(packets).groupBy(*CONNECTION_KEY).agg(
        F.min_by("proto_name", "seq").alias("proto_name"),
        F.count("*").alias("packets"),
        F.sum("len").alias("bytes"),
    )


def connection_listing(packets: DataFrame, short: int = 5, head: int = 3) -> DataFrame:
    """Packets to print per connection: all of a short one, else the first few and a remainder."""
    keyed = connection_key(packets)
    # Each share keeps only its first rows, so a hot connection never meets in one task.
    share = Window.partitionBy(*CONNECTION_KEY, "_share").orderBy("seq")
    whole = Window.partitionBy(*CONNECTION_KEY).orderBy("seq")
    first = (
        keyed.withColumn("_share", F.pmod(F.xxhash64("seq"), F.lit(64)))
        .withColumn("rn", F.row_number().over(share)).filter(F.col("rn") <= short)
        .withColumn("rn", F.row_number().over(whole)).filter(F.col("rn") <= short)
        .select(*CONNECTION_KEY, "rn", "seq", "len")
    )
    totals = connection_summary(packets)
    shown = first.join(totals, CONNECTION_KEY)
    shown = shown.filter((F.col("packets") <= short) | (F.col("rn") <= head))
    rest = F.when(F.col("packets") > short, F.col("packets") - head).otherwise(F.lit(0))
    return shown.withColumn("not_shown", rest.cast("bigint"))


def protocol_histogram(packets: DataFrame) -> DataFrame:
    name = net.protocol_name(F.col("ethertype"), F.col("ip_proto"))
    return packets.groupBy(name.alias("proto_name")).agg(F.count("*").alias("packets")).orderBy("proto_name")


def first_packets(packets: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` captured packets, of which only the IP ones are listed."""
    return only_ip(packets.orderBy("seq").limit(n)).withColumn("packet_num", F.col("seq") + 1)
