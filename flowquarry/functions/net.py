"""Packet-level column expressions: naming, services, flags, addresses, payload hints."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowquarry.functions.numeric import flag

# Well-known service ports.
SERVICE_PORTS = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp",
    53: "dns", 80: "http", 110: "pop3", 143: "imap", 443: "https",
    993: "imaps", 995: "pop3s", 1433: "mssql", 3306: "mysql",
    5432: "postgresql", 6379: "redis", 27017: "mongodb",
}
# IP protocol numbers and the names reports use for them.
PROTOCOL_NAMES = {
    1: "ICMP", 2: "IGMP", 4: "IP-in-IP", 6: "TCP", 8: "EGP", 12: "PUP", 17: "UDP",
    27: "RDP", 41: "IPv6", 43: "IPv6-Route", 44: "IPv6-Frag", 47: "GRE", 50: "ESP",
    51: "AH", 58: "ICMPv6", 89: "OSPF", 103: "PIM",
}
# EtherType numbers.
IPV4, IPV6, ARP = 0x0800, 0x86DD, 0x0806
TCP, UDP, ICMP = 6, 17, 1
# TCP flag letters by bit, lowest first.
TCP_FLAGS = [("F", 1), ("S", 2), ("R", 4), ("P", 8), ("A", 16), ("U", 32)]


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def is_tcp() -> Column:
    return (F.col("ethertype") == IPV4) & (F.col("ip_proto") == TCP)


def is_udp() -> Column:
    return (F.col("ethertype") == IPV4) & (F.col("ip_proto") == UDP)


def protocol_name(ethertype: Column, number: Column) -> Column:
    """Readable protocol of a packet; ``number`` is the IPv4 protocol or IPv6 next header."""
    v4 = F.coalesce(
        F.try_element_at(literal_map(PROTOCOL_NAMES), number),
        F.concat(F.lit("Proto-"), number.cast("string")),
    )
    v6 = (
        F.when(number == TCP, "TCP").when(number == UDP, "UDP").when(number == 58, "ICMPv6")
        .otherwise(F.concat(F.lit("IPv6-"), number.cast("string")))
    )
    return (
        F.when(ethertype == IPV4, v4).when(ethertype == IPV6, v6)
        .when(ethertype == ARP, "ARP").otherwise("Unknown")
    )


def flow_protocol(number: Column) -> Column:
    """Lower-case protocol of the feature table."""
    return F.when(number == TCP, "tcp").when(number == UDP, "udp").when(number == ICMP, "icmp").otherwise("other")


def flag_string(bits: Column) -> Column:
    return F.concat(*[
        F.when(bits.bitwiseAND(F.lit(bit)) > 0, F.lit(letter)).otherwise(F.lit("")) for letter, bit in TCP_FLAGS
    ])


def tcp_state(bits: Column) -> Column:
    """Connection state from the union of all flags seen on the flow."""
    def seen(bit: int) -> Column:
        return bits.bitwiseAND(F.lit(bit)) > 0

    return (
        F.when(seen(1), "FIN").when(seen(4), "RST")
        .when(seen(2) & seen(16), "CON").when(seen(2), "REQ").otherwise("INT")
    )


def port_service(src_port: Column, dst_port: Column) -> Column:
    """Service named by the destination port, else by the source port, else NULL."""
    ports = literal_map(SERVICE_PORTS)
    return F.coalesce(F.try_element_at(ports, dst_port), F.try_element_at(ports, src_port))


def payload_service(payload: Column) -> Column:
    """Service hinted at by payload text, or NULL."""
    text = F.lower(payload)
    web = text.contains("http") | text.contains("get ") | text.contains("post ")
    return F.when(web, "http").when(text.contains("ftp"), "ftp").when(text.contains("smtp"), "smtp")


def packet_service() -> Column:
    """Service one packet yields by itself; only TCP looks into the payload."""
    by_port = port_service(F.col("src_port"), F.col("dst_port"))
    tcp = F.when(is_tcp(), F.coalesce(by_port, payload_service(F.col("payload")), F.lit("-")))
    return tcp.when(is_udp(), F.coalesce(by_port, F.lit("-"))).otherwise(F.lit("-"))


def is_dns() -> Column:
    return is_udp() & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))


def http_method_seen(payload: Column) -> Column:
    return flag(payload.rlike("(GET|POST|PUT|DELETE) "))


def http_version_seen(payload: Column) -> Column:
    return flag(payload.contains("HTTP/1."))


def content_length(payload: Column) -> Column:
    digits = F.regexp_extract(payload, r"Content-Length:\s*([0-9]+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def ftp_login_seen(payload: Column) -> Column:
    return flag(payload.rlike("(USER|PASS) "))


def ftp_command_seen(payload: Column) -> Column:
    return flag(payload.rlike("(USER|PASS|LIST|RETR|STOR|CWD|PWD|QUIT) "))


def private_address(ip: Column) -> Column:
    """10/8, 172.16/12 and 192.168/16; anything malformed is not private."""
    parts = F.split(ip, r"\.")
    first = F.try_element_at(parts, F.lit(1)).try_cast("int")
    second = F.try_element_at(parts, F.lit(2)).try_cast("int")
    inside = (
        (first == 10) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168))
    )
    return F.coalesce((F.size(parts) == 4) & second.isNotNull() & inside, F.lit(False))
