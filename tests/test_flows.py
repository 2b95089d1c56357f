"""Flow building: independence of partitioning and block size, odd flows, frames and capture files."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from flowquarry.functions import frames
from flowquarry.operators import flows as L
from flowquarry.plans.views import packets
from flowquarry.sources import captures

SCHEMA = ("seq bigint, t double, ethertype int, src_ip string, dst_ip string, src_port int, dst_port int, ip_proto int, "
          "len bigint, ttl int, win int, flags int, tcp_seq bigint, payload string")


def row(seq, t, src, dst, proto=6, size=60, flags=16, payload="", ttl=64, win=100, tcp_seq=7):
    return (seq, float(t), 2048, src[0], dst[0], src[1], dst[1], proto, size, ttl, win, flags, tcp_seq, payload)


def brute_force(rows):
    """The features that depend on packet order, one flow at a time in plain Python."""
    ports = L.net.SERVICE_PORTS
    found = {}
    for r in sorted(rows):
        seq, t, _, sip, dip, sp, dp, proto, size, ttl, win, flags, tcp_seq, payload = r
        src, dst = (sip, sp), (dip, dp)
        key, fwd = ((src, dst), True) if src < dst else ((dst, src), False)
        f = found.setdefault(key, {"svc": "-", "times": {True: [], False: []}, "http": 0, "depth": 0, "cmd": 0, "n": 0})
        f["n"] += 1
        f["times"][fwd].append(t)
        if f["svc"] == "-":
            f["svc"] = ports.get(dp) or ports.get(sp) or "-"
            low = payload.lower()
            if f["svc"] == "-" and proto == 6 and low:
                f["svc"] = ("http" if any(x in low for x in ("http", "get ", "post ")) else
                            "ftp" if "ftp" in low else "smtp" if "smtp" in low else "-")
        if proto == 17 and 53 in (sp, dp):
            f["svc"] = "dns"
        if proto == 6 and payload and f["svc"] == "http":
            f["http"] += any(m in payload for m in ("GET ", "POST ", "PUT ", "DELETE "))
            f["depth"] += "HTTP/1." in payload
        if proto == 6 and payload and f["svc"] == "ftp":
            f["cmd"] += any(c + " " in payload for c in "USER PASS LIST RETR STOR CWD PWD QUIT".split())
    out = {}
    for key, f in found.items():
        jit = []
        for side in (True, False):
            times = f["times"][side]
            gaps = [abs(b - a) for a, b in zip(times, times[1:], strict=False)]
            mean = sum(gaps) / len(gaps) if gaps else 0
            jit.append(sum(abs(g - mean) for g in gaps) / len(gaps) if len(gaps) >= 2 else 0.0)
        out[key] = (f["svc"], f["n"], f["http"], f["depth"], f["cmd"], round(jit[0], 6), round(jit[1], 6))
    return out


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_features_against_brute_force(spark, block):
    """Random traffic with a dominant flow, unmapped ports, late services and DNS takeovers."""
    rng = random.Random(5)
    texts = ["", "PUT /a", "GET /b HTTP/1.1", "USER x", "hello ftp", "LIST ", "HTTP/1.0 200", "Content-Length: 5", "smtp"]
    ends = [(("10.0.0.1", 5000), ("10.0.0.2", 6000)), (("10.0.0.1", 53), ("10.0.0.3", 80)), (("1.1.1.1", 7000), ("2.2.2.2", 21)),
            (("9.9.9.9", 40000), ("10.0.0.9", 50000))]
    rows = []
    for seq in range(400):
        a, b = rng.choice(ends[:1] * 5 + ends)
        if rng.random() < 0.4:
            a, b = b, a
        proto = 17 if rng.random() < 0.08 else 6
        rows.append(row(seq, 1000 + rng.random() * 50, a, b, proto, payload=rng.choice(texts)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {
        ((r["a_ip"], r["a_port"]), (r["b_ip"], r["b_port"])): (
            r["service"], r["packets"], r["ct_flw_http_mthd"], r["trans_depth"], r["ct_ftp_cmd"],
            round(r["sjit"], 6), round(r["djit"], 6))
        for r in L.flow_features(df, block_rows=block).collect()
    }
    assert got == brute_force(rows)


def test_independent_of_partitions_and_blocks(spark, folder):
    rows = packets(spark, folder)
    columns = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in L.flow_features(rows).dtypes]
    one = L.flow_features(rows.coalesce(1)).select(*columns)
    many = L.flow_features(rows.repartition(7), block_rows=50).select(*columns)
    assert one.count() == many.count() == one.intersect(many).count()


def test_packets_are_conserved_and_non_ip_is_ignored(spark, folder):
    rows = packets(spark, folder)
    arp = rows.limit(5).withColumn("ethertype", F.lit(L.net.ARP))
    total = L.flow_features(rows.unionByName(arp)).agg(F.sum(F.col("spkts") + F.col("dpkts"))).first()[0]
    assert total == rows.count()


def test_no_elephant_flow_in_one_window(spark, folder):
    """Packets are never exchanged on the flow alone, except as partial aggregates."""
    plan = L.jitter(L.keyed_packets(packets(spark, folder)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(cell" in plan
    plan = L.flow_base(L.keyed_packets(packets(spark, folder)))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "SortAggregate" not in plan


def test_initiator_orientation(spark):
    rows = [row(0, 1, ("9.0.0.1", 9), ("10.0.0.1", 80)), row(1, 2, ("10.0.0.1", 80), ("9.0.0.1", 9)),
            row(2, 3, ("9.0.0.1", 9), ("10.0.0.1", 80))]
    df = spark.createDataFrame(rows, SCHEMA)
    plain, turned = L.flow_features(df).first(), L.flow_features(df, orientation="initiator").first()
    # "10.0.0.1" sorts before "9.0.0.1", so the canonical source is the server.
    assert (plain["a_ip"], plain["spkts"], plain["dpkts"]) == ("10.0.0.1", 1, 2)
    assert (turned["spkts"], turned["dpkts"]) == (2, 1)


# A hand-made Ethernet / IPv4 / TCP frame: 192.168.1.2:20100 -> 172.65.251.78:443, SYN+ACK, seq 100.
FRAME = bytes.fromhex(
    "020202020202" "020202020203" "0800" "4500002c" "00000000" "4006" "0000" "c0a80102" "ac41fb4e"
    "4e84" "01bb" "00000064" "00000000" "5012" "2000" "00000000" "48690aff"
)
IP6 = bytes.fromhex(
    "020202020202" "020202020203" "86dd" "60000000" "000811ff" "20010db8000000000000000000000001"
    "fe800000000000010000000000000002" "0035" "1f90" "0008" "0000"
)
ARP = bytes.fromhex("ffffffffffff" "020202020203" "0806" "0001080006040001" "020202020203" "0a000001" "000000000000" "0a000002")


def decoded(spark, *raw, link=frames.ETHERNET):
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "seq bigint, frame binary")
    return frames.decode_frames(df, "frame", F.lit(link)).orderBy("seq").collect()


def test_decode_tcp_frame(spark):
    r = decoded(spark, FRAME)[0]
    assert (r["src_ip"], r["dst_ip"], r["src_port"], r["dst_port"]) == ("192.168.1.2", "172.65.251.78", 20100, 443)
    assert (r["ttl"], r["ip_proto"], r["flags"], r["win"], r["tcp_seq"], r["len"]) == (64, 6, 18, 8192, 100, len(FRAME))
    assert r["payload"] == "Hi\n"  # the undecodable byte is left out


def test_decode_ipv6_arp_vlan_options_fragment(spark):
    vlan = FRAME[:12] + bytes.fromhex("81000064") + FRAME[12:]
    options = FRAME[:14] + bytes.fromhex("46000030") + FRAME[18:34] + b"\x00" * 4 + FRAME[34:]
    fragment = FRAME[:20] + bytes.fromhex("00b9") + FRAME[22:]
    six, arp, tagged, opted, later = decoded(spark, IP6, ARP, vlan, options, fragment)
    assert (six["src_ip"], six["dst_ip"]) == ("2001:db8::1", "fe80:0:0:1::2")
    assert (six["ip_proto"], six["src_port"], six["dst_port"]) == (17, 53, 8080)
    assert (arp["ethertype"], arp["src_ip"], arp["dst_ip"], arp["ip_proto"]) == (L.net.ARP, "10.0.0.1", "10.0.0.2", None)
    assert (tagged["ethertype"], tagged["dst_port"]) == (L.net.IPV4, 443)
    assert (opted["dst_port"], opted["flags"]) == (443, 18)
    assert (later["src_ip"], later["ip_proto"], later["src_port"]) == ("192.168.1.2", None, None)


def test_decode_raw_ip_and_short_frames(spark):
    bare = decoded(spark, FRAME[14:], link=frames.RAW_IP)[0]
    assert (bare["src_ip"], bare["dst_port"]) == ("192.168.1.2", 443)
    short = decoded(spark, b"\x01\x02", b"", FRAME[:20])
    assert all(r["src_ip"] is None and r["ethertype"] is None for r in short)
    rows = spark.createDataFrame([(0, bytearray(FRAME[:20])), (1, bytearray(FRAME))], "seq bigint, frame binary")
    packets = frames.decode_frames(rows).withColumn("t", F.lit(1.0))
    assert [r["packets"] for r in L.flow_features(packets).collect()] == [1]


def capture(records, order="<", magic=0xA1B2C3D4):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for sec, frac, frame in records:
        out += struct.pack(order + "IIII", sec, frac, len(frame), len(frame)) + frame
    return out


def test_read_capture_files(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([(10, 500000, FRAME), (11, 0, ARP)]))
    (tmp_path / "b.pcap").write_bytes(capture([(12, 250000000, FRAME)], ">", 0xA1B23C4D))
    (tmp_path / "c.pcap").write_bytes(capture([(13, 0, FRAME)])[:-3])
    (tmp_path / "d.pcap").write_bytes(b"not a capture")
    good, bad = captures.read_captures(spark, str(tmp_path))
    rows = good.orderBy("seq").collect()
    assert [r["t"] for r in rows] == [10.5, 11.0, 12.25]
    assert [r["seq"] for r in rows] == [0, 1, 1 << 40]
    assert {r["error"] for r in bad.collect()} == {"record cut off", "not a capture file"}
    flow = L.flow_features(good).collect()
    assert len(flow) == 1 and flow[0]["packets"] == 2 and flow[0]["service"] == "https"
