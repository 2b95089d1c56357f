"""Record layouts shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

# The 42 flow features in the order every file and model expects.
FEATURES = [
    "dur", "proto", "service", "state", "spkts", "dpkts", "sbytes", "dbytes",
    "rate", "sttl", "dttl", "sload", "dload", "sloss", "dloss", "sinpkt", "dinpkt",
    "sjit", "djit", "swin", "stcpb", "dtcpb", "dwin", "tcprtt", "synack", "ackdat",
    "smean", "dmean", "trans_depth", "response_body_len", "ct_srv_src", "ct_state_ttl",
    "ct_dst_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm", "is_ftp_login",
    "ct_ftp_cmd", "ct_flw_http_mthd", "ct_src_ltm", "ct_srv_dst", "is_sm_ips_ports",
]
CATEGORICAL = ["proto", "service", "state"]
NUMERIC = [name for name in FEATURES if name not in CATEGORICAL]
REQUIRED = ["dur", "proto", "service", "state"]

_DOUBLES = {
    "dur", "rate", "sload", "dload", "sinpkt", "dinpkt", "sjit", "djit",
    "tcprtt", "synack", "ackdat", "smean", "dmean",
}
_LONGS = {"spkts", "dpkts", "sbytes", "dbytes", "sloss", "dloss", "stcpb", "dtcpb", "response_body_len"}


def _feature_type(name: str) -> T.DataType:
    if name in CATEGORICAL:
        return T.StringType()
    if name in _DOUBLES:
        return T.DoubleType()
    return T.LongType() if name in _LONGS else T.IntegerType()


FLOW = T.StructType([T.StructField(name, _feature_type(name)) for name in FEATURES])
NETWORK_LOG = T.StructType([T.StructField("id", T.LongType()), *FLOW.fields])
TRAINING_SET = T.StructType(
    [*NETWORK_LOG.fields, T.StructField("attack_cat", T.StringType()), T.StructField("label", T.IntegerType())]
)

BASIC_INFO = T.StructType([
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
])
PACKET = T.StructType([
    T.StructField("timestamp", T.DoubleType()),
    # Written as text by some producers, so it is read as text and cast later.
    T.StructField("capture_time", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("interface", T.StringType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("raw_bytes", T.StringType()),
    T.StructField("packet_summary", T.StringType()),
    T.StructField("packet_id", T.StringType()),
    T.StructField("protocol_stack", T.ArrayType(T.StringType())),
    T.StructField("packet_layers", T.ArrayType(T.StringType())),
    T.StructField("basic_info", BASIC_INFO),
])
BATCH_HEAD = [
    T.StructField("batch_id", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("interface", T.StringType()),
    T.StructField("packet_count", T.IntegerType()),
]
# Packets stay JSON text here: an entry may be an object or a string holding one.
BATCH = T.StructType([*BATCH_HEAD, T.StructField("packets", T.ArrayType(T.StringType()))])

ALERT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("destination_ip", T.StringType()),
])
LOGGED_ALERT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("log_id", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("attack_probability", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("models", T.MapType(T.StringType(), T.DoubleType())),
])
_GAUGE = T.StructType([
    T.StructField("usage_percent", T.DoubleType()),
    T.StructField("cores", T.IntegerType()),
])
_CAPACITY = T.StructType([
    T.StructField("total", T.LongType()),
    T.StructField("used", T.LongType()),
    T.StructField("free", T.LongType()),
    T.StructField("available", T.LongType()),
    T.StructField("percent", T.DoubleType()),
])
_TRAFFIC = T.StructType([
    T.StructField("bytes_sent", T.LongType()),
    T.StructField("bytes_recv", T.LongType()),
    T.StructField("packets_sent", T.LongType()),
    T.StructField("packets_recv", T.LongType()),
])
SYSTEM_SAMPLE = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("uptime_seconds", T.DoubleType()),
    T.StructField("cpu", _GAUGE),
    T.StructField("memory", _CAPACITY),
    T.StructField("disk", _CAPACITY),
    T.StructField("network", _TRAFFIC),
])
