"""Fixed names, constants and StructTypes shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values that must equal the reference's for equal results -------------
# Destination ports that are *not* flagged as uncommon.
COMMON_PORTS = (80, 443, 22, 1883, 8080, 53)
# IP protocol number -> display name; anything else is "OTHER".
PROTO_NAMES = {6: "TCP", 17: "UDP", 1: "ICMP"}
PROTO_OTHER = "OTHER"
# The fifteen model features, in vector order.
FEATURES = (
    "duration", "total_packets", "total_bytes",
    "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes",
    "mean_pkt_len", "std_pkt_len", "mean_iat", "std_iat",
    "pkts_per_sec", "bytes_per_sec", "uncommon_port", "dst_ip_entropy",
)
NORMAL = "NORMAL"
# Rolling window of the destination-entropy feature, seconds.
ENTROPY_WINDOW_S = 10
# Log timestamp format (strict ISO-8601 UTC, second precision).
LOG_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ssX"
# Anomaly score weights for attack / normal rows and the "elevated" threshold.
ANOMALY_WEIGHT_ATTACK = 0.12
ANOMALY_WEIGHT_NORMAL = 0.02
ANOMALY_ELEVATED = 0.15
# Sequence length of the sequence model.
SEQ_LEN = 5
# Flow table page size: default and maximum.
PAGE_DEFAULT = 200
PAGE_MAX = 500
# Timeline: bucket counts.
TIMELINE_MIN_BINS = 10
TIMELINE_MAX_BINS = 60
TIMELINE_EMPTY_ROWS = 30
# Capture segment length (seconds) of the rotating capture.
SEGMENT_S = 30
# ---------------------------------------------------------------------------------

FIVE_TUPLE = ("src_ip", "src_port", "dst_ip", "dst_port", "proto")
FLOW_KEY = ("segment_id",) + FIVE_TUPLE
US = 1_000_000

PACKETS = T.StructType([
    T.StructField("segment_id", T.LongType()),
    T.StructField("pkt_idx", T.LongType()),
    T.StructField("t_us", T.LongType()),
    T.StructField("is_ip", T.BooleanType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("proto", T.IntegerType()),
    T.StructField("len", T.IntegerType()),
])

FLOW_COLUMNS = (
    "src_ip", "src_port", "dst_ip", "dst_port", "proto", "start_time", "end_time",
    "duration", "total_packets", "total_bytes", "fwd_packets", "bwd_packets",
    "fwd_bytes", "bwd_bytes", "mean_pkt_len", "std_pkt_len", "mean_iat", "std_iat",
    "pkts_per_sec", "bytes_per_sec", "uncommon_port", "dst_ip_entropy",
    "segment_id", "seq",
)

_FLOW_TYPES = {
    "src_ip": T.StringType(), "src_port": T.IntegerType(), "dst_ip": T.StringType(),
    "dst_port": T.IntegerType(), "proto": T.IntegerType(), "total_packets": T.LongType(),
    "total_bytes": T.LongType(), "fwd_packets": T.LongType(), "bwd_packets": T.LongType(),
    "fwd_bytes": T.LongType(), "bwd_bytes": T.LongType(), "uncommon_port": T.IntegerType(),
    "segment_id": T.LongType(), "seq": T.LongType(),
}
FLOWS = T.StructType([
    T.StructField(c, _FLOW_TYPES.get(c, T.DoubleType())) for c in FLOW_COLUMNS
])
LABELED_FLOWS = T.StructType(FLOWS.fields + [T.StructField("label", T.StringType())])

ATTACK_LOG = T.StructType([
    T.StructField("line_no", T.LongType()),
    T.StructField("line", T.StringType()),
])
INTERVALS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("start_us", T.LongType()),
    T.StructField("end_us", T.LongType()),
    T.StructField("rank", T.LongType()),
])
EVENTS_LOG = T.StructType([
    T.StructField("t", T.TimestampType()),
    T.StructField("level", T.StringType()),
    T.StructField("msg", T.StringType()),
])
EVALUATION = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("false_positive_rate", T.DoubleType()),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
])
