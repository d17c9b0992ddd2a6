"""Fixed table schemas. Times are TIMESTAMP (UTC) or integer microseconds."""

from __future__ import annotations

from pyspark.sql import types as T

PACKET = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("packet_size", T.IntegerType()),
        T.StructField("sport", T.IntegerType()),
        T.StructField("dport", T.IntegerType()),
    ]
)

# A decoded capture record, before ports are settled on one layer.
RAW_PACKET = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("has_ip", T.BooleanType()),
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("proto", T.StringType()),
        T.StructField("length", T.StringType()),
        T.StructField("tcp_sport", T.StringType()),
        T.StructField("tcp_dport", T.StringType()),
        T.StructField("udp_sport", T.StringType()),
        T.StructField("udp_dport", T.StringType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("kind", T.StringType()),
    ]
)

BLOCK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ip", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)

# What a rate limit needs of a signature hit.
HIT = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)

DEVICE = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("name", T.StringType()),
        T.StructField("open_ports", T.ArrayType(T.IntegerType())),
        T.StructField("risk", T.StringType()),
    ]
)

TRUSTED = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("created_ts", T.TimestampType()),
    ]
)

NODE = T.StructType(
    [
        T.StructField("tree_id", T.IntegerType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("feature_idx", T.IntegerType()),
        T.StructField("cut", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
    ]
)

# Fixed value: the model's feature order.
FEATURES = [
    "protocol",
    "packet_size_log",
    "time_diff",
    "dport",
    "is_ephemeral_sport",
    "unique_dports_15s",
    "direction",
]

LOG_COLUMNS = ["id", "ts", "ip", "type", "label", "severity", "kind"]
