"""Adapters from the generic ``events`` table to the tables this library works on.

Each is a projection or a filter over the whole table, so the derived tables
grow with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LOCAL_IPS = ["10.0.0.2", "10.0.0.3", "10.0.0.4"]
EPOCH_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_k(spark.read.parquet(f"{sf_dir}/events.parquet"))


def with_k(events: DataFrame) -> DataFrame:
    """Events with the number in ``props`` as ``k``, parsed once per row."""
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _k() -> Column:
    return F.col("k")


def _u() -> Column:
    return F.col("user_id") % 8


def _real_ts() -> Column:
    return F.col("ts").cast("timestamp")


def _second() -> Column:
    return F.date_trunc("second", _real_ts())


def src_ip() -> Column:
    return F.when(_u() < 3, F.concat(F.lit("10.0.0."), (_u() + 2).cast("string"))).otherwise(
        F.concat(F.lit("203.0.113."), _u().cast("string"))
    )


def dest_ip() -> Column:
    return F.when(_u() < 3, F.concat(F.lit("203.0.113."), (F.col("event_id") % 5).cast("string"))).otherwise(
        F.concat(F.lit("10.0.0."), (F.col("event_id") % 3 + 2).cast("string"))
    )


def dport() -> Column:
    sensitive = F.array(*[F.lit(p) for p in (22, 23, 2323, 3389, 5900)])
    return F.when(_k() < 5, F.get(sensitive, _k())).otherwise(F.lit(1000) + _k())


def packets(events: DataFrame, *carry: str) -> DataFrame:
    """Packet records; time is compressed 1000 times so that 15 second windows hold data."""
    return events.select(
        *carry,
        F.col("event_id").alias("seq"),
        F.lit("cap0").alias("sensor_id"),
        F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH_US}L) div 1000").alias("ts_us"),
        src_ip().alias("src_ip"),
        dest_ip().alias("dest_ip"),
        F.when(F.col("event_id") % 3 == 0, 17).otherwise(6).alias("protocol"),
        (F.lit(60) + F.floor(F.col("value") * 4)).cast("int").alias("packet_size"),
        (F.lit(40000) + (F.col("event_id") * 7919) % 25536).cast("int").alias("sport"),
        dport().cast("int").alias("dport"),
    )


def raw_packets(events: DataFrame) -> DataFrame:
    """Capture records before normalization: views carry no IP layer, signups no ports,
    purchases both layers, and a few sizes are missing or unreadable."""
    both = F.col("event_type") == "purchase"
    tcp = F.col("event_type").isin("error", "purchase")
    udp = (F.col("event_type") == "click") | both
    return (
        packets(events, "event_type")
        .select(
            "seq",
            "sensor_id",
            F.format_string("%d.%06d", F.expr("ts_us div 1000000"), F.col("ts_us") % 1_000_000).alias("time"),
            (F.col("event_type") != "view").alias("has_ip"),
            F.col("src_ip").alias("src"),
            F.col("dest_ip").alias("dst"),
            F.col("protocol").cast("string").alias("proto"),
            F.when(F.col("seq") % 11 == 0, F.lit(None))
            .when(F.col("seq") % 13 == 0, "n/a")
            .otherwise(F.col("packet_size").cast("string"))
            .alias("length"),
            F.when(tcp, F.col("sport").cast("string")).alias("tcp_sport"),
            F.when(tcp, F.col("dport").cast("string")).alias("tcp_dport"),
            F.when(udp, (F.col("sport") + 1).cast("string")).alias("udp_sport"),
            F.when(udp, (F.col("dport") + 1).cast("string")).alias("udp_dport"),
        )
    )


def alerts(events: DataFrame) -> DataFrame:
    k = _k()
    anomaly = F.col("event_type") == "error"
    where = F.format_string("%s:%d", dest_ip(), dport().cast("int"))
    label = F.when(anomaly, F.concat(where, F.format_string(" score=%.3f", -k / F.lit(500.0)))).otherwise(
        F.concat(F.when(k < 5, "inbound-sensitive-port").otherwise("port-scan-suspected"), F.lit(" "), where)
    )
    severity = (
        F.when(anomaly & (k >= 50), "HIGH")
        .when(anomaly & (k >= 25), "MEDIUM")
        .when(anomaly, "LOW")
        .when(k < 5, "MEDIUM")
        .otherwise("HIGH")
    )
    return events.filter(F.col("event_type").isin("error", "view")).select(
        F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("id"),
        _second().alias("ts"),
        src_ip().alias("src_ip"),
        label.alias("label"),
        severity.alias("severity"),
        F.when(anomaly, "ANOMALY").otherwise("SIGNATURE").alias("kind"),
    )


def user_ip() -> Column:
    """An address per user."""
    user = F.col("user_id")
    return F.concat_ws(".", F.lit("198.18"), F.floor(user / 256).cast("string"), (user % 256).cast("string"))


def blocks(events: DataFrame, ip: Column | None = None) -> DataFrame:
    k = _k()
    block = F.col("event_type") == "purchase"
    expires = F.timestamp_micros(F.unix_micros(_second()) + k.cast("bigint") * 60_000_000)
    return events.filter(F.col("event_type").isin("purchase", "signup")).select(
        F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("id"),
        _second().alias("ts"),
        (src_ip() if ip is None else ip).alias("ip"),
        F.when(block, "block").otherwise("unblock").alias("action"),
        F.when(block & (k % 2 == 0), "auto-high").otherwise("manual").alias("reason"),
        F.when(block & (k % 2 == 1), expires).alias("expires_at"),
    )


def trusted(events: DataFrame) -> DataFrame:
    """Two known sources, trusted since they were first seen."""
    return (
        events.select(src_ip().alias("ip"), _second().alias("ts"))
        .filter(F.col("ip").isin("10.0.0.2", "203.0.113.3"))
        .groupBy("ip")
        .agg(F.min("ts").alias("created_ts"))
        .select("ip", F.when(F.col("ip") == "10.0.0.2", "gateway").otherwise("partner").alias("note"), "created_ts")
    )


def logins(events: DataFrame) -> DataFrame:
    """Login attempts: errors fail, signups succeed."""
    return events.filter(F.col("event_type").isin("error", "signup")).select(
        F.col("user_id").cast("string").alias("username"),
        F.col("event_id").alias("seq"),
        _real_ts().alias("ts"),
        (F.col("event_type") == "signup").alias("ok"),
    )


def commands(events: DataFrame) -> DataFrame:
    """Containment commands per address. Some addresses are blank or malformed."""
    k = _k()
    name = (
        F.when(F.col("event_type") == "purchase", "block")
        .when(F.col("event_type") == "signup", "unblock")
        .when(F.col("event_type") == "view", "trust")
        .otherwise("untrust")
    )
    ip = (
        F.when(F.col("event_id") % 97 == 0, " ")
        .when(F.col("event_id") % 89 == 0, F.concat(src_ip(), F.lit(".9")))
        .otherwise(src_ip())
    )
    return events.filter(F.col("event_type") != "click").select(
        F.col("event_id").alias("seq"),
        _second().alias("ts"),
        ip.alias("ip"),
        name.alias("command"),
        F.when(k % 2 == 1, (k * 10).cast("string")).alias("minutes"),
        F.when(k % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("r"), k.cast("string"))).alias("reason"),
    )


def device_names(events: DataFrame) -> DataFrame:
    """Name sightings per address; odd ones are blank."""
    return events.filter(F.col("event_type") == "signup").select(
        src_ip().alias("ip"),
        F.col("event_id").alias("seq"),
        _real_ts().alias("ts"),
        F.when(_k() % 2 == 0, F.concat(F.lit("host-"), _k().cast("string"))).otherwise("").alias("name"),
    )


# Three hand-written trees over the raw features, for scoring checks.
# tree_id, node_id, feature_idx, cut, left, right, depth, n
FIXED_NODES = [
    (0, 0, 5, 8.5, 1, 2, 0, 256),
    (0, 1, 1, 5.0, 3, 4, 1, 236),
    (0, 2, -1, 0.0, -1, -1, 1, 2),
    (0, 3, -1, 0.0, -1, -1, 2, 150),
    (0, 4, -1, 0.0, -1, -1, 2, 86),
    (1, 0, 3, 1000.5, 1, 2, 0, 256),
    (1, 1, -1, 0.0, -1, -1, 1, 1),
    (1, 2, 2, 0.5, 3, 4, 1, 255),
    (1, 3, -1, 0.0, -1, -1, 2, 200),
    (1, 4, -1, 0.0, -1, -1, 2, 55),
    (2, 0, 1, 6.0, 1, 2, 0, 256),
    (2, 1, 6, 0.5, 3, 4, 1, 220),
    (2, 2, -1, 0.0, -1, -1, 1, 36),
    (2, 3, -1, 0.0, -1, -1, 2, 120),
    (2, 4, -1, 0.0, -1, -1, 2, 100),
]
FIXED_OFFSET = -0.64
