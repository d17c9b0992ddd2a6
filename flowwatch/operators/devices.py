"""Device inventory, services seen per device, and device table merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.functions.ips import is_ip, is_loopback, is_private
from flowwatch.functions.ports import WATCHED_PORTS, port_risk


def device_inventory(packets: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Every valid address seen as source or destination, with first and last time.

    ``names`` (ip, seq, ts, name) gives each device its last non-empty name. Addresses are
    checked once each, after the aggregate.
    """
    seen = packets.select("ts_us", F.explode(F.array("src_ip", "dest_ip")).alias("ip"))
    devices = (
        seen.filter(F.col("ip") != "")
        .groupBy("ip")
        .agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
        .filter(is_ip(F.col("ip")))
        .select(
            "ip",
            F.timestamp_micros("first_us").alias("first_seen"),
            F.timestamp_micros("last_us").alias("last_seen"),
        )
    )
    if names is None:
        return devices.withColumn("name", F.lit(""))
    last_name = names.filter(F.coalesce("name", F.lit("")) != "").groupBy("ip").agg(
        F.max_by("name", F.struct("ts", "seq")).alias("name")
    )
    return devices.join(last_name, "ip", "left").withColumn("name", F.coalesce("name", F.lit("")))


def device_services(packets: DataFrame, watched: list[int] = WATCHED_PORTS) -> DataFrame:
    """Watched ports each device was reached on, and the risk they stand for.

    The watch list bounds the collected set.
    """
    return (
        packets.filter(F.col("dport").isin(list(watched)))
        .groupBy(F.col("dest_ip").alias("ip"))
        .agg(F.array_sort(F.collect_set("dport")).alias("open_ports"))
        .withColumn("risk", port_risk(F.col("open_ports")))
    )


def merge_devices(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Insert new devices, widen the times of known ones, take a new name only if it is not empty."""
    n = seen.select(
        F.col("ip").alias("_ip"),
        F.col("first_seen").alias("_first"),
        F.col("last_seen").alias("_last"),
        F.nullif(F.col("name"), F.lit("")).alias("_name"),
    )
    own = [c for c in current.columns if c not in ("ip", "first_seen", "last_seen", "name")]
    return current.join(n, current["ip"] == n["_ip"], "full_outer").select(
        F.coalesce("ip", "_ip").alias("ip"),
        F.least("first_seen", "_first").alias("first_seen"),
        F.greatest("last_seen", "_last").alias("last_seen"),
        F.coalesce("_name", "name", F.lit("")).alias("name"),
        *own,
    )


def rename_devices(current: DataFrame, names: DataFrame, order: str | None = None) -> DataFrame:
    """New names (ip, name) for devices that exist; others are ignored. Empty names change nothing.

    Of several names for a device the last by the column ``order`` counts; without such a column
    the names have no order, and the greatest counts.
    """
    last = F.struct(F.col(order), F.col("name")) if order else F.struct("name")
    given = names.filter(F.coalesce("name", F.lit("")) != "").groupBy("ip").agg(F.max(last).alias("_last"))
    n = given.select("ip", F.col("_last.name").alias("_name"))
    return (
        current.join(n, "ip", "left")
        .withColumn("name", F.coalesce("_name", "name"))
        .select(*current.columns)
    )


def merge_scan(current: DataFrame, services: DataFrame, as_of: Column) -> DataFrame:
    """Scan results (ip, open_ports, risk) put on the devices; missing devices are created."""
    s = services.select(
        F.col("ip").alias("_ip"), F.col("open_ports").alias("_ports"), F.col("risk").alias("_risk")
    )
    hit = F.col("_ip").isNotNull()
    return current.join(s, current["ip"] == s["_ip"], "full_outer").select(
        F.coalesce("ip", "_ip").alias("ip"),
        F.coalesce("first_seen", as_of).alias("first_seen"),
        F.when(hit, as_of).otherwise(F.col("last_seen")).alias("last_seen"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.when(hit, F.col("_ports")).otherwise(F.col("open_ports")).alias("open_ports"),
        F.when(hit, F.col("_risk")).otherwise(F.col("risk")).alias("risk"),
    )


def ensure_devices(current: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Requests (ip, name) applied to the devices, as a user would make them.

    A name goes to a device that exists. A request without one makes sure that the device exists and
    counts as seen at ``as_of``. Blank addresses are ignored.
    """
    asked = requests.select(F.trim("ip").alias("ip"), F.trim(F.coalesce("name", F.lit(""))).alias("name")).filter("ip <> ''")
    touched = asked.filter("name = ''").select("ip").distinct()
    touched = touched.select("ip", as_of.alias("first_seen"), as_of.alias("last_seen"), F.lit("").alias("name"))
    return rename_devices(merge_devices(current, touched), asked)


def newest_devices(devices: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = devices.orderBy(F.col("last_seen").desc(), F.col("ip"))
    return ordered if limit is None else ordered.limit(limit)


def scan_targets(devices: DataFrame, limit: int | None = None) -> DataFrame:
    """Private and loopback addresses of the devices, or of the ``limit`` seen last."""
    ip = F.col("ip")
    chosen = devices if limit is None else newest_devices(devices, limit)
    return chosen.filter(is_private(ip) | is_loopback(ip)).select("ip").distinct()
