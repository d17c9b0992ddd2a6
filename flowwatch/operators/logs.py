"""Log views over alerts and blocks: union, filters, pages, counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.operators.ordered import keep_first
from flowwatch.schemas import LOG_COLUMNS

Cursor = datetime | str | tuple


def log_events(alerts: DataFrame, blocks: DataFrame) -> DataFrame:
    return alerts.select(
        "id", "ts", F.col("src_ip").alias("ip"), F.lit("alert").alias("type"), "label", "severity", "kind"
    ).unionByName(
        blocks.select(
            "id",
            "ts",
            "ip",
            F.lit("block").alias("type"),
            F.col("action").alias("label"),
            F.lit(None).cast("string").alias("severity"),
            F.lit("block").alias("kind"),
        )
    )


def newest_first(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest rows, id breaking ties so that pages are stable."""
    out = df.orderBy(F.col("ts").desc(), F.col("id").desc())
    return out if limit is None else out.limit(int(limit))


def _moment(value) -> Column:
    return F.lit(value).cast("timestamp")


def filter_logs(
    logs: DataFrame,
    ip: str | None = None,
    severity: str | None = None,
    type: str | None = None,
    kind: str | None = None,
    ts_from=None,
    ts_to=None,
    limit: int | None = None,
) -> DataFrame:
    """Rows matching every given filter; bounds are inclusive, text filters but ip ignore case.

    The filters sit above a union and reach both scans through it.
    """
    out = logs
    if ip:
        out = out.filter(F.col("ip") == ip)
    if severity:
        out = out.filter(F.lower(F.coalesce("severity", F.lit(""))) == severity.lower())
    if type:
        out = out.filter(F.lower("type") == type.lower())
    if kind:
        out = out.filter(F.lower("kind") == kind.lower())
    if ts_from:
        out = out.filter(F.col("ts") >= _moment(ts_from))
    if ts_to:
        out = out.filter(F.col("ts") <= _moment(ts_to))
    return out if limit is None else newest_first(out, limit)


def filter_normalized(
    rows: DataFrame,
    ip: str | None = None,
    severity: str | None = None,
    type: str | None = None,
    ts_from=None,
    ts_to=None,
) -> DataFrame:
    """The same on normalized events: type matches exactly, rows without a time pass the bounds."""
    out = rows
    if ip and ip.strip():
        out = out.filter(F.col("ip") == ip.strip())
    if severity and severity.strip():
        out = out.filter(F.lower("severity") == severity.strip().lower())
    if type and type.strip():
        out = out.filter(F.col("type") == type.strip())
    if ts_from:
        out = out.filter(F.col("ts").isNull() | (F.col("ts") >= _moment(ts_from)))
    if ts_to:
        out = out.filter(F.col("ts").isNull() | (F.col("ts") <= _moment(ts_to)))
    return out


def page(df: DataFrame, limit: int, cursor: Cursor | None = None) -> DataFrame:
    """One newest-first page. A cursor is the last row's time, or its (time, id): the time
    alone skips the rest of a second that was cut by the page end, the pair does not."""
    if cursor is None:
        return newest_first(df, limit)
    if isinstance(cursor, tuple):
        ts, id_ = cursor
        before = (F.col("ts") < _moment(ts)) | ((F.col("ts") == _moment(ts)) & (F.col("id") < id_))
    else:
        before = F.col("ts") < _moment(cursor)
    return newest_first(df.filter(before), limit)


def export_rows(logs: DataFrame) -> DataFrame:
    """Log rows as text columns in export order."""
    from flowwatch.functions.text import iso_utc

    return logs.select(*[iso_utc(F.col(c)).alias(c) if c == "ts" else F.col(c) for c in LOG_COLUMNS])


def stats_snapshot(alerts: DataFrame, blocks: DataFrame, cap: int | None = None) -> DataFrame:
    """Alert and block counts in one row; with ``cap`` also as shown, never above it."""
    n = (
        alerts.select(F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(blocks.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
        .agg(F.coalesce(F.sum("a"), F.lit(0)).alias("alerts"), F.coalesce(F.sum("b"), F.lit(0)).alias("blocks"))
    )
    if cap is None:
        return n
    return n.select(
        F.least("alerts", F.lit(cap)).cast("bigint").alias(f"alerts_{cap}"),
        F.least("blocks", F.lit(cap)).cast("bigint").alias(f"blocks_{cap}"),
        "alerts",
        "blocks",
    )


def dashboard_counts(devices: DataFrame, alerts: DataFrame, blocks: DataFrame, as_of: Column) -> DataFrame:
    """Device totals and the alerts and blocks of the 24 hours up to ``as_of``."""
    recent = F.col("ts").between(as_of - F.expr("INTERVAL 24 HOURS"), as_of)
    parts = [
        devices.select(
            F.lit("devices").alias("what"), F.coalesce("name", F.lit("")).eqNullSafe("").cast("int").alias("unnamed")
        ),
        alerts.filter(recent).select(F.lit("alerts").alias("what"), F.lit(0).alias("unnamed")),
        blocks.filter(recent).select(F.lit("blocks").alias("what"), F.lit(0).alias("unnamed")),
    ]
    return (
        parts[0]
        .unionByName(parts[1])
        .unionByName(parts[2])
        .agg(
            F.count_if(F.col("what") == "devices").alias("devices"),
            F.coalesce(F.sum("unnamed"), F.lit(0)).alias("unnamed_devices"),
            F.count_if(F.col("what") == "alerts").alias("alerts_24h"),
            F.count_if(F.col("what") == "blocks").alias("blocks_24h"),
        )
    )


def alert_rates(alerts: DataFrame, unit: str = "hour") -> DataFrame:
    return alerts.groupBy(F.date_trunc(unit, "ts").alias("bucket"), "severity", "kind").agg(
        F.count("*").alias("n_alerts")
    )


def latest_feed(rows: DataFrame, limit: int | None = None, order: str = "arrival") -> DataFrame:
    """The live view: each (id, type) once, as last received, newest arrivals first."""
    last = keep_first(rows, ["id", "type"], [F.col(order).desc()]).orderBy(F.col(order).desc())
    return last if limit is None else last.limit(limit)
