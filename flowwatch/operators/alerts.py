"""Alert rows: from scores and signature hits, upserts, and normalized events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.functions.ips import is_ip, is_loopback
from flowwatch.functions.severity import Thresholds, severity_of
from flowwatch.functions.text import (
    anomaly_label,
    anomaly_line,
    label_score,
    label_text,
    signature_label,
    signature_line,
)
from flowwatch.operators.ordered import keep_first


def alert_id(*parts: Column) -> Column:
    """An id that is the same on every run."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def alert_rows(
    id: Column, ts: Column, src_ip: Column, label: Column, severity: Column, kind: Column
) -> list[Column]:
    """The six alert columns; an empty label falls back to the kind."""
    return [
        id.alias("id"),
        ts.alias("ts"),
        src_ip.alias("src_ip"),
        F.coalesce(F.nullif(label, F.lit("")), kind).alias("label"),
        severity.alias("severity"),
        kind.alias("kind"),
    ]


def with_anomaly(scored: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Rows scored below zero, with their severity."""
    return scored.filter(F.col("score") < 0).withColumn("severity", severity_of(F.col("score"), thresholds))


def anomaly_alerts(scored: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    return with_anomaly(scored, thresholds).select(
        *alert_rows(
            alert_id(F.col("sensor_id"), F.col("seq"), F.lit("anomaly")),
            F.date_trunc("second", F.timestamp_micros("ts_us")),
            F.col("src_ip"),
            anomaly_label(F.col("dest_ip"), F.col("dport"), F.col("score")),
            F.upper("severity"),
            F.lit("ANOMALY"),
        )
    )


def signature_alerts(hits: DataFrame) -> DataFrame:
    return hits.select(
        *alert_rows(
            alert_id(F.col("sensor_id"), F.col("seq"), F.col("rule")),
            F.date_trunc("second", F.timestamp_micros("ts_us")),
            F.col("src_ip"),
            signature_label(F.col("rule"), F.col("dest_ip"), F.col("dport")),
            F.upper("rule_severity"),
            F.lit("SIGNATURE"),
        )
    )


def anomaly_lines(anomalies: DataFrame) -> Column:
    return anomaly_line(
        F.col("ts_us"),
        F.col("src_ip"),
        F.col("dest_ip"),
        F.col("protocol"),
        F.col("packet_size"),
        F.col("dport"),
        F.col("is_ephemeral_sport"),
        F.col("unique_dports_15s"),
        F.col("direction"),
        F.col("score"),
        F.col("severity"),
    )


def signature_lines() -> Column:
    return signature_line(
        F.col("rule"), F.col("rule_severity"), F.col("src_ip"), F.col("dest_ip"), F.col("dport"), F.col("description")
    )


def upsert_by_id(current: DataFrame, changes: DataFrame, order: str = "batch") -> DataFrame:
    """Current rows with changes applied: per id, the change latest in ``order`` wins."""
    both = current.withColumn(order, F.lit(None).cast(changes.schema[order].dataType)).unionByName(changes)
    return keep_first(both, ["id"], [F.col(order).desc_nulls_last()]).drop(order)


def parsed_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("label_text", label_text(F.col(label))).withColumn("label_score", label_score(F.col(label)))


def _text(df: DataFrame, *names: str) -> Column:
    """First non-empty text among the columns that exist; '' if none."""
    found = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(""))


def normalize_events(events: DataFrame) -> DataFrame:
    """Feed or log rows as (id, ts, ip, type, detail, severity, score).

    Log rows of blocks carry their action as label, so the action is read from there when
    there is no action column value.
    """
    df = events
    ip = _text(df, "src_ip", "ip")
    kind, severity, label = _text(df, "kind"), _text(df, "severity"), _text(df, "label")
    type_ = _text(df, "type")
    action = F.coalesce(
        F.nullif(_text(df, "action"), F.lit("")), F.when(F.lower(kind) == "block", F.nullif(label, F.lit("")))
    )
    is_alert = (type_ == "alert") | kind.isin("ANOMALY", "SIGNATURE")
    is_block = (type_ == "block") | F.coalesce(action.isin("block", "unblock"), F.lit(False))
    shown = F.coalesce(F.nullif(label, F.lit("")), kind)
    other = F.coalesce(F.nullif(label, F.lit("")), _text(df, "detail"))
    return df.select(
        "id",
        "ts",
        ip.alias("ip"),
        F.when(is_alert, "alert")
        .when(is_block, F.when(action == "block", "block").otherwise("unblock"))
        .otherwise(F.coalesce(F.nullif(type_, F.lit("")), F.nullif(kind, F.lit("")), F.lit("event")))
        .alias("type"),
        F.when(is_alert, F.coalesce(F.nullif(label_text(shown), F.lit("")), kind))
        .when(is_block, F.coalesce(action, F.lit("")))
        .otherwise(label_text(other))
        .alias("detail"),
        severity.alias("severity"),
        F.when(is_alert, label_score(shown)).when(~is_block, label_score(other)).alias("score"),
    )


def autoblock_decisions(
    anomalies: DataFrame, local_ips: list[str], trusted: DataFrame, already: DataFrame | None = None
) -> DataFrame:
    """The block rows that high-severity anomalies call for, one per source, at its first one."""
    src = F.trim("src_ip")
    wanted = (
        anomalies.filter(F.lower("severity") == "high")
        .select(src.alias("ip"), "sensor_id", "ts_us", "seq")
        .filter((F.col("ip") != "") & ~F.col("ip").isin(list(local_ips)))
    )
    # One row per source before anything is checked or joined.
    first = wanted.groupBy("ip").agg(F.min(F.struct("ts_us", "seq", "sensor_id")).alias("first"))
    allowed = first.filter(is_ip(F.col("ip")) & ~is_loopback(F.col("ip"))).join(
        trusted.select("ip"), "ip", "left_anti"
    )
    if already is not None:
        allowed = allowed.join(already.select("ip"), "ip", "left_anti")
    return allowed.select(
        alert_id(F.col("first.sensor_id"), F.col("first.seq"), F.lit("autoblock")).alias("id"),
        F.date_trunc("second", F.timestamp_micros("first.ts_us")).alias("ts"),
        "ip",
        F.lit("block").alias("action"),
        F.lit("auto-high").alias("reason"),
        F.lit(None).cast("timestamp").alias("expires_at"),
    )
