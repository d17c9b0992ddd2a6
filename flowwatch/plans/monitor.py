"""The monitoring job: packets to features, alerts, devices and block decisions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from flowwatch.functions.severity import Thresholds
from flowwatch.operators import alerts as al
from flowwatch.operators.features import engineer
from flowwatch.operators.model import Model
from flowwatch.operators.signatures import Rule, default_rules, evaluate, rate_limited


@dataclass(frozen=True)
class Settings:
    local_ips: list[str] = field(default_factory=list)
    thresholds: Thresholds = Thresholds()
    rules: list[Rule] | None = None
    dedup_seconds: float | None = None


def signature_hits(packets: DataFrame, settings: Settings) -> DataFrame:
    rules = default_rules() if settings.rules is None else settings.rules
    hits = evaluate(engineer(packets, settings.local_ips), rules)
    return hits if settings.dedup_seconds is None else rate_limited(hits, settings.dedup_seconds)


def scored_anomalies(packets: DataFrame, model: Model, settings: Settings) -> DataFrame:
    return al.with_anomaly(model.with_score(engineer(packets, settings.local_ips)), settings.thresholds)


def all_alerts(packets: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """Anomaly and signature alerts of a packet table."""
    rows = engineer(packets, settings.local_ips)
    rules = default_rules() if settings.rules is None else settings.rules
    hits = evaluate(rows, rules)
    if settings.dedup_seconds is not None:
        hits = rate_limited(hits, settings.dedup_seconds)
    return al.anomaly_alerts(model.with_score(rows), settings.thresholds).unionByName(al.signature_alerts(hits))


def block_decisions(packets: DataFrame, model: Model, trusted: DataFrame, settings: Settings) -> DataFrame:
    return al.autoblock_decisions(scored_anomalies(packets, model, settings), settings.local_ips, trusted)
