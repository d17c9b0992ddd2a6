"""Signature rules: named boolean expressions over engineered packets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowwatch.functions.ports import SENSITIVE_PORTS
from flowwatch.operators.features import zero_filled
from flowwatch.operators.ordered import keep_first

# Rule names, severities and descriptions.
PORT_SCAN = (
    "port-scan-suspected",
    "high",
    "Source contacted many unique destination ports over a short window.",
)
SENSITIVE_PORT = (
    "inbound-sensitive-port",
    "medium",
    "Inbound traffic to a sensitive service port.",
)


# Functions that end a job whatever the mode, and have no form that gives NULL instead.
_RAISING = ("raise_error", "assert_true")


def _matching(fn: Callable[[pd.DataFrame], pd.Series], batch: pd.DataFrame) -> np.ndarray:
    """Where the function holds. Parts on which it raises are tried again by halves."""
    out = np.zeros(len(batch), dtype=bool)
    parts = [(0, len(batch))] if len(batch) else []
    while parts:
        low, high = parts.pop()
        try:
            found = pd.Series(fn(batch.iloc[low:high].reset_index(drop=True)))
            if len(found) != high - low:
                raise ValueError("a rule returns one value for each row")
            out[low:high] = found.where(found.notna(), False).astype(bool).to_numpy()
        except Exception:
            if high - low > 1:
                mid = (low + high) // 2
                parts += [(low, mid), (mid, high)]
    return out


@contextmanager
def _lenient(spark: SparkSession) -> Iterator[None]:
    """While a plan is built here, arithmetic, casts and element access give NULL where they would fail.

    Expressions take the mode of the moment they are resolved, so the plan keeps it later on.
    """
    name = "spark.sql.ansi.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass(frozen=True)
class Rule:
    """A predicate with a name. ``context`` adds window columns the predicate needs."""

    name: str
    severity: str
    description: str
    predicate: Column
    context: dict[str, Column] = field(default_factory=dict)

    @classmethod
    def from_function(
        cls, name: str, severity: str, description: str, fn: Callable[[pd.DataFrame], pd.Series], columns: list[str]
    ) -> "Rule":
        """A rule from a Python function of whole columns: it gets a frame of them and returns a boolean for each row.

        A row on which the function raises does not match. Only a batch on which it raises is cut
        in halves, down to the rows that make it raise.
        """

        @F.pandas_udf("boolean")
        def matches(batch: pd.DataFrame) -> pd.Series:
            return pd.Series(_matching(fn, batch), dtype="bool")

        return cls(name, severity, description, matches(F.struct(*columns)))


def port_scan_rule(threshold: float = 10.0) -> Rule:
    return Rule(*PORT_SCAN, zero_filled(F.col("unique_dports_15s")) >= threshold)


def sensitive_port_rule(ports: list[int] = SENSITIVE_PORTS) -> Rule:
    inbound = zero_filled(F.col("direction")).cast("int") == 0
    return Rule(*SENSITIVE_PORT, inbound & F.coalesce(F.col("dport"), F.lit(0)).cast("int").isin(list(ports)))


def default_rules(threshold: float = 10.0, ports: list[int] = SENSITIVE_PORTS, enabled: bool = True) -> list[Rule]:
    return [port_scan_rule(threshold), sensitive_port_rule(ports)] if enabled else []


def evaluate(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """One output row per packet and matching rule, in rule order.

    Columns ``rule_no, rule, rule_severity, description`` are added. A predicate that is
    NULL does not match, nor does one that cannot be computed on a row, such as a division by zero or a bad cast: it
    is resolved in the mode that gives NULL for these. A rule that calls a function made to end the job is refused
    before anything runs.
    """
    for rule in rules:
        for column in (rule.predicate, *rule.context.values()):
            raising = [f for f in _RAISING if f"{f}(" in str(column)]
            if raising:
                raise ValueError(f"rule {rule.name} would end the job on some rows: {raising[0]}")
    with _lenient(rows.sparkSession):
        return _evaluated(rows, rules)


def _evaluated(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    for column in ("unique_dports_15s", "direction", "dport"):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(0.0))
    for rule in rules:
        rows = rows.withColumns(dict(rule.context))
    hit_type = "array<struct<rule_no:int,rule:string,rule_severity:string,description:string>>"
    hits = [
        F.when(
            F.coalesce(r.predicate, F.lit(False)),
            F.struct(
                F.lit(i).alias("rule_no"),
                F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("rule_severity"),
                F.lit(r.description).alias("description"),
            ),
        )
        for i, r in enumerate(rules)
    ]
    # With no rules this is a typed empty array, so the result is empty with the right schema.
    found = F.array_compact(F.array(*hits)).cast(hit_type) if hits else F.array().cast(hit_type)
    return rows.select("*", F.inline(found))


def _spaced(seconds: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by key and second; a key may go on over batch borders.
        key, last = None, None
        for batch in batches:
            if batch.empty:
                continue
            keep = np.zeros(len(batch), dtype=bool)
            keys = batch[["rule", "src_ip", "dest_ip"]].to_numpy()
            start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            second = batch["second"].to_numpy()
            for lo, hi in zip(start, np.r_[start[1:], len(batch)]):
                here = tuple(keys[lo])
                if here != key:
                    key, last = here, None
                i = lo if last is None else lo + np.searchsorted(second[lo:hi], last + seconds)
                while i < hi:
                    keep[i], last = True, second[i]
                    i = lo + np.searchsorted(second[lo:hi], last + seconds)
            yield batch[keep]

    return run


def rate_limited(hits: DataFrame, seconds: float = 5.0) -> DataFrame:
    """At most one hit per (rule, source, destination) within ``seconds`` of the last one
    let through.

    Alert times have a resolution of one second, so a key's hits first shrink to the
    earliest of each second, on the map side. What is left per key is bounded by the time
    the data spans and is read as a sorted stream, never held as a group.
    """
    keys = ["rule", "src_ip", "dest_ip"]
    rest = ["ts_us", "seq", "sensor_id", "dport", "rule_severity", "description"]
    seconds_of = hits.withColumn("second", F.expr("ts_us div 1000000")).select(*keys, "second", *rest)
    per_second = keep_first(seconds_of, [*keys, "second"], [F.col(c) for c in rest])
    return (
        per_second.repartition(*keys)
        .sortWithinPartitions(*keys, "second")
        .mapInPandas(_spaced(float(seconds)), per_second.schema)
    )
