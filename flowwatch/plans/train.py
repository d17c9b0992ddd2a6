"""Training jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.operators.features import engineer, with_arrival_index
from flowwatch.operators.model import Model, Params, fit

MIN_RETRAIN_ROWS = 50


def train_on_packets(
    packets: DataFrame, local_ips: list[str], params: Params = Params(), mode: str = "per_event", **fit_args
) -> Model:
    """Packets to a fitted model. Empty input raises."""
    return fit(engineer(packets, local_ips, mode=mode), params, **fit_args)


def newest_window(rolling: DataFrame, span_us: int | None = None) -> DataFrame:
    """Each sensor's engineered packets of the last ``span_us`` of its own clock; by default all."""
    if span_us is None:
        return rolling
    newest = rolling.groupBy("sensor_id").agg(F.max("ts_us").alias("_newest"))
    return rolling.join(newest, "sensor_id").filter(F.col("ts_us") > F.col("_newest") - span_us).drop("_newest")


def retrain(rolling: DataFrame, params: Params = Params(), span_us: int | None = None, **fit_args) -> Model | None:
    """A model of the newest window, or None while the window is too small."""
    window = newest_window(rolling, span_us)
    if window.count() < MIN_RETRAIN_ROWS:
        return None
    return fit(window, params, **fit_args)


def due(before: Column, now: Column, every: int) -> Column:
    """Whether a sensor's count of packets passes a multiple of ``every`` on the way from ``before`` to ``now``."""
    return F.floor(now / every) > F.floor(before / every)


def retrain_points(packets: DataFrame, every: int, window_rows: int) -> DataFrame:
    """Packets of each sensor after which an online retrain over its last rows falls due."""
    filled = F.least(F.col("arrival_index"), F.lit(window_rows))
    return with_arrival_index(packets).filter(
        due(F.col("arrival_index") - 1, F.col("arrival_index"), every) & (filled >= MIN_RETRAIN_ROWS)
    ).select("sensor_id", "seq", "arrival_index", filled.alias("window_rows"))
