"""Live feeds: merged events, the newest-rows view, and windowed scan summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from flowwatch.operators.logs import latest_feed
from flowwatch.streaming import versions


def event_feed(alerts: DataFrame, blocks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Alert and block streams as (event, id, ts, payload), each id once.

    Duplicates are recognised within the watermark delay, which bounds the state.
    """

    def events(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(
            F.lit(name).alias("event"), "id", "ts", F.to_json(F.struct(*rows.columns)).alias("payload")
        )

    both = events(alerts, "alert").unionByName(events(blocks, "block"))
    return both.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event", "id"])


def latest_view(path: str, schema: StructType, limit: int):
    """A ``foreachBatch`` function that keeps the newest ``limit`` rows by (id, type).

    Rows need an ``arrival`` column. Each micro-batch leaves a version of the view.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        before = versions.before(batch.sparkSession, path, batch_id, schema)
        versions.leave(latest_feed(before.unionByName(batch.select(*schema.fieldNames())), limit), path, batch_id)

    return update


def scan_summary(packets: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """Distinct ports and packets per source in sliding 15 second windows, on a packet stream, exact.

    Two counts in a row: packets of each (window, source, port), then ports and packets of each (window,
    source). The first is combined before its exchange, so a busy source reaches its state as one row per
    port and task. A window is given out once, when the watermark has passed its end.
    """
    timed = packets.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)
    ports = timed.groupBy(F.window("event_time", "15 seconds", "5 seconds"), "src_ip", "dport").agg(F.count("*").alias("n"))
    counted = ports.groupBy("window", "src_ip").agg(F.count("dport").alias("unique_dports"), F.sum("n").alias("packets"))
    return counted.select(F.col("window.start").alias("window_start"), "src_ip", "unique_dports", "packets")
