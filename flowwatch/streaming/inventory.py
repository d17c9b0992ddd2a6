"""Devices and blocked sources of a live system, kept as state per address.

Both write what a micro-batch brought and nothing else: the devices that were seen, and the blocks that are new.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from flowwatch.functions.ips import is_ip
from flowwatch.schemas import BLOCK, DEVICE
from flowwatch.session import state_by_core, use_rocksdb
from flowwatch.streaming import versions

_SEEN = StructType([f for f in DEVICE.fields if f.name in ("ip", "first_seen", "last_seen")])
_CANDIDATE = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BLOCK.fields)


def device_changes(packets: DataFrame) -> DataFrame:
    """Every valid address of a packet stream with first and last time, in update mode: each micro-batch gives the addresses that it saw."""
    use_rocksdb(packets.sparkSession)
    seen = packets.select("ts_us", F.explode(F.array("src_ip", "dest_ip")).alias("ip")).filter("ip <> ''")
    times = seen.groupBy("ip").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    return times.filter(is_ip(F.col("ip"))).select(
        "ip", F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen")
    )


def start_devices(packets: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the changed devices of each micro-batch under ``out``/devices."""

    def write(changed: DataFrame, batch_id: int) -> None:
        versions.add(changed, f"{out}/devices", batch_id)

    writer = device_changes(packets).writeStream.outputMode("update").foreachBatch(write)
    with state_by_core(packets.sparkSession):
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def devices(spark: SparkSession, out: str, names: DataFrame | None = None) -> DataFrame:
    """The devices from all changes. ``names``: (ip, seq, ts, name); the last that is not empty counts."""
    changes = spark.read.schema(_SEEN).parquet(f"{out}/devices")
    known = changes.groupBy("ip").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    if names is None:
        return known.withColumn("name", F.lit(""))
    given = names.filter(F.coalesce("name", F.lit("")) != "").groupBy("ip").agg(F.max_by("name", F.struct("ts", "seq")).alias("name"))
    return known.join(given, "ip", "left").withColumn("name", F.coalesce("name", F.lit("")))


class _Once(StatefulProcessor):
    """Passes the first row of an address and remembers that it did."""

    columns = BLOCK.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known, first = self.done.exists(), None
        for b in rows:
            if not known:
                both = b if first is None else pd.concat([first, b])
                first = both.sort_values(["ts", "id"]).head(1)
        if first is not None:
            self.done.update((True,))
            yield first[self.columns]

    def close(self) -> None:
        pass


def first_blocks(candidates: DataFrame) -> DataFrame:
    """Of a stream of block rows the first of each address over the life of the stream."""
    use_rocksdb(candidates.sparkSession)
    rows = candidates.select(*BLOCK.fieldNames())
    return rows.groupBy("ip").transformWithStateInPandas(_Once(), _CANDIDATE, "append", "None")


def start_blocks(spark: SparkSession, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends to ``out``/blocks each source that the monitor's candidates name for the first time."""
    candidates = spark.readStream.schema(BLOCK).option("ignoreMissingFiles", True).parquet(f"{out}/candidates/batch=*")
    writer = first_blocks(candidates).writeStream.format("parquet").option("path", f"{out}/blocks").outputMode("append")
    with state_by_core(spark):
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
