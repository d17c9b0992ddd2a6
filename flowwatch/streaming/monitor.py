"""The live monitor: packets in, engineered rows, hits, alerts and candidates for blocks out.

Each micro-batch runs the batch operators over its packets and a short tail of earlier ones,
so a source that dominates the traffic is split here as it is in batch, and stream and
batch results are equal for packets that arrive in time order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from flowwatch.operators import alerts as al, signatures as sg
from flowwatch.operators.features import HORIZON_US, engineer
from flowwatch.operators.model import Model, load, save
from flowwatch.plans.monitor import Settings
from flowwatch.plans.train import due, retrain
from flowwatch.schemas import ALERT, BLOCK, PACKET
from flowwatch.streaming import versions

_COUNT = StructType([StructField("sensor_id", StringType()), StructField("packets", LongType()), StructField("newest", LongType())])


def rolling_schema(rows: StructType) -> StructType:
    """The rolling table's columns from those of engineered rows."""
    return StructType([*rows.fields, StructField("event_date", DateType()), StructField("batch", LongType())])


@dataclass
class Monitor:
    """A ``foreachBatch`` function. Results are tables under ``out``:

    ``rolling`` by date and micro-batch, ``hits``, ``anomalies``, ``alerts`` and ``candidates`` by micro-batch.
    Rolling rows hold the packets, so there is no other copy of them. Candidates are the sources that a micro-batch would
    block, given who is trusted then; ``inventory`` blocks each once.
    ``lateness_us`` is how much longer than the horizon earlier packets are kept for late ones.
    ``model`` scores until the first retrain; retrained bundles are under ``models``, and each
    micro-batch takes the newest that an earlier one left, so a restart or a repeated batch scores
    as the first run did. Retraining reads the last ``window_us`` of the rolling table, by default all.
    """

    out: str
    settings: Settings
    model: Model | None = None
    trusted: Callable[[], DataFrame] | None = None
    lateness_us: int = 0
    retrain_every: int = 0
    window_us: int | None = None

    def features(self, packets: DataFrame, batch_id: int) -> DataFrame:
        """Engineered rows of this micro-batch's packets."""
        spark = packets.sparkSession
        tail = versions.before(spark, f"{self.out}/tail", batch_id, PACKET)
        both = tail.withColumn("_new", F.lit(False)).unionByName(packets.withColumn("_new", F.lit(True)))
        rows = engineer(both, self.settings.local_ips).filter("_new").drop("_new")
        done = versions.add_dated(rows, f"{self.out}/rolling", batch_id, F.to_date(F.timestamp_micros("ts_us")))

        whole = tail.unionByName(done.select(*PACKET.fieldNames()))
        newest = whole.groupBy("sensor_id").agg(F.max("ts_us").alias("_newest"))
        kept = whole.join(newest, "sensor_id").filter(
            F.col("ts_us") >= F.col("_newest") - (HORIZON_US + self.lateness_us)
        )
        versions.leave(kept.select(*PACKET.fieldNames()), f"{self.out}/tail", batch_id)
        return done

    def hits(self, rows: DataFrame, batch_id: int) -> DataFrame:
        rules = sg.default_rules() if self.settings.rules is None else self.settings.rules
        hits = versions.add(sg.evaluate(rows, rules), f"{self.out}/hits", batch_id)
        if self.settings.dedup_seconds is None:
            return hits
        # The last hit let through of each key takes part again, as the row that holds back
        # its followers, and is taken out of the result.
        columns = ["rule", "src_ip", "dest_ip", "ts_us", "seq", "sensor_id", "dport", "rule_severity", "description"]
        thin = hits.select(*columns)
        path = f"{self.out}/limits"
        carried = versions.before(rows.sparkSession, path, batch_id, thin.schema)
        both = carried.withColumn("_old", F.lit(True)).unionByName(thin.withColumn("_old", F.lit(False)))
        passed = sg.rate_limited(both.select(*columns), self.settings.dedup_seconds).select(*columns)
        newest = Window.partitionBy("rule", "src_ip", "dest_ip").orderBy(F.col("ts_us").desc(), F.col("seq").desc())
        ranked = passed.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1")
        # A hit older than the limit holds nothing back any more.
        reach = int(self.settings.dedup_seconds * 1e6) + 1_000_000 + self.lateness_us
        clock = rows.groupBy("sensor_id").agg((F.max("ts_us") - reach).alias("_recent"))
        # A sensor that is silent now keeps its hits: its own clock has not moved on.
        kept = ranked.join(clock, "sensor_id", "left").filter(F.col("_recent").isNull() | (F.col("ts_us") >= F.col("_recent")))
        versions.leave(kept.select(*columns), path, batch_id)
        return passed.join(carried.select("sensor_id", "seq", "rule"), ["sensor_id", "seq", "rule"], "left_anti")

    def __call__(self, packets: DataFrame, batch_id: int) -> None:
        spark = packets.sparkSession
        rows = self.features(packets.select(*PACKET.fieldNames()), batch_id)

        alerts = al.signature_alerts(self.hits(rows, batch_id))
        anomalies = None
        model = self.model_before(spark, batch_id)
        if model is not None:
            anomalies = versions.add(
                al.with_anomaly(model.with_score(rows), self.settings.thresholds),
                f"{self.out}/anomalies",
                batch_id,
            )
            alerts = alerts.unionByName(al.anomaly_alerts(anomalies, self.settings.thresholds))
        versions.add(alerts.select(*ALERT.fieldNames()), f"{self.out}/alerts", batch_id)

        if anomalies is not None:
            trusted = self.trusted() if self.trusted else spark.createDataFrame([], "ip string")
            wanted = al.autoblock_decisions(anomalies, self.settings.local_ips, trusted)
            versions.add(wanted.select(*BLOCK.fieldNames()), f"{self.out}/candidates", batch_id)
        if self.retrain_every > 0:
            self.retrain(rows, batch_id, model)

    def model_before(self, spark: SparkSession, batch_id: int) -> Model | None:
        """The model that the micro-batches before this one have left."""
        last = versions.latest(spark, f"{self.out}/models", "batch", batch_id, "meta/_SUCCESS")
        return self.model if last is None else load(spark, f"{self.out}/models/batch={last}")

    def retrain(self, rows: DataFrame, batch_id: int, model: Model | None) -> None:
        """A new model when a sensor's packets pass a multiple of the interval, as in ``retrain_points``."""
        spark = rows.sparkSession
        counts = versions.before(spark, f"{self.out}/counts", batch_id, _COUNT)
        # One row per sensor.
        now = rows.groupBy("sensor_id").agg(F.count("*").alias("packets"), F.max("ts_us").alias("newest"))
        both = counts.withColumn("before", F.col("packets")).unionByName(now.withColumn("before", F.lit(0).cast("long")))
        total = both.groupBy("sensor_id").agg(F.sum("packets").alias("packets"), F.max("newest").alias("newest"), F.sum("before").alias("before"))
        total = versions.leave(total, f"{self.out}/counts", batch_id)
        if model is not None and not total.filter(due(F.col("before"), F.col("packets"), self.retrain_every)).isEmpty():
            rolling = spark.read.schema(rolling_schema(rows.schema)).parquet(f"{self.out}/rolling").filter(F.col("batch") <= batch_id)
            if self.window_us is not None:
                # Only the dates that a sensor's window can reach are listed and read.
                oldest = total.agg((F.min("newest") - self.window_us).alias("at")).first()["at"]
                rolling = rolling.filter(F.col("event_date") >= F.to_date(F.timestamp_micros(F.lit(oldest))))
            fresh = retrain(rolling, model.params, self.window_us)
            if fresh is not None:
                save(fresh, spark, f"{self.out}/models/batch={batch_id}")


def start_monitor(packets: DataFrame, monitor: Monitor, checkpoint: str, **trigger) -> StreamingQuery:
    trigger = trigger or {"availableNow": True}
    return (
        packets.writeStream.foreachBatch(monitor).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
