"""Streams with a little state per key: signature limits, login lockout, ban expiry.

Limits and bans keep a few numbers per key in the state store, and event-time timers take them out
when they cannot matter any more: when the limit has passed, or the ban has ended and no row that is not late could
be older. Before rows are dealt by key each task drops those that others of the same second, or the same time, make
irrelevant; what is left of a key in a micro-batch is read batch by batch.

The order of logins matters row by row, so the lockout runs the batch fold on each micro-batch, cut and
composed as there, from the states that earlier ones have left. Users that have no failures and no lock are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from flowwatch.operators.lockout import LOCK_AFTER, LOCK_MINUTES, lockout_onward
from flowwatch.session import Scratch, use_rocksdb
from flowwatch.streaming import versions

_HIT = "rule string, src_ip string, dest_ip string, second bigint, ts_us bigint, seq bigint"


def _first_per_second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ordered = b.sort_values(["ts_us", "seq"])
        yield ordered.drop_duplicates(["rule", "src_ip", "dest_ip", "second"])


class _Timed(StatefulProcessor):
    """A processor with one timer per key, whose time follows from the state, so that timers need not be listed."""

    handle: StatefulProcessorHandle

    def set_timer(self, old_ms: int | None, at_ms: int) -> None:
        if old_ms == at_ms:
            return
        if old_ms is not None:
            self.handle.deleteTimer(old_ms)
        self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


class _Limit(_Timed):
    """Keeps the second of the last hit let through until the limit has passed."""

    columns = ["rule", "src_ip", "dest_ip", "second", "ts_us", "seq"]

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "second bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        last = before = None if held is None else held[0]
        best: dict[int, tuple[int, int]] = {}
        for b in rows:
            for second, ts, seq in zip(b["second"].tolist(), b["ts_us"].tolist(), b["seq"].tolist()):
                if second not in best or (ts, seq) < best[second]:
                    best[second] = (ts, seq)
        out = []
        for second in sorted(best):
            if last is None or second >= last + self.seconds:
                last = second
                out.append((*key, second, *best[second]))
        if out:
            self.last.update((last,))
            self.set_timer(None if before is None else self.over(before), self.over(last))
            yield pd.DataFrame(out, columns=self.columns)

    def over(self, second: int) -> int:
        return int((second + self.seconds) * 1000) + 1

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()


def limit_hits(hits: DataFrame, seconds: float = 5.0, delay: str = "0 seconds") -> DataFrame:
    """At most one hit per (rule, source, destination) within ``seconds`` of the last one
    let through. Each task first drops all but the earliest hit of a second, so a hot key
    reaches its state as few rows. Hits that come ``delay`` behind the newest one are late and dropped."""
    use_rocksdb(hits.sparkSession)
    thin = hits.withColumn("second", F.expr("ts_us div 1000000")).select(
        "rule", "src_ip", "dest_ip", "second", "ts_us", "seq"
    )
    timed = thin.mapInPandas(_first_per_second, _HIT).withColumn("event_time", F.timestamp_micros("ts_us"))
    return (
        timed.withWatermark("event_time", delay)
        .groupBy("rule", "src_ip", "dest_ip")
        .transformWithStateInPandas(_Limit(float(seconds)), _HIT, "append", "EventTime")
    )


_STATE = StructType([StructField("key", StringType()), StructField("state", IntegerType()), StructField("until", LongType())])
_CLOCK = StructType([StructField("tick", LongType())])


@dataclass
class Lockout:
    """A ``foreachBatch`` function over login attempts (username, seq, ts, ok).

    Verdicts, as of ``login_verdicts``, are under ``out``/verdicts by micro-batch, the failures and locks that hold after it
    under ``out``/state as versions. Rows of a micro-batch are taken in (ts, seq) order, micro-batches in that of
    arrival. A lock is kept until ``lateness`` seconds after its end.
    """

    out: str
    lock_after: int = LOCK_AFTER
    lock_minutes: float = LOCK_MINUTES
    lateness: int = 0

    def __call__(self, logins: DataFrame, batch_id: int) -> None:
        spark = logins.sparkSession
        carried = versions.before(spark, f"{self.out}/state", batch_id, _STATE)
        clock = versions.before(spark, f"{self.out}/clock", batch_id, _CLOCK)
        now = clock.unionByName(logins.select(F.unix_seconds("ts").alias("tick"))).agg(F.max("tick").alias("tick"))
        now = versions.leave(now, f"{self.out}/clock", batch_id)
        tick = now.first()["tick"]
        over = F.lit(False) if tick is None else (F.col("state") == self.lock_after) & (F.col("until") + self.lateness <= tick)
        with Scratch(spark) as scratch:
            verdicts, left = lockout_onward(logins, carried, scratch, self.lock_after, self.lock_minutes)
            versions.add(verdicts.select("username", "seq", "verdict"), f"{self.out}/verdicts", batch_id)
            versions.leave(left.filter((F.col("state") != 0) & ~over), f"{self.out}/state", batch_id)


def start_lockout(logins: DataFrame, lockout: Lockout, checkpoint: str, **trigger) -> StreamingQuery:
    trigger = trigger or {"availableNow": True}
    return logins.writeStream.foreachBatch(lockout).option("checkpointLocation", checkpoint).trigger(**trigger).start()


_BAN = "ip string, ts timestamp, us bigint, id string, ends bigint"


def _last_of_a_time(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.sort_values("id").drop_duplicates(["ip", "us"], keep="last")


class _Bans(_Timed):
    """Keeps the newest row of an address and the end of its ban until both lie behind the watermark.

    It takes and gives rows: an address has few of them, for which a frame of its own would cost more than the rest.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ban = handle.getValueState("ban", "newest bigint, last_id string, ends bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.ban.get()
        newest, last_id, ends = (-(1 << 62), "", 0) if held is None else held
        came: dict[int, tuple[str, int]] = {}
        for r in rows:
            if r.us not in came or r.id > came[r.us][0]:
                came[r.us] = (r.id, r.ends)
        for us in sorted(came):
            row_id, end = came[us]
            if (us, row_id) < (newest, last_id):
                continue
            if 0 < ends < us:
                yield Row(ip=key[0], ended=ends)
            newest, last_id, ends = us, row_id, end
        if held is None or (newest, last_id, ends) != tuple(held):
            self.ban.update((newest, last_id, ends))
            self.set_timer(None if held is None else self.over(held[0], held[2]), self.over(newest, ends))

    def over(self, newest: int, ends: int) -> int:
        # A ban ends after its last second.
        return max(ends, newest) // 1000 + 1

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.ban.get()
        self.ban.clear()
        if held is not None and held[2] > 0:
            yield Row(ip=key[0], ended=held[2])


def ban_expiry_stream(blocks: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """An unblock row for each temporary ban that reached its end, at that end.

    ``blocks`` has (ip, ts, id, action, expires_at). The ban in force is that of the latest row by
    (ts, id), whatever micro-batch brought it. A later block or unblock of the address
    replaces it, if it comes before the end; otherwise the ban has ended by then. A ban whose end no later
    row shows ends by a timer, once event time has passed it. A row that comes after a newer one
    of its address changes nothing.
    """
    use_rocksdb(blocks.sparkSession)
    ends = F.when((F.col("action") == "block") & F.col("expires_at").isNotNull(), F.unix_micros("expires_at")).otherwise(F.lit(0))
    rows = blocks.select("ip", "ts", F.unix_micros("ts").alias("us"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.coalesce(ends, F.lit(0)).cast("bigint").alias("ends"))
    thin = rows.mapInPandas(_last_of_a_time, _BAN).withWatermark("ts", delay)
    ended = thin.groupBy("ip").transformWithState(_Bans(), "ip string, ended bigint", "append", "EventTime")
    return ended.select("ip", F.timestamp_micros("ended").alias("ts"), F.lit("unblock").alias("action"), F.lit("auto-expired").alias("reason"))
