"""Each stream, fed in small time-ordered files, equals its batch query."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import Row, functions as F

from flowwatch.operators import containment as ct, devices as dv, features as ft, lockout as lk, logs as lg, model as md, signatures as sg
from flowwatch.plans import registry
from flowwatch.plans.monitor import Settings
from flowwatch.schemas import BLOCK, PACKET
from flowwatch.sources import fixtures as fx
from flowwatch.sources.packets import read_packet_stream
from flowwatch.streaming import feeds, inventory, keyed, versions
from flowwatch.streaming.inventory import start_blocks, start_devices
from flowwatch.streaming.monitor import Monitor, start_monitor


def in_files(df, order, folder, parts=4):
    """Rows as parquet files in time order, with rising file times."""
    folder.mkdir()
    pdf = df.orderBy(order).toPandas()
    size = -(-len(pdf) // parts)
    for i in range(parts):
        part = folder / f"part-{i}.parquet"
        df.sparkSession.createDataFrame(pdf.iloc[i * size : (i + 1) * size], df.schema).toPandas().to_parquet(
            part, coerce_timestamps="us", allow_truncated_timestamps=True
        )
        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_memory(df, name, checkpoint, mode="append"):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    )
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def monitored(spark, packets, tmp_path_factory):
    base = tmp_path_factory.mktemp("monitor")
    path = in_files(packets, "ts_us", base / "in")
    monitor = Monitor(
        out=str(base / "out"),
        settings=Settings(local_ips=fx.LOCAL_IPS, dedup_seconds=5.0),
        model=registry._fixed_model(),
        retrain_every=400,
    )
    q = start_monitor(read_packet_stream(spark, path, max_files=1), monitor, str(base / "check"))
    q.awaitTermination(600)
    assert q.exception() is None
    for _ in range(2):  # the second run finds nothing new
        start_blocks(spark, str(base / "out"), str(base / "blocks"), availableNow=True).awaitTermination(300)
    return spark, str(base / "out")


def test_live_features_equal_batch(monitored, packets):
    spark, out = monitored
    cols = ["seq", "time_diff", "unique_dports_15s", "direction"]
    got = spark.read.parquet(f"{out}/rolling").select(*cols)
    assert rows(got) == rows(ft.engineer(packets, fx.LOCAL_IPS).select(*cols))


def test_live_alerts_equal_batch(monitored, packets):
    spark, out = monitored
    engineered = ft.engineer(packets, fx.LOCAL_IPS)
    hits = sg.rate_limited(sg.evaluate(engineered, sg.default_rules()), 5.0)
    want = registry.al.signature_alerts(hits).unionByName(
        registry.al.anomaly_alerts(registry._fixed_model().with_score(engineered))
    )
    got = spark.read.parquet(f"{out}/alerts").drop("batch")
    # The stream's later batches score with retrained models, so only signatures must agree.
    assert rows(got.filter("kind = 'SIGNATURE'")) == rows(want.filter("kind = 'SIGNATURE'"))


def test_live_devices_equal_batch(spark, packets, tmp_path):
    path, out = in_files(packets, "ts_us", tmp_path / "in"), str(tmp_path / "out")
    source = read_packet_stream(spark, path, max_files=1)
    start_devices(source, out, str(tmp_path / "c")).awaitTermination(300)
    assert rows(inventory.devices(spark, out)) == rows(dv.device_inventory(packets))
    # A micro-batch of one packet writes its two devices, one without news writes none.
    one = packets.orderBy(F.col("ts_us").desc()).limit(1)
    one.withColumns({"ts_us": F.col("ts_us") + 5, "src_ip": F.lit("8.8.8.8"), "dest_ip": F.lit("10.0.0.2")}).toPandas().to_parquet(f"{path}/later.parquet")
    for _ in range(2):
        start_devices(source, out, str(tmp_path / "c")).awaitTermination(300)
    changed = spark.read.parquet(f"{out}/devices").filter("batch > 3")
    assert sorted(r["ip"] for r in changed.collect()) == ["10.0.0.2", "8.8.8.8"]
    known = {r["ip"]: r for r in inventory.devices(spark, out).collect()}
    before = {r["ip"]: r for r in dv.device_inventory(packets).collect()}
    assert known["10.0.0.2"]["first_seen"] == before["10.0.0.2"]["first_seen"] < known["8.8.8.8"]["first_seen"] == known["10.0.0.2"]["last_seen"]


def test_blocks_are_appended_once_for_each_source(spark, tmp_path):
    out = str(tmp_path / "out")
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    block = lambda i, s, ip: (i, at(s), ip, "block", "auto-high", None)
    came = [[block("a2", 5, "a"), block("a1", 3, "a"), block("b", 4, "b")], [block("c", 6, "c"), block("a3", 1, "a")], []]
    for i, rows_ in enumerate(came):
        versions.add(spark.createDataFrame(rows_, BLOCK).repartition(3), f"{out}/candidates", i)
        start_blocks(spark, out, str(tmp_path / "c")).awaitTermination(300)
    blocks = spark.read.schema(BLOCK).parquet(f"{out}/blocks")
    assert sorted(r["id"] for r in blocks.collect()) == ["a1", "b", "c"]


def test_live_blocks_are_unique(monitored):
    spark, out = monitored
    blocks = spark.read.schema(BLOCK).parquet(f"{out}/blocks")
    candidates = spark.read.schema(BLOCK).parquet(f"{out}/candidates/batch=*")
    assert blocks.count() == blocks.select("ip").distinct().count()
    assert {r["ip"] for r in candidates.collect()} == {r["ip"] for r in blocks.collect()}


def test_packets_are_kept_once(monitored, packets):
    spark, out = monitored
    assert "packets" not in os.listdir(out)
    rolling = spark.read.parquet(f"{out}/rolling")
    assert rolling.count() == packets.count() and {"event_date", "batch"} < set(rolling.columns)


def test_retraining_reads_the_dates_of_its_window(spark, packets, tmp_path):
    spread = packets.withColumn("ts_us", F.col("ts_us") + (F.col("seq") % 2) * 5 * 86_400_000_000)
    path = in_files(spread, "ts_us", tmp_path / "in", parts=2)
    monitor = Monitor(str(tmp_path / "out"), Settings(local_ips=fx.LOCAL_IPS), registry._fixed_model(), retrain_every=100, window_us=86_400_000_000)
    start_monitor(read_packet_stream(spark, path, max_files=1), monitor, str(tmp_path / "c")).awaitTermination(600)
    assert len([d for d in os.listdir(tmp_path / "out" / "rolling") if d.startswith("event_date")]) == 2
    late = spread.filter("seq % 2 = 1").count()
    assert md.load(spark, f"{tmp_path}/out/models/batch=1").subsample == min(256, late)


def test_retrain_leaves_models(monitored):
    _, out = monitored
    # 250 packets a file: the counts 500 and 1000 pass multiples of 400 at the 2nd and 4th.
    assert sorted(os.listdir(f"{out}/models")) == ["batch=1", "batch=3"]


def test_a_restarted_monitor_goes_on_with_the_retrained_model(monitored, packets, tmp_path):
    spark, whole = monitored
    path = in_files(packets, "ts_us", tmp_path / "in")
    later = tmp_path / "later"
    later.mkdir()
    for i in (2, 3):
        os.rename(f"{path}/part-{i}.parquet", later / f"part-{i}.parquet")
    for _ in range(2):
        monitor = Monitor(
            out=str(tmp_path / "out"),
            settings=Settings(local_ips=fx.LOCAL_IPS, dedup_seconds=5.0),
            model=registry._fixed_model(),
            retrain_every=400,
        )
        q = start_monitor(read_packet_stream(spark, path, max_files=1), monitor, str(tmp_path / "check"))
        q.awaitTermination(600)
        for name in os.listdir(later):
            os.rename(later / name, f"{path}/{name}")
    a, b = (spark.read.parquet(f"{out}/alerts").drop("batch") for out in (whole, tmp_path / "out"))
    assert rows(a) == rows(b)


def test_limit_hits(spark, packets, tmp_path):
    hits = sg.evaluate(ft.engineer(packets, fx.LOCAL_IPS), sg.default_rules()).select(
        "rule", "src_ip", "dest_ip", "ts_us", "seq"
    )
    path = in_files(hits, "ts_us", tmp_path / "in")
    got = run_to_memory(keyed.limit_hits(stream(spark, path, hits.schema), 5.0), "limited", tmp_path / "c")
    full = sg.rate_limited(sg.evaluate(ft.engineer(packets, fx.LOCAL_IPS), sg.default_rules()), 5.0)
    assert rows(got.select("rule", "src_ip", "dest_ip", "second", "seq")) == rows(
        full.select("rule", "src_ip", "dest_ip", "second", "seq")
    )


def test_a_limit_leaves_the_state(spark, tmp_path):
    schema = "rule string, src_ip string, dest_ip string, ts_us long, seq long"
    hits = spark.createDataFrame([("r", f"s{i % 30}", "d", i * 1_000_000, i) for i in range(60)] + [("r", "z", "d", 900_000_000, 99)], schema)
    path = in_files(hits, "ts_us", tmp_path / "in", parts=3)
    assert state_sizes(keyed.limit_hits(stream(spark, path, hits.schema), 5.0), "held", tmp_path / "c")[-1] <= 1


def state_sizes(df, name, checkpoint):
    """Rows of state after each micro-batch."""
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress]


def test_an_ended_ban_leaves_the_state(spark, tmp_path):
    schema = "ip string, ts string, id string, action string, expires_at string"
    data = [(f"a{i}", f"2024-01-01 00:00:{i:02}", str(i), "block", "2024-01-01 00:05:00") for i in range(40)]
    data += [("z", "2024-01-02 00:00:00", "z", "unblock", None)]
    times = {c: F.col(c).cast("timestamp") for c in ("ts", "expires_at")}
    blocks = spark.createDataFrame(data, schema).withColumns(times)
    path = in_files(blocks, "ts", tmp_path / "in", parts=2)
    assert state_sizes(keyed.ban_expiry_stream(stream(spark, path, blocks.schema)), "ended", tmp_path / "c")[-1] <= 1
    assert spark.table("ended").count() == 40


def locked(spark, path, schema, folder, after, minutes):
    job = keyed.Lockout(str(folder / "out"), after, minutes)
    q = keyed.start_lockout(stream(spark, path, schema), job, str(folder / "c"))
    q.awaitTermination(600)
    assert q.exception() is None
    return spark.read.parquet(f"{folder}/out/verdicts").select("username", "seq", "verdict")


def test_an_ended_lock_leaves_the_state(spark, tmp_path):
    data = [(f"u{i % 10}", i, i, False) for i in range(50)] + [("ok", 60, 60, True), ("one", 61, 61, False), ("late", 62, 9000, True)]
    logins = spark.createDataFrame(data, "username string, seq long, s long, ok boolean")
    logins = logins.select("username", "seq", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "ok")
    path = in_files(logins, "seq", tmp_path / "in", parts=53)
    held = []
    job = keyed.Lockout(str(tmp_path / "out"), 5, 15)

    def watched(batch, batch_id):
        job(batch, batch_id)
        held.append({r["key"] for r in spark.read.parquet(f"{tmp_path}/out/state/version={batch_id}").collect()})

    two = spark.readStream.schema(logins.schema).option("maxFilesPerTrigger", 26).parquet(path)
    two.writeStream.foreachBatch(watched).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(600)
    assert len(held) == 3 and held[0] == held[1] - {"one"} == {f"u{i}" for i in range(10)} | ({"one"} & held[0])
    assert held[2] == {"one"}


def test_lockout_stream(spark, events, tmp_path):
    logins = fx.logins(events)
    path = in_files(logins, "ts", tmp_path / "in")
    got = locked(spark, path, logins.schema, tmp_path, 5, 4320)
    want = lk.login_verdicts(logins, 5, 4320).select("username", "seq", "verdict")
    assert rows(got) == rows(want)
    assert want.filter("verdict = 'locked'").count() > 0


def test_lockout_stream_orders_a_user_across_arrow_batches(spark, tmp_path):
    data = [("u", i, i * 7919 % 400, i % 5 == 0) for i in range(400)]
    logins = spark.createDataFrame(data, "username string, seq long, s long, ok boolean")
    logins = logins.select("username", "seq", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "ok")
    path = in_files(logins, "seq", tmp_path / "in", parts=1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = locked(spark, path, logins.schema, tmp_path, 3, 0.1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(got) == rows(lk.login_verdicts(logins, 3, 0.1).select("username", "seq", "verdict"))


def test_ban_expiry_stream(spark, events, tmp_path):
    blocks = fx.blocks(events, fx.user_ip()).select("ip", "ts", "id", "action", "expires_at")
    closing = spark.createDataFrame(
        [("192.0.2.1", "2024-03-01 00:00:00", "z", "unblock", None)], "ip string, ts string, id string, action string, expires_at timestamp"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    path = in_files(blocks.unionByName(closing.select(blocks.columns)), "ts", tmp_path / "in", parts=6)
    got = run_to_memory(keyed.ban_expiry_stream(stream(spark, path, blocks.schema)), "expiries", tmp_path / "c")
    assert rows(got.select("ip", "ts")) == ended_bans(blocks)
    assert len(ended_bans(blocks)) > 0


def ended_bans(blocks):
    """Bans that ran to their end: nothing replaced them before it."""
    by_ip, out = {}, []
    for r in sorted(blocks.collect(), key=lambda r: (r.ts, r.id)):
        by_ip.setdefault(r.ip, []).append(r)
    for ip, mine in by_ip.items():
        for r, after in zip(mine, [*mine[1:], None]):
            if r.action == "block" and r.expires_at is not None and (after is None or r.expires_at < after.ts):
                out.append((ip, r.expires_at))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 3])
def test_each_ban_ends_once_whatever_the_micro_batches(spark, parts, tmp_path):
    schema = "ip string, ts string, id string, action string, expires_at string"
    data = [
        ("a", "2024-01-01 00:00:00", "1", "block", "2024-01-01 00:05:00"),
        ("a", "2024-01-01 01:00:00", "2", "block", "2024-01-01 01:05:00"),
        ("b", "2024-01-01 01:01:00", "3", "block", "2024-01-01 02:00:00"),
        ("b", "2024-01-01 01:02:00", "4", "unblock", None),
        ("c", "2024-01-01 01:03:00", "6", "block", None),
        ("z", "2024-01-02 00:00:00", "7", "unblock", None),
    ]
    times = {c: F.col(c).cast("timestamp") for c in ("ts", "expires_at")}
    blocks = spark.createDataFrame(data, schema).withColumns(times)
    path = in_files(blocks, "ts", tmp_path / "in", parts=parts)
    got = run_to_memory(keyed.ban_expiry_stream(stream(spark, path, blocks.schema)), f"bans{parts}", tmp_path / "c")
    assert rows(got.select("ip", "ts")) == ended_bans(blocks)


def test_event_feed_sends_each_id_once(spark, events, tmp_path):
    alerts, blocks = fx.alerts(events), fx.blocks(events)
    a = in_files(alerts.unionByName(alerts.filter("kind = 'ANOMALY'")), "ts", tmp_path / "a")
    b = in_files(blocks, "ts", tmp_path / "b")
    feed = feeds.event_feed(stream(spark, a, alerts.schema), stream(spark, b, blocks.schema), "60 days")
    got = run_to_memory(feed, "feed", tmp_path / "c")
    assert got.count() == alerts.count() + blocks.count()
    assert got.select("event", "id").distinct().count() == got.count()


def test_latest_view(spark, events, tmp_path):
    logs = lg.log_events(fx.alerts(events), fx.blocks(events)).withColumn(
        "arrival", F.substring("id", 2, 20).cast("bigint")
    )
    path = in_files(logs, "arrival", tmp_path / "in")
    out = str(tmp_path / "out")
    q = (
        stream(spark, path, logs.schema).writeStream.foreachBatch(feeds.latest_view(out, logs.schema, 20))
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    q.awaitTermination(300)
    assert rows(versions.before(spark, out, 4, logs.schema)) == rows(lg.latest_feed(logs, 20))


def test_scan_summary(spark, packets, tmp_path):
    path = in_files(packets, "ts_us", tmp_path / "in")
    got = run_to_memory(feeds.scan_summary(stream(spark, path, PACKET)), "scans", tmp_path / "c")
    # Windows that the watermark has passed, each once.
    newest = packets.agg(F.max("ts_us")).first()[0] // 1000 * 1000 - 30_000_000
    exact = ft.scan_windows(packets).filter(F.unix_micros("window_end") <= newest).select("window_start", "src_ip", "unique_dports", "packets")
    assert rows(got) == rows(exact)
    assert got.count() > 100


def test_old_versions_go(spark, tmp_path):
    table = spark.range(3)
    for i in range(versions.KEPT + 2):
        versions.leave(table, str(tmp_path / "t"), i)
    left = sorted(int(n.split("=")[1]) for n in os.listdir(tmp_path / "t"))
    assert left == list(range(2, versions.KEPT + 2))
    assert versions.before(spark, str(tmp_path / "t"), versions.KEPT + 2, table.schema).count() == 3
    assert versions.before(spark, str(tmp_path / "none"), 0, table.schema).count() == 0
    with pytest.raises(FileNotFoundError):
        versions.before(spark, str(tmp_path / "none"), 5, table.schema)


def test_a_large_micro_batch_of_one_date_is_several_files(spark, tmp_path):
    # Before, whatever came below 64 MB was one file, which one task wrote and all that follows read by one task.
    many = spark.range(600_000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    for i, rows_ in enumerate([many, many.limit(50)]):
        got = versions.add_dated(rows_, str(tmp_path / "t"), i, F.to_date(F.lit("2024-01-01")))
        assert rows(got.agg(F.count("*"), F.sum("id"))) == rows(rows_.agg(F.count("*"), F.sum("id")))
    files = [[f for f in os.listdir(tmp_path / "t" / "event_date=2024-01-01" / f"batch={i}") if f.endswith(".parquet")] for i in (0, 1)]
    assert 2 <= len(files[0]) <= 16 and len(files[1]) == 1


def test_state_is_dealt_by_core(spark, packets, tmp_path):
    path, name = in_files(packets, "ts_us", tmp_path / "in", parts=1), "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "50")
    try:
        q = start_devices(read_packet_stream(spark, path, max_files=1), str(tmp_path / "out"), str(tmp_path / "c"))
        q.awaitTermination(300)
        assert spark.conf.get(name) == "50"
        assert {s["numShufflePartitions"] for p in q.recentProgress for s in p["stateOperators"]} == {8}
    finally:
        spark.conf.set(name, before)


class _Handle:
    """State of one key that counts its calls; timers cannot be listed."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_an_address_takes_few_calls_of_state():
    handle, bans = _Handle(), keyed._Bans()
    bans.init(handle)
    row = lambda us, ends: Row(us=us, id=str(us), ends=ends)
    given = [[row(1000, 5000), row(9000, 20_000)], [row(15_000, 0)], [row(10_000, 99_000)]]
    assert [[r.ended for r in bans.handleInputRows(("a",), iter(g), None)] for g in given] == [[5000], [], []]
    # A ban that is replaced before its end, and a row older than the newest, change no other timer.
    assert handle.timers == {16} and handle.value == (15_000, "15000", 0)
    assert handle.calls == 3 + 4 + 1
    assert list(bans.handleExpiredTimer(("a",), None, None)) == [] and handle.value is None
