from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowwatch.operators import alerts as al, containment as ct, devices as dv, folds, lockout as lk, logs as lg, retention as rt
from flowwatch.schemas import ALERT, BLOCK, DEVICE, RAW_PACKET, TRUSTED
from flowwatch.session import Scratch
from flowwatch.sources import packets as pk, stores

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def alerts(spark):
    return spark.createDataFrame([("alert-1", at(0), "10.0.0.5", "8.8.8.8:53 score=-0.2", "high", "ANOMALY")], ALERT)


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame([("block-1", at(1), "203.0.113.10", "block", "manual", None)], BLOCK)


def test_log_view_and_exports(spark, alerts, blocks, tmp_path):
    logs = lg.log_events(alerts, blocks)
    stores.export_csv(logs, str(tmp_path / "csv"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "csv")).collect())
    assert "id,ts,ip,type,label,severity,kind" in lines
    assert "block-1,2024-01-01T00:01:00Z,203.0.113.10,block,block,,block" in lines
    stores.export_json(logs, str(tmp_path / "json"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert any('"severity":null' in t for t in text)


def test_log_filters(alerts, blocks):
    logs = lg.log_events(alerts, blocks)
    ids = lambda **f: [r["id"] for r in lg.filter_logs(logs, **f).collect()]
    assert ids(severity="HIGH") == ["alert-1"]
    assert ids(type="Block") == ["block-1"]
    assert ids(type="signature") == []
    assert ids(kind="anomaly") == ["alert-1"]
    assert ids(ts_from=str(at(1))) == ["block-1"] and ids(ts_to=str(at(0))) == ["alert-1"]
    assert ids(limit=10) == ["block-1", "alert-1"]
    assert ids(ip="nobody") == []


def test_pages_cover_everything_once(spark):
    rows = [(f"a{i:02}", at(i // 7), "ip", "l", "low", "ANOMALY") for i in range(30)]
    df = spark.createDataFrame(rows, ALERT)
    seen, cursor = [], None
    while page := lg.page(df, 4, cursor).collect():
        seen += [r["id"] for r in page]
        cursor = (str(page[-1]["ts"]), page[-1]["id"])
    assert seen == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]


def test_normalized_events(spark):
    rows = [
        ("1", at(0), "alert", "ANOMALY", "1.1.1.1:1 score=-0.5", "HIGH", None, "9.9.9.9", None),
        ("2", at(0), "block", "block", "unblock", None, None, None, "8.8.8.8"),
        ("3", at(0), None, None, None, None, "block", None, "8.8.8.8"),
        ("4", at(0), "scan", None, "done score=2", None, None, None, None),
        ("5", at(0), None, None, None, None, None, None, None),
    ]
    schema = "id string, ts timestamp, type string, kind string, label string, severity string, action string, src_ip string, ip string"
    got = al.normalize_events(spark.createDataFrame(rows, schema)).orderBy("id").collect()
    assert [(r["ip"], r["type"], r["detail"], r["score"]) for r in got] == [
        ("9.9.9.9", "alert", "1.1.1.1:1", -0.5),
        ("8.8.8.8", "unblock", "unblock", None),
        ("8.8.8.8", "block", "block", None),
        ("", "scan", "done", 2.0),
        ("", "event", "", None),
    ]


def test_upsert_replaces_by_id(spark, alerts):
    change = alerts.withColumns({"label": F.lit("new"), "batch": F.lit(1)})
    later = alerts.withColumns({"label": F.lit("newest"), "batch": F.lit(2)})
    extra = alerts.withColumns({"id": F.lit("alert-2"), "batch": F.lit(1)})
    got = al.upsert_by_id(alerts, change.unionByName(later).unionByName(extra)).collect()
    assert {r["id"]: r["label"] for r in got} == {"alert-1": "newest", "alert-2": "8.8.8.8:53 score=-0.2"}


def test_label_falls_back_to_kind(spark):
    df = spark.createDataFrame([("", "SIGNATURE"), (None, "K"), ("x", "K")], "label string, kind string")
    cols = al.alert_rows(F.lit("i"), F.lit(None), F.lit("ip"), F.col("label"), F.lit("low"), F.col("kind"))
    assert [r["label"] for r in df.select(*cols).collect()] == ["SIGNATURE", "K", "x"]


def test_packet_normalization(spark):
    rows = [
        (1, "s", "1.5", True, "a", "b", "6", "60", "1", "2", "3", "4"),
        (2, "s", "2.0", True, "a", "b", "17", None, None, None, "3", "4"),
        (3, "s", "3.0", True, "a", "b", "1", "60", None, None, None, None),
        (4, "s", "4.0", False, "a", "b", "6", "60", "1", "2", None, None),
        (5, "s", "5.0", True, "a", "b", "tcp", "60", "1", "2", None, None),
    ]
    raw = spark.createDataFrame(rows, RAW_PACKET)
    got = pk.normalize_packets(raw).orderBy("seq").select("seq", "ts_us", "packet_size", "sport", "dport").collect()
    assert [tuple(r) for r in got] == [(1, 1_500_000, 60, 1, 2), (2, 2_000_000, 0, 3, 4), (3, 3_000_000, 60, 0, 0)]
    assert [r["seq"] for r in pk.rejected_packets(raw).collect()] == [5]


def test_trusted_address_is_not_blocked(spark):
    trusted = spark.createDataFrame([("198.51.100.9", "n", at(0))], TRUSTED)
    schema = "seq long, ts timestamp, ip string, command string, minutes string, reason string"
    commands = spark.createDataFrame(
        [
            (1, at(1), "198.51.100.9", "block", None, ""),
            (2, at(1), " 203.0.113.55 ", "block", "5", " temp "),
            (3, at(2), "203.0.113.56", "unblock", None, " "),
            (4, at(2), " ", "block", None, ""),
        ],
        schema,
    )
    got = {r["ip"]: (r["action"], r["reason"], r["expires_at"]) for r in ct.block_state(commands, trusted).collect()}
    assert got == {"203.0.113.55": ("block", "temp", at(6)), "203.0.113.56": ("unblock", "manual", None)}


def test_expired_bans(spark):
    rows = [
        ("1", at(0), "a", "block", "", at(5)),
        ("2", at(0), "b", "block", "", at(5)),
        ("3", at(1), "b", "unblock", "", None),
        ("4", at(0), "c", "block", "", at(10)),
        ("5", at(0), "d", "block", "", None),
        ("6", at(0), "e", "block", "", at(4)),
        ("7", at(0), "e", "block", "", at(4)),
    ]
    df = spark.createDataFrame(rows, BLOCK)
    got = ct.expired_bans(df, F.lit(str(at(10))).cast("timestamp")).collect()
    assert sorted(r["ip"] for r in got) == ["a", "e", "e"]
    assert {r["action"] for r in got} == {"unblock"}


def contain(commands):
    """Verdicts straight from the guards, per address in order."""
    state, out = {}, {}
    for seq, ts, ip, command, minutes in sorted(commands, key=lambda c: (c[1], c[0])):
        kind, until = state.get(ip, ("none", None))
        if kind == "blocked" and until is not None and until < ts:
            kind, until = "none", None
        verdict = "ok"
        if command == "block":
            if kind == "trusted":
                verdict = "trusted_ip"
            else:
                kind, until = "blocked", ts + timedelta(minutes=minutes) if minutes else None
        elif command == "unblock":
            kind, until = ("none", None) if kind == "blocked" else (kind, until)
        elif command == "trust":
            if kind == "blocked":
                verdict = "ip_blocked"
            else:
                kind = "trusted"
        elif kind == "trusted":
            kind = "none"
        state[ip], out[seq] = (kind, until), verdict
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for q in range(900):
        ip = "203.0.113.1" if q % 3 == 0 else f"203.0.113.{rng.randint(2, 9)}"
        when = T0 + timedelta(seconds=rng.randint(0, 40) * 20)
        rows.append((q, when, ip, rng.choice(["block", "unblock", "trust", "untrust"]), rng.choice([None, 1, 2])))
    data = [(q, t, ip, c, None if m is None else str(m), "") for q, t, ip, c, m in rows]
    schema = "seq long, ts timestamp, ip string, command string, minutes string, reason string"
    got = ct.containment_verdicts(spark.createDataFrame(data, schema).repartition(6), block_rows=4).collect()
    assert {r["seq"]: r["verdict"] for r in got} == contain(rows)


def test_unknown_commands_change_nothing(spark):
    schema = "seq long, ts timestamp, ip string, command string, minutes string, reason string"
    at0 = lambda s: T0 + timedelta(seconds=s)
    data = [
        (1, at0(0), "203.0.113.1", "trust", None, ""),
        (2, at0(1), "203.0.113.1", "ban", None, ""),
        (3, at0(2), "203.0.113.1", "block", None, ""),
        (4, at0(5), "203.0.113.2", "block", None, ""),
        (5, at0(5), "203.0.113.2", None, None, ""),
        (6, at0(5), "203.0.113.2", "trust", None, ""),
        (None, at0(8), "203.0.113.3", "block", None, "first"),
        (7, at0(8), "203.0.113.3", "trust", None, ""),
        (8, None, "203.0.113.3", "unblock", None, ""),
    ]
    got = ct.containment_verdicts(spark.createDataFrame(data, schema)).collect()
    assert {(r["seq"], r["command"]): r["verdict"] for r in got} == {
        (1, "trust"): "ok", (2, "ban"): "bad_command", (3, "block"): "trusted_ip",
        (4, "block"): "ok", (5, None): "bad_command", (6, "trust"): "ip_blocked",
        (None, "block"): "ok", (7, "trust"): "ip_blocked", (8, "unblock"): "bad_time",
    }


def lock(attempts, after, minutes):
    state, out = {}, {}
    for user, seq, ts, ok in sorted(attempts, key=lambda a: (a[2], a[1])):
        fails, until = state.get(user, (0, T0))
        if until > ts:
            out[seq] = "locked"
            continue
        if ok:
            fails, out[seq] = 0, "ok"
        else:
            fails, out[seq] = fails + 1, "invalid"
            if fails >= after:
                fails, until = 0, ts + timedelta(minutes=minutes)
        state[user] = (fails, until)
    return out


@pytest.mark.parametrize("after,minutes", [(5, 15), (2, 1), (1, 3)])
def test_lockout_against_brute_force(spark, after, minutes):
    rng = random.Random(after)
    rows = [
        ("admin" if q % 3 else f"u{rng.randint(0, 5)}", q, T0 + timedelta(seconds=rng.randint(0, 600) * 3), rng.random() < 0.2)
        for q in range(1500)
    ]
    df = spark.createDataFrame(rows, "username string, seq long, ts timestamp, ok boolean")
    got = lk.login_verdicts(df.repartition(5), after, minutes, block_rows=3).collect()
    assert {r["seq"]: r["verdict"] for r in got} == lock(rows, after, minutes)


def test_seven_wrong_logins_lock(spark):
    rows = [("admin", i, T0 + timedelta(seconds=i), False) for i in range(7)]
    df = spark.createDataFrame(rows, "username string, seq long, ts timestamp, ok boolean")
    got = [r["verdict"] for r in lk.login_verdicts(df).orderBy("seq").collect()]
    assert got == ["invalid"] * 5 + ["locked"] * 2


def test_device_merges(spark):
    known = spark.createDataFrame([("a", at(1), at(2), "old", [22], "Medium"), ("b", at(1), at(2), "b", [], "Low")], DEVICE)
    seen = spark.createDataFrame([("a", at(0), at(5), ""), ("c", at(3), at(3), "new")], "ip string, first_seen timestamp, last_seen timestamp, name string")
    got = {r["ip"]: (r["first_seen"], r["last_seen"], r["name"], r["open_ports"]) for r in dv.merge_devices(known, seen).collect()}
    assert got == {"a": (at(0), at(5), "old", [22]), "b": (at(1), at(2), "b", []), "c": (at(3), at(3), "new", None)}

    names = spark.createDataFrame([("a", "x"), ("z", "y"), ("b", "")], "ip string, name string")
    assert {r["ip"]: r["name"] for r in dv.rename_devices(known, names).collect()} == {"a": "x", "b": "b"}
    twice = spark.createDataFrame([("a", "zeta", 1), ("a", "alpha", 2), ("a", "", 3)], "ip string, name string, seq int")
    assert {r["ip"]: r["name"] for r in dv.rename_devices(known, twice, "seq").collect()}["a"] == "alpha"

    scan = spark.createDataFrame([("a", [23], "High"), ("n", [80], "Medium")], "ip string, open_ports array<int>, risk string")
    got = {r["ip"]: (r["last_seen"], r["open_ports"], r["risk"]) for r in dv.merge_scan(known, scan, F.lit(at(9))).collect()}
    assert got == {"a": (at(9), [23], "High"), "b": (at(2), [], "Low"), "n": (at(9), [80], "Medium")}


def test_trusted_merge(spark):
    now = spark.createDataFrame([("a", "old", at(0)), ("b", "keep", at(0))], TRUSTED)
    add = spark.createDataFrame([("a", "new", at(1)), ("c", "c", at(1))], TRUSTED)
    gone = spark.createDataFrame([("c",)], "ip string")
    assert {r["ip"]: r["note"] for r in ct.merge_trusted(now, add, gone).collect()} == {"a": "new", "b": "keep"}


def test_retention_keeps_the_cutoff_day(spark):
    as_of = F.lit("2024-01-10 12:00:00").cast("timestamp")
    rows = [("old", datetime(2024, 1, 2, 23, 59, 59)), ("edge", datetime(2024, 1, 3, 0, 0, 1)), ("new", datetime(2024, 1, 9))]
    df = spark.createDataFrame(rows, "id string, ts timestamp")
    ids = lambda *a: sorted(r["id"] for r in rt.kept(df, *a).collect())
    assert ids(7, as_of) == ["edge", "new"]
    assert ids(7, as_of, "exact") == ["new"]
    assert ids(0, as_of) == ids(None, as_of) == ["edge", "new", "old"]
    assert rt.deleted_counts(df, df, 7, None, as_of).first().asDict() == {"alerts": 1, "blocks": 0}


def test_dropping_dates(spark, tmp_path):
    as_of = F.lit("2024-01-10 12:00:00").cast("timestamp")
    path = str(tmp_path / "dated")
    rows = [("old", datetime(2024, 1, 1)), ("older", datetime(2023, 12, 31)), ("edge", datetime(2024, 1, 3)), ("new", datetime(2024, 1, 9))]
    stores.replace_dates(spark.createDataFrame(rows, "id string, ts timestamp"), path)
    ids = lambda: sorted(r["id"] for r in spark.read.parquet(path).collect())
    for nothing in (0, None):
        assert rt.drop_dates(spark, path, nothing, as_of).count() == 0
        assert ids() == ["edge", "new", "old", "older"]
    with pytest.raises(ValueError):
        rt.drop_dates(spark, path, -1, as_of)
    # A run that was cut short left a folder that it had taken out.
    os.rename(f"{path}/event_date=2023-12-31", f"{path}/_dropped-left")
    assert ids() == ["edge", "new", "old"]
    assert [(str(r[0]), r[1]) for r in rt.drop_dates(spark, path, 7, as_of).collect()] == [("2024-01-01", 1)]
    assert ids() == ["edge", "new"]
    assert not [n for n in os.listdir(path) if n.startswith("_dropped")]


def test_dates_are_replaced_and_versions_are_whole(spark, tmp_path):
    day = lambda d, v: (v, datetime(2024, 1, d))
    table = lambda *rows: spark.createDataFrame(list(rows), "id string, ts timestamp")
    path = str(tmp_path / "dates")
    stores.replace_dates(table(day(1, "a"), day(2, "b")), path)
    stores.replace_dates(table(day(2, "c"), day(3, "d")), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["a", "c", "d"]

    path, schema = str(tmp_path / "versions"), table(day(1, "a")).schema
    assert stores.read_dated(spark, path, schema).count() == 0
    assert stores.write_dated(table(day(1, "a"), day(2, "b")), path) == 0
    # The next version is made from the one that it replaces.
    assert stores.write_dated(stores.read_dated(spark, path, schema).filter("id = 'b'").select("id", "ts"), path) == 1
    assert [r["id"] for r in stores.read_dated(spark, path, schema).collect()] == ["b"]
    os.remove(f"{path}/version=1/_SUCCESS")  # a version that is not complete
    assert sorted(r["id"] for r in stores.read_dated(spark, path, schema).collect()) == ["a", "b"]


def test_a_date_is_few_files(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("seq"), (F.col("id") % 5 * 86_400_000_000).alias("ts_us")).repartition(40)
    stores.append_rolling(rows, str(tmp_path / "r"))
    files = {d: [f for f in os.listdir(tmp_path / "r" / d) if f.endswith(".parquet")] for d in os.listdir(tmp_path / "r") if d.startswith("event")}
    assert len(files) == 5 and all(len(f) <= 2 for f in files.values())
    back = stores.read_rolling(spark, str(tmp_path / "r"), StructType([*rows.schema.fields, StructField("later", StringType())]))
    assert back.count() == 20_000 and back.filter("later is null").count() == 20_000


def test_requests_make_sure_that_a_device_exists(spark):
    known = spark.createDataFrame([("a", at(1), at(2), "old"), ("b", at(1), at(2), "")], "ip string, first_seen timestamp, last_seen timestamp, name string")
    asked = spark.createDataFrame([("a", ""), ("b", " x "), ("c", None), ("d", "no"), (" ", "y")], "ip string, name string")
    got = {r["ip"]: tuple(r)[1:] for r in dv.ensure_devices(known, asked, F.lit(at(9))).collect()}
    assert got == {"a": (at(1), at(9), "old"), "b": (at(1), at(2), "x"), "c": (at(9), at(9), "")}


def test_a_key_is_chained_in_several_tasks(spark):
    """One key, small blocks and runs: the result is that of one task, and the runs of the key are dealt out."""
    rng = random.Random(9)
    rows = [("k", rng.randint(0, 4000), q, int(rng.random() < 0.2), 0) for q in range(3000)]
    df = spark.createDataFrame(rows, "key string, tick long, seq long, op int, arg long")
    machine = lk.lockout_machine(3, 40)
    verdicts = lambda block, run: {r["seq"]: (r["state_before"], r["verdict"]) for r in folds.fold_commands(df, machine, block, run).collect()}
    state, until, want = 0, 0, {}
    for _, tick, seq, op, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        state = 0 if state == 3 and until <= tick else state
        before = state
        state, verdict, timer = machine.step(state, op, 0)
        until = tick + timer if timer > 0 else until
        want[seq] = (before, verdict)
    for run in (1, 7, 100, 1 << 12):
        assert verdicts(500, run) == want
    _, maps = folds._tick_blocks(df, machine, 500, 100)
    parts = maps.repartition(4, "key", "run").select(F.spark_partition_id().alias("p"), "run").distinct().groupBy("p").count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == len({r[1] // 100 for r in rows})


@pytest.mark.parametrize("cut", [1, 900, 2500])
def test_a_fold_goes_on_from_what_is_left(spark, cut):
    rng = random.Random(cut)
    rows = [(rng.choice("ab"), rng.randint(0, 3000), q, int(rng.random() < 0.2), 0) for q in range(900)]
    df = spark.createDataFrame(rows, "key string, tick long, seq long, op int, arg long")
    machine, nothing = lk.lockout_machine(3, 200), spark.createDataFrame([], "key string, state int, until long")
    pick = lambda d: sorted((r["seq"], r["state_before"], r["verdict"]) for r in d.collect())
    with Scratch(spark) as scratch:
        first, left = folds.fold_onward(df.filter(F.col("tick") < cut), nothing, machine, scratch, 100, 64)
        second, _ = folds.fold_onward(df.filter(F.col("tick") >= cut), left, machine, scratch, 100, 64)
        assert pick(first.unionByName(second)) == pick(folds.fold_commands(df, machine))
        assert os.path.isdir(scratch.path)
    assert not os.path.exists(scratch.path)


def test_older_tables_conform(spark):
    old = spark.createDataFrame([("1", at(0), "ip", "block")], "id string, ts timestamp, ip string, action string")
    row = rt.conform(old, BLOCK).first()
    assert (row["reason"], row["expires_at"]) == ("", None)


def test_rolling_store_appends(spark, packets, tmp_path):
    path = str(tmp_path / "rolling")
    stores.append_rolling(packets.filter("seq < 500"), path)
    stores.append_rolling(packets.filter("seq >= 500").withColumn("extra", F.lit(1)), path)
    back = stores.read_rolling(spark, path)
    assert back.count() == packets.count() and "extra" in back.columns


def test_empty_tables(spark):
    alerts, blocks = spark.createDataFrame([], ALERT), spark.createDataFrame([], BLOCK)
    assert lg.log_events(alerts, blocks).count() == 0
    assert lg.stats_snapshot(alerts, blocks, 200).first().asDict() == {"alerts_200": 0, "blocks_200": 0, "alerts": 0, "blocks": 0}
    assert ct.latest_action(blocks).count() == 0


def test_lines_are_written_without_a_sort_by_level(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    name, text, seen = "spark.sql.maxConcurrentOutputFileWriters", DataFrameWriter.text, []
    before = spark.conf.get(name)
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **b: (seen.append(int(spark.conf.get(name))), text(self, *a, **b))[1])
    lines = spark.range(900).selectExpr("concat('l', id) AS line", "element_at(array('high', 'medium', 'low'), int(id % 3) + 1) AS severity").coalesce(1)
    stores.write_lines(lines, str(tmp_path / "lines"))
    # A file for each level is open in a task at once; with fewer, lines are sorted by level.
    assert seen == [3] and spark.conf.get(name) == before
    got = spark.read.text(str(tmp_path / "lines"))
    assert {r["level"]: r["count"] for r in got.groupBy("level").count().collect()} == {"ERROR": 300, "WARNING": 300, "INFO": 300}
    assert got.select("value").distinct().count() == 900
