"""Named queries over a folder of tables. Times are shown as ISO text or microseconds."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DateType, StructField, StructType

from flowwatch.functions import coerce, ips, ports, severity as sv, text as tx
from flowwatch.operators import (
    alerts as al,
    containment as ct,
    devices as dv,
    features as ft,
    iforest as forest,
    lockout as lk,
    logs as lg,
    model as md,
    retention as rt,
    scaler as sc,
    signatures as sg,
)
from flowwatch.plans import train
from flowwatch.plans.monitor import Settings
from flowwatch.schemas import BLOCK, FEATURES, HIT, NODE, PACKET
from flowwatch.session import share_package, shared_dir, state_by_core
from flowwatch.sources import fixtures as fx, packets as pk, stores
from flowwatch.streaming import feeds, inventory, keyed
from flowwatch.streaming.inventory import start_blocks, start_devices
from flowwatch.streaming.monitor import Monitor, start_monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2024-01-31 12:34:56"
LOCAL = fx.LOCAL_IPS
FOREST_PARAMS = md.Params(n_estimators=100)
RETRAIN_EVERY = 700


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_package(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _events(spark, sf):
    return fx.read_events(spark, sf)


def _packets(spark, sf):
    return fx.packets(_events(spark, sf))


def _engineered(spark, sf):
    return ft.engineer(_packets(spark, sf), LOCAL)


def _iso(*names: str) -> dict[str, Column]:
    return {n: tx.iso_utc(F.col(n)) for n in names}


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------------


@query
def packets_view(spark, sf):
    return _packets(spark, sf)


@query
def normalize_packets(spark, sf):
    return pk.normalize_packets(fx.raw_packets(_events(spark, sf)))


@query
def rejected_packets(spark, sf):
    raw = fx.raw_packets(_events(spark, sf)).withColumn(
        "proto", F.when(F.col("length") == "n/a", "tcp").otherwise(F.col("proto"))
    )
    return pk.rejected_packets(raw).select("seq", "src_ip", "dest_ip", "sport", "dport")


@query
def rolling_rows(spark, sf):
    path = _scratch(spark, "rolling")
    rows = _engineered(spark, sf)
    stores.append_rolling(rows, path)
    schema = StructType([*rows.schema.fields, StructField("event_date", DateType())])
    return stores.read_rolling(spark, path, schema).select(
        "seq",
        "ts_us",
        F.round("time_diff", 6).alias("time_diff"),
        "unique_dports_15s",
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
    )


def _changed(rows: DataFrame, field: str, only: Column) -> DataFrame:
    first = rows.withColumn(field, F.concat(F.col(field), F.lit(" v1"))).withColumn("batch", F.lit(1))
    second = rows.filter(only).withColumn(field, F.concat(F.col(field), F.lit(" v2"))).withColumn("batch", F.lit(2))
    return first.unionByName(second)


@query
def alert_upsert(spark, sf):
    alerts = fx.alerts(_events(spark, sf))
    changes = _changed(alerts.filter("severity <> 'LOW'"), "label", F.col("kind") == "ANOMALY")
    return al.upsert_by_id(alerts, changes).withColumns(_iso("ts"))


@query
def block_upsert(spark, sf):
    blocks = fx.blocks(_events(spark, sf))
    changes = _changed(blocks.filter("action = 'block'"), "reason", F.col("expires_at").isNull())
    return al.upsert_by_id(blocks, changes).withColumns(_iso("ts", "expires_at"))


def _logs(spark, sf):
    e = _events(spark, sf)
    return lg.log_events(fx.alerts(e), fx.blocks(e))


@query
def export_csv_rows(spark, sf):
    path = _scratch(spark, "logs-csv")
    stores.export_csv(_logs(spark, sf), path)
    return spark.read.option("header", True).csv(path)


@query
def export_json_rows(spark, sf):
    path = _scratch(spark, "logs-json")
    stores.export_json(_logs(spark, sf), path)
    columns = "id string, ts string, ip string, type string, label string, severity string, kind string"
    return spark.read.schema(columns).json(path)


@query
def anomaly_lines(spark, sf):
    anomalies = al.with_anomaly(_fixed_model().with_score(_engineered(spark, sf)))
    return anomalies.select("seq", al.anomaly_lines(anomalies).alias("line"))


@query
def signature_lines(spark, sf):
    hits = sg.evaluate(_engineered(spark, sf), sg.default_rules())
    return hits.select("seq", al.signature_lines().alias("line"))


@query
def log_levels(spark, sf):
    path = _scratch(spark, "lines")
    hits = sg.evaluate(_engineered(spark, sf), sg.default_rules())
    lines = hits.select(al.signature_lines().alias("line"), F.col("rule_severity").alias("severity"))
    anomalies = al.with_anomaly(_fixed_model().with_score(_engineered(spark, sf)))
    stores.write_lines(lines.unionByName(anomalies.select(al.anomaly_lines(anomalies).alias("line"), "severity")), path)
    return spark.read.text(path).groupBy("level").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("value").startswith("ANOMALY")).alias("n_anomaly")
    )


# --- scalar functions --------------------------------------------------------------------


@query
def feat_size_log(spark, sf):
    return _packets(spark, sf).select("seq", F.round(ft.size_log(F.col("packet_size")), 9).alias("packet_size_log"))


@query
def feat_ephemeral(spark, sf):
    return _packets(spark, sf).select("seq", ports.is_ephemeral(F.col("sport")).alias("is_ephemeral_sport"))


@query
def feat_direction(spark, sf):
    return _packets(spark, sf).select("seq", ft.direction(F.col("src_ip"), LOCAL).alias("direction"))


@query
def feat_direction_by_sensor(spark, sf):
    """Two sensors; the inner addresses that a sensor sees send UDP are its own."""
    p = _packets(spark, sf).withColumn("sensor_id", F.concat(F.lit("cap"), (F.col("seq") % 2).cast("string")))
    local = p.filter("protocol = 17 AND src_ip LIKE '10.0.0.%'").select("sensor_id", F.col("src_ip").alias("ip"))
    return ft.with_direction_by_sensor(p, local).select("seq", "sensor_id", "direction")


@query
def feature_vector(spark, sf):
    rows = _engineered(spark, sf)
    shown = F.transform(ft.feature_vector(rows), lambda x: F.format_string("%.6f", x))
    return rows.select("seq", F.array_join(shown, ",").alias("features"))


def _feature_columns() -> list[Column]:
    return ["seq", *[F.round(F.col(n).cast("double"), 9).alias(n) for n in FEATURES]]


@query
def features_per_event(spark, sf):
    return _engineered(spark, sf).select(*_feature_columns())


@query
def features_empty(spark, sf):
    """No packet is ICMP, so the features of the ICMP packets are an empty table."""
    return ft.engineer(_packets(spark, sf).filter("protocol = 1"), LOCAL).select(*_feature_columns())


@query
def features_batch_reference(spark, sf):
    return ft.engineer(_packets(spark, sf), LOCAL, mode="batch_reference").select(*_feature_columns())


def _number_texts(events: DataFrame) -> DataFrame:
    k = fx._k()
    number = F.concat(k.cast("string"), F.lit("."), (F.col("event_id") % 10).cast("string"))
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(k % 9 == 0, "nan")
        .when(k % 9 == 1, "not-a-number")
        .when(k % 9 == 2, F.concat(F.lit(" "), number, F.lit(" ")))
        .when(k % 9 == 3, F.concat(F.lit("-"), number))
        .when(k % 9 == 4, F.concat(k.cast("string"), F.lit("e2")))
        .when(k % 9 == 5, "")
        .otherwise(number)
        .alias("text"),
        F.when(k % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 20).alias("number"),
        (k % 2 == 0).alias("flag"),
    )


@query
def coerce_int(spark, sf):
    t = _number_texts(_events(spark, sf))
    return t.select(
        "seq",
        coerce.text_as_int(F.col("text"), 99).alias("from_text"),
        coerce.double_as_int(F.col("number"), -3).alias("from_number"),
        coerce.bool_as_int(F.col("flag")).alias("from_flag"),
    )


@query
def coerce_float(spark, sf):
    x = coerce.text_as_float(F.col("text"), -1.5)
    t = _number_texts(_events(spark, sf)).select("seq", x.alias("x"))
    return t.select("seq", F.isnan("x").alias("is_nan"), F.nanvl("x", F.lit(0.0)).alias("value"))


@query
def severity_map(spark, sf):
    k = fx._k()
    score = F.when(k % 10 == 7, F.lit(None)).when(k % 10 == 8, F.lit(float("nan"))).otherwise((k - 60) / F.lit(400.0))
    return _events(spark, sf).select(F.col("event_id").alias("seq"), score.cast("double").alias("s")).select(
        "seq", sv.severity_of(F.col("s")).alias("severity")
    )


@query
def alert_labels(spark, sf):
    p = _packets(spark, sf)
    return p.select(
        "seq",
        tx.anomaly_label(F.col("dest_ip"), F.col("dport"), -(F.col("dport") % 500) / F.lit(500.0)).alias("anomaly"),
        tx.signature_label(F.lit(sg.PORT_SCAN[0]), F.col("dest_ip"), F.col("dport")).alias("signature"),
    )


@query
def alert_rows(spark, sf):
    e = _events(spark, sf).select("*", fx.src_ip().alias("ip"))
    kind = F.upper("event_type")
    label = F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("props"))
    return e.select(
        *al.alert_rows(
            al.alert_id(F.col("event_id"), kind), F.col("ts").cast("timestamp"), F.col("ip"), label, F.lit("LOW"), kind
        )
    ).withColumns(_iso("ts"))


@query
def label_parse(spark, sf):
    return al.parsed_label(fx.alerts(_events(spark, sf))).select("id", "label_text", "label_score")


def _feed(spark, sf) -> DataFrame:
    """Alerts and blocks as the feed sends them, with their own columns."""
    e = _events(spark, sf)
    return fx.alerts(e).unionByName(fx.blocks(e).drop("expires_at", "reason"), allowMissingColumns=True)


@query
def normalize_events(spark, sf):
    return al.normalize_events(_feed(spark, sf)).withColumns(_iso("ts"))


@query
def iso_parts(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return _events(spark, sf).select(
        F.col("event_id").alias("seq"),
        tx.iso_utc(ts).alias("iso"),
        F.date_format(ts, "yyyy-MM-dd").alias("date"),
        F.date_format(ts, "HH:mm").alias("hhmm"),
    )


@query
def ban_expiry(spark, sf):
    k = fx._k()
    minutes = (
        F.when(k % 5 == 0, " ")
        .when(k % 5 == 1, "soon")
        .when(k % 5 == 2, F.concat(F.lit("-"), k.cast("string")))
        .when(k % 5 == 3, F.concat(k.cast("string"), F.lit(".5")))
        .otherwise(F.concat(F.lit(" "), k.cast("string")))
    )
    return _events(spark, sf).select(
        F.col("event_id").alias("seq"), tx.iso_utc(tx.ban_expiry(F.col("ts").cast("timestamp"), minutes)).alias("expires")
    )


@query
def port_risk(spark, sf):
    # A set of port numbers is bounded by 65,536.
    sets = _events(spark, sf).groupBy("user_id").agg(F.collect_set(fx.dport()).alias("ports"))
    return sets.select("user_id", ports.port_risk(F.col("ports")).alias("risk"))


def _addresses(events: DataFrame) -> DataFrame:
    k = fx._k()
    parts = [k * 3, F.col("user_id") % 300, F.col("event_id") % 256, k]
    return events.select(F.col("event_id").alias("seq"), F.concat_ws(".", *[p.cast("string") for p in parts]).alias("ip"))


@query
def ip_valid(spark, sf):
    return _addresses(_events(spark, sf)).select("seq", "ip", ips.is_ip(F.col("ip")).alias("valid"))


@query
def ip_class(spark, sf):
    return _addresses(_events(spark, sf)).select("seq", ips.ip_class(F.col("ip")).alias("ip_class"))


@query
def cidr_hosts(spark, sf):
    k = fx._k()
    text = F.lower(F.hex(k))
    cidrs = F.array(
        F.concat(fx.dest_ip(), F.lit("/"), (F.lit(22) + k % 11).cast("string")),
        F.concat(F.lit("2001:db8::"), text, F.lit("/"), (F.lit(118) + k % 11).cast("string")),
        F.when(k % 5 == 3, F.concat(F.lit("2001:db8:1::"), text)),
        F.when(k == 0, "0.0.0.0/0").when(k == 1, "::/0").when(k == 2, "bad/8").when(k == 3, "10.0.0.0/33"),
    )
    nets = _events(spark, sf).select(F.explode(F.array_compact(cidrs)).alias("cidr")).distinct()
    return ips.expand_targets(nets, "cidr", 256)


@query
def ports_csv(spark, sf):
    sets = _packets(spark, sf).groupBy("src_ip").agg(F.array_sort(F.collect_set("dport")).alias("p"))
    csv = ports.ports_to_csv(F.col("p"))
    back = ports.csv_to_ports(csv, ports.MAX_PORTS)
    return sets.select("src_ip", csv.alias("csv"), F.size(back).alias("n_first"), ports.ports_to_csv(back).alias("first"))


@query
def feature_checksum(spark, sf):
    names = F.array(F.col("event_type"), fx.src_ip(), fx._k().cast("string"))
    return _events(spark, sf).select(F.col("event_id").alias("seq"), tx.feature_checksum(names).alias("checksum"))


# --- filters, pages and rules ------------------------------------------------------------


@query
def logs_filtered(spark, sf):
    return lg.filter_logs(
        _logs(spark, sf),
        ip="203.0.113.5",
        severity="high",
        type="ALERT",
        ts_from="2024-01-05 00:00:00",
        ts_to="2024-01-25 00:00:00",
        limit=200,
    ).withColumns(_iso("ts"))


@query
def logs_by_kind(spark, sf):
    return lg.filter_logs(_logs(spark, sf), kind="signature").withColumns(_iso("ts"))


@query
def normalized_filtered(spark, sf):
    return lg.filter_normalized(
        al.normalize_events(_feed(spark, sf)), ip=" 10.0.0.3 ", type="unblock", ts_from="2024-01-10 00:00:00"
    ).withColumns(_iso("ts"))


@query
def alerts_page(spark, sf):
    alerts = fx.alerts(_events(spark, sf))
    return lg.page(alerts, 50, ("2024-01-20 00:00:00", "a5000")).withColumns(_iso("ts"))


@query
def alerts_page_by_time(spark, sf):
    return lg.page(fx.alerts(_events(spark, sf)), 50, "2024-01-20 00:00:00").withColumns(_iso("ts"))


@query
def rule_port_scan(spark, sf):
    return sg.evaluate(_engineered(spark, sf), [sg.port_scan_rule()]).select("seq", "rule", "unique_dports_15s")


@query
def rule_sensitive_port(spark, sf):
    return sg.evaluate(_engineered(spark, sf), [sg.sensitive_port_rule()]).select("seq", "rule", "dport")


@query
def signature_hits(spark, sf):
    # Two rules that cannot be computed on some rows: a division by zero, and a text that is no number.
    port = F.col("dport")
    odd = [
        sg.Rule("size-by-port", "low", "Large for its port.", F.col("packet_size") / (port % 7) > 50),
        sg.Rule("high-even-port", "low", "Even port from 1040 on.", F.when(port % 2 == 0, port.cast("string")).otherwise("odd").cast("int") >= 1040),
    ]
    hits = sg.evaluate(_engineered(spark, sf), [*sg.default_rules(), *odd])
    return hits.select("seq", "src_ip", "dest_ip", "dport", "rule", "rule_severity", "description")


@query
def function_rule(spark, sf):
    def large_inbound(rows: pd.DataFrame) -> pd.Series:
        if (rows["sport"] % 499 == 0).any():
            raise ValueError("a port that the rule cannot judge")
        return (rows["packet_size"] > 300) & (rows["is_in"] == 1)

    rule = sg.Rule.from_function("large-inbound", "low", "Large inbound packet.", large_inbound, ["packet_size", "is_in", "sport"])
    rows = _packets(spark, sf).withColumn("is_in", 1 - ft.direction(F.col("src_ip"), LOCAL).cast("int"))
    return sg.evaluate(rows, [rule]).select("seq", "rule", "packet_size")


@query
def context_rule(spark, sf):
    """A rule that looks at the packets around: the source's fifth packet of a size or more within its last ten."""
    last_ten = Window.partitionBy("src_ip").orderBy("ts_us", "seq").rowsBetween(-9, 0)
    large = F.sum((F.col("packet_size") >= 300).cast("int")).over(last_ten)
    rule = sg.Rule("burst-of-large", "medium", "Five large packets of the last ten.", F.col("large_of_ten") >= 5, {"large_of_ten": large})
    return sg.evaluate(_packets(spark, sf), [rule]).select("seq", "rule", "large_of_ten")


@query
def rules_toggled(spark, sf):
    """Hits of the default rules with a lower limit and other ports, and of rules that are switched off."""
    rows = _engineered(spark, sf)
    on = sg.evaluate(rows, sg.default_rules(threshold=5.0, ports=[23, 1001]))
    off = sg.evaluate(rows, sg.default_rules(enabled=False))
    pick = lambda hits, name: hits.select("seq", "rule", F.lit(name).alias("setting"))
    return pick(on, "on").unionByName(pick(off, "off"))


@query
def threshold_texts(spark, sf):
    """Severities under thresholds given as text, one of them unreadable."""
    rows = _events(spark, sf).select(F.col("event_id").alias("seq"), ((fx._k() - 60) / F.lit(400.0)).alias("s"))
    texts = {"wide": "-0.08, -0.01", "spaced": " -0.12 ,-0.02,", "unreadable": "high, medium"}
    return rows.select("seq", *(sv.severity_of(F.col("s"), sv.Thresholds.parse(t)).alias(n) for n, t in texts.items()))


@query
def conformed_blocks(spark, sf):
    """Block rows of an older table, without reason and end, in today's columns."""
    return rt.conform(fx.blocks(_events(spark, sf)).drop("reason", "expires_at"), BLOCK).withColumns(_iso("ts", "expires_at"))


@query
def signature_dedup(spark, sf):
    hits = sg.evaluate(_engineered(spark, sf), sg.default_rules())
    return sg.rate_limited(hits, 5.0).select("rule", "src_ip", "dest_ip", "second", "seq")


@query
def signature_alerts(spark, sf):
    return al.signature_alerts(sg.evaluate(_engineered(spark, sf), sg.default_rules())).withColumns(_iso("ts"))


# --- bans and trust ----------------------------------------------------------------------


@query
def expired_bans(spark, sf):
    return ct.expired_bans(fx.blocks(_events(spark, sf), fx.user_ip()), _as_of()).select("id", "ip", "action", "reason")


@query
def blocks_with_trust(spark, sf):
    e = _events(spark, sf)
    return ct.with_trust(fx.blocks(e), fx.trusted(e)).select("id", "ip", "action", "trusted")


@query
def block_candidates(spark, sf):
    e = _events(spark, sf)
    return ct.block_candidates(fx.blocks(e), fx.trusted(e)).select("id", "ip", "reason")


def _trust_requests(e: DataFrame) -> DataFrame:
    return e.filter("event_type = 'click'").select(F.col("event_id").alias("seq"), fx.src_ip().alias("ip"))


@query
def trust_rejected(spark, sf):
    e = _events(spark, sf)
    return ct.rejected_trust(_trust_requests(e), fx.blocks(e)).select("seq", "ip")


@query
def latest_action(spark, sf):
    return ct.latest_action(fx.blocks(_events(spark, sf), fx.user_ip())).select("ip", "id", "action", "reason")


@query
def block_state(spark, sf):
    e = _events(spark, sf)
    return ct.block_state(fx.commands(e), fx.trusted(e)).withColumns(_iso("ts", "expires_at"))


@query
def containment_fold(spark, sf):
    return ct.containment_verdicts(fx.commands(_events(spark, sf))).select("seq", "ip", "command", "verdict")


@query
def lockout_verdicts(spark, sf):
    return lk.login_verdicts(fx.logins(_events(spark, sf)), 5, 3 * 24 * 60).select(
        "username", "seq", "ok", "failures_before", "verdict"
    )


@query
def lockout_states(spark, sf):
    return lk.lockout_states(lk.login_verdicts(fx.logins(_events(spark, sf)), 5, 3 * 24 * 60))


@query
def trusted_list(spark, sf):
    return fx.trusted(_events(spark, sf)).orderBy("ip").withColumns(_iso("created_ts"))


@query
def trusted_merge(spark, sf):
    e = _events(spark, sf)
    second = F.date_trunc("second", F.col("ts").cast("timestamp"))
    added = e.filter("event_type = 'signup'").select(
        fx.src_ip().alias("ip"), F.col("props").alias("note"), second.alias("created_ts")
    )
    removed = fx.blocks(e).filter("action = 'block'").groupBy("ip").agg(F.max("expires_at").alias("until"))
    removed = removed.filter(F.unix_seconds("until") % 2 == 0)
    return ct.merge_trusted(fx.trusted(e), added, removed).withColumns(_iso("created_ts"))


# --- aggregates, devices and tables ------------------------------------------------------


@query
def dports_per_src(spark, sf):
    return ft.dports_per_source(_packets(spark, sf))


@query
def dports_per_src_approx(spark, sf):
    """From a stored table of sketches: the exact count, and whether the estimate is within five percent of it."""
    packets = _packets(spark, sf)
    path = _scratch(spark, "sketches")
    ft.port_sketches(packets).write.parquet(path)
    near = ft.ports_from_sketches(spark.read.parquet(path))
    both = ft.dports_per_source(packets).join(near, "src_ip")
    close = F.abs(F.col("estimate") - F.col("unique_dports")) <= 0.05 * F.col("unique_dports")
    return both.select("src_ip", "unique_dports", close.alias("within_bound"))


@query
def port_entropy(spark, sf):
    return ft.value_entropy(_packets(spark, sf), "dport", ["src_ip"]).select(
        "src_ip", F.round("entropy", 6).alias("entropy")
    )


@query
def stats_snapshot(spark, sf):
    e = _events(spark, sf)
    return lg.stats_snapshot(fx.alerts(e), fx.blocks(e), 200)


def _devices(spark, sf, packets: DataFrame | None = None) -> DataFrame:
    e = _events(spark, sf)
    return dv.device_inventory(fx.packets(e) if packets is None else packets, fx.device_names(e))


@query
def dashboard_counts(spark, sf):
    e = _events(spark, sf)
    as_of = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return lg.dashboard_counts(_devices(spark, sf), fx.alerts(e), fx.blocks(e), as_of)


def _device_view(devices: DataFrame) -> DataFrame:
    shown = {n: F.unix_micros(n) for n in ("first_seen", "last_seen")}
    return devices.withColumns(shown)


@query
def device_inventory(spark, sf):
    return _device_view(_devices(spark, sf))


@query
def device_services(spark, sf):
    return dv.device_services(_packets(spark, sf)).withColumn("open_ports", ports.ports_to_csv(F.col("open_ports")))


@query
def devices_top(spark, sf):
    return _device_view(dv.newest_devices(_devices(spark, sf), 5))


@query
def scan_targets(spark, sf):
    return dv.scan_targets(_devices(spark, sf))


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Devices known from TCP traffic, and devices newly seen in UDP traffic."""
    p = _packets(spark, sf)
    known = dv.device_inventory(p.filter("protocol = 6"))
    return known, _devices(spark, sf, p.filter("protocol = 17"))


@query
def device_merge(spark, sf):
    known, seen = _halves(spark, sf)
    return _device_view(dv.merge_devices(known, seen))


@query
def device_rename(spark, sf):
    known, _ = _halves(spark, sf)
    names = fx.trusted(_events(spark, sf)).select("ip", F.col("note").alias("name"))
    return _device_view(dv.rename_devices(known, names))


@query
def device_ensure(spark, sf):
    """Rename requests of known and unknown addresses, some of them without a name."""
    known, _ = _halves(spark, sf)
    ip = F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("192.0.2."), (F.col("event_id") % 50).cast("string"))).otherwise(fx.dest_ip())
    asked = _events(spark, sf).select(ip.alias("ip"), F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("host "), ip)).otherwise(" ").alias("name"))
    return _device_view(dv.ensure_devices(known, asked, _as_of()))


@query
def device_scan_merge(spark, sf):
    p = _packets(spark, sf)
    known = dv.device_inventory(p.filter("protocol = 17").select("ts_us", F.col("src_ip"), F.col("src_ip").alias("dest_ip")))
    known = known.withColumns({"open_ports": F.array().cast("array<int>"), "risk": F.lit("")})
    merged = dv.merge_scan(known, dv.device_services(p), _as_of())
    return _device_view(merged).withColumn("open_ports", ports.ports_to_csv(F.col("open_ports")))


@query
def alert_rates(spark, sf):
    return lg.alert_rates(fx.alerts(_events(spark, sf))).withColumns(_iso("bucket"))


@query
def alerts_top(spark, sf):
    return lg.newest_first(fx.alerts(_events(spark, sf)), 100).withColumns(_iso("ts"))


@query
def blocks_top(spark, sf):
    return lg.newest_first(fx.blocks(_events(spark, sf)), 100).withColumns(_iso("ts", "expires_at"))


@query
def log_events(spark, sf):
    return _logs(spark, sf).withColumns(_iso("ts"))


@query
def retention_kept(spark, sf):
    return rt.kept(fx.alerts(_events(spark, sf)), 7, _as_of()).select("id", "severity", tx.iso_utc(F.col("ts")).alias("ts"))


@query
def retention_counts(spark, sf):
    e = _events(spark, sf)
    return rt.deleted_counts(fx.alerts(e), fx.blocks(e), 7, 14, _as_of())


@query
def retention_job(spark, sf):
    path = _scratch(spark, "dated")
    fx.alerts(_events(spark, sf)).withColumn("event_date", F.to_date("ts")).write.partitionBy("event_date").parquet(path)
    for nothing in (0, None):
        rt.drop_dates(spark, path, nothing, _as_of())
    gone = rt.drop_dates(spark, path, 7, _as_of())
    left = spark.read.parquet(path).groupBy("event_date").agg(F.count("*").alias("n_rows"), F.lit(False).alias("dropped"))
    return gone.withColumn("dropped", F.lit(True)).unionByName(left).withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))


@query
def latest_feed(spark, sf):
    e = _events(spark, sf)
    number = F.substring("id", 2, 20).cast("bigint")
    first = lg.log_events(fx.alerts(e), fx.blocks(e)).withColumn("arrival", number)
    again = first.filter("severity = 'HIGH'").withColumns(
        {"severity": F.lit("MEDIUM"), "arrival": F.col("arrival") + 100}
    )
    return lg.latest_feed(first.unionByName(again), 200).withColumns(_iso("ts"))


# --- windows -----------------------------------------------------------------------------


@query
def feat_time_diff(spark, sf):
    return ft.with_time_diff(_packets(spark, sf)).select("seq", F.round("time_diff", 6).alias("time_diff"))


@query
def feat_unique_dports(spark, sf):
    return ft.with_unique_dports(_packets(spark, sf)).select("seq", "unique_dports_15s")


@query
def feat_unique_dports_capped(spark, sf):
    return ft.with_unique_dports(_packets(spark, sf), max_rows=40).select("seq", "unique_dports_15s")


@query
def arrival_index(spark, sf):
    return ft.with_arrival_index(_packets(spark, sf)).select("seq", "arrival_index")


@query
def retrain_points(spark, sf):
    return train.retrain_points(_packets(spark, sf), 100, 500).select("seq", "arrival_index", "window_rows")


@query
def scan_windows(spark, sf):
    w = ft.scan_windows(_packets(spark, sf))
    return w.withColumns({n: F.unix_micros(n) for n in ("window_start", "window_end")})


# --- model -------------------------------------------------------------------------------


def _fixed_model() -> md.Model:
    """The hand-written forest on unscaled features."""
    nodes = pd.DataFrame(fx.FIXED_NODES, columns=NODE.fieldNames())
    n = len(FEATURES)
    return md.Model(FEATURES, [0.0] * n, [1.0] * n, nodes, 256, fx.FIXED_OFFSET, md.Params())


_TRAINED: dict[tuple[str, str], md.Model] = {}


def _trained(spark, sf) -> md.Model:
    """The table's model, trained once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        _TRAINED[key] = train.train_on_packets(_packets(spark, sf), LOCAL, FOREST_PARAMS)
    return _TRAINED[key]


def _vectors(spark, sf) -> DataFrame:
    rows = _engineered(spark, sf)
    return rows.select("sensor_id", "seq", ft.feature_vector(rows).alias("features"))


@query
def scaler_stats(spark, sf):
    return sc.fit_scaler(_vectors(spark, sf), FEATURES).select(
        "feature_idx", "name", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale")
    )


@query
def scaled_features(spark, sf):
    v = _vectors(spark, sf)
    stats = sc.fit_scaler(v, FEATURES).orderBy("feature_idx").collect()  # one row per feature
    raw = [F.get("features", F.lit(i)) for i in range(len(FEATURES))]
    out = sc.scaled(raw, [r["mean"] for r in stats], [r["scale"] for r in stats])
    return v.select("seq", *[F.round(c, 6).alias(n) for c, n in zip(out, FEATURES)])


@query
def iforest_sample(spark, sf):
    p = _packets(spark, sf)
    return forest.sample_trees(p, p.count(), 8).select("tree_id", "rank", "seq")


@query
def iforest_nodes(spark, sf):
    return spark.createDataFrame(_trained(spark, sf).nodes, NODE)


@query
def score_fixed_forest(spark, sf):
    scored = _fixed_model().with_score(_engineered(spark, sf))
    return scored.select("seq", F.round("score", 9).alias("score"))


@query
def score_trained(spark, sf):
    return _trained(spark, sf).with_label(_engineered(spark, sf)).select("seq", "score", "label")


@query
def contamination_offset(spark, sf):
    scores = _events(spark, sf).select((F.lit(-1.0) / (F.lit(1.0) + F.col("value"))).alias("score"))
    return forest.exact_quantile(scores, 0.05).select(F.round("quantile", 12).alias("score_offset"))


@query
def predict_labels(spark, sf):
    return _fixed_model().with_label(_engineered(spark, sf)).select("seq", "label")


@query
def predict_shuffled_columns(spark, sf):
    model, rows = _trained(spark, sf), _engineered(spark, sf)
    turned = rows.select("seq", *reversed(FEATURES))
    a = model.with_label(rows).select("seq", "label")
    b = model.with_label(turned).select("seq", F.col("label").alias("shuffled"))
    return a.join(b, "seq").select("seq", (F.col("label") == F.col("shuffled")).alias("same"))


@query
def iforest_shape(spark, sf):
    nodes = spark.createDataFrame(_trained(spark, sf).nodes, NODE)
    leaf = F.col("feature_idx") < 0
    return nodes.groupBy("tree_id").agg(
        F.max(F.when(F.col("node_id") == 0, F.col("n"))).alias("root_rows"),
        F.sum(F.when(leaf, F.col("n"))).alias("leaf_rows"),
        (F.count_if(leaf) - F.count_if(~leaf)).alias("extra_leaves"),
        (F.max("depth") <= 8).alias("depth_ok"),
    )


@query
def model_metadata(spark, sf):
    shown = _trained(spark, sf).metadata(spark).drop("trained_at", "offset")
    return shown.withColumn("feature_names", F.array_join("feature_names", ", "))


@query
def model_roundtrip(spark, sf):
    model, path = _trained(spark, sf), _scratch(spark, "model")
    md.save(model, spark, path)
    rows = _engineered(spark, sf)
    a = model.with_score(rows).select("seq", "score")
    b = md.load(spark, path).with_score(rows).select("seq", F.col("score").alias("loaded"))
    return a.join(b, "seq").select("seq", (F.col("score") == F.col("loaded")).alias("same"))


@query
def train_job(spark, sf):
    model = train.train_on_packets(_packets(spark, sf), LOCAL, FOREST_PARAMS)
    return model.metadata(spark).select("n_estimators", "subsample", "feature_checksum", (F.col("offset") < 0).alias("usable"))


@query
def anomaly_alerts(spark, sf):
    return al.anomaly_alerts(_fixed_model().with_score(_engineered(spark, sf))).withColumns(_iso("ts"))


@query
def autoblock_decisions(spark, sf):
    e = _events(spark, sf)
    anomalies = al.with_anomaly(_fixed_model().with_score(_engineered(spark, sf)))
    return al.autoblock_decisions(anomalies, LOCAL, fx.trusted(e)).withColumns(_iso("ts", "expires_at"))


# --- streams over the same tables --------------------------------------------------------


MICRO_BATCHES = 4
_FILE_ROWS = 1000


def _slices(spark, sf) -> tuple[list[DataFrame], int]:
    """The events in as many parts as there are micro-batches, in time order, and the files to write of each."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last, n = events.agg(F.min(us), F.max(us), F.count("*")).first()
    if first is None:
        return [], 1
    at = F.expr(f"(unix_micros(cast(ts as timestamp)) - {first}L) * {MICRO_BATCHES} div {last - first + 1}L")
    return [events.filter(at == i) for i in range(MICRO_BATCHES)], max(1, min(64, n // (MICRO_BATCHES * _FILE_ROWS)))


def _event_stream(spark, sf) -> DataFrame:
    """The events as a stream of a few micro-batches of several files in time order, so that state is carried between them."""
    out = _scratch(spark, "events")
    parts, files = _slices(spark, sf)
    for part in parts:
        part.repartition(files).write.mode("append").parquet(out)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return fx.with_k(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(out))


def _drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a table, and read it."""
    spark = stream.sparkSession
    out = _scratch(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{out}-check").trigger(availableNow=True)
    with state_by_core(spark):
        if mode == "append":
            running = writer.format("parquet").option("path", out).outputMode("append").start()
        else:
            running = writer.foreachBatch(
                lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
            ).outputMode(mode).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_MONITORED: dict[tuple[str, str], str] = {}


def _run(spark, sf, out: str, job: Monitor, after: Callable[[], None] = lambda: None) -> None:
    """The monitor over the packet stream, stopped and started again between micro-batches; then ``after`` each."""
    parts, files = _slices(spark, sf)
    for part in parts:
        part.repartition(files).write.mode("append").parquet(f"{out}-in")
        source = fx.with_k(spark.readStream.schema(part.schema).parquet(f"{out}-in"))
        start_monitor(fx.packets(source), job, f"{out}-check").awaitTermination()
        after()


def _monitored(spark, sf) -> str:
    """The folder of a monitor run, and of what follows from its tables, once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MONITORED:
        out = _scratch(spark, "monitor")
        job = Monitor(
            out, Settings(local_ips=LOCAL), _fixed_model(), trusted=lambda: fx.trusted(_events(spark, sf))
        )
        packets = f"{out}/rolling/event_date=*/batch=*"

        def follow() -> None:
            start_devices(spark.readStream.schema(PACKET).parquet(packets), out, f"{out}-devices").awaitTermination()
            start_blocks(spark, out, f"{out}-blocks").awaitTermination()
            hits = spark.readStream.schema(HIT).parquet(f"{out}/hits/batch=*")
            limited = keyed.limit_hits(hits, 5.0, "1 day").writeStream.format("parquet").option("path", f"{out}/limited")
            with state_by_core(spark):
                running = limited.option("checkpointLocation", f"{out}-limited").trigger(availableNow=True).start()
            running.awaitTermination()

        _run(spark, sf, out, job, follow)
        _MONITORED[key] = out
    return _MONITORED[key]


@query
def live_features(spark, sf):
    rows = spark.read.parquet(f"{_monitored(spark, sf)}/rolling")
    return rows.select(*_feature_columns())


@query
def live_alerts(spark, sf):
    return spark.read.parquet(f"{_monitored(spark, sf)}/alerts").drop("batch").withColumns(_iso("ts"))


@query
def live_devices(spark, sf):
    return _device_view(inventory.devices(spark, _monitored(spark, sf)))


@query
def live_blocks(spark, sf):
    return spark.read.schema(BLOCK).parquet(f"{_monitored(spark, sf)}/blocks").withColumns(_iso("ts", "expires_at"))


@query
def live_limited_hits(spark, sf):
    rows = spark.read.parquet(f"{_monitored(spark, sf)}/limited")
    return rows.select("rule", "src_ip", "dest_ip", "second", "seq")


@query
def live_retrain(spark, sf):
    """The model versions that a monitor leaves, one for each micro-batch in which a retrain falls due."""
    out = _scratch(spark, "retrain")
    start = replace(_fixed_model(), params=md.Params(n_estimators=20))
    _run(spark, sf, out, Monitor(out, Settings(local_ips=LOCAL), start, retrain_every=RETRAIN_EVERY))
    left = spark.read.parquet(f"{out}/models/batch=*/meta")
    at = F.regexp_extract(F.input_file_name(), "/batch=([0-9]+)/", 1).cast("long")
    return left.select(at.alias("micro_batch"), "n_estimators", "subsample", "feature_checksum")


@query
def live_lockout(spark, sf):
    out = _scratch(spark, "lockout")
    job = keyed.Lockout(out, 5, 3 * 24 * 60)
    keyed.start_lockout(fx.logins(_event_stream(spark, sf)), job, f"{out}-check").awaitTermination()
    return spark.read.parquet(f"{out}/verdicts").select("username", "seq", "verdict")


@query
def live_ban_expiry(spark, sf):
    ended = _drain(keyed.ban_expiry_stream(fx.blocks(_event_stream(spark, sf), fx.user_ip())), "expiry")
    return ended.withColumns(_iso("ts"))


@query
def live_feed(spark, sf):
    e = _event_stream(spark, sf)
    feed = feeds.event_feed(fx.alerts(e).unionByName(fx.alerts(e)), fx.blocks(_event_stream(spark, sf)), "60 days")
    return _drain(feed, "feed").select("event", "id", tx.iso_utc(F.col("ts")).alias("ts"))


@query
def live_view(spark, sf):
    e = _event_stream(spark, sf)
    logs = lg.log_events(fx.alerts(e), fx.blocks(e)).withColumn("arrival", F.substring("id", 2, 20).cast("bigint"))
    out = _scratch(spark, "view")
    update = feeds.latest_view(out, logs.schema, 200)
    logs.writeStream.foreachBatch(update).option("checkpointLocation", f"{out}-check").trigger(
        availableNow=True
    ).start().awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("version").alias("v")).scalar()
    return rows.filter(F.col("version") == last).drop("version").withColumns(_iso("ts"))


@query
def live_scan_summary(spark, sf):
    summary = feeds.scan_summary(fx.packets(_event_stream(spark, sf)))
    rows = _drain(summary, "scans")
    return rows.select(F.unix_micros("window_start").alias("window_start"), "src_ip", "unique_dports", "packets")
