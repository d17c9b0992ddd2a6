"""Plan shapes that keep the work spread out."""

from __future__ import annotations

from flowwatch.operators import alerts as al, containment as ct, features as ft, logs as lg, signatures as sg
from flowwatch.plans import registry
from flowwatch.schemas import ALERT, BLOCK
from flowwatch.sources import fixtures as fx, stores


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_move_packets_once(packets):
    text = plan(ft.engineer(packets, fx.LOCAL_IPS))
    # The packet scan sits under one exchange; the other scans read the span summary.
    scans = [line for line in text.splitlines() if "FileScan" in line and "event_id" in line]
    assert len(scans) == 1
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_latest_per_key_is_limited_before_the_exchange(events):
    text = plan(ct.latest_action(fx.blocks(events)))
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_log_filters_reach_the_files(spark, events, tmp_path):
    stores.write_dated(fx.alerts(events), str(tmp_path / "alerts"))
    stores.write_dated(fx.blocks(events), str(tmp_path / "blocks"))
    alerts, blocks = (stores.read_dated(spark, str(tmp_path / n), s) for n, s in (("alerts", ALERT), ("blocks", BLOCK)))
    logs = lg.log_events(alerts, blocks)
    text = lg.filter_logs(logs, ip="10.0.0.2", ts_from="2024-01-10 00:00:00", limit=10)
    text = text._jdf.queryExecution().toString()
    assert text.count("EqualTo(src_ip,10.0.0.2)") >= 1 and text.count("EqualTo(ip,10.0.0.2)") >= 1
    assert "TakeOrderedAndProject" in text


def test_the_forest_is_walked_once_for_each_row(packets):
    scored = registry._fixed_model().with_score(ft.engineer(packets, fx.LOCAL_IPS))
    assert plan(al.anomaly_alerts(scored)).count("ArrowEvalPython") == 1


def test_the_rate_limit_hashes_its_hits(packets):
    hits = sg.evaluate(ft.engineer(packets, fx.LOCAL_IPS), sg.default_rules())
    text = plan(sg.rate_limited(hits))
    assert "SortAggregate" not in text and "WindowGroupLimit" in text


def test_narrow_reads(packets):
    text = plan(ft.dports_per_source(packets))
    assert "ReadSchema: struct<user_id:bigint,props:string>" in text
