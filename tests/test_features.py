from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from conftest import packet_rows
from pyspark.sql import functions as F

from flowwatch.operators import features as ft, ordered
from flowwatch.schemas import FEATURES, PACKET

S = 1_000_000


def values(df, *columns):
    return [tuple(r) for r in df.orderBy("seq").select(*columns).collect()]


@pytest.fixture(scope="module")
def two_way(spark):
    rows = [(i, i * 0.2, "10.0.0.2", "8.8.8.8", 6, 100, 55555, 80) for i in range(3)]
    rows += [(i, i * 0.2, "8.8.8.8", "10.0.0.2", 17, 90, 53, 53000) for i in range(3, 5)]
    return packet_rows(spark, rows)


def test_two_way(two_way):
    f = ft.engineer(two_way, ["10.0.0.2"])
    assert f.count() == 5
    got = values(f, *FEATURES)
    assert [g[2] for g in got] == [0.0, 0.2, 0.2, 0.2, 0.2]
    assert [g[6] for g in got] == [1.0, 1.0, 1.0, 0.0, 0.0]
    assert [g[4] for g in got] == [1.0, 1.0, 1.0, 0.0, 0.0]
    assert got[0][1] == pytest.approx(math.log1p(100))


def test_scan_of_five_packets(spark):
    rows = [(i, float(i), "1.1.1.1", "2.2.2.2", 6, 60, 1000, p) for i, p in enumerate([22, 22, 80, 443, 8080])]
    f = ft.engineer(packet_rows(spark, rows), [])
    assert [v for (v,) in values(f, "unique_dports_15s")] == [1.0, 1.0, 2.0, 3.0, 4.0]
    batch = ft.engineer(packet_rows(spark, rows), [], mode="batch_reference")
    assert [v for (v,) in values(batch, "unique_dports_15s")] == [4.0] * 5


def test_missing_columns_raise(two_way):
    with pytest.raises(ValueError, match="sport"):
        ft.engineer(two_way.drop("protocol", "sport"), [])


def test_absent_protocol_and_dport_are_zero(two_way):
    f = ft.engineer(two_way.drop("protocol", "dport"), [])
    assert f.select(ft.feature_vector(f).alias("v")).filter("v[0] <> 0 or v[3] <> 0").count() == 0


def test_empty_input(spark):
    empty = spark.createDataFrame([], PACKET)
    for mode in ("per_event", "batch_reference"):
        f = ft.engineer(empty, ["10.0.0.2"], mode=mode)
        assert set(FEATURES) <= set(f.columns)
        assert f.count() == 0
    assert ft.value_entropy(empty, "dport").collect()[0]["entropy"] == 0.0


def lopsided(spark, n=600, seed=3):
    """Two sensors; one source holds a third of the rows and a sixth shares one microsecond."""
    rng = random.Random(seed)
    rows = []
    for q in range(n):
        ts = rng.choice([0, 15 * S, 15 * S + 1, 30 * S]) if rng.random() < 0.4 else rng.randint(0, 90 * S)
        if q % 6 == 0:
            ts = 20 * S
        src = "hot" if q % 3 == 0 else f"s{rng.randint(0, 4)}"
        port = None if rng.random() < 0.05 else rng.randint(1, 30)
        rows.append((q, rng.choice(["a", "b"]), ts, src, "d", 6, 60, 1000, port))
    return rows, spark.createDataFrame(rows, PACKET)


def brute(rows, max_rows=None, horizon=15 * S):
    """Feature values straight from their definition."""
    gap, count, index = {}, {}, {}
    by_sensor = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by_sensor[r[1]].append(r)
    for seen in by_sensor.values():
        for i, r in enumerate(seen):
            index[r[0]] = i + 1
            gap[r[0]] = (r[2] - seen[i - 1][2]) / 1e6 if i else 0.0
            low = 0 if max_rows is None else max(0, i - max_rows + 1)
            window = [x for x in seen[low : i + 1] if x[3] == r[3] and x[2] >= r[2] - horizon]
            count[r[0]] = float(len({x[8] for x in window if x[8] is not None}))
    return gap, count, index


@pytest.mark.parametrize("floor", [1 << 20, 40, 5])
def test_per_event_against_brute_force(spark, floor):
    rows, df = lopsided(spark)
    gap, count, _ = brute(rows)
    got = ft.engineer(df, [], floor=floor).select("seq", "time_diff", "unique_dports_15s").collect()
    assert {r["seq"]: r["time_diff"] for r in got} == pytest.approx(gap)
    assert {r["seq"]: r["unique_dports_15s"] for r in got} == count


def test_more_heavy_groups_than_are_listed(spark, monkeypatch):
    """Beyond the list the heavy groups are a table to join; results are the same."""
    monkeypatch.setattr(ordered, "HEAVY_LISTED", 2)
    rows, df = lopsided(spark)
    gap, count, index = brute(rows)
    loads = df.groupBy("src_ip").agg(F.count("*").alias("n_rows"))
    assert "LocalTableScan" not in plan_of(ordered.heavy_groups(loads, ["src_ip"], floor=0))
    got = ft.engineer(df, [], floor=5).select("seq", "time_diff", "unique_dports_15s").collect()
    assert {r["seq"]: r["time_diff"] for r in got} == pytest.approx(gap)
    assert {r["seq"]: r["unique_dports_15s"] for r in got} == count
    got = ft.with_arrival_index(df, floor=5).collect()
    assert {r["seq"]: r["arrival_index"] for r in got} == index


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("horizon", [15 * S, 4 * S, 40 * S])
def test_other_horizons(spark, horizon):
    rows, df = lopsided(spark, seed=8)
    _, count, _ = brute(rows, horizon=horizon)
    got = ft.with_unique_dports(df, horizon_us=horizon, floor=30).collect()
    assert {r["seq"]: r["unique_dports_15s"] for r in got} == count


@pytest.mark.parametrize("max_rows,floor", [(1, 1 << 20), (7, 1 << 20), (50, 20), (10_000, 1 << 20)])
def test_capped_against_brute_force(spark, max_rows, floor):
    rows, df = lopsided(spark, 300)
    _, count, _ = brute(rows, max_rows)
    got = ft.with_unique_dports(df, max_rows=max_rows, floor=floor).collect()
    assert {r["seq"]: r["unique_dports_15s"] for r in got} == count


@pytest.mark.parametrize("floor,piece_rows", [(1 << 20, 1 << 20), (30, 1 << 20), (30, 4), (5, 1)])
def test_ordered_scans_against_brute_force(spark, floor, piece_rows):
    rows, df = lopsided(spark, seed=11)
    gap, _, index = brute(rows)
    got = ft.with_time_diff(df, floor=floor, piece_rows=piece_rows).collect()
    assert {r["seq"]: r["time_diff"] for r in got} == pytest.approx(gap)
    got = ft.with_arrival_index(df, floor=floor, piece_rows=piece_rows).collect()
    assert {r["seq"]: r["arrival_index"] for r in got} == index


def test_row_order_and_partitions_do_not_matter(packets):
    cols = ["seq", *FEATURES]
    a = sorted(map(tuple, ft.engineer(packets, ["10.0.0.2"]).select(*cols).collect()))
    turned = packets.orderBy(F.rand(1)).repartition(13)
    b = sorted(map(tuple, ft.engineer(turned, ["10.0.0.2"]).select(*cols).collect()))
    assert a == b


def test_vector_fills_nulls(spark):
    df = spark.createDataFrame([(1, None, float("nan"))], "protocol int, dport int, time_diff double")
    assert df.select(ft.feature_vector(df)).first()[0] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_entropy(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int")
    assert ft.value_entropy(df, "v").first()["entropy"] == pytest.approx(1.5)
    assert ft.value_entropy(df.filter("v = 1"), "v").first()["entropy"] == 0.0


def test_approximate_ports_are_close(packets):
    exact = {r[0]: r[1] for r in ft.dports_per_source(packets).collect()}
    near = {r[0]: r[1] for r in ft.dports_per_source(packets, approximate=True).collect()}
    assert exact.keys() == near.keys()
    assert all(abs(near[k] - exact[k]) <= 0.2 * exact[k] for k in exact)
