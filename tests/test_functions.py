from __future__ import annotations

import ipaddress
import math
import random
from itertools import islice

import pytest
from pyspark.sql import functions as F

from flowwatch.functions import coerce, ips, ports, severity as sv, text as tx


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_text_as_int(spark):
    texts = ["15.2", "not-a-number", "-3.9", " 7 ", "1e3", "nan", "inf", "", None, "1.0d", "0x10"]
    got = column(spark, texts, "string", lambda c: coerce.text_as_int(c, 99))
    assert got == [15, 99, -3, 7, 1000, 99, 99, 99, 99, 99, 99]


def test_number_and_flag_as_int(spark):
    got = column(spark, [12.7, float("nan"), -0.5, 1e300, None], "double", lambda c: coerce.double_as_int(c, -3))
    assert got == [12, -3, 0, -3, -3]
    assert column(spark, [True, False, None], "boolean", lambda c: coerce.bool_as_int(c, 5)) == [1, 0, 5]


def test_text_as_float_keeps_nan(spark):
    got = column(spark, ["3.14", "nan", "x", None, "1"], "string", lambda c: coerce.text_as_float(c, -1.0))
    assert got[0] == 3.14 and math.isnan(got[1]) and got[2:] == [-1.0, -1.0, 1.0]


def test_severity(spark):
    scores = [-0.9, -0.10, -0.3, -0.05, -0.07, 0.0, 0.9, None, float("nan")]
    got = column(spark, scores, "double", sv.severity_of)
    assert got == ["high", "high", "high", "medium", "medium", "low", "low", "unknown", "unknown"]
    levels = column(spark, ["HIGH", "medium", "low", None], "string", sv.log_level)
    assert levels == ["ERROR", "WARNING", "INFO", "INFO"]


def test_thresholds():
    assert sv.Thresholds.parse(" -0.25 , -0.1 ") == sv.Thresholds(-0.25, -0.1)
    assert sv.Thresholds.parse("invalid-value") == sv.Thresholds()
    with pytest.raises(ValueError):
        sv.Thresholds.parse("0.10, -0.05", strict=True)
    with pytest.raises(ValueError):
        sv.Thresholds.parse("x", strict=True)


def addresses():
    rng = random.Random(5)
    out = [
        "", "1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "127.0.0.1", "10.1.1.1", "192.0.0.9", "192.0.0.1",
        "203.0.113.7", "8.8.8.8", "::", "::1", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::ffff:127.0.0.1",
        "fe80::1%eth0", "fe80::1%", "2001:db8::", "2001:4860:4860::8888", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
        "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1::2::3", "1:::2", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:1.2.3.4",
        "1:2:3:4:5::1.2.3.4", "1:2:3:4:5:6::1.2.3.4", "64:ff9b:1::1", "100::1", "2002::1", "fc00::", "fdff::1",
        "2001:1::1", "2001:20::5", "abcde::1", "g::1", "172.31.255.255", "172.32.0.0", "198.19.0.1", "100.64.0.1",
        "255.255.255.255", "0.0.0.0", " 1.2.3.4",
    ]
    for _ in range(150):
        groups = [format(rng.choice([0, 1, 0xFE80, 0x2001, 0xDB8, rng.randint(0, 65535)]), "x") for _ in range(rng.randint(1, 9))]
        cut = rng.randint(0, len(groups))
        out.append(":".join(groups) if rng.random() < 0.4 else ":".join(groups[:cut]) + "::" + ":".join(groups[cut:]))
        out.append(".".join(str(rng.randint(0, 258)) for _ in range(4)))
    return out


def test_ip_class_agrees_with_the_standard_library(spark):
    values = addresses()
    df = spark.createDataFrame([(v,) for v in values], "ip string")
    c = F.col("ip")
    got = df.select("ip", ips.is_ip(c), ips.is_private(c), ips.is_loopback(c)).collect()
    for ip, valid, private, loopback in got:
        try:
            a = ipaddress.ip_address(ip)
            want = (True, a.is_private, a.is_loopback)
        except ValueError:
            want = (False, False, False)
        assert (valid, private, loopback) == want, ip


def test_cidr_hosts_agree_with_the_standard_library(spark):
    nets = ["10.0.0.5/30", "10.0.0.0/31", "10.0.0.9/32", "10.0.0.9", "10.1.2.3/16", "0.0.0.0/0", "192.168.1.77/25"]
    for text, got in zip(nets, column(spark, nets, "string", lambda c: ips.cidr_hosts(c, 256))):
        hosts = []
        net = ipaddress.ip_network(text, strict=False)
        for host in net.hosts() if net.prefixlen < 32 else [net.network_address]:
            hosts.append(str(host))
            if len(hosts) == 256:
                break
        assert got == hosts
    assert column(spark, ["bad/8", "1.2.3.4/33", None], "string", lambda c: ips.cidr_hosts(c, 256)) == [None, None, None]


def test_expanded_targets_agree_with_the_standard_library(spark):
    nets = [
        "10.0.0.5/30", "10.0.0.0/31", "10.0.0.9/32", "10.0.0.9", " 10.1.2.3/20 ", "192.168.1.77/25",
        "2001:db8::/120", "2001:DB8::5/126", "2001:db8::6/127", "2001:db8::7/128", "::1", "fe80::1:0:0:2", "1:0:0:2::3", "::ffff:1.2.3.4", "0:0:1::",
        "fe80::1%eth0", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:fff0/121",
    ]
    large = ["0.0.0.0/0", "::/0", "2001:db8::/64", "2001:db8:ffff::1/33", "8000::/1", "1:2:3:4:8000::/65", "1:2:3:4::/66"]
    bad = ["bad/8", "1.2.3.4/33", "::/129", "fe80::1%eth0/64", "1.2.3.4/", "1.2.3.4/-1", "", None]

    def wanted(text, limit):
        text = text.strip()
        if "/" not in text:
            return [str(ipaddress.ip_address(text))]
        net = ipaddress.ip_network(text, strict=False)
        hosts = net.hosts() if net.prefixlen < net.max_prefixlen else iter([net.network_address])
        return [str(h) for h in islice(hosts, limit)]

    for limit, texts in ((None, nets), (5, nets + large), (70_000, ["10.0.0.0/8", *large])):
        df = spark.createDataFrame([(t,) for t in texts + bad], "cidr string")
        found = {}
        for cidr, host in ips.expand_targets(df, "cidr", limit).collect():
            found.setdefault(cidr, []).append(host)
        assert found.keys() == set(texts)
        for t in texts:
            ordered = found[t] if limit else sorted(found[t], key=lambda h: ipaddress.ip_address(h))
            assert ordered == wanted(t, limit), t


def test_a_network_too_large_for_an_array_is_named(spark):
    with pytest.raises(Exception, match="too many hosts"):
        column(spark, ["0.0.0.0/0"], "string", ips.cidr_hosts)


def test_ports(spark):
    assert column(spark, ["22,x, 80,", None, ""], "string", ports.csv_to_ports) == [[22, 80], [], []]
    many = ",".join(map(str, range(1, 101)))
    assert column(spark, [many], "string", lambda c: ports.csv_to_ports(c, 64)) == [list(range(1, 65))]
    got = column(spark, [[80], [21], [], None], "array<int>", ports.port_risk)
    assert got == ["Medium", "High", "Low", "Low"]


def test_labels(spark):
    labels = ["8.8.8.8:53 score=-0.123", "x SCORE=1e-3 tail", "plain", "", None, "a score=. b"]
    assert column(spark, labels, "string", tx.label_text) == ["8.8.8.8:53", "x", "plain", "", "", "a score=. b"]
    assert column(spark, labels, "string", tx.label_score) == [-0.123, 0.001, None, None, None, None]


def test_ban_expiry(spark):
    df = spark.createDataFrame([(m,) for m in ["5", " 5 ", "0", "-1", "", "abc", "1.5", None]], "m string")
    end = tx.iso_utc(tx.ban_expiry(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.coalesce("m", F.lit(""))))
    got = [r[0] for r in df.select(end).collect()]
    assert got == ["2024-01-01T00:05:00Z"] * 2 + [None] * 6


def test_checksum_of_no_names(spark):
    assert column(spark, [[], ["a", "b"]], "array<string>", lambda c: F.length(tx.feature_checksum(c))) == [0, 64]


def test_a_final_line_feed_is_no_part_of_an_address(spark):
    df = spark.createDataFrame([("1.2.3.4\n",), ("::1\n",), ("1.2.3.4",), ("::1",)], "ip string")
    assert [r[0] for r in df.select(ips.is_ip(F.col("ip"))).collect()] == [False, False, True, True]


def test_caps_are_the_callers(spark):
    df = spark.createDataFrame([("10.0.0.0/22", ",".join(map(str, range(100))))], "cidr string, csv string")
    sizes = df.select(
        F.size(ips.cidr_hosts(F.col("cidr"))), F.size(ips.cidr_hosts(F.col("cidr"), 256)),
        F.size(ports.csv_to_ports(F.col("csv"))), F.size(ports.csv_to_ports(F.col("csv"), 64)),
    ).first()
    assert tuple(sizes) == (1022, 256, 100, 64)


def test_a_length_out_of_range_is_rejected(spark):
    from flowwatch.sources import packets as pk

    raw = spark.createDataFrame(
        [(1, "c", True, "1.5", "a", "b", "6", "3000000000", "1", "2", None, None), (2, "c", True, "1.5", "a", "b", "6", "60", "1", "2", None, None)],
        "seq long, sensor_id string, has_ip boolean, time string, src string, dst string, proto string, length string, tcp_sport string, tcp_dport string, udp_sport string, udp_dport string",
    )
    assert [r.seq for r in pk.normalize_packets(raw).collect()] == [2]
    assert [r.seq for r in pk.rejected_packets(raw).collect()] == [1]
