from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowwatch.operators import signatures as sg


def hits(spark, row, rules=None):
    schema = "unique_dports_15s double, direction double, dport int"
    df = spark.createDataFrame([row], schema)
    return [tuple(r) for r in sg.evaluate(df, sg.default_rules() if rules is None else rules).select("rule", "rule_severity").collect()]


def test_default_rules(spark):
    assert hits(spark, (12.0, 1.0, 80)) == [("port-scan-suspected", "high")]
    assert hits(spark, (1.0, 0.0, 22)) == [("inbound-sensitive-port", "medium")]
    assert hits(spark, (10.0, 0.0, 5900)) == [("port-scan-suspected", "high"), ("inbound-sensitive-port", "medium")]
    assert hits(spark, (9.0, 0.0, 80)) == []


def test_parameters(spark):
    rules = sg.default_rules(threshold=3, ports=[80])
    assert len(hits(spark, (3.0, 0.0, 80), rules)) == 2
    assert hits(spark, (2.0, 0.0, 22), rules) == []


def test_disabled(spark):
    assert hits(spark, (12.0, 0.0, 22), sg.default_rules(enabled=False)) == []


def test_missing_fields_are_zero(spark):
    df = spark.createDataFrame([(1,)], "seq int")
    assert sg.evaluate(df, sg.default_rules()).count() == 0


def test_null_predicate_does_not_match(spark):
    rule = sg.Rule("n", "low", "", F.lit(None).cast("boolean"))
    assert hits(spark, (1.0, 1.0, 1), [rule]) == []


def test_failing_function_rule_gives_no_hit(spark):
    bad = sg.Rule.from_function("bad", "low", "", lambda r: 1 / 0 > 0, ["dport"])
    good = sg.Rule.from_function("good", "low", "", lambda r: r["dport"] == 22, ["dport"])
    assert hits(spark, (1.0, 1.0, 22), [bad, good]) == [("good", "low")]


def test_a_rule_that_cannot_be_computed_gives_no_hit(spark):
    df = spark.createDataFrame([(1, 0, "7", [1]), (2, 2, "x", []), (3, 4, None, [9, 9])], "seq int, d int, t string, a array<int>")
    rules = [
        sg.Rule("ratio", "low", "", F.lit(8) / F.col("d") >= 2),
        sg.Rule("modulo", "low", "", F.lit(8) % F.col("d") == 0),
        sg.Rule("cast", "low", "", F.col("t").cast("int") == 7),
        sg.Rule("element", "low", "", F.col("a")[1] == 9),
        sg.Rule("context", "low", "", F.col("q") > 1, {"q": F.lit(8) / F.col("d")}),
    ]
    got = sorted((r["rule"], r["seq"]) for r in sg.evaluate(df, rules).collect())
    assert got == [("cast", 1), ("context", 2), ("context", 3), ("element", 3), ("modulo", 2), ("modulo", 3), ("ratio", 2), ("ratio", 3)]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    with pytest.raises(ValueError, match="raise_error"):
        sg.evaluate(df, [sg.Rule("r", "low", "", F.raise_error(F.lit("no")).cast("boolean"))])


def test_only_a_failing_batch_is_cut():
    calls = []

    def rule(rows):
        calls.append(len(rows))
        if (rows["v"] == 3).any():
            raise ValueError
        return rows["v"] > 1

    assert sg._matching(rule, pd.DataFrame({"v": [0, 1, 2, 5] * 16})).sum() == 32
    assert calls == [64]
    calls.clear()
    found = sg._matching(rule, pd.DataFrame({"v": [2] * 20 + [3] + [2] * 43}))
    assert not found[20] and found.sum() == 63
    assert len(calls) == 13 and max(calls) == 64  # two for each halving
    assert sg._matching(lambda rows: pd.Series([None, True], dtype="object"), pd.DataFrame({"v": [1, 2]})).tolist() == [False, True]
    assert sg._matching(lambda rows: [True], pd.DataFrame({"v": [1, 2]})).tolist() == [True, True]


def test_context_columns(spark):
    rule = sg.Rule("ctx", "low", "", F.col("twice") > 20, {"twice": F.col("dport") * 2})
    assert hits(spark, (1.0, 1.0, 22), [rule]) == [("ctx", "low")]


def test_rate_limit_against_brute_force(spark):
    rng = random.Random(2)
    rows = [
        (q, "cap0", rng.randint(0, 120) * 500_000, "hot" if q % 3 else f"s{q % 4}", "d", 80, rng.choice("xy"), "high", "t")
        for q in range(500)
    ]
    schema = (
        "seq long, sensor_id string, ts_us long, src_ip string, dest_ip string, dport int, rule string, "
        "rule_severity string, description string"
    )
    got = sg.rate_limited(spark.createDataFrame(rows, schema).repartition(7), 5.0).select("rule", "src_ip", "seq").collect()
    want, last = set(), {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        key, second = (r[6], r[3]), r[2] // 1_000_000
        if key not in last or second >= last[key] + 5:
            last[key] = second
            want.add((*key, r[0]))
    assert {tuple(r) for r in got} == want
