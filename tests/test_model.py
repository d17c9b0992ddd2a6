from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwatch.operators import iforest as fo, model as md, scaler as sc
from flowwatch.operators.features import engineer
from flowwatch.plans import train
from flowwatch.schemas import FEATURES
from flowwatch.sources import fixtures as fx


def matrix(spark, n, d, seed=0, shift=None):
    x = np.random.default_rng(seed).normal(size=(n, d))
    if shift is not None:
        x[-3:] += shift
    names = [f"f{i}" for i in range(d)]
    rows = [("s", i, *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, ["sensor_id", "seq", *names]), names


def scores(df):
    return {r["seq"]: r["score"] for r in df.select("seq", "score").collect()}


PARAMS = md.Params(n_estimators=30)


@pytest.fixture(scope="module")
def trained(spark):
    df, names = matrix(spark, 200, 4, shift=9.0)
    return df, md.fit(df, PARAMS, names=names, trained_at="2024-01-01T00:00:00+00:00")


def test_outliers_score_below_the_median(trained):
    df, model = trained
    s = scores(model.with_score(df))
    assert max(s[q] for q in (197, 198, 199)) < np.median(list(s.values()))
    assert {197, 198, 199} <= {r["seq"] for r in model.with_label(df).filter("label = 'Anomaly'").collect()}


def test_share_of_anomalies_is_the_contamination(trained):
    df, model = trained
    assert model.with_label(df).filter("label = 'Anomaly'").count() == 10


def test_same_seed_same_model_whatever_the_partitions(trained):
    df, model = trained
    again = md.fit(df.orderBy(F.rand(4)).repartition(9), PARAMS, names=model.feature_names)
    # The scaler's sums may differ in the last bit, and the cuts with them.
    shape = ["tree_id", "node_id", "feature_idx", "left", "right", "depth", "n"]
    assert again.nodes[shape].equals(model.nodes[shape])
    assert np.allclose(again.nodes["cut"], model.nodes["cut"], rtol=0, atol=1e-9)
    assert again.offset == pytest.approx(model.offset, abs=1e-9)
    other = md.fit(df, md.Params(n_estimators=30, random_state=7), names=model.feature_names)
    assert not other.nodes.equals(model.nodes)


def test_column_order_does_not_matter(trained):
    df, model = trained
    turned = df.select("seq", "f3", "f1", "f0", "f2")
    assert scores(model.with_score(df)) == scores(model.with_score(turned))


def test_round_trip(spark, trained, tmp_path):
    df, model = trained
    md.save(model, spark, str(tmp_path / "m"))
    loaded = md.load(spark, str(tmp_path / "m"))
    assert scores(loaded.with_score(df)) == scores(model.with_score(df))
    assert loaded.meta() == model.meta()


def test_missing_and_incomplete_bundles(spark, trained, tmp_path):
    with pytest.raises(FileNotFoundError):
        md.load(spark, str(tmp_path / "none"))
    trained[1].metadata(spark).write.parquet(str(tmp_path / "part" / "meta"))
    with pytest.raises(RuntimeError):
        md.load(spark, str(tmp_path / "part"))


def test_parameter_rules():
    for bad in ({"contamination": 0.0}, {"contamination": 0.6}, {"n_estimators": 9}):
        with pytest.raises(ValueError):
            md.Params(**bad)


def test_empty_training_raises(spark):
    df, names = matrix(spark, 1, 2)
    with pytest.raises(ValueError):
        md.fit(df.filter("seq < 0"), PARAMS, names=names)


def test_metadata(spark, packets):
    model = train.train_on_packets(packets, fx.LOCAL_IPS, md.Params(n_estimators=10))
    meta = model.metadata(spark).first()
    assert meta["feature_names"] == FEATURES
    assert len(meta["feature_checksum"]) == 64
    assert meta["version"] == "1.0.0"
    assert meta["feature_count"] == 7


def test_scaler_keeps_constant_columns(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<double>")
    got = [(r["mean"], r["scale"]) for r in sc.fit_scaler(df, ["a", "b"]).orderBy("feature_idx").collect()]
    assert got == [(2.0, 1.0), (5.0, 1.0)]


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.333, 1.0])
def test_exact_quantile(spark, q):
    x = np.random.default_rng(1).normal(size=999)
    x[:300] = x[0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "score double")
    got = fo.exact_quantile(df, q, low=-1.0, high=1.0, bins=16).first()["quantile"]
    assert got == pytest.approx(np.quantile(x, q), abs=1e-12)


def test_trees_cover_their_samples():
    x = np.random.default_rng(0).normal(size=(256, 3))
    x[:90] = x[0]
    nodes = fo.grow_tree(0, x, np.random.default_rng(1), 8)
    leaves = [n for n in nodes if n[2] < 0]
    assert sum(n[7] for n in leaves) == 256 and max(n[6] for n in nodes) <= 8
    assert all(n[7] > 0 for n in leaves)


def test_samples_are_distinct_and_thinned_alike(spark):
    df = spark.range(20_000).select(F.lit("s").alias("sensor_id"), F.col("id").alias("seq"))
    sample = fo.sample_trees(df, 20_000, 12, subsample=64)
    per_tree = sample.groupBy("tree_id").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("d")).collect()
    assert [(r["n"], r["d"]) for r in per_tree] == [(64, 64)] * 12
    again = fo.sample_trees(df.repartition(5), 20_000, 12, subsample=64)
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, again.select(sample.columns).collect()))


@pytest.mark.parametrize("n", [10, 64, 65, 3071, 3072, 3073, 9000])
def test_samples_follow_one_rule_at_every_size(spark, n):
    """Each tree takes the rows of the smallest hashes, on tables of any size, in any partitions."""
    df = spark.range(n).select(F.lit("s").alias("sensor_id"), F.col("id").alias("seq")).repartition(6)
    got = {}
    for r in fo.sample_trees(df, n, 12, subsample=64).collect():
        got.setdefault(r["tree_id"], []).append((r["rank"], r["seq"]))
    want = {}
    for t in range(12):
        a, b = fo.tree_factors(42, t)
        digest = {q: hashlib.md5(f"42:s:{q}".encode()).hexdigest() for q in range(n)}
        order = sorted(range(n), key=lambda q: ((int(digest[q][:7], 16) * a + int(digest[q][7:14], 16) * b) % ((1 << 31) - 1), q))
        want[t] = list(enumerate(order[:64], 1))
    assert {t: sorted(v) for t, v in got.items()} == want


def test_a_task_holds_few_rows_of_each_tree(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(fo, "_SAMPLE_ROWS", 50)
    rng = np.random.default_rng(1)
    factors = np.array([fo.tree_factors(1, t) for t in range(3)], dtype=np.int64)
    rows = [pa.RecordBatch.from_pydict({"_high": rng.integers(0, 1 << 28, 1000), "_low": rng.integers(0, 1 << 28, 1000)}) for _ in range(5)]
    held = list(fo._smallest(factors, 20)(iter(rows)))
    assert len(held) == 1 and held[0].num_rows == 60
    assert list(fo._smallest(factors, 20)(iter([]))) == []


def test_retrain_needs_fifty_rows(packets):
    rolling = engineer(packets, fx.LOCAL_IPS)
    assert train.retrain(rolling.filter("seq < 49"), md.Params(n_estimators=10)) is None
    times = sorted(r["ts_us"] for r in rolling.select("ts_us").collect())
    model = train.retrain(rolling, md.Params(n_estimators=10), span_us=times[-1] - times[-61])
    assert model.subsample == 60
    assert train.retrain(rolling, md.Params(n_estimators=10)).subsample == 256
