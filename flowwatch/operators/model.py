"""The anomaly model: scaler, forest and offset, with save and load."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowwatch.operators.features import zero_filled
from flowwatch.operators.iforest import SUBSAMPLE, Forest, exact_quantile, grow_forest, predict, raw_score, sample_trees
from flowwatch.operators.scaler import fit_scaler, scaled
from flowwatch.schemas import FEATURES, NODE
from flowwatch.session import Scratch

VERSION = "1.0.0"
_META = (
    "version string, trained_at string, feature_names array<string>, feature_count int, "
    "feature_checksum string, contamination double, n_estimators int, random_state int, "
    "subsample int, offset double"
)


@dataclass(frozen=True)
class Params:
    contamination: float = 0.05
    n_estimators: int = 200
    random_state: int = 42

    def __post_init__(self):
        if not 0.0 < self.contamination <= 0.5:
            raise ValueError("contamination must be in (0, 0.5]")
        if self.n_estimators < 10:
            raise ValueError("n_estimators must be at least 10")


@dataclass(frozen=True)
class Model:
    """Everything here is small: a few numbers per feature and the forest's nodes."""

    feature_names: list[str]
    means: list[float]
    scales: list[float]
    nodes: pd.DataFrame
    subsample: int
    offset: float
    params: Params
    trained_at: str = ""

    def columns(self, df: DataFrame) -> list[Column]:
        """Scaled features by name, whatever the table's column order; absent and null are 0."""
        raw = [zero_filled(F.col(n)) if n in df.columns else F.lit(0.0) for n in self.feature_names]
        return scaled(raw, self.means, self.scales)

    def with_score(self, df: DataFrame) -> DataFrame:
        """Decision score: below zero is anomalous."""
        raw = raw_score(df, Forest(self.nodes, self.subsample), self.columns(df))
        return df.withColumn("score", raw - F.lit(self.offset))

    def with_label(self, df: DataFrame) -> DataFrame:
        return self.with_score(df).withColumn("label", predict(F.col("score")))

    def checksum(self) -> str:
        names = ",".join(self.feature_names)
        return hashlib.sha256(names.encode()).hexdigest() if names else ""

    def meta(self) -> dict:
        return {
            "version": VERSION,
            "trained_at": self.trained_at,
            "feature_names": list(self.feature_names),
            "feature_count": len(self.feature_names),
            "feature_checksum": self.checksum(),
            "contamination": self.params.contamination,
            "n_estimators": self.params.n_estimators,
            "random_state": self.params.random_state,
            "subsample": self.subsample,
            "offset": self.offset,
        }

    def metadata(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([self.meta()], _META)


def fit(
    features: DataFrame,
    params: Params = Params(),
    names: list[str] | None = None,
    key: tuple[str, ...] = ("sensor_id", "seq"),
    trained_at: str | None = None,
    subsample: int = SUBSAMPLE,
) -> Model:
    """Train on a feature table that has the key columns. This runs jobs.

    The result depends on the rows and the seed only, not on partitions or row order, but for
    the last bits of the scaler's sums.
    """
    names = names or FEATURES
    raw = [zero_filled(F.col(n)).alias(f"x{i}") if n in features.columns else F.lit(0.0).alias(f"x{i}") for i, n in enumerate(names)]
    with Scratch(features.sparkSession) as scratch:
        # Three passes read these rows, so the costly feature plan runs once.
        rows = scratch.keep(features.select(*key, *raw), "features")
        return _fit(rows, params, names, key, trained_at, subsample, scratch)


def _fit(rows: DataFrame, params: Params, names: list[str], key: tuple[str, ...], trained_at: str | None, subsample: int, scratch: Scratch) -> Model:
    vector = F.array(*[F.col(f"x{i}") for i in range(len(names))])
    stats = fit_scaler(rows.select(vector.alias("features")), names).orderBy("feature_idx").collect()
    n_rows = stats[0]["n_rows"]
    if n_rows == 0:
        raise ValueError("no features provided for training")
    means, scales = [r["mean"] for r in stats], [r["scale"] for r in stats]

    columns = scaled([F.col(f"x{i}") for i in range(len(names))], means, scales)
    points = rows.select(*key, *[c.alias(f"x{i}") for i, c in enumerate(columns)])
    samples = sample_trees(points, n_rows, params.n_estimators, params.random_state, subsample, key).select(
        "tree_id", "rank", vector.alias("features")
    )
    psi = min(subsample, n_rows)
    # The node table is bounded by trees x 2 subsample rows.
    nodes = grow_forest(samples, params.random_state).toPandas().sort_values(["tree_id", "node_id"], ignore_index=True)

    raw_scores = points.select(
        raw_score(points, Forest(nodes, psi), [F.col(f"x{i}") for i in range(len(names))]).alias("score")
    )
    offset = exact_quantile(scratch.keep(raw_scores, "scores"), params.contamination).first()["quantile"]
    stamp = trained_at or datetime.now(timezone.utc).isoformat()
    return Model(list(names), means, scales, nodes, psi, float(offset), params, stamp)


def save(model: Model, spark: SparkSession, path: str) -> None:
    scaler = [(i, n, m, s) for i, (n, m, s) in enumerate(zip(model.feature_names, model.means, model.scales))]
    spark.createDataFrame(model.nodes, NODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame(scaler, "feature_idx int, name string, mean double, scale double").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/scaler")
    # Written last: a bundle without it is incomplete.
    model.metadata(spark).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Model:
    def part(name: str) -> pd.DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/{name}").toPandas()
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    nodes, scaler, meta = part("nodes"), part("scaler"), part("meta")
    if nodes is None and scaler is None and meta is None:
        raise FileNotFoundError(f"no model bundle at {path}")
    if any(p is None or p.empty for p in (nodes, scaler, meta)):
        raise RuntimeError("model bundle is incomplete")
    scaler, m = scaler.sort_values("feature_idx"), meta.iloc[0]
    return Model(
        feature_names=[str(n) for n in m["feature_names"]],
        means=scaler["mean"].tolist(),
        scales=scaler["scale"].tolist(),
        nodes=nodes,
        subsample=int(m["subsample"]),
        offset=float(m["offset"]),
        params=Params(float(m["contamination"]), int(m["n_estimators"]), int(m["random_state"])),
        trained_at=str(m["trained_at"]),
    )
