"""Standard scaling with population deviation; constant columns keep scale 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fit_scaler(vectors: DataFrame, names: list[str], column: str = "features") -> DataFrame:
    """One row per feature: ``feature_idx, name, mean, scale, n_rows``, from one aggregate pass."""
    aggs = [F.count("*").alias("n")]
    for i, _ in enumerate(names):
        x = F.get(F.col(column), F.lit(i))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("feature_idx"),
                F.lit(n).alias("name"),
                F.col(f"m{i}").alias("mean"),
                F.when(F.col(f"s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("scale"),
                F.col("n").alias("n_rows"),
            )
            for i, n in enumerate(names)
        ]
    )
    return vectors.agg(*aggs).select(F.inline(rows))


def scaled(columns: list[Column], means: list[float], scales: list[float]) -> list[Column]:
    """The scaled features, given a fitted scaler's few numbers."""
    return [(c - F.lit(m)) / F.lit(s) for c, m, s in zip(columns, means, scales)]
