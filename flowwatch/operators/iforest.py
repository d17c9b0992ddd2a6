"""Isolation forest on DataFrames, after Liu, Ting and Zhou, "Isolation Forest", ICDM 2008."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from flowwatch.schemas import NODE

SUBSAMPLE = 256
EULER_GAMMA = 0.5772156649015329
_HEX_DIGITS = 15
_PRIME = (1 << 31) - 1
_SAMPLE_ROWS = 4096
_MERGE_GROUPS = 64


def average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of ``n`` leaves."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    many = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, many))


def row_hash(*parts: Column) -> Column:
    """A uniform hex text per row that does not depend on partitioning."""
    return F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, _HEX_DIGITS)


def tree_factors(seed: int, tree_id: int) -> tuple[int, int]:
    """The tree's two random factors below the hash prime."""
    digest = hashlib.md5(f"{seed}:{tree_id}".encode()).hexdigest()
    return 1 + int(digest[:15], 16) % (_PRIME - 1), 1 + int(digest[15:30], 16) % (_PRIME - 1)


def sample_trees(
    rows: DataFrame,
    n_rows: int,
    n_trees: int,
    seed: int = 42,
    subsample: int = SUBSAMPLE,
    key: tuple[str, ...] = ("sensor_id", "seq"),
) -> DataFrame:
    """``tree_id, rank`` and the row, for each tree's sample without replacement.

    Every row gets one md5 of the seed and its key, cut in two numbers. A tree orders rows
    by a linear hash of the two modulo a prime, with the tree's own random factors, and
    takes the smallest. So a sample depends on neither partitioning nor row order, and the rule is the same for
    tables of any size.

    Each task holds the smallest rows of each tree as it reads, ``subsample`` of them and ties; what tasks hold is merged in two
    steps, first by tree and a few groups of tasks, then by tree.
    """
    psi = min(subsample, n_rows)
    halves = {
        f"_{n}": F.conv(F.substring(row_hash(F.lit(seed), *[F.col(k) for k in key]), at, 7), 16, 10).cast("bigint")
        for n, at in (("high", 1), ("low", 8))
    }
    hashed = rows.withColumns(halves)
    factors = np.array([tree_factors(seed, t) for t in range(n_trees)], dtype=np.int64).reshape(-1, 2)
    kept = StructType([*hashed.schema.fields, StructField("tree_id", IntegerType()), StructField("_order", LongType())])
    held = hashed.mapInArrow(_smallest(factors, psi), kept).withColumn("_group", F.spark_partition_id() % _MERGE_GROUPS)
    some = _lowest(held, ["tree_id", "_group"], key, psi)
    return _lowest(some, ["tree_id"], key, psi).drop("_order", "_high", "_low", "_group")


def _lowest(rows: DataFrame, keys: list[str], key: tuple[str, ...], psi: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("_order", *key)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= psi)


def _smallest(factors: np.ndarray, psi: int):
    """Of the rows of a task, for each tree the ``psi`` smallest in its order and those that tie with the last of them."""
    a, b = factors.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Above its cut no row can be among a tree's smallest any more.
        cut = np.full(len(a), _PRIME, dtype=np.int64)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, _SAMPLE_ROWS):
                part = batch.slice(at, _SAMPLE_ROWS)
                high, low = (part.column(n).to_numpy()[:, None] for n in ("_high", "_low"))
                order = (high * a + low * b) % _PRIME
                if part.num_rows > psi:
                    np.minimum(cut, np.partition(order, psi - 1, axis=0)[psi - 1], out=cut)
                row, tree = np.nonzero(order <= cut)
                found = part.take(pa.array(row))
                held.append(found.append_column("tree_id", pa.array(tree, pa.int32())).append_column("_order", pa.array(order[row, tree])))
                if sum(h.num_rows for h in held) > 2 * psi * len(a) + _SAMPLE_ROWS:
                    held = [_pruned(held, cut, psi)]
        if held:
            yield _pruned(held, cut, psi)

    return run


def _pruned(held: list[pa.RecordBatch], cut: np.ndarray, psi: int) -> pa.RecordBatch:
    """The rows that can still count; lowers the cut of each tree that has enough."""
    rows = pa.Table.from_batches(held).combine_chunks()
    tree, order = (rows.column(n).to_numpy() for n in ("tree_id", "_order"))
    by = np.lexsort((order, tree))
    first = np.searchsorted(tree[by], np.arange(len(cut) + 1))
    full = np.flatnonzero(np.diff(first) >= psi)
    cut[full] = order[by[first[full] + psi - 1]]
    return rows.filter(pa.array(order <= cut[tree])).combine_chunks().to_batches(max_chunksize=None)[0] if len(order) else held[0]


def grow_tree(tree_id: int, x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes of one tree over a small sample, grown a level at a time.

    A node with more than one distinct row above the depth limit is cut at a uniform point
    of a random feature that varies in it.
    """
    nodes: list[tuple] = []
    ids, next_id = np.array([0]), 1
    groups = np.zeros(len(x), dtype=np.int64)  # position in ids of each row's node
    for depth in range(max_depth + 1):
        order = np.argsort(groups, kind="stable")
        part = x[order]
        starts = np.searchsorted(groups[order], np.arange(len(ids)))
        sizes = np.diff(np.append(starts, len(part)))
        low, high = np.minimum.reduceat(part, starts), np.maximum.reduceat(part, starts)
        varies = high > low
        split = varies.any(axis=1) & (depth < max_depth)
        feature = np.where(varies, rng.random(varies.shape), -1.0).argmax(axis=1)
        at = np.arange(len(ids)), feature
        # Below the maximum, so that both sides get rows.
        cut = np.minimum(low[at] + rng.random(len(ids)) * (high[at] - low[at]), np.nextafter(high[at], low[at]))
        child = next_id + 2 * (np.cumsum(split) - 1)
        for i in range(len(ids)):
            if split[i]:
                ends = int(feature[i]), float(cut[i]), int(child[i]), int(child[i]) + 1
            else:
                ends = -1, 0.0, -1, -1
            nodes.append((tree_id, int(ids[i]), *ends, depth, int(sizes[i])))
        if not split.any():
            break
        node = groups[order]
        going = split[node]
        rows, node = part[going], node[going]
        right = rows[np.arange(len(rows)), feature[node]] > cut[node]
        x = rows
        groups = 2 * (np.cumsum(split) - 1)[node] + right
        ids = np.repeat(child[split], 2) + np.tile([0, 1], int(split.sum()))
        next_id += len(ids)
    return nodes


def grow_forest(samples: DataFrame, seed: int, column: str = "features", subsample: int = SUBSAMPLE) -> DataFrame:
    """Node table of the forest. A group is one tree's sample, at most ``subsample`` rows."""
    names = NODE.fieldNames()

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(key[0])
        ordered = group.sort_values("rank")
        x = np.vstack(ordered["x"].to_numpy())
        max_depth = max(1, math.ceil(math.log2(max(len(x), 2))))
        nodes = grow_tree(tree_id, x, np.random.default_rng([seed, tree_id]), max_depth)
        return pd.DataFrame(nodes, columns=names)

    return (
        samples.select("tree_id", "rank", F.col(column).alias("x")).groupBy("tree_id").applyInPandas(grow, NODE)
    )


class Forest:
    """Node arrays of a forest, small by construction (trees x 2 subsample nodes)."""

    def __init__(self, nodes: pd.DataFrame, subsample: int):
        nodes = nodes.sort_values(["tree_id", "node_id"])
        sizes = nodes.groupby("tree_id").size()
        base = sizes.cumsum().shift(fill_value=0)
        offset = nodes["tree_id"].map(base).to_numpy()
        leaf = nodes["feature_idx"].to_numpy() < 0
        here = np.arange(len(nodes))
        self.roots = base.to_numpy()
        self.feature = np.where(leaf, 0, nodes["feature_idx"].to_numpy()).astype(np.int32)
        self.cut = np.where(leaf, np.inf, nodes["cut"].to_numpy())
        # A leaf leads to itself, so every walk takes the same number of steps.
        left = np.where(leaf, here, nodes["left"].to_numpy() + offset)
        right = np.where(leaf, here, nodes["right"].to_numpy() + offset)
        self.children = np.column_stack([left, right]).ravel().astype(np.int32)
        self.path = nodes["depth"].to_numpy() + average_path(nodes["n"].to_numpy())
        self.steps = int(nodes["depth"].max()) if len(nodes) else 0
        self.norm = max(float(average_path(subsample)), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """``-2 ** (-mean path / c)``: near -1 for outliers, towards 0 for ordinary rows."""
        total = np.zeros(len(x))
        flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
        row = np.arange(len(x), dtype=np.int64) * width
        for root in self.roots:
            at = np.full(len(x), root, dtype=np.int32)
            for _ in range(self.steps):
                above = flat[row + self.feature[at]] > self.cut[at]
                at = self.children[2 * at + above]
            total += self.path[at]
        return -np.exp2(-total / len(self.roots) / self.norm)


def raw_score(rows: DataFrame, forest: Forest, scaled: list[Column]) -> Column:
    """Score of the scaled features. The forest is sent to each executor once.

    Marked as not deterministic, though it is: a filter on the score is then not moved below it with a copy of the walk,
    so each row walks the forest once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.column_stack([f.to_numpy() for f in features])))

    return score.asNondeterministic()(*scaled)


def _running(partition: list[str], order: str) -> Window:
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _holding(counts: DataFrame, partition: list[str], order: str) -> DataFrame:
    """Of counted buckets, those that hold the lower or upper rank; ``before`` is updated to the
    rows ahead of the bucket."""
    start = F.col("before") + F.sum("n").over(_running(partition, order)) - F.col("n")
    return counts.withColumn("before", start).filter(
        "lower between before and before + n - 1 or upper between before and before + n - 1"
    )


def exact_quantile(
    scores: DataFrame, q: float, column: str = "score", low: float = -1.0, high: float = 0.0, bins: int = 1 << 20
) -> DataFrame:
    """The q-quantile with linear interpolation, exact, as one row ``quantile``.

    Values between ``low`` and ``high`` are counted in ``bins`` equal bins, then the one or two
    bins holding the ranks in question are cut the same way, and only what falls into their
    cells is counted value by value. Two cuts leave a cell no wider than a few thousand
    doubles of the score's range, so every table here is bounded. Values outside the range
    share the outermost bins, which is still exact.
    """
    width = (high - low) / bins

    def cell(start: str, size: float) -> Column:
        at = F.expr(f"floor((_x - ({start})) / {size!r}D)")
        return F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("bigint")

    x = F.col(column)
    binned = scores.filter(x.isNotNull() & ~F.isnan(x)).select(x.alias("_x")).withColumn("_bin", cell(f"{low!r}D", width))
    counts = binned.groupBy("_bin").agg(F.count("*").alias("n"))
    position = F.lit(float(q)) * counts.agg((F.sum("n") - 1).alias("last")).scalar()
    ranks = ["pos", "lower", "upper"]
    # A window over all bins, of which there are at most ``bins``.
    first = _holding(
        counts.withColumns({"pos": position, "before": F.lit(0).cast("bigint")}).withColumns(
            {"lower": F.floor("pos"), "upper": F.ceil("pos")}
        ),
        [],
        "_bin",
    ).select("_bin", "before", *ranks)
    # One or two rows are broadcast here and below.
    inner = binned.join(F.broadcast(first), "_bin").withColumn(
        "_cell", cell(f"{low!r}D + _bin * {width!r}D", width / bins)
    )
    cells = inner.groupBy("_bin", "_cell", "before", *ranks).agg(F.count("*").alias("n"))
    second = _holding(cells, ["_bin"], "_cell").select("_bin", "_cell", F.col("before").alias("ahead"))
    values = (
        inner.drop("before")
        .join(F.broadcast(second), ["_bin", "_cell"])
        .groupBy("_bin", "_cell", "_x", F.col("ahead").alias("before"), *ranks)
        .agg(F.count("*").alias("n"))
    )
    return (
        _holding(values, ["_bin", "_cell"], "_x")
        .agg(
            F.max(F.expr("if(lower between before and before + n - 1, _x, null)")).alias("a"),
            F.max(F.expr("if(upper between before and before + n - 1, _x, null)")).alias("b"),
            F.max(F.expr("pos - lower")).alias("part"),
        )
        .select(F.expr("a + (b - a) * part").alias("quantile"))
    )


def predict(score: Column) -> Column:
    return F.when(score < 0, "Anomaly").otherwise("Normal")
