"""Sharding by proportional stratified interleaving.

Rows of each source are put into a seeded random order, and row r of n gets the fractional rank
(r - 1/2) / n. Sorted by it, all sources advance in step, so any run of that order has the mixture of
the whole. The order is cut into equal runs: shard sizes differ by one row at most, and the share of a
source in a shard is off by a row or so.

Neither rank nor place needs a sort in one task. The random key cuts a source into buckets of about
``rows_per_part`` rows and a fraction cuts the order likewise; rows are numbered inside a bucket and
the sums of the buckets before it are added, from a table with one row per bucket.

A null source is a source of its own. Ids and texts may be null; rows are ordered by a hash of
seed, id and text, so equal rows are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowwatch.llm.tables import parts_for
from flowwatch.session import materialize

ROWS_PER_PART = 100_000


def _numbered(rows: DataFrame, groups: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Adds the number of each row, from 0, in its group by (bucket, order)."""
    sizes = rows.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*(groups or [F.lit(0)])).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "starts")
    inside = F.row_number().over(W.partitionBy(*groups, bucket).orderBy(*order)) - 1
    numbered = rows.withColumn("_inside", inside)
    same = [numbered[c].eqNullSafe(starts[c]) for c in [*groups, bucket]]
    return numbered.join(starts, same).select(*(numbered[c] for c in rows.columns), (F.col("_start") + F.col("_inside")).alias(out))


def shard(docs: DataFrame, shards: int, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """One row per document: id, source, size, text_crc32, order (its place in the whole), shard, slot."""
    rows = docs.select(
        F.col(key).alias("id"),
        F.col(source).alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("draw"),
    )
    rows = materialize(rows, "drawn")
    total = rows.count()
    parts = parts_for(docs.sparkSession, total, rows_per_part)
    ties = [F.col("draw"), F.col("id"), F.col("text_crc32"), F.col("size")]
    bucketed = rows.withColumn("part", F.floor((F.shiftright("draw", 32) + (1 << 31)) * parts / F.lit(1 << 32)).cast("int"))
    ranked = _numbered(bucketed, ["source"], "part", ties, "rank").drop("part")
    sizes = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    joined = ranked.join(sizes.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = joined.withColumn("fraction", (F.col("rank") * 2 + 1) / (F.col("n") * 2))
    placed = materialize(placed.withColumn("part", F.least(F.floor(F.col("fraction") * parts), F.lit(parts - 1)).cast("int")), "fractions")
    ordered = _numbered(placed, [], "part", [F.col("fraction"), *ties, F.col("source")], "order")
    # Shard k holds the places from ceil(k * total / shards) on.
    at = F.floor(F.col("order") * shards / F.lit(max(1, total)))
    begins = F.ceil(F.col("shard") * F.lit(total) / shards).cast("long")
    return ordered.withColumn("shard", at.cast("int")).select("id", "source", "size", "text_crc32", "order", "shard", (F.col("order") - begins).alias("slot"))
