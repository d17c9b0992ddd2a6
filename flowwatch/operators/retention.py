"""Retention by age, and reading tables written with fewer columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from flowwatch.session import materialize

# Spark reads no folder whose name begins so.
_DROPPED = "_dropped-"


def is_old(ts: Column, days: int | None, as_of: Column, granularity: str = "day") -> Column:
    """Older than ``days`` before ``as_of``; never, for 0 or None.

    ``day`` keeps the whole cutoff day, ``exact`` compares to the second.
    """
    if not days or days <= 0:
        return F.lit(False)
    cutoff = as_of - F.make_dt_interval(days=F.lit(int(days)))
    if granularity == "day":
        old = F.to_date(ts) < F.to_date(cutoff)
    elif granularity == "exact":
        old = ts < cutoff
    else:
        raise ValueError(f"unknown granularity: {granularity}")
    return F.coalesce(old, F.lit(False))


def kept(table: DataFrame, days: int | None, as_of: Column, granularity: str = "day") -> DataFrame:
    """The next version of the table. On a date-partitioned table this prunes partitions."""
    return table.filter(~is_old(F.col("ts"), days, as_of, granularity))


def deleted_counts(
    alerts: DataFrame, blocks: DataFrame, days_alerts: int | None, days_blocks: int | None, as_of: Column
) -> DataFrame:
    a = alerts.select(is_old(F.col("ts"), days_alerts, as_of).alias("a"), F.lit(False).alias("b"))
    b = blocks.select(F.lit(False).alias("a"), is_old(F.col("ts"), days_blocks, as_of).alias("b"))
    return a.unionByName(b).agg(F.count_if("a").alias("alerts"), F.count_if("b").alias("blocks"))


def drop_dates(spark: SparkSession, path: str, days: int | None, as_of: Column, column: str = "event_date") -> DataFrame:
    """Drops the dates older than ``days`` from a table kept in folders by date; none, for 0 or None.

    Returns (date, n_rows) for each. Only these dates are read, to count them; the others are neither read nor written.
    A date leaves the table in one step: its folder is renamed to a name that readers skip, so
    they list it whole or not at all, and then deleted. A run that was cut short can be run again; what it left behind goes then.
    """
    if days is not None and days < 0:
        raise ValueError("a table cannot be kept for a negative number of days")
    table = spark.read.parquet(path)
    if not days:
        return table.limit(0).groupBy(column).agg(F.count("*").alias("n_rows"))
    old = table.filter(F.col(column) < F.to_date(as_of - F.make_dt_interval(days=F.lit(int(days)))))
    gone = materialize(old.groupBy(column).agg(F.count("*").alias("n_rows")), "dropped-dates")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in gone.select(column).collect():  # as many as there are dates
        folder = at(f"{path}/{column}={row[0]}")
        if fs.exists(folder) and not fs.rename(folder, at(f"{path}/{_DROPPED}{uuid.uuid4().hex}")):
            raise OSError(f"{folder} could not be taken out of the table")
    for left in fs.listStatus(at(path)):
        if left.getPath().getName().startswith(_DROPPED):
            fs.delete(left.getPath(), True)
    return gone


def conform(table: DataFrame, schema: StructType) -> DataFrame:
    """The table in a newer schema: missing text columns are '', other missing columns NULL."""
    out = []
    for f in schema.fields:
        if f.name in table.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.dataType.simpleString() == "string":
            out.append(F.lit("").alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return table.select(*out)
