"""Writers and readers of the tables jobs leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from flowwatch.functions.severity import log_level
from flowwatch.operators.logs import export_rows
from flowwatch.streaming import versions


def _by_date(dated: DataFrame) -> DataFrame:
    """Rows of a date brought together before a write by date.

    A task then writes few dates and a date is few files: adaptive execution cuts a large date and joins
    small ones by size.
    """
    return dated.hint("rebalance", "event_date")


def append_rolling(rows: DataFrame, path: str) -> None:
    """Append engineered packets once each, by day, so that readers can prune days."""
    dated = rows.withColumn("event_date", F.to_date(F.timestamp_micros("ts_us")))
    _by_date(dated).write.mode("append").partitionBy("event_date").parquet(path)


def read_rolling(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rolling table in the given schema; files written with fewer columns give NULL there.

    Without a schema all files are opened to find the columns that any of them has.
    """
    if schema is None:
        return spark.read.option("mergeSchema", True).parquet(path)
    return spark.read.schema(schema).parquet(path)


def replace_dates(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Rows that replace the dates they have in a table by day; other dates stay as they are.

    Files are staged and take the place of the old ones when the whole write has succeeded.
    """
    dated = _by_date(rows.withColumn("event_date", F.to_date(ts)))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def write_dated(table: DataFrame, path: str, ts: str = "ts") -> int:
    """A new version of an alert or block table, by day; returns its number.

    Readers go on with the version before until this one is complete, so ``table`` may be read from the same path.
    """
    done = newest_version(table.sparkSession, path)
    number = 0 if done is None else done + 1
    dated = _by_date(table.withColumn("event_date", F.to_date(ts)))
    dated.write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/version={number}")
    return number


def newest_version(spark: SparkSession, path: str) -> int | None:
    return versions.latest(spark, path, "version", None, "_SUCCESS")


def read_dated(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest complete version, or no rows; ``schema`` is without the date."""
    number = newest_version(spark, path)
    if number is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={number}")


def export_csv(logs: DataFrame, path: str) -> None:
    """Log rows as CSV with a header; NULL is an empty field."""
    export_rows(logs).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def export_json(logs: DataFrame, path: str) -> None:
    """Log rows as one JSON object per line; NULL fields are kept."""
    export_rows(logs).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def with_level(lines: DataFrame, severity: str = "severity") -> DataFrame:
    return lines.withColumn("level", log_level(F.col(severity)))


def write_lines(lines: DataFrame, path: str) -> None:
    """Alert lines (line, severity) as text, in a folder per log level.

    A task has a file open for each of the three levels, so no task sorts its lines by level, which takes memory for all of them.
    """
    conf, name = lines.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, "3")
    try:
        with_level(lines).select(F.col("line").alias("value"), "level").write.mode("append").partitionBy("level").text(path)
    finally:
        conf.set(name, before)
