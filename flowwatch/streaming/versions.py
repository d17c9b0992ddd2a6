"""Small tables that a stream carries from one micro-batch to the next.

Each micro-batch writes its own version, so a batch that is run again after a failure reads
what it read before and overwrites what it wrote before.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

KEPT = 10


def before(spark: SparkSession, path: str, batch_id: int, schema: StructType) -> DataFrame:
    """The version the previous micro-batch left; empty before the first one.

    A missing version is an error: going on without it would forget what was known.
    """
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(f"{path}/version={batch_id - 1}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"{path} has no version {batch_id - 1}") from e
        raise


def leave(table: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Write this micro-batch's version and read it back. Versions no batch can need again go."""
    spark = table.sparkSession
    here = f"{path}/version={batch_id}"
    table.write.mode("overwrite").parquet(here)
    if batch_id >= KEPT:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={batch_id - KEPT}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(table.schema).parquet(here)


def add(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Append rows under the micro-batch's own partition, replacing an earlier attempt."""
    here = f"{path}/batch={batch_id}"
    rows.write.mode("overwrite").parquet(here)
    return rows.sparkSession.read.schema(rows.schema).parquet(here)


def add_dated(rows: DataFrame, path: str, batch_id: int, date: Column) -> DataFrame:
    """Append rows by date and micro-batch, replacing an earlier attempt at the same micro-batch, and read them back.

    A date is dealt in pieces, two for each core, so that a large micro-batch of one date is written, and read by what
    follows, on all cores. Adaptive execution joins small ones.
    """
    spark = rows.sparkSession
    pieces = 2 * max(1, spark.sparkContext.defaultParallelism)
    piece = F.pmod(F.xxhash64(*rows.columns), F.lit(pieces))
    dated = rows.withColumns({"event_date": date, "batch": F.lit(batch_id), "_piece": piece}).hint("rebalance", "event_date", "_piece").drop("_piece")
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(path)
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(
        spark._jvm.org.apache.hadoop.fs.Path(f"{path}/event_date=*/batch={batch_id}")
    ):
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(f"{path}/event_date=*/batch={batch_id}")


def latest(spark: SparkSession, path: str, name: str, batch_id: int | None, mark: str) -> int | None:
    """The newest complete ``name=N`` folder, one that holds ``mark``, of a micro-batch before ``batch_id`` if that is given."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}=")]
    done = [n for n in numbers if (batch_id is None or n < batch_id) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}={n}/{mark}"))]
    return max(done, default=None)
