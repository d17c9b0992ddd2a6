"""Session helpers shared by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# On a cluster these come from spark-defaults; tests and bench use them as is.
# ANSI stays on (the 4.x default), so lenient casts are written as try_cast.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "12g",
}

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB, which state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


@contextmanager
def state_by_core(spark: SparkSession) -> Iterator[None]:
    """Streams that are started in here deal their state to a partition per core, or fewer if shuffles have fewer.

    A partition of state costs about a second in each micro-batch, however few keys it has, while RocksDB holds many keys
    in one. The number stays with the checkpoint.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(1, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_LOCAL_DIRS: dict[str, str] = {}


def local_session(cores: int | str = 8, app: str = "flowwatch", shuffle_partitions: int = 8) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    share_package(spark)
    return spark


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from a source checkout.

    Installed packages and ``--py-files`` need no help; this covers local runs and clusters
    that mount the checkout.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (known, root) if p)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, as in
    tests, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="flowwatch-")
    return _LOCAL_DIRS[app]


class Scratch:
    """Tables for the length of a ``with`` block: written to the shared folder, gone at its end.

    For jobs that have read them through by then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *error) -> None:
        self.drop()

    def drop(self) -> None:
        """The tables go now; new ones may follow."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Lineage ends there, so losing executors costs no recomputation, and later readers get
    column pruning and size statistics. The folder's owner clears it, as with checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
