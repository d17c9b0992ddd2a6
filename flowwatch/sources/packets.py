"""Packet tables and streams: reading, and settling raw records into packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowwatch.functions.coerce import text_as_int, text_to_double
from flowwatch.schemas import PACKET


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(PACKET).load(path)


def read_packet_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(PACKET)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def _settle(raw: DataFrame) -> DataFrame:
    tcp = F.col("tcp_sport").isNotNull() | F.col("tcp_dport").isNotNull()
    udp = F.col("udp_sport").isNotNull() | F.col("udp_dport").isNotNull()

    def port(side: str):
        # The pair comes from one layer: TCP first, then UDP, else 0.
        chosen = F.when(tcp, F.col(f"tcp_{side}")).when(udp, F.col(f"udp_{side}")).otherwise("0")
        return chosen.try_cast("int")

    return raw.filter("has_ip").select(
        "seq",
        "sensor_id",
        F.round(text_to_double(F.coalesce("time", F.lit("0"))) * 1e6).try_cast("bigint").alias("ts_us"),
        F.coalesce("src", F.lit("")).alias("src_ip"),
        F.coalesce("dst", F.lit("")).alias("dest_ip"),
        F.coalesce("proto", F.lit("0")).try_cast("int").alias("protocol"),
        text_as_int(F.col("length")).try_cast("int").alias("packet_size"),
        port("sport").alias("sport"),
        port("dport").alias("dport"),
    )


def _readable():
    return (
        F.col("ts_us").isNotNull()
        & F.col("protocol").isNotNull()
        & F.col("packet_size").isNotNull()
        & F.col("sport").isNotNull()
        & F.col("dport").isNotNull()
    )


def normalize_packets(raw: DataFrame) -> DataFrame:
    """IP records as packets. Records with an unreadable field are left to ``rejected_packets``."""
    return _settle(raw).filter(_readable())


def rejected_packets(raw: DataFrame) -> DataFrame:
    return _settle(raw).filter(~_readable())
