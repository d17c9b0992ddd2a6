"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, A_Z, A_Z.lower())


def text_key(text: Column) -> Column:
    """Names a text by its content; rows with equal texts share it, null has none."""
    return F.md5(text)


def n_alnum_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """How many parts of about ``each`` rows: at least Spark's own number of shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Names for working columns that the rows do not have yet."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row.

    A filter on a plain column is moved below it with the column's expression in its place, also into
    lambdas, where it would then be computed for each element. No filter moves below a generator.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))
