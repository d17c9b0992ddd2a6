"""Cleans ``documents`` for training in five stages, each one of the operators in ``flowwatch.llm``.

Stages take and return the columns of ``documents``; the last returns the encoded documents. Each is
written as Parquet and read again, so a stage works on what its predecessor kept and a lost executor
costs no more than the stage it is in. Nulls, empty texts, repeated rows and extra columns are treated as each
operator's module says; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowwatch.llm import decontaminate, jaccard_join, line_frequency, line_templates, pieces
from flowwatch.llm.tables import fresh, read, text_key
from flowwatch.session import materialize, share_package

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Page furniture goes; documents that fail the base rules or are depleted go."""
    return line_frequency.clean(docs, long_lines=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in the first document only. No document goes.

    Passages that variants share (half of their shingles or more are the same) stay; the next stage links those at 80 percent.
    """
    return line_templates.dedup_lines(docs, copy_percent=50).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, of repeated rows one.

    Five-word shingles, Jaccard similarity 0.8 or more. Documents without words are linked with nothing and
    all stay. Null ids come last.
    """
    joined = jaccard_join.join(docs, n=5, percent=80, spare=50)
    grouped = joined.where("n_shingles > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "text_key")).alias("first")
    # A component of null ids only has no id to be named by: its texts are told apart by their key.
    name = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("text_key"))]
    keepers = grouped.groupBy(*(c.alias(f"g{i}") for i, c in enumerate(name))).agg(first)
    i, k = fresh(docs, "_id", "_key")
    keepers = materialize(keepers.select(F.col("first.id").alias(i), F.col("first.text_key").alias(k)), "keepers")
    keyed = docs.withColumn(k, text_key(F.col("text")))
    worded = F.btrim(F.coalesce("text", F.lit("")), F.lit(line_frequency.SPACE)) != ""
    one = keyed.where(worded).join(keepers.withColumnRenamed(k, f"{k}2"), (F.col(k) == F.col(f"{k}2")) & F.col("doc_id").eqNullSafe(F.col(i)), "left_semi")
    return one.dropDuplicates(["doc_id", k]).unionByName(keyed.where(~worded)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is found in the benchmark go."""
    judged = decontaminate.judge(docs, read(spark, sf_dir, "benchmark"))
    return judged.where("not overlap.contaminated").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, piece_ids and whether they decode to the text again."""
    tripped = pieces.round_trip(docs.select("doc_id", "text"))
    return tripped.select("doc_id", "text", F.col("pieces.ids").alias("piece_ids"), "pieces.lossless")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    share_package(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
