"""The queries of this folder over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowwatch.llm import (
    decontaminate,
    jaccard_join,
    licences,
    line_frequency,
    line_templates,
    lm_score,
    merkle,
    pieces,
    quality_classifier,
    sharding,
    simhash,
    token_align,
    url_filter,
)
from flowwatch.llm.tables import read
from flowwatch.session import share_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_decontaminate(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    judged = decontaminate.judge(docs, read(spark, sf, "benchmark"))
    items = F.col("overlap.items")
    return judged.select(
        "doc_id",
        "overlap.n_words",
        "overlap.n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        "overlap.contaminated",
    )


@query
def op3_jaccard_join(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    joined = jaccard_join.join(docs, n=3, percent=90)
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


#: Host, path and verdict of each rule.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op2_url_filter(spark, sf):
    """Listed are the addresses that two or more pages claim."""
    pages = read(spark, sf, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    address = url_filter.canonical(F.col("url"))
    listed = pages.groupBy(address.alias("a")).agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url")).where("a is not null and n > 1")
    judged = url_filter.judge(pages, rules, listed)
    return judged.select("page_id", "url_filter.host", "url_filter.path", "url_filter.rule", "url_filter.verdict", "url_filter.listed")


@query
def op5_sharding(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source", "text")
    return sharding.shard(docs, 8).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


@query
def op7_line_frequency(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source", "text")
    judged = line_frequency.judge(docs, long_lines=True)
    return judged.select(
        "doc_id", "base.n_words", "base.word_chars", "base.n_symbols", "base.n_dup_lines", "base.n_repeat_words",
        F.col("base.failed").alias("base_failed"), "lines.kept", "lines.n_removed_words",
    )


@query
def op9_line_templates(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    cleaned = line_templates.dedup_lines(docs)
    return cleaned.select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.size("line_dedup.templates").cast("long").alias("n_templates"), F.md5("text").alias("text_md5")
    )


@query
def op4_licences(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    found = licences.label(docs, licences.TEMPLATES)
    return found.select(
        "doc_id",
        F.size("licences.matches").cast("long").alias("n_matches"),
        F.concat_ws(",", "licences.names").alias("licences"),
        F.col("licences.best.licence").alias("best"),
        F.col("licences.best.dice").alias("best_dice"),
    )


@query
def op6_lm_score(spark, sf):
    """The target are the documents labelled as of good quality."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    target = read(spark, sf, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(docs, target).withColumnRenamed("id", "doc_id")


@query
def op8_pieces(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    tripped = pieces.round_trip(docs)
    return tripped.select(
        "doc_id",
        F.size("pieces.ids").cast("long").alias("n_pieces"),
        F.xxhash64("pieces.ids").alias("ids_hash"),
        F.md5("pieces.decoded").alias("decoded_md5"),
        "pieces.lossless",
    )


def held_out(key: Column) -> Column:
    """One in four documents, on which scores can be checked."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


@query
def op10_quality_classifier(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    labels = read(spark, sf, "labels").select("doc_id", "quality")
    scored = quality_classifier.classify(docs, labels, learn=~held_out(F.col("doc_id")))
    return scored.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op11_merkle_manifest(spark, sf):
    """Trees by language; in one document of seven the count of characters is changed after the manifest was made."""
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    changed = {c: F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in fields}
    tampered = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0, merkle.leaf(*changed.values()))
    manifest = merkle.build(docs, "lang", "doc_id", merkle.leaf(*map(F.col, fields)), tampered)
    audited = merkle.audit(manifest)
    return audited.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified"
    )


@query
def op12_simhash(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, n=3, within=2).withColumnRenamed("id", "doc_id")


@query
def op13_token_align(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return token_align.score(docs).withColumnRenamed("id", "doc_id")
