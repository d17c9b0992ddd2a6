"""URL filters: a blocked Bloom filter before an exact hash join.

Two lists are looked up. ``listed`` holds URLs; they and the judged URLs are made canonical, and a URL
whose canonical form is listed is blocked. ``rules`` hold a host and a path each, with a verdict; a rule
fits its host and all subdomains where the path starts with the rule's, so a URL is looked up under
each parent of its host that has as many labels as some rule's host, and each listed length of path. That is linear in the URL. All keys of both lists go into one Bloom
filter of bounded size, which most keys do not pass. What passes is joined with the lists on the
exact text, which removes false positives.

The longest fitting rule decides (host and path together; of equal ones, that with the longer host); without
one a listed URL is blocked, any other allowed. A null URL, or one without ``://``, has empty host and
path, no canonical form, and is allowed. URLs are judged by their text, so repeated rows agree.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.llm import bloom
from flowwatch.llm.tables import fresh, lower_ascii
from flowwatch.session import materialize

#: Query parameters that only track visits.
TRACKING = ["fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, ``m.``, default port and final dot; path without index page, ``.html``
    and final slash; parameters in order, without those that only track; no fragment."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)\z", ""), r"\.\z", "")
    host = F.regexp_replace(host, r"\A(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?\z", "/"), r"(\.html?|(?<!/)/+)\z", "")
    query = F.split(F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(query, lambda x: (x != "") & ~F.split(x, "=")[0].isin(TRACKING)))
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(F.instr(url, "://") > 0, whole)


def _rule_keys(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """Texts host + newline + path start, for each parent of the host of a listed number of labels and each listed length."""
    labels = F.length(host) - F.length(F.translate(host, ".", "")) + 1
    hosts = F.array_compact(F.array(*(F.when(labels >= n, F.substring_index(host, ".", -n)) for n in depths)).cast("array<string>"))
    starts = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length(path))
    pairs = F.transform(hosts, lambda h: F.transform(starts, lambda n: F.concat(h, F.lit("\n"), F.substring(path, F.lit(1), n))))
    return F.flatten(pairs)


def _passing(table):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(bloom.maybe(table.value, b.column("hash").to_numpy())))

    return run


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", listed_url: str = "url", most_blocks: int = bloom.MOST_BLOCKS) -> DataFrame:
    """The pages with a struct ``url_filter``: host, path, canonical, rule, listed and verdict.

    ``rules`` has host, path and verdict; rows with a null in one of them are ignored, and of rows for
    the same host and path the smallest verdict counts (allow before block).
    """
    spark = pages.sparkSession
    u, found = fresh(pages, "_url", "_found")
    policy = rules.select(lower_ascii(F.col("host")).alias("h"), F.col("path").alias("p"), "verdict").dropna()
    policy = policy.groupBy("h", "p").agg(F.min("verdict").alias("verdict"))
    dots = F.length("h") - F.length(F.translate("h", ".", ""))
    depths = sorted(r.n for r in policy.select((dots + 1).alias("n")).distinct().collect())  # as many as hosts have depths
    lengths = sorted(r.n for r in policy.select(F.length("p").alias("n")).distinct().collect())  # as many as paths have lengths
    entries = policy.select(F.concat("h", F.lit("\n"), "p").alias("entry"), F.struct(F.concat("h", "p").alias("rule"), F.length("h").alias("host_size"), "verdict").alias("rule"))
    entries = entries.unionByName(
        listed.select(F.concat(F.lit("\n"), canonical(F.col(listed_url))).alias("entry")).dropna().distinct(), allowMissingColumns=True
    )
    entries = materialize(entries.withColumn("hash", F.xxhash64("entry")), "url-entries")
    table = spark.sparkContext.broadcast(bloom.build(entries, "hash", most_blocks))

    target = F.col(url)
    one = F.col("url")
    keys = F.concat(_rule_keys(host_of(one), path_of(one), depths, lengths), F.array(F.concat(F.lit("\n"), canonical(one))))
    asked = pages.select(target.alias("url")).where(F.instr(one, "://") > 0).select("url", F.explode(keys).alias("entry"))
    asked = asked.withColumn("hash", F.xxhash64("entry"))
    passed = asked.mapInArrow(_passing(table), "url string, entry string, hash long").distinct()
    exact = passed.join(entries, ["hash", "entry"])
    order = F.struct(F.length("rule.rule").alias("size"), "rule.host_size", "rule.rule", "rule.verdict")
    by_url = exact.groupBy("url").agg(F.max(F.when(F.col("rule").isNotNull(), order)).alias("best"), F.max(F.col("rule").isNull()).alias("listed"))
    by_url = materialize(by_url.select("url", "best.rule", "best.verdict", "listed"), "url-found")
    named = by_url.select(F.col("url").alias(u), F.struct("rule", "verdict", "listed").alias(found))
    on_list = F.coalesce(F.col(f"{found}.listed"), F.lit(False))
    verdict = F.coalesce(F.col(f"{found}.verdict"), F.when(on_list, "block").otherwise("allow"))
    result = F.struct(
        host_of(target).alias("host"), path_of(target).alias("path"), canonical(target).alias("canonical"),
        F.col(f"{found}.rule").alias("rule"), on_list.alias("listed"), verdict.alias("verdict"),
    )
    return pages.join(named, F.col(url) == F.col(u), "left").withColumn("url_filter", result).drop(u, found)
