"""Pieces, URL filter, Bloom filter, classifier."""

from __future__ import annotations

import math
import re
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import samples  # noqa: E402
from flowwatch.llm import bloom, pieces, quality_classifier, registry, url_filter, words as wd  # noqa: E402
from flowwatch.llm.tables import read  # noqa: E402

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.MODEL)


CHUNK = re.compile(r" *[^ ]+| +")


def sample(texts, seeds, vocabulary):
    flat, counts = pieces.sample(pa.array(texts, pa.string()), seeds, vocabulary)
    return np.split(flat, np.cumsum(counts)[:-1]) if texts else []


def spell(ids, vocabulary):
    return b"".join(vocabulary.bytes[i] for i in ids)[1:].decode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁\nabethoing"), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_round_trip(vocabulary, texts):
    ids = sample(texts, wd.mix(np.arange(len(texts))), vocabulary)
    assert [spell(x, vocabulary) for x in ids] == texts


def slow_sample(text, seed, vocabulary):
    """The same draws over a lattice of the whole text, in logarithms."""
    out = []
    for number, chunk in enumerate(CHUNK.findall(" " + text)):
        units = [(c, [vocabulary.pieces[c]]) if c in vocabulary.pieces else (c, [vocabulary.byte[x] for x in c.encode()]) for c in chunk]
        ways = [0.0]
        for j in range(1, len(chunk) + 1):
            terms = [ways[i] + vocabulary.log_weight[vocabulary.pieces[chunk[i:j]]] for i in range(j) if chunk[i:j] in vocabulary.pieces]
            if chunk[j - 1] not in vocabulary.pieces:
                terms.append(ways[j - 1] + sum(vocabulary.log_weight[x] for x in units[j - 1][1]))
            top = max(terms)
            ways.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        j, step, back = len(chunk), 0, []
        while j:
            u = pieces._draws(np.array([seed], np.uint64), np.array([number]), step)[0]
            step += 1
            so_far, chosen = 0.0, None
            for i in range(j):
                if chunk[i:j] in vocabulary.pieces:
                    so_far += math.exp(ways[i] + vocabulary.log_weight[vocabulary.pieces[chunk[i:j]]] - ways[j])
                    chosen = (i, [vocabulary.pieces[chunk[i:j]]])
                    if u < so_far:
                        break
            if chunk[j - 1] not in vocabulary.pieces and u >= so_far:
                chosen = (j - 1, units[j - 1][1])
                step += len(chosen[1]) - 1
            back[:0] = chosen[1]
            j = chosen[0]
        out += back
    return out


def test_samples_are_those_of_the_slow_way(vocabulary):
    texts = [t for t in samples.texts() if t is not None and len(t) < 2000] + ["averyveryverylongwordindeedwithoutanyblank" * 8]
    seeds = wd.mix(np.arange(len(texts)))
    for text, seed, ids in zip(texts, seeds, sample(texts, seeds, vocabulary)):
        assert slow_sample(text, seed, vocabulary) == ids.tolist()


def test_samples_follow_the_weights(vocabulary):
    n = 20_000
    seen = Counter(tuple(x.tolist()) for x in sample(["the"] * n, wd.mix(np.arange(n)), vocabulary))
    weight = {k: math.exp(sum(vocabulary.log_weight[i] for i in k)) for k in seen}
    assert len(seen) > 1
    for k, c in seen.items():
        share = weight[k] / sum(weight.values())
        assert abs(c / n - share) < 5 * math.sqrt(share / n) + 2e-4


def test_round_trip_of_a_table(spark):
    rows, docs = samples.documents(spark)
    docs = samples.clashing(docs)
    got = pieces.round_trip(docs)
    assert set(got.columns) == {*docs.columns, "pieces"}
    a = got.select("doc_id", "text", "pieces").collect()
    assert len(a) == len(rows) and all(r.pieces.lossless and r.pieces.decoded == r.text for r in a)
    assert all((r.pieces["ids"] is None) == (r.text is None) for r in a)
    ids = pieces.encode(docs.select("doc_id", "text")).withColumn("again", pieces.decode(F.col("piece_ids")))
    assert ids.where("not (again <=> text)").count() == 0
    b = pieces.round_trip(docs.repartition(3, "lang")).select("doc_id", "text", "pieces").collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))
    other = pieces.round_trip(docs, seed=1).select("doc_id", "text", "pieces").collect()
    assert sorted(map(repr, a)) != sorted(map(repr, other))
    assert pieces.round_trip(docs.limit(0)).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    for most in (1, 50, 1 << 16):
        table = bloom.build(keys, "k", most)
        assert len(table) <= most
        assert bloom.maybe(table, keys.toPandas()["k"].to_numpy()).all()
    others = wd.mix(np.arange(100_000)).view(np.int64)
    assert bloom.maybe(table, others).mean() < 0.01
    assert not bloom.maybe(bloom.build(keys.limit(0), "k"), others).any()


URLS = [
    "https://WWW.Example.com/en/x?q=1", "http://example.com/en/", "http://a.b.example.com/en", "http://x.net/es/1", "http://net/fr/", "http://planet/fr/", "http://example.com",
    "ftp://other.org/a/index.html?utm_source=x&b=2&a=1#f", "http://www.other.org:80/a?a=1&b=2", "no scheme", "", None, "http://user@host.com:8080/p#?x", "://", "http://x.net/es/1", "a\nb://c.com/\nd",
]


def slow_judge(url, rules, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if url in listed else "allow"


@pytest.mark.parametrize("most", [1, 1 << 16])
def test_urls(spark, most):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("_url", F.lit(1)).withColumn("entry", F.lit(2))
    rules = spark.createDataFrame([*registry.URL_RULES, ("other.org", "/none", "block"), (None, "/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("https://m.other.org/a/?b=2&a=1",), ("http://nowhere.org/",), (None,), ("no scheme",)], "url string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules, listed, most_blocks=most).select("page_id", "url_filter.*").collect()}
    on_list = {URLS[7], URLS[8]}
    for i, u in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == slow_judge(u, registry.URL_RULES, on_list), u
    assert url_filter.judge(pages.limit(0), rules, listed).count() == 0
    bare = url_filter.judge(pages, rules.limit(0), listed.limit(0)).select("url_filter.verdict").distinct().collect()
    assert [r.verdict for r in bare] == ["allow"]


def test_a_host_of_many_labels(spark):
    """The work for a URL grows with its length: a host of 100,000 labels, a path of as many slashes."""
    long = ".".join(["a"] * 100_000)
    urls = [f"http://{long}.example.com/en/x", f"http://{long}.net/fr/", f"http://x.net/{'/' * 100_000}a", "http://example.com/en//"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame([*registry.URL_RULES, (f"{long}.net", "/f", "allow")], "host string, path string, verdict string")
    began = time.time()
    got = {r.page_id: r for r in url_filter.judge(pages, rules, pages.limit(0)).select("page_id", "url_filter.*").collect()}
    assert time.time() - began < 60
    assert [got[i].verdict for i in range(4)] == ["block", "allow", "allow", "block"]
    assert got[0].rule == "example.com/en/" and got[1].rule.endswith(".net/f") and got[2].rule is None


def test_classifier_on_documents_it_has_not_seen(spark):
    scored = registry.QUERIES["op10_quality_classifier"](spark, DATA)
    labels = read(spark, DATA, "labels").select("doc_id", "quality")
    held = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert len(held) > 50
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].score.mean() - held[held.quality == 0].score.mean() > 0.8


def test_classifier_on_odd_rows(spark):
    rows, docs = samples.documents(spark)
    docs = samples.clashing(docs)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0
    assert set(quality_classifier.classify(docs, labels.limit(0)).toPandas().score) == {0.5}
    one = quality_classifier.classify(docs, labels.where("quality = 1")).toPandas()
    assert (one.score > 0.99).all()


def test_word_hashes_know_rows_apart():
    got = wd.cut(pa.array(["Ab c", None, "", "ab", "é C"]))
    assert got.counts().tolist() == [2, 0, 0, 1, 2]
    assert got.hash[0] == got.hash[2] and got.hash[1] == got.hash[4] and len(set(got.hash.tolist())) == 3
    found, row = wd.shingles(got, 2)
    assert row.tolist() == [0, 3, 4] and len(set(found.tolist())) == 3
