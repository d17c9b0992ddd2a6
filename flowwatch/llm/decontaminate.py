"""Benchmark decontamination by winnowing.

Every text is reduced to the minimal k-gram hash of each run of w k-grams. Two texts that share
k + w - 1 consecutive words share such a run, so they share its fingerprint: no span of that length
is missed. Fingerprints of documents that pass a Bloom filter of the items' fingerprints, which has a bounded
size, are joined with these, and each hit is extended along its
diagonal over the actual words, which removes hash collisions and finds the exact span.

A null or wordless text or item matches nothing. An item of fewer words than ``span`` is one window
of its own length. A null item id is shown as the empty string; rows that repeat an id are one
item. Documents are known by the content of their text, so repeated rows and null ids get the same
answer as any other row. Other columns of the documents pass through; one that is named like the
added ``overlap`` is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowwatch.llm import bloom, words as wd
from flowwatch.llm.tables import fresh, n_alnum_words, text_key
from flowwatch.session import materialize

SPAN = 13
ITEMS_TOGETHER = 64
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def winnow(hashes: np.ndarray, row: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that any two equal runs of ``span`` words have in common, and their places."""
    k = (span + 1) // 2
    run = span - k + 1
    gram, at = wd.grams(hashes, row, k)
    size = max(0, len(gram) - run + 1)
    if not size:
        return gram[:0], at[:0]
    low, where = gram[:size].copy(), np.arange(size)
    for i in range(1, run):
        other = gram[i : i + size]
        less = other <= low  # the rightmost of equal minima
        low = np.where(less, other, low)
        where = np.where(less, np.arange(i, i + size), where)
    whole = row[at[:size]] == row[at[run - 1 : run - 1 + size]]
    chosen = np.unique(where[whole])
    # Spans of different lengths never meet.
    return wd.mix(gram[chosen] + np.uint64(span)), at[chosen]


def _item_prints(span: int):
    def run(batches):
        for b in wd.slices(batches, "item_text"):
            w = wd.cut(b.column("item_text"), wd.ALNUM)
            counts, place = w.counts(), w.position()
            for n in np.unique(np.minimum(counts[counts > 0], span)):
                mine = np.minimum(counts[w.row], span) == n
                prints, at = winnow(w.hash[mine], w.row[mine], int(n))
                rows, at = w.row[mine][at], place[mine][at]
                yield pa.RecordBatch.from_arrays(
                    [b.column("item_key").take(pa.array(rows)), pa.array(np.full(len(rows), n, np.int32)), pa.array(prints.view(np.int64)), pa.array(at, pa.int32())],
                    names=["item_key", "span", "print", "item_at"],
                )

    return run


def _suspects(spans: list[int], known):
    """Texts with fingerprints that pass the filter of the items' fingerprints, and these."""

    def run(batches):
        for b in wd.slices(batches, "text"):
            w = wd.cut(b.column("text"), wd.ALNUM)
            place = w.position()
            passed = []
            for n in spans:
                prints, at = winnow(w.hash, w.row, n)
                some = bloom.maybe(known.value, prints.view(np.int64))
                passed.append((w.row[at[some]], prints[some].view(np.int64), place[at[some]]))
            row, prints, at = (np.concatenate(x) for x in zip(*passed)) if passed else (np.empty(0, np.int64),) * 3
            order = np.argsort(row, kind="stable")
            rows, counts = np.unique(row, return_counts=True)
            chosen = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("text_key").take(chosen), b.column("text").take(chosen), wd.lists(prints[order], counts, pa.int64()), wd.lists(at[order], counts, pa.int64())],
                names=["text_key", "text", "prints", "ats"],
            )

    return run


def _numbers(text: str, known: dict[bytes, int]) -> np.ndarray:
    return np.array([known.setdefault(w, len(known)) for w in _WORD.findall(text.encode().lower())], np.int64)


def _extended(text: np.ndarray, item: np.ndarray, shift: int, span: int) -> list[tuple[int, int]]:
    """Runs of at least ``span`` equal words where text[i + shift] stands beside item[i]."""
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    if hi - lo < span:
        return []
    same = np.concatenate([[False], text[lo + shift : hi + shift] == item[lo:hi], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(int(a) + lo + shift, int(b) + lo + shift) for a, b in zip(edges[::2], edges[1::2]) if b - a >= span]


def _extend(batches):
    for b in batches:
        out = {"text_key": [], "spans": [], "items": []}
        for key, text, found in zip(*(b.column(c).to_pylist() for c in ("text_key", "text", "found"))):
            known: dict[bytes, int] = {}
            mine = _numbers(text, known)
            hit, items = np.zeros(len(mine) + 2, np.int8), set()
            for f in found:
                item = _numbers(f["item_text"], known)
                for shift in f["shifts"]:
                    for first, end in _extended(mine, item, shift, f["span"]):
                        hit[first + 1 : end + 1] = 1
                        items.add(f["item"])
            if items:
                edges = np.flatnonzero(hit[1:] != hit[:-1])
                out["text_key"].append(key)
                out["spans"].append([{"first": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])])
                out["items"].append(sorted(items))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([_FOUND.field(n) for n in out]))


def _merged(batches):
    """Joins the spans that several parts of a text's items have found; sorts the items."""
    for b in batches:
        out = {"text_key": b.column("text_key").to_pylist(), "n_hit": [], "spans": [], "items": []}
        for spans, items in zip(b.column("spans").to_pylist(), b.column("items").to_pylist()):
            kept: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["first"], s["end"])):
                if kept and s["first"] <= kept[-1]["end"]:
                    kept[-1]["end"] = max(kept[-1]["end"], s["end"])
                else:
                    kept.append(s)
            out["spans"].append(kept)
            out["n_hit"].append(sum(s["end"] - s["first"] for s in kept))
            out["items"].append(sorted(set(items)))
        yield pa.RecordBatch.from_pydict(out, schema=_FOUND)


_FOUND = pa.schema(
    [
        ("text_key", pa.string()),
        ("n_hit", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """One row per distinct text that holds a window of an item.

    text_key, n_hit (words inside any occurrence), spans (first word and end of each run of such
    words) and items (ids as strings, sorted).
    """
    listed = materialize(
        items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("item_text"))
        .where(n_alnum_words(F.col("item_text")) > 0)
        .distinct()
        .withColumn("item_key", text_key(F.col("item_text"))),
        "items",
    )
    known = materialize(
        listed.select("item_key", "item_text").dropDuplicates(["item_key"]).mapInArrow(_item_prints(span), "item_key string, span int, print long, item_at int"),
        "item-prints",
    )
    spans = sorted(r.span for r in known.select("span").distinct().collect())  # at most `span` numbers
    table = docs.sparkSession.sparkContext.broadcast(bloom.build(known.select("print").distinct(), "print"))
    texts = docs.select(text_key(F.col(text)).alias("text_key"), F.col(text).alias("text")).where("text is not null")
    # Few texts pass, and they are kept here with what passed: the others move nowhere.
    suspects = texts.mapInArrow(_suspects(spans, table), "text_key string, text string, prints array<long>, ats array<long>")
    suspects = materialize(suspects.dropDuplicates(["text_key"]), "suspects")
    prints = suspects.select("text_key", F.explode(F.arrays_zip("prints", "ats")).alias("p"))
    met = materialize(
        prints.select("text_key", F.col("p.prints").alias("print"), F.col("p.ats").alias("at"))
        .join(known, "print")
        .select("text_key", "item_key", "span", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
        .groupBy("text_key", "item_key", "span")
        .agg(F.collect_list("shift").alias("shifts")),
        "met",
    )
    # A text meets its items in parts of about ITEMS_TOGETHER, so that a phrase that many items share fills no row.
    parts = met.groupBy("text_key").agg(F.ceil(F.count(F.lit(1)) / ITEMS_TOGETHER).alias("parts"))
    dealt = met.join(parts, "text_key").withColumn("part", F.pmod(F.xxhash64("item_key"), F.col("parts")))
    found = dealt.join(listed, "item_key").groupBy("text_key", "part").agg(F.collect_list(F.struct("item", "item_text", "span", "shifts")).alias("found"))
    hits = suspects.select("text_key", "text").join(found, "text_key").mapInArrow(_extend, "text_key string, spans array<struct<first:long,end:long>>, items array<string>")
    whole = hits.groupBy("text_key").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return whole.mapInArrow(_merged, "text_key string, n_hit long, spans array<struct<first:long,end:long>>, items array<string>")


def judge(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, share: int = 20) -> DataFrame:
    """The documents, all rows and columns, with a struct ``overlap``.

    It holds n_words, n_hit, spans, items and contaminated: some word is hit, and at least one in
    ``share`` of all words.
    """
    _key, _words, _found = fresh(docs, "_key", "_words", "_found")
    found = materialize(matches(docs, items, text, item_id, item_text, span), "found")
    found = found.select(F.col("text_key").alias(_key), F.struct("n_hit", "spans", "items").alias(_found))
    n_words, n_hit = F.col(_words), F.coalesce(F.col(f"{_found}.n_hit"), F.lit(0).cast("long"))
    overlap = F.struct(
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.col(f"{_found}.spans").alias("spans"),
        F.coalesce(F.col(f"{_found}.items"), F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= n_words)).alias("contaminated"),
    )
    # Counted before the join, so that a caller who drops the text does not shuffle it.
    keyed = docs.withColumns({_key: text_key(F.col(text)), _words: n_alnum_words(F.col(text))})
    return keyed.join(found, _key, "left").withColumn("overlap", overlap).drop(_key, _words, _found)
