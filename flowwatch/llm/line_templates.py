"""Line dedup by a tree of line templates.

Lines are parsed as log messages are: down a tree of fixed depth by number of tokens and by the first
tokens, a token with a digit standing for a variable field. In a leaf, a token that fewer than
``min_docs`` documents have at its place is a variable field too, which gives the line's template;
a line that would lose more than half of its tokens keeps them and is its own template. A template
that lines of ``min_docs`` documents or more share recurs. Its lines stay in the first document and
are dropped from all others (``keep_first=False``: from all).

Five documents are asked for because short lines recur by chance. A line of ``long_tokens`` tokens or
more does not, so it is a passage that recurs from two documents on, if it is the same token for token,
digits too. Near copies of the first document (five-word shingles, Jaccard similarity of
``copy_percent`` or more) count as the first document and keep their passages: to take these out would hide the copies
from the near-duplicate operators, which take the whole document. Passages inside longer lines, or
broken into lines elsewhere, are not found.

Documents are counted by text, so exact copies are one document and keep the same lines. First is the
smallest id; null comes last. Tokens are cut at white space, A-Z count as a-z. Lines without a token
are left as they are. A null text stays null, an empty one empty, and a document all of whose lines
are dropped becomes empty. Other columns pass through; one
that is named like the added ``line_dedup`` is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowwatch.llm import bloom, words as wd
from flowwatch.llm.tables import fresh, text_key
from flowwatch.session import materialize

MIN_DOCS = 5
DEPTH = 3
LONG_TOKENS = 50
COPY_SHINGLE = 5
COPY_PERCENT = 80
SALTS = 16
VARIABLE = "<*>"
_FIELD = re.compile(rb"\S*[0-9]\S*")
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_ANY = np.uint64(0x5851F42D4C957F2D)


class _Lines:
    """The lines of a batch that have tokens: row, number in the row, byte range, tokens, leaf and hashes."""

    def __init__(self, texts: pa.Array, depth: int):
        w = wd.cut(texts)
        self.data = w.data
        breaks = np.flatnonzero(w.data == 10)
        _, at = wd.text_bytes(texts)
        before = np.searchsorted(breaks, w.start) + w.row
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(before) else np.empty(0, np.int64)
        last = np.append(first[1:], len(before))
        digits = np.concatenate([[0], np.cumsum(_DIGIT[w.data])])
        token = np.where(digits[w.end] > digits[w.start], _ANY, w.hash)
        size = last - first
        self.size = size
        self.row = w.row[first]
        self.number = before[first] - self.row - np.searchsorted(breaks, at[:-1])[self.row]
        self.start, self.end = w.start[first], (w.end[last - 1] if len(first) else first)
        leaf = wd.mix(size.astype(np.uint64))
        for i in range(depth):
            here = token[np.minimum(first + i, last - 1)]
            leaf = wd.mix(leaf ^ np.where(i < size, here, np.uint64(0)))
        self.leaf = leaf.view(np.int64)
        place = np.arange(len(token)) - np.repeat(first, size)
        place = wd.mix(place.astype(np.uint64))
        # With variable fields alike, and with every token as it is.
        self.hash, self.exact = (wd.mix(np.add.reduceat(x, first) if len(first) else x).view(np.int64) for x in (wd.mix(token + place), wd.mix(w.hash + place)))


def _leaves(depth: int, long_tokens: int):
    """The leaf of each line, and the exact hash of each long one."""

    def run(batches):
        for b in wd.slices(batches, "text"):
            lines = _Lines(b.column("text"), depth)
            some = np.flatnonzero(lines.size >= long_tokens)
            row = pa.array(np.concatenate([lines.row, lines.row[some]]))
            mark = np.repeat([False, True], [len(lines.row), len(some)])
            leaf = np.concatenate([lines.leaf, lines.exact[some]])
            yield pa.RecordBatch.from_arrays([b.column("text_key").take(row), pa.array(mark), pa.array(leaf)], names=["text_key", "long", "leaf"])

    return run


def _plain(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def _masked(line: bytes) -> str:
    return _FIELD.sub(VARIABLE.encode(), _plain(line)).decode()


def _occurrences(depth: int, long_tokens: int, leaves, passages):
    """Lines of leaves that may recur, with variable fields masked, and long lines that may recur, as they are.

    The whole text of each row with such long lines comes with it, under the number -1.
    """

    def run(batches):
        for b in wd.slices(batches, "text"):
            lines = _Lines(b.column("text"), depth)
            data = lines.data.tobytes()
            for mark, at, leaf, line in (
                (False, bloom.maybe(leaves.value, lines.leaf), lines.leaf, lines.hash),
                (True, (lines.size >= long_tokens) & bloom.maybe(passages.value, lines.exact), lines.exact, lines.exact),
            ):
                at = np.flatnonzero(at)
                shown = [data[x:y] for x, y in zip(lines.start[at], lines.end[at])]
                masked = [_plain(x).decode() for x in shown] if mark else [_masked(x) for x in shown]
                first = at[np.concatenate([[True], lines.row[at][1:] != lines.row[at][:-1]])[: len(at)]] if mark else at[:0]
                number = np.concatenate([lines.number[at], np.full(len(first), -1)]).astype(np.int32)
                whole = pa.concat_arrays([pa.nulls(len(at), b.column("text").type), b.column("text").take(pa.array(lines.row[first]))])
                masked += [None] * len(first)
                at = np.concatenate([at, first])
                row = pa.array(lines.row[at])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(row), b.column("text_key").take(row), pa.array(number), pa.array(np.full(len(at), mark)), pa.array(leaf[at]), pa.array(line[at]), pa.array(masked, pa.string()), whole],
                    names=["id", "text_key", "number", "long", "leaf", "line", "masked", "text"],
                )

    return run


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text")).where("text is not null")


def templates(docs: DataFrame, key: str, text: str, min_docs: int, depth: int, long_tokens: int) -> DataFrame:
    """One row per line of a recurring leaf, and per long line of two to ``min_docs`` - 1 texts, which is its own template.

    id, text_key, number, long, template, and for each text with such long lines a row of number -1 with the text. A long line of more texts is in a recurring leaf.
    """
    texts = _texts(docs, key, text)
    id_type = dict(texts.dtypes)["id"]
    seen = texts.select("text_key", "text").mapInArrow(_leaves(depth, long_tokens), "text_key string, long boolean, leaf long").distinct()
    recurs = F.when(F.col("long"), (F.col("count") >= 2) & (F.col("count") < min_docs)).otherwise(F.col("count") >= min_docs)
    often = materialize(seen.groupBy("long", "leaf").count().where(recurs).select("long", "leaf"), "leaves")
    sc = docs.sparkSession.sparkContext
    tables = [sc.broadcast(bloom.build(often.where(F.col("long") == mark), "leaf")) for mark in (False, True)]
    lines = texts.mapInArrow(_occurrences(depth, long_tokens, *tables), f"id {id_type}, text_key string, number int, long boolean, leaf long, line long, masked string, text string")
    every = materialize(lines.join(often.withColumn("often", F.lit(True)), ["long", "leaf"], "left").where("often or number < 0").drop("often"), "lines")
    lines = every.where("not long").drop("long", "text")

    # Of each distinct line: the documents that have it, then those that have a token at a place.
    counted = lines.select("leaf", "line", "masked", "text_key").distinct().groupBy("leaf", "line").agg(F.first("masked").alias("masked"), F.count(F.lit(1)).alias("docs"))
    counted = materialize(counted, "distinct-lines")
    tokens = counted.select("leaf", "line", "docs", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    common = tokens.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("all")).where(F.col("all") >= min_docs).drop("all")
    fields = tokens.join(common.withColumn("common", F.lit(True)), ["leaf", "place", "token"], "left")
    shown = F.when(F.col("common"), F.col("token")).otherwise(F.lit(VARIABLE))
    parsed = fields.groupBy("leaf", "line").agg(
        F.sort_array(F.collect_list(F.struct("place", shown.alias("t")))).alias("parts"),
        F.sum(F.when(F.col("common"), 0).otherwise(1)).alias("lost"),
    )
    parsed = parsed.join(counted, ["leaf", "line"]).select(
        "leaf", "line", F.when(F.col("lost") * 2 > F.size("parts"), F.col("masked")).otherwise(F.concat_ws(" ", "parts.t")).alias("template")
    )
    # Distinct lines are few beside their occurrences, so they go to every salt of a frequent line.
    salted = parsed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).cast("int"))
    short = dealt.join(salted, ["leaf", "line", "salt"]).select("id", "text_key", "number", F.lit(False).alias("long"), "template", F.lit(None).cast("string").alias("text"))
    return short.unionAll(every.where("long").select("id", "text_key", "number", "long", F.col("masked").alias("template"), "text"))


def _similar(percent: int):
    """The pairs of near copies."""

    def run(batches):
        for b in wd.slices(wd.slices(batches, "text"), "other"):
            sets = []
            for name in ("text", "other"):
                found, row = wd.shingles(wd.cut(b.column(name)), COPY_SHINGLE)
                found, at = np.unique(wd.mix(found + wd.mix(row.astype(np.uint64))), return_index=True)
                sets.append((found, row[at]))
            _, at, _ = np.intersect1d(sets[0][0], sets[1][0], assume_unique=True, return_indices=True)
            one, two, shared = (np.bincount(x, minlength=b.num_rows) for x in (sets[0][1], sets[1][1], sets[0][1][at]))
            every = one + two - shared
            at = pa.array(np.flatnonzero(shared * 100 >= every * percent))
            yield pa.RecordBatch.from_arrays([b.column("text_key").take(at), b.column("holder").take(at)], names=["text_key", "holder"])

    return run


def _copies(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs of text_key and holder those whose texts are near copies."""
    other = texts.select(F.col("text_key").alias("holder"), F.col("text").alias("other"))
    return pairs.join(texts, "text_key").join(other, "holder").select("text_key", "holder", "text", "other").mapInArrow(_similar(percent), "text_key string, holder string")


def dropped_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH, keep_first: bool = True, long_tokens: int = LONG_TOKENS, copy_percent: int = COPY_PERCENT
) -> DataFrame:
    """One row per distinct text that loses lines: text_key, numbers (from 0) and templates of them."""
    found = materialize(templates(docs, key, text, min_docs, depth, long_tokens), "templates")
    whole = materialize(found.where("number < 0").select("text_key", "text").dropDuplicates(["text_key"]), "holders")
    found = found.where("number >= 0")
    by_text = found.groupBy("long", "template", "text_key").agg(F.min("id").alias("id"))
    again = by_text.groupBy("long", "template").agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.struct(F.col("id").isNull().alias("n"), "id", "text_key"))["text_key"].alias("holder")
    )
    again = again.where(F.col("long") | (F.col("docs") >= min_docs)).drop("docs")
    gone = found.select("long", "template", "text_key", "number").distinct().join(again, ["long", "template"])
    passages = materialize(gone.where("long"), "passages")
    pairs = materialize(passages.where("text_key != holder").select("text_key", "holder").distinct(), "pairs")
    others = passages.where("text_key != holder").join(_copies(pairs, whole, copy_percent), ["text_key", "holder"], "left_anti")
    gone = gone.where("not long")
    if keep_first:
        gone = gone.where(F.col("text_key") != F.col("holder"))
    else:
        others = passages.join(others.select("template").distinct(), "template", "left_semi")
    gone = gone.select("text_key", "number", "template").unionAll(others.select("text_key", "number", "template"))
    return gone.groupBy("text_key").agg(F.sort_array(F.collect_set("number")).alias("numbers"), F.sort_array(F.collect_set("template")).alias("templates"))


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH, keep_first: bool = True, long_tokens: int = LONG_TOKENS, copy_percent: int = COPY_PERCENT
) -> DataFrame:
    """The documents without the dropped lines, and a struct ``line_dedup``: n_lines, n_dropped, templates."""
    _key, _gone = fresh(docs, "_key", "_gone")
    gone = materialize(dropped_lines(docs, key, text, min_docs, depth, keep_first, long_tokens, copy_percent), "dropped")
    gone = gone.select(F.col("text_key").alias(_key), F.struct("numbers", "templates").alias(_gone))
    joined = docs.withColumn(_key, text_key(F.col(text))).join(gone, _key, "left")
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(f"{_gone}.numbers", i)), "\n")
    report = F.struct(
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(f"{_gone}.numbers"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.col(f"{_gone}.templates"), F.array().cast("array<string>")).alias("templates"),
    )
    cleaned = F.when(F.col(_gone).isNull(), F.col(text)).otherwise(left)
    return joined.withColumns({"line_dedup": report, text: cleaned}).drop(_key, _gone)
