"""Scores by cross-entropy difference of two n-gram language models.

A target model is counted over the target documents and a background model over all documents. They are
matched: one vocabulary, the same bigram order and the same smoothing. The score of a document is the
mean over its words of (target loss - background loss), in nats; low is close to the target.

Words are named by their 64-bit hash and none is unknown. With p(w) the unigram share, smoothed over as many
words as there are, p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU). Counts of
words and bigrams grow with the corpus and are never gathered; only those of the ``HOT`` most frequent words are
broadcast, and those of bigrams of two of the first ``PAIRED`` of them, PAIRED^2 entries at most, which are counted in each task and summed.
Target ids are broadcast up to ``MARKED`` of them; more are joined.

All other words are dealt with the words before them: a run of documents (about ``_FLUSH`` bytes of text) sends each of its bigrams
once, with how often it occurs, to one of many groups, one for about ``GROUP_TOKENS`` words of the corpus: that of a word
that is not hot by its hash, that of a hot one by the hash of the bigram. So a group gets every occurrence of a word that is not hot, hence
c(w) and all c(v w). It returns counts in the order in which bigrams came, and the run, which has kept the documents of its bigrams in that order,
adds them up: -log of the numerator where the word stands, and, as the denominator of the next bigram knows its first word
only, log(c(w) + MU) if a word follows. What moves is a few bytes for each bigram of a run, however many groups there are.

Texts are named by a 64-bit hash and copies add to both sums alike, so they get the same score. A
null, empty or wordless text has no words and a null score. Repeated and null ids are allowed.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from flowwatch.llm import words as wd
from flowwatch.llm.tables import parts_for
from flowwatch.session import Scratch, materialize

_log = logging.getLogger(__name__)

HOT = 1 << 16
PAIRED = 512
MARKED = 1 << 22
GROUP_TOKENS = 1 << 20
MU = 16.0
ADD = 0.1
_FLUSH = 2 << 20
_NEXT_BIT = 15
_MOST_DOCS = 1 << _NEXT_BIT


class _Docs:
    """Some documents: refs, target marks, and the flat ids of their words with their document."""

    def __init__(self, refs: np.ndarray, marks: np.ndarray, w: wd.Words):
        sizes = w.counts()
        some = np.flatnonzero(sizes)
        self.refs, self.marks, sizes = refs[some], marks[some], sizes[some]
        self.ids = w.hash
        self.doc = np.repeat(np.arange(len(some)), sizes)
        # Whether a word stands before, and after.
        self.prev, self.next = np.ones(len(self.ids), bool), np.ones(len(self.ids), bool)
        self.prev[np.cumsum(sizes) - sizes] = False
        self.next[np.cumsum(sizes) - 1] = False
        self.before = np.where(self.prev, np.roll(self.ids, 1), np.uint64(0))


def _runs(batches, chosen):
    """The documents that have words, about ``_FLUSH`` bytes of text at a time. Every pass cuts the words again: hashes would take more room than the texts.

    ``chosen``: the sorted ids of the target documents, or none where rows are marked.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, _MOST_DOCS):
            for b in wd.slices(iter([batch.slice(at, _MOST_DOCS)]), "text", _FLUSH):
                docs = _Docs(b.column("ref").to_numpy(), _marks(b, chosen), wd.cut(b.column("text")))
                if len(docs.ids):
                    yield docs


def _marks(b: pa.RecordBatch, chosen) -> np.ndarray:
    if chosen is None:
        return b.column("is_target").to_numpy(zero_copy_only=False)
    ids = pc.fill_null(b.column("id").cast(pa.int64()), 0).to_numpy()
    at = np.minimum(np.searchsorted(chosen.value, ids), max(len(chosen.value) - 1, 0))
    same = chosen.value[at] == ids if len(chosen.value) else np.zeros(len(ids), bool)
    return same & b.column("id").is_valid().to_numpy(zero_copy_only=False)


def _words(chosen):
    """Each run's counts of its words."""

    def run(batches):
        for d in _runs(batches, chosen):
            words, which = np.unique(d.ids, return_inverse=True)
            target, every = np.bincount(which[d.marks[d.doc]], minlength=len(words)), np.bincount(which)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(target), pa.array(every)], names=["word", "target", "every"])

    return run


class _Model:
    """Totals, and the counts of hot words and of their bigrams, for both models at once."""

    def __init__(self, totals: np.ndarray, vocabulary: int, words: np.ndarray, counts: np.ndarray):
        """``words``: the hot ones, the most frequent first."""
        order = np.argsort(words)
        self.totals, self.vocabulary = totals, vocabulary
        self.words, self.counts = words[order], counts[:, order]
        self.paired = min(PAIRED, len(words))
        self.top = np.where(order < self.paired, order, -1)
        self.pairs = np.zeros((2, self.paired**2))

    def rank(self, w: np.ndarray) -> np.ndarray:
        """The number of each word among the hot ones, or -1."""
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, at, -1) if len(self.words) else np.full(len(w), -1)

    def hot(self, d: _Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ranks of the words; which words need no dealing; which end bigrams whose counts are broadcast; the places of these counts."""
        rank = self.rank(d.ids)
        top = np.where(rank >= 0, self.top[rank], -1) if len(self.top) else rank
        both = d.prev & (top >= 0) & (np.roll(top, 1) >= 0)
        return rank, both | (~d.prev & (rank >= 0)), both, np.roll(top, 1)[both] * self.paired + top[both]

    def share(self, counts: np.ndarray) -> np.ndarray:
        """Smoothed share of words that have these counts."""
        return (counts + ADD) / (self.totals + ADD * self.vocabulary)


def _pairs(model, chosen):
    """Each task's counts of bigrams of two hot words."""

    def run(batches):
        size = model.value.paired**2
        target, every = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for d in _runs(batches, chosen):
            _, _, both, found = model.value.hot(d)
            every += np.bincount(found, minlength=size)
            target += np.bincount(found[d.marks[d.doc[both]]], minlength=size)
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(every[some])], names=["at", "target", "every"])

    return run


def _sums(doc: np.ndarray, losses: np.ndarray, size: int) -> np.ndarray:
    """Sums of losses by document, for both models."""
    return np.stack([np.bincount(doc, weights=x, minlength=size).astype(np.float64) for x in losses])


def _blobs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column: so many of the values in each row."""
    at = np.concatenate([[0], np.cumsum(sizes * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(rows: pa.Table, name: str, kind) -> np.ndarray:
    """The values of all rows of a binary column."""
    column = pa.concat_arrays(rows[name].cast(pa.large_binary()).chunks)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.empty(0, kind)


def _count_blobs(name: str, counts: np.ndarray, row: np.ndarray, rows: int) -> dict[str, pa.Array]:
    """Pairs of counts (target, all) of a row in a byte each; those of 255 or more stand in a second column."""
    flat, most = counts.T.astype(np.int64).ravel(), np.bincount(row, minlength=rows)
    more = flat >= 255
    return {
        name: _blobs(np.minimum(flat, 255).astype(np.uint8), 2 * most),
        f"{name}_more": _blobs(flat[more], np.bincount(np.repeat(row, 2)[more], minlength=rows)),
    }


def _counts(rows: pa.Table, name: str) -> np.ndarray:
    flat = _flat(rows, name, np.uint8).astype(np.int64)
    flat[flat == 255] = _flat(rows, f"{name}_more", np.int64)
    return flat.reshape(-1, 2).T


def _packed(docs: np.ndarray) -> bytes:
    """Low bytes, then high bytes, compressed."""
    return len(docs).to_bytes(8, "little") + pa.compress(docs.view(np.uint8).reshape(-1, 2).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(docs: bytes) -> np.ndarray:
    size = 2 * int.from_bytes(docs[:8], "little")
    return np.frombuffer(pa.decompress(docs[8:], size, codec="zstd", asbytes=True), np.uint8).reshape(2, -1).T.copy().view(np.uint16).ravel()


# Kinds of bigrams: 0 two hot words, 1 a hot word after another, 2 another after a hot one, 3 two others, or a first word that is not hot.
# Hot words are sent by rank, others by hash, 0 before a first word. ``sizes``: how many of each kind.
_HOME = ["refs", "sums", "docs"]
_ECHOED = ["sizes", "times", "times_more", "w_rank", *_HOME]
_TIMES = ["uses", "uses_more", "seen", "seen_more"]


def _schema(names: list[str]) -> str:
    return "part int, run long, " + ", ".join(f"{name} binary" for name in names)


_DEALT = [*_ECHOED, "v_rank", "w_hash", "v_hash"]
_RETURNED = [*_ECHOED, *_TIMES]


def _kinds(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.tile(np.arange(4), len(sizes) // 4), sizes)


def _deal(model, chosen, groups: int):
    """A row for each run and group, and one, for any group, of what the run keeps: refs, number of words and sums over what needs nothing but the broadcast counts, documents of the bigrams dealt."""

    def run(batches):
        m, task = model.value, TaskContext.get()
        for number, d in enumerate(_runs(batches, chosen)):
            rank, known, both, found = m.hot(d)
            size = len(d.refs)
            seen = np.zeros((2, len(d.ids)))
            seen[:, both] = m.pairs[:, found]
            share = m.share(m.counts[:, rank[known]])
            sums = _sums(d.doc[known], -np.log(np.where(d.prev[known], seen[:, known] + MU * share, share)), size)
            leads = d.next & (rank >= 0)
            sums += _sums(d.doc[leads], np.log(m.counts[:, rank[leads]] + MU), size)

            at = np.flatnonzero(~known)
            w, v, w_rank = d.ids[at], np.where(d.prev, np.maximum(d.before, np.uint64(1)), np.uint64(0))[at], rank[at]
            v_rank = np.where(d.prev, np.roll(rank, 1), -1)[at]
            pair = wd.mix(wd.mix(v) + w)
            group = np.where(w_rank >= 0, pair, wd.mix(w)) % np.uint64(groups)
            code = group * np.uint64(4) + np.uint64(2) * (w_rank < 0) + (v_rank < 0)
            bits = np.uint64((4 * groups).bit_length())
            order = np.argsort(code << (np.uint64(64) - bits) | pair >> bits, kind="stable")
            code, w, v, w_rank, v_rank = code[order], w[order], v[order], w_rank[order], v_rank[order]
            docs, marks = d.doc[at][order], d.marks[d.doc[at]][order]
            # Each bigram once; one that comes again after another of the same key counts as two.
            changes = np.ones(len(at), bool)
            changes[1:] = (code[1:] != code[:-1]) | (w[1:] != w[:-1]) | (v[1:] != v[:-1])
            first = np.flatnonzero(changes)
            every = np.diff(np.append(first, len(at)))
            target = np.add.reduceat(marks.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
            code, w, v, w_rank, v_rank = code[first], w[first], v[first], w_rank[first], v_rank[first]

            parts, row = np.unique(code >> np.uint64(2), return_inverse=True)
            rows, kind = len(parts) + 1, (code & np.uint64(3)).astype(np.int64)
            key = wd.mix(np.array([task.partitionId() << 32 | number] if task else [number], np.uint64)) + wd.mix(d.refs.view(np.uint64) + np.arange(size, dtype=np.uint64)).sum(dtype=np.uint64)
            name = wd.mix(key).view(np.int64)[0]
            send = lambda values, some: _blobs(values[some], np.bincount(row[some], minlength=rows))
            keep = lambda values: _blobs(np.frombuffer(values, np.uint8), np.append(np.zeros(rows - 1, np.int64), len(values)))
            out = {
                "part": pa.array(np.append(parts.astype(np.int32), np.int32(name % groups)), pa.int32()),
                "run": pa.array(np.full(rows, name)),
                "sizes": _blobs(np.bincount(4 * row + kind, minlength=4 * rows).astype(np.int32), np.full(rows, 4)),
                **_count_blobs("times", np.stack([target, every]), row, rows),
                "w_rank": send(w_rank.astype(np.uint16), kind < 2),
                "refs": keep(d.refs.tobytes()),
                "sums": keep(np.stack([np.bincount(d.doc, minlength=size), *sums]).tobytes()),
                "docs": keep(_packed((docs + (d.next[at][order] << _NEXT_BIT)).astype(np.uint16))),
                "v_rank": send(v_rank.astype(np.uint16), kind % 2 == 0),
                "w_hash": send(w, kind >= 2),
                "v_hash": send(v, kind % 2 == 1),
            }
            yield pa.RecordBatch.from_pydict(out)

    return run


def _count(model):
    """Returns, in place of the bigrams, how often they and their words occur; 0 times for the one of a first word. Counts of hot words are known."""

    def run(rows: pa.Table) -> pa.Table:
        m = model.value
        sizes = _flat(rows, "sizes", np.int32)
        kind, row = _kinds(sizes), np.repeat(np.arange(len(rows)), sizes.reshape(-1, 4).sum(axis=1))
        w, v = np.empty(len(kind), np.uint64), np.empty(len(kind), np.uint64)
        w[kind < 2], w[kind >= 2] = m.words[_flat(rows, "w_rank", np.uint16)], _flat(rows, "w_hash", np.uint64)
        v[kind % 2 == 0], v[kind % 2 == 1] = m.words[_flat(rows, "v_rank", np.uint16)], _flat(rows, "v_hash", np.uint64)
        times = _counts(rows, "times")

        def summed(which: np.ndarray, times: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(which, weights=x) for x in times])[:, which] if len(which) else times

        words, at = np.unique(w, return_inverse=True)
        _, before = np.unique(v, return_inverse=True)
        _, pair = np.unique(before * len(words) + at, return_inverse=True)
        seen = np.where(v > 0, summed(pair, times), 0)
        other = kind >= 2
        counts = _count_blobs("uses", summed(at[other], times[:, other]), row[other], len(rows)) | _count_blobs("seen", seen, row, len(rows))
        return pa.table({name: rows[name] for name in ["part", "run", *_ECHOED]} | counts)

    return run


def _add(model):
    """Sums by document of one run, from the counts in the order in which it dealt its bigrams."""

    def run(rows: pa.Table) -> pa.Table:
        m = model.value
        rows = rows.sort_by("part")
        refs, docs = _flat(rows, "refs", np.int64), [x for x in rows["docs"].to_pylist() if x]
        kind, times = _kinds(_flat(rows, "sizes", np.int32)), _counts(rows, "times")[1]
        docs = _unpacked(docs[0]) if len(docs) == 1 else None
        if docs is None or len(docs) != times.sum():
            raise RuntimeError("a run of documents has changed while it was counted: the order of its rows must be the same each time they are read")
        uses = np.empty((2, len(kind)))
        uses[:, kind < 2], uses[:, kind >= 2] = m.counts[:, _flat(rows, "w_rank", np.uint16)], _counts(rows, "uses")
        seen, share = _counts(rows, "seen"), m.share(uses)
        losses = -np.log(np.where(seen[1] > 0, seen + MU * share, share))
        leads = np.where(kind >= 2, np.log(uses + MU), 0)
        at = np.repeat(np.arange(len(kind)), times)
        losses = losses[:, at] + np.where(docs >> _NEXT_BIT > 0, leads[:, at], 0)
        n, *known = _flat(rows, "sums", np.float64).reshape(3, -1)
        target, background = known + _sums(docs & (_MOST_DOCS - 1), losses, len(refs))
        return pa.table({"ref": refs, "n": n.astype(np.int64), "target": target, "background": background})

    return run


def _most_frequent(words: DataFrame) -> DataFrame:
    """The first ``HOT`` words. Only those of about their counts are sorted: else each partition would send as many."""
    step = F.floor(F.log2("every") * 8)
    steps = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    found, least = 0, 0
    for least, n in steps:
        found += n
        if found >= HOT:
            break
    return words.where(step >= least).orderBy(F.desc("every"), "word").limit(HOT)


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, target_loss, background_loss (means) and score.

    ``target`` has the ids of the target documents in a column named as ``key``.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("ref"), F.col(text).alias("text"))
    chosen = materialize(target.select(F.col(key).alias("id")).dropna().distinct(), "target-ids")
    texts, ids = rows.where(F.col("text") != ""), None
    if isinstance(rows.schema["id"].dataType, IntegralType) and chosen.count() <= MARKED:
        # Few enough to go to the documents.
        ids = sc.broadcast(np.sort(chosen.toPandas()["id"].to_numpy(np.int64)))
    else:
        # The documents are marked by a join instead, and written.
        marked = texts.join(chosen.withColumn("is_target", F.lit(True)), "id", "left").select("ref", F.coalesce("is_target", F.lit(False)).alias("is_target"), "text")
        texts = materialize(marked, "marked-texts")

    words = texts.mapInArrow(_words(ids), "word long, target long, every long").groupBy("word").agg(F.sum("target").alias("target"), F.sum("every").alias("every"))
    with Scratch(docs.sparkSession) as scratch:
        words = scratch.keep(words, "words")
        total = words.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("target"), F.lit(0)).alias("target"), F.coalesce(F.sum("every"), F.lit(0)).alias("every")).first()
        _log.info("%d distinct words", total["words"])
        hot = _most_frequent(words).toPandas()
    counts = hot[["target", "every"]].to_numpy(np.float64).T
    model = _Model(np.array([[total["target"]], [total["every"]]], np.float64), total["words"], hot["word"].to_numpy(np.int64).view(np.uint64), counts)
    ranks = sc.broadcast(model)
    pairs = texts.mapInArrow(_pairs(ranks, ids), "at long, target long, every long").groupBy("at").agg(F.sum("target").alias("target"), F.sum("every").alias("every")).toPandas()
    model.pairs[:, pairs["at"].to_numpy(np.int64)] = pairs[["target", "every"]].to_numpy(np.float64).T
    full = sc.broadcast(model)
    groups = parts_for(docs.sparkSession, total["every"], GROUP_TOKENS)
    counted = texts.mapInArrow(_deal(full, ids, groups), _schema(_DEALT)).groupBy("part").applyInArrow(_count(full), _schema(_RETURNED))
    sums = counted.groupBy("run").applyInArrow(_add(full), "ref long, n long, target double, background double")
    sums = sums.groupBy("ref").agg(F.sum("n").alias("n"), F.sum("target").alias("target"), F.sum("background").alias("background"))
    copies = texts.groupBy("ref").agg(F.count(F.lit(1)).alias("copies"))
    sums = materialize(sums.join(copies, "ref"), "loss-sums")
    mean = lambda c: F.round(F.col(c) / F.col("n"), 6)
    return rows.select("id", "ref").join(sums, "ref", "left").select(
        "id", F.coalesce((F.col("n") / F.col("copies")).cast("long"), F.lit(0).cast("long")).alias("n_words"),
        mean("target").alias("target_loss"), mean("background").alias("background_loss"),
        F.round((F.col("target") - F.col("background")) / F.col("n"), 6).alias("score"),
    )
