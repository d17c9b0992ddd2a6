"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Each text becomes the set of its distinct n-word shingles (64-bit hashes). Texts with equal sets are
one class and travel once. Sets of Jaccard similarity t share T = ceil(t * size) shingles at least,
T from the larger one. DivideSkip sets the L longest inverted lists of a query aside, heap-merges the
short ones, keeps sets that occur in T - L of them, and looks the long lists up by binary search.

Spread over a cluster:

1. Sets order their shingles by hash and show the first p = size - T + 1 and ``spare`` percent more.
   Shingles shown by over ``long_list`` sets have long lists: they come last in every set's order.
2. A set with p or more short lists among those it shows is *plain*. It has L = T - l long lists set
   aside, l = short lists - p + 1. Any two similar plain sets meet in min(l) of their short lists.
   The short lists of a query are brought together, heap-merged and filtered by T - L and by size.
   What passes is probed: all shingles of one set are searched for in the sorted other one.
3. Other sets are *dense*: mostly shingles that many sets have, as in large groups of near copies.
   Against plain sets they are queries too, by their first short lists in full. Among themselves
   they are joined in blocks of bounded size, for pairs of blocks whose sizes allow a link, with
   DivideSkip inside each block. Blocks return counts and a spanning forest, never all pairs.

No list, candidate or link is capped: both classes are exact for every ``long_list``.

A null, empty or wordless text has no shingles and no links; its component is its own id. A text of
fewer words than n has one shingle. Ids may be null or repeated: a component takes the smallest id
that is not null. Other columns are never read.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.llm import bloom, words as wd
from flowwatch.llm.graph import components
from flowwatch.llm.tables import text_key
from flowwatch.session import Scratch, materialize

LONG_LIST = 64
BLOCK_SHINGLES = 1 << 16


def _least(size, percent: int):
    """Shingles that a set of this size shares with any similar one, at least."""
    return -(-percent * size // 100)


def _sorted_sets(w: wd.Words, n: int):
    """(row, sorted distinct shingles) of each row that has words."""
    found, row = wd.shingles(w, n)
    found = found.view(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else []
    for a, b in zip(begins, [*begins[1:], len(row)] if len(row) else []):
        s = np.sort(found[a:b])
        yield int(row[a]), s[np.concatenate([[True], s[1:] != s[:-1]])]


def _sketches(n: int, percent: int, spare: int):
    """Per row: set id, set size and the shingles it shows."""

    def run(batches):
        for b in wd.slices(batches, "text"):
            ids, sizes, shown = [None] * b.num_rows, [0] * b.num_rows, [np.empty(0, np.int64)] * b.num_rows
            for i, s in _sorted_sets(wd.cut(b.column("text")), n):
                p = len(s) - _least(len(s), percent) + 1
                total = wd.mix(s.view(np.uint64)).sum(dtype=np.uint64)
                ids[i] = int(wd.mix(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0])
                sizes[i], shown[i] = len(s), s[: p + p * spare // 100]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_key"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), wd.long_lists(shown)],
                names=["id", "text_key", "set_id", "size", "shown"],
            )

    return run


def _whole_sets(n: int, wanted):
    """All shingles of the texts that pass the filter of the wanted ones."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(bloom.maybe(wanted.value, batch.column("hash").to_numpy())))
            yield from whole(batch)

    def whole(batch):
        for b in wd.slices(iter([batch]), "text"):
            rows, sets = [], []
            for i, s in _sorted_sets(wd.cut(b.column("text")), n):
                rows.append(i)
                sets.append(s)
            yield pa.RecordBatch.from_arrays(
                [b.column("text_key").take(pa.array(rows, pa.int64())), wd.long_lists(sets)], names=["text_key", "shingles"]
            )

    return run


def _merge(batches):
    """Heap-merges each query's short lists; pairs that occur in T - L of them go on."""
    for b in batches:
        out: tuple[list, list] = ([], [])
        for query, need, lists in zip(b.column("set_id").to_pylist(), b.column("need").to_pylist(), b.column("lists")):
            runs = [list(zip(x["set_id"], x["need"])) for x in (_fields(y) for y in lists.values)]
            for (other, theirs), same in groupby(heapq.merge(*runs)):
                if sum(1 for _ in same) >= min(need, theirs):
                    out[0].append(min(query, other))
                    out[1].append(max(query, other))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])


def _fields(entries: pa.Scalar) -> dict[str, list]:
    """The fields of one list of (set_id, size, need)."""
    values = entries.values
    return {f: values.field(f).to_pylist() for f in ("set_id", "need")}


def _probe(percent: int):
    """Looks one set's shingles up in the sorted other one; keeps similar pairs."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = _found(y, x)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _found(sorted_values: np.ndarray, wanted: np.ndarray) -> int:
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return int((sorted_values[at] == wanted).sum())


class _Block:
    """Inverted lists of a block of sets: for each shingle the places of its sets, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        shingle = np.concatenate(sets)
        place = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(shingle, kind="stable")
        self.places = place[order]
        self.shingles, self.begins = np.unique(shingle[order], return_index=True)
        self.ends = np.append(self.begins[1:], len(shingle))
        # One ascending number per (list, place), for binary search in any list.
        self.keys = np.repeat(np.arange(len(self.shingles)), self.ends - self.begins) * len(sets) + self.places

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Places of the sets that are similar to the query."""
        t = _least(len(query), percent)
        at = np.searchsorted(self.shingles, query)
        at[at == len(self.shingles)] = 0
        lists = at[self.shingles[at] == query]
        if len(lists) < t:
            return np.empty(0, np.int64)
        lists = lists[np.argsort((self.ends - self.begins)[lists], kind="stable")]
        short, long = lists[: len(lists) - t + 1], lists[len(lists) - t + 1 :]
        merged = heapq.merge(*(self.places[self.begins[x] : self.ends[x]].tolist() for x in short))
        counted = [(place, sum(1 for _ in same)) for place, same in groupby(merged)]
        if not counted:
            return np.empty(0, np.int64)
        places, seen = np.array(counted).T
        fits = (100 * self.sizes[places] >= percent * len(query)) & (100 * len(query) >= percent * self.sizes[places])
        places, seen = places[fits], seen[fits]
        for some in np.array_split(long, max(1, len(long) // 64)) if len(places) else []:
            wanted = (some[:, None] * len(self.sizes) + places[None, :]).ravel()
            spot = np.searchsorted(self.keys, wanted)
            spot[spot == len(self.keys)] = 0
            seen = seen + (self.keys[spot] == wanted).reshape(len(some), len(places)).sum(0)
        return places[100 * seen >= percent * (len(query) + self.sizes[places] - seen)]


def _join_blocks(percent: int):
    """Links between two blocks, or inside one: a spanning forest and each set's linked copies."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        stored, asked = group[group["stored"]], group[~group["stored"]]
        within = key[:2] == key[2:]
        asked = stored if within else asked
        out: dict[str, list] = {"a": [], "b": [], "copies": []}
        if stored.empty or asked.empty:
            return pd.DataFrame(out).astype("int64")
        block = _Block([np.asarray(s) for s in stored["shingles"]])
        ids, copies = stored["set_id"].to_numpy(), stored["copies"].to_numpy()
        gained = np.zeros(len(ids), np.int64)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, (me, shingles, mine) in enumerate(zip(asked["set_id"], asked["shingles"], asked["copies"])):
            near = block.search(np.asarray(shingles), percent)
            near = near[near != i] if within else near
            if not len(near):
                continue
            if not within:
                gained[near] += mine
            out["a"].append(me), out["b"].append(me), out["copies"].append(int(copies[near].sum()))
            for other in ids[near]:
                x, y = root(me), root(other)
                if x != y:
                    parent[x] = y
                    out["a"].append(me), out["b"].append(other), out["copies"].append(0)
        for x in np.flatnonzero(gained):
            out["a"].append(ids[x]), out["b"].append(ids[x]), out["copies"].append(gained[x])
        return pd.DataFrame(out).astype("int64")

    return run


def _texts_of(docs: DataFrame, text: str, wanted: DataFrame, n: int) -> DataFrame:
    """All shingles of the wanted sets, from one text of each.

    A Bloom filter of bounded size leaves other texts where they are; the join is exact.
    """
    named = wanted.select("set_id", "text_key")
    table = docs.sparkSession.sparkContext.broadcast(bloom.build(named.select(F.xxhash64("text_key").alias("hash")), "hash"))
    texts = docs.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text_key"))
    sets = texts.mapInArrow(_whole_sets(n, table), "text_key string, shingles array<long>").dropDuplicates(["text_key"])
    return sets.join(named, "text_key").select("set_id", "shingles")


def _prefix(size: Column, percent: int) -> Column:
    """p: the shingles of which one at least is shared with any similar set."""
    return (size - F.ceil(size * percent / F.lit(100)) + 1).cast("int")


def _dense_links(dense: DataFrame, percent: int, block: int, scratch: Scratch) -> DataFrame:
    """Rows (a, b, copies): a spanning forest of links, and with a = b the linked copies of a set."""
    # Similar sets are in the same band or in neighbouring ones.
    banded = dense.withColumn("band", F.floor(F.log(F.col("size")) / F.log(F.lit(100.0 / (percent - 1)))).cast("int"))
    blocks = banded.groupBy("band").agg(F.ceil(F.sum("size") / block).cast("int").alias("blocks"))
    blocks = scratch.keep(blocks, "blocks")
    mine = banded.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    below = blocks.select((F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    above = blocks.select((F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    mine = mine.join(below, "band", "left").join(above, "band", "left")
    keep = ("set_id", "size", "copies", "shingles")

    def dealt(stored: bool, band: str, at: str, by_band: str, by: str) -> DataFrame:
        """The sets, with the pair of blocks in which they take part."""
        return mine.select(*keep, F.lit(stored).alias("stored"), F.expr(band).alias("band"), F.expr(at).alias("at"), F.expr(by_band).alias("by_band"), F.expr(by).alias("by"))

    parts = [
        dealt(True, "band", "own", "band", "own"),
        # Inside a band each pair of blocks once: the one with the smaller number is stored.
        dealt(True, "band", "own", "band", "explode(filter(sequence(0, blocks - 1), x -> x > own))"),
        dealt(False, "band", "explode(filter(sequence(0, blocks - 1), x -> x < own))", "band", "own"),
        # Neighbouring bands: the lower one is stored.
        dealt(True, "band", "own", "band + 1", "explode(if(above is null, array(), sequence(0, above - 1)))"),
        dealt(False, "band - 1", "explode(if(below is null, array(), sequence(0, below - 1)))", "band", "own"),
    ]
    work = parts[0]
    for p in parts[1:]:
        work = work.unionAll(p)
    return work.groupBy("band", "at", "by_band", "by").applyInPandas(_join_blocks(percent), "a long, b long, copies long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, long_list: int = LONG_LIST, block: int = BLOCK_SHINGLES, spare: int = 100) -> DataFrame:
    """One row per document: id, text_key, n_shingles, n_links and component_id.

    n_links counts the other documents that it links with, copies included; component_id is the
    smallest id reachable by links. ``spare``: shingles that a set shows beyond the p it must, in
    percent of p; more of them raise l, fewer make more sets dense.
    """
    texts = docs.select(F.col(key).alias("id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    id_type = dict(texts.dtypes)["id"]
    with Scratch(docs.sparkSession) as sketched:
        rows = sketched.keep(texts.mapInArrow(_sketches(n, percent, spare), f"id {id_type}, text_key string, set_id long, size int, shown array<long>"), "sketches")
        # The shown shingles, most of what is written here, stay with the sets only, and those until all links are known.
        members = materialize(rows.select("id", "text_key", "set_id", "size"), "members")
        with Scratch(docs.sparkSession) as scratch:
            sets = _sets(rows, scratch)
            sketched.drop()
            named = materialize(_named(docs, text, sets, scratch, n, percent, long_list, block, spare), "components")
    return members.join(named, "set_id", "left").select(
        "id", "text_key", F.col("size").cast("long").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _sets(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per set: size, shown shingles, a text and the smallest id of those that have it."""
    sets = rows.where("set_id is not null").groupBy("set_id").agg(
        F.first("size").alias("size"), F.first("shown").alias("shown"), F.min("text_key").alias("text_key"),
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"),
    )
    return scratch.keep(sets, "sets")


def _named(docs: DataFrame, text: str, sets: DataFrame, scratch: Scratch, n: int, percent: int, long_list: int, block: int, spare: int) -> DataFrame:
    """Component and links of each set; the tables on the way are in ``scratch``."""
    shown = sets.select("set_id", F.explode("shown").alias("shingle"))
    long = scratch.keep(shown.groupBy("shingle").count().where(F.col("count") > long_list).select("shingle"), "long")
    burden = shown.join(long, "shingle").groupBy("set_id").agg(F.collect_list("shingle").alias("long"))
    p = _prefix(F.col("size"), percent)
    short = F.when(F.col("long").isNull(), F.col("shown")).otherwise(F.array_except("shown", "long"))
    sorted_out = sets.join(burden, "set_id", "left").select("set_id", "size", "text_key", "copies", p.alias("p"), short.alias("short"))
    sorted_out = sorted_out.withColumn("need", F.size("short") - F.col("p") + 1)
    plain = sorted_out.where("need >= 1")
    dense = scratch.keep(sorted_out.where("need < 1").select("set_id", "size", "text_key", "copies", "p"), "dense")
    dense = scratch.keep(_texts_of(docs, text, dense, n).join(dense, "set_id"), "dense-sets")

    # Dealt as flat rows before they are collected, under one filter: both readers of the lists share the exchange.
    postings = plain.select(F.explode("short").alias("shingle"), "set_id", "size", "need").where("shingle is not null").repartition("shingle")
    lists = postings.groupBy("shingle").agg(F.sort_array(F.collect_list(F.struct("set_id", "size", "need"))).alias("list"))
    own = lists.where(F.size("list") > 1).select(F.explode("list").alias("q"), "list")
    own = own.select("q.*", F.filter("list", lambda x: x["set_id"] < F.col("q.set_id")).alias("list"))
    every = dense.select("set_id", "size", "p", F.explode("shingles").alias("shingle")).join(long, "shingle", "left_anti")
    first = every.groupBy("set_id", "size", "p").agg(F.sort_array(F.collect_list("shingle")).alias("s")).withColumn("s", F.slice("s", 1, F.col("p") + F.floor(F.col("p") * spare / 100).cast("int")))
    first = first.select("set_id", "size", F.greatest(F.lit(1), F.size("s") - F.col("p") + 1).alias("need"), F.explode("s").alias("shingle"))
    asked = own.unionAll(first.join(lists, "shingle").select("set_id", "size", "need", "list"))
    size = F.col("size")
    fits = lambda x: (x["size"] * 100 >= size * percent) & (size * 100 >= x["size"] * percent)
    asked = asked.withColumn("list", F.filter("list", fits)).where(F.size("list") > 0)
    queries = asked.groupBy("set_id", "need").agg(F.collect_list("list").alias("lists"))
    pairs = scratch.keep(queries.mapInArrow(_merge, "a long, b long").distinct(), "pairs")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(sets, "set_id")
    whole = scratch.keep(_texts_of(docs, text, wanted, n), "whole")
    probed = pairs.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b").mapInArrow(_probe(percent), "a long, b long")
    links = scratch.keep(probed, "links")
    blocks = scratch.keep(_dense_links(dense, percent, block, scratch), "dense-links")

    roots = components(links.unionAll(blocks.where("a <> b").select("a", "b")))
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(sets.select(F.col("set_id").alias("b"), "copies"), "b").select("a", "copies").unionAll(blocks.where("a = b").select("a", "copies"))
    n_links = counted.groupBy(F.col("a").alias("set_id")).agg(F.sum("copies").alias("linked"))
    named = sets.select("set_id", "copies", "least").join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").join(n_links, "set_id", "left")
    named = named.withColumn("root", F.coalesce("root", "set_id"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(lowest, "root").select("set_id", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
