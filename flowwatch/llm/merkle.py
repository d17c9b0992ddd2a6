"""A Merkle manifest of a table, by a tree of stored SHA-256 states.

Rows are leaves. The leaves of a group, in the order of their key, are folded ``arity`` at a time: every
run of consecutive nodes (the last may be shorter, even one node) becomes the SHA-256 of their digests
as hex text, until one is left, the subroot. Subroots in the order of the groups give the root the same
way. A parent keeps a copy of the hash state before each of its children, so replacing a child costs
one block for the replacement and one for each sibling to its right; those to its left are never read.

Spread over a cluster: a range partitioning gives each leaf its place in the group, and pieces of
``arity ** k`` leaves (4,096 at most) grow their part of the tree in one task each. Their tops are the
leaves of the next tier, so a group of any size takes a few tiers and no task sees more than a piece. Proofs
and folds go down the tiers: each piece receives the path above it, and works on all of its leaves at once.

Null groups form one group that comes first, null keys come first in their group, repeated keys are
ordered by their leaf; repeated rows are one leaf each. An empty table has no root (null). Columns
other than the ones given are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowwatch.llm import sha_states as sha
from flowwatch.session import materialize

PIECE = 4096
_LEAVES = 1 << 14
_STEP = "array<struct<state: binary, right: binary, others: binary, children: int>>"


def leaf(*fields: Column) -> Column:
    """Digest of a row: of each field its UTF-8 size, a colon and the value, or - for null."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values)), 256)


@dataclass
class Manifest:
    """``tiers`` of the groups' trees, from the leaves up, and of the tree over ``subroots`` (group, top)."""

    arity: int
    piece: int
    tiers: list[DataFrame]
    above: list[DataFrame]
    subroots: DataFrame
    root: str | None


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Level:
    """One level of several trees: where each node's parent is, in flat order, and which child of it the node is."""

    def __init__(self, counts: np.ndarray, arity: int):
        self.up = -(-counts // arity)
        at = _ranges(counts)
        self.first = np.cumsum(counts) - counts
        self.parent = np.repeat(np.cumsum(self.up) - self.up, counts) + at // arity
        self.slot = at % arity
        self.children = np.bincount(self.parent, minlength=int(self.up.sum()))


def _finished(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    out = np.empty((state.shape[1], 8), np.uint32)
    for n in np.unique(children):
        some = children == n
        out[some] = sha.finish(state[:, some], int(n))
    return out


def _grow(digests: np.ndarray, level: _Level, arity: int) -> tuple[np.ndarray, np.ndarray]:
    """The parents' digests, and their states before each child."""
    state = sha.started(len(level.children))
    states = np.empty((len(level.children), arity, 8), np.uint32)
    for s in range(arity):
        states[:, s] = state.T
        at = np.flatnonzero(level.slot == s)
        if len(at):
            state[:, level.parent[at]] = sha.absorb(state[:, level.parent[at]], digests[at])
    return _finished(state, level.children), states


def _some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``_LEAVES`` leaves in all."""
    for batch in batches:
        sizes = batch.column("leaves").value_lengths().to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // _LEAVES
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def _digests(column: pa.Array) -> np.ndarray:
    return sha.unpack(b"".join(column.to_pylist()))


def _grower(arity: int, piece: int):
    """Adds to each piece its levels, their nodes and states, and the node at its top."""

    def run(batches):
        for batch in _some_rows(batches):
            leaves = batch.column("leaves")
            counts = leaves.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            total = batch.column("total").to_numpy()
            # A piece of a larger group grows to its full height, even from a single leaf.
            height = np.ceil(np.round(np.log(np.maximum(np.where(total > piece, piece, counts), 1)) / np.log(arity), 9)).astype(np.int64)
            nodes: list[list[bytes]] = [[] for _ in counts]
            states: list[list[bytes]] = [[] for _ in counts]
            live, digests = np.arange(len(counts)), _digests(leaves.flatten().field("leaf"))
            top = [b""] * len(counts)
            for done in range(int(height.max(initial=0)) + 1):
                ends = np.cumsum(counts)
                for i in np.flatnonzero(height[live] == done):
                    top[live[i]] = sha.pack(digests[ends[i] - 1 : ends[i]])
                going = height[live] > done
                digests = digests[np.repeat(going, counts)]
                live, counts = live[going], counts[going]
                if not len(live):
                    break
                level = _Level(counts, arity)
                digests, kept = _grow(digests, level, arity)
                counts = level.up
                for i, a, b in zip(live, np.cumsum(counts) - counts, np.cumsum(counts)):
                    nodes[i].append(sha.pack(digests[a:b]))
                    states[i].append(sha.pack(kept[a:b]))
            more = [pa.array(height, pa.int32()), *(pa.array([b"".join(x) for x in y], pa.binary()) for y in (nodes, states)), pa.array(top, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "height", "nodes", "states", "top"])

    return run


def _levels(batch: pa.RecordBatch, arity: int):
    """From the leaves up: the trees that go on, the level, and its digests and its parents' states."""
    leaves = batch.column("leaves")
    counts = leaves.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    height = batch.column("height").to_numpy()
    nodes, states = batch.column("nodes").to_pylist(), batch.column("states").to_pylist()
    read = np.zeros(len(counts), np.int64)
    live, digests = np.arange(len(counts)), _digests(leaves.flatten().field("leaf"))
    for done in range(int(height.max(initial=0))):
        going = height[live] > done
        digests = digests[np.repeat(going, counts)]
        live, counts = live[going], counts[going]
        level = _Level(counts, arity)
        size = level.up
        kept = sha.unpack(b"".join(states[i][32 * arity * read[i] : 32 * arity * (read[i] + n)] for i, n in zip(live, size))).reshape(-1, arity, 8)
        yield live, level, digests, kept
        digests = sha.unpack(b"".join(nodes[i][32 * read[i] : 32 * (read[i] + n)] for i, n in zip(live, size)))
        read[live] += size
        counts = size


def _pather(arity: int):
    """For each leaf of a piece the steps from it to the root: those inside the piece, then the piece's own."""

    def run(batches):
        for batch in _some_rows(batches):
            leaves = batch.column("leaves")
            counts = leaves.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            tree = np.repeat(np.arange(len(counts)), counts)
            steps: list[list[dict]] = [[] for _ in tree]
            at = _ranges(counts)
            for live, level, digests, kept in _levels(batch, arity):
                place = np.full(len(counts), -1)
                place[live] = level.first
                for i in np.flatnonzero(place[tree] >= 0):
                    node = place[tree[i]] + at[i]
                    parent, slot = level.parent[node], level.slot[node]
                    left, right = digests[node - slot : node], digests[node + 1 : node - slot + level.children[parent]]
                    steps[i].append({"state": sha.pack(kept[parent, slot]), "right": sha.pack(right), "others": sha.pack(left) + sha.pack(right), "children": int(level.children[parent])})
                    at[i] //= arity
            own, subroots = batch.column("path").to_pylist(), batch.column("subroot").to_pylist()
            flat = leaves.flatten()
            paths = pa.array([s + (own[t] or []) for s, t in zip(steps, tree)], batch.schema.field("path").type)
            yield pa.RecordBatch.from_arrays(
                [batch.column("group").take(pa.array(tree)), flat.field("pos"), flat.field("id"), paths, pa.array([subroots[t] for t in tree], pa.string())],
                names=["group", "pos", "id", "path", "subroot"],
            )

    return run


def _folder(arity: int):
    """For each leaf its proof, and the root that follows from its replacement."""

    def run(batches):
        for batch in _some_rows(batches):
            leaves = batch.column("leaves")
            counts = leaves.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            tree = np.repeat(np.arange(len(counts)), counts)
            flat = leaves.flatten()
            now, at = _digests(flat.field("again")), _ranges(counts)
            proof: list[tuple[np.ndarray, np.ndarray]] = []
            for live, level, digests, kept in _levels(batch, arity):
                place = np.full(len(counts), -1)
                place[live] = level.first
                rows = np.flatnonzero(place[tree] >= 0)
                node = place[tree[rows]] + at[rows]
                parent, slot = level.parent[node], level.slot[node]
                state = sha.absorb(np.ascontiguousarray(kept[parent, slot].T), now[rows])
                for s in range(arity):
                    other = np.flatnonzero((s != slot) & (s < level.children[parent]))
                    proof.append((rows[other], digests[node[other] - slot[other] + s]))
                    right = other[slot[other] < s]
                    if len(right):
                        state[:, right] = sha.absorb(state[:, right], digests[node[right] - slot[right] + s])
                now[rows] = _finished(state, level.children[parent])
                at[rows] //= arity
            paths = batch.column("path").to_pylist()
            begins = np.cumsum(counts) - counts
            for step in range(max((len(p or []) for p in paths), default=0)):
                for i, path in enumerate(paths):
                    if len(path or []) <= step:
                        continue
                    rows = np.arange(begins[i], begins[i] + counts[i])
                    for other in sha.unpack(path[step]["others"]):
                        proof.append((rows, np.broadcast_to(other, (len(rows), 8))))
                    state = sha.absorb(np.repeat(sha.unpack(path[step]["state"]).T, len(rows), 1), now[rows])
                    for right in sha.unpack(path[step]["right"]):
                        state = sha.absorb(state, np.broadcast_to(right, (len(rows), 8)))
                    now[rows] = sha.finish(state, path[step]["children"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("group").take(pa.array(tree)), flat.field("id"), _hex(_digests(flat.field("leaf"))),
                 batch.column("subroot").take(pa.array(tree)), _joined(proof, len(tree)), _hex(now)],
                names=["group", "id", "leaf", "subroot", "proof", "folded_root"],
            )

    return run


def _hex(digests: np.ndarray) -> pa.Array:
    at = np.arange(len(digests) + 1, dtype=np.int32) * 64
    return pa.StringArray.from_buffers(len(digests), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(sha.hex_bytes(digests))))


def _joined(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """The digests of each row as one hex text, in the order found."""
    row = np.concatenate([np.empty(0, np.int64), *(r for r, _ in found)])
    digests = np.concatenate([np.empty((0, 8), np.uint32), *(d for _, d in found)])
    order = np.argsort(row, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) * 64)]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(sha.hex_bytes(digests[order]))))


def _placed(rows: DataFrame) -> DataFrame:
    """Adds each row's place in its group (``pos``) and the group's size (``total``); rows: group, id, leaf, again.

    Sorted ranges number their rows; a table of one row per range and group shifts the numbers.
    """
    rows = materialize(rows, "leaves")
    ordered = rows.repartitionByRange("group", "id", "leaf").sortWithinPartitions("group", "id", "leaf")
    ordered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered-leaves").withColumn("part", F.shiftright("at", 33))
    runs = ordered.groupBy("group", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("group")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    runs = runs.select(F.col("group").alias("g"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total"))
    joined = ordered.join(runs, F.col("group").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return joined.select("group", "id", "leaf", "again", (F.col("at") + F.col("shift")).alias("pos"), "total")


def _tiers(rows: DataFrame, arity: int, piece: int) -> list[DataFrame]:
    tiers = []
    while True:
        held = F.sort_array(F.collect_list(F.struct("pos", "id", "leaf", "again"))).alias("leaves")
        pieces = rows.withColumn("piece", F.floor(F.col("pos") / piece)).groupBy("group", "total", "piece").agg(held)
        made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
        tiers.append(materialize(pieces.mapInArrow(_grower(arity, piece), f"{made}, height int, nodes binary, states binary, top binary"), "tier"))
        larger = tiers[-1].where(F.col("total") > piece)
        if larger.isEmpty():
            return tiers
        again = F.col("top").alias("again")
        rows = larger.select("group", F.lit(None).cast("int").alias("id"), F.col("top").alias("leaf"), again, F.col("piece").alias("pos"), F.ceil(F.col("total") / piece).alias("total"))


def build(rows: DataFrame, group: str, key: str, digest: Column, replacement: Column | None = None, arity: int = 2, piece: int = PIECE) -> Manifest:
    """The manifest of the rows. ``digest``: each row's leaf as hex text. ``replacement``: a digest to fold in its place, null for none."""
    if arity < 2:
        raise ValueError("a parent has two children or more")
    size = arity
    while size * arity <= piece:
        size *= arity
    again = F.lit(None).cast("binary") if replacement is None else F.unhex(replacement)
    leaves = rows.select(F.col(group).alias("group"), F.col(key).alias("id"), F.unhex(digest).alias("leaf"), again.alias("again"))
    leaves = leaves.withColumn("again", F.coalesce("again", "leaf"))
    tiers = _tiers(_placed(leaves), arity, size)
    tops = [t.where(F.col("total") <= size).select("group", "top") for t in tiers]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionAll(t)
    subroots = materialize(subroots, "subroots")
    above = _tiers(_placed(subroots.select(F.lit(0).alias("group"), F.col("group").alias("id"), F.col("top").alias("leaf"), F.col("top").alias("again"))), arity, size)
    last = above[-1].where(F.col("total") <= size).first()
    return Manifest(arity, size, tiers, above, subroots, bytes(last.top).hex() if last else None)


def _paths(tier: DataFrame, arity: int) -> DataFrame:
    kinds = dict(tier.dtypes)
    return tier.mapInArrow(_pather(arity), f"`group` {kinds['group']}, pos long, id {_id_type(tier)}, path {_STEP}, subroot string")


def _id_type(tier: DataFrame) -> str:
    return tier.schema["leaves"].dataType.elementType["id"].dataType.simpleString()


def _downward(manifest: Manifest, tiers: list[DataFrame], groups: DataFrame) -> DataFrame:
    """The lowest tier with each piece's path to the root. ``groups``: group, subroot and the path of the subroot."""
    reached = None
    for tier in reversed(tiers):
        lone = tier.where(F.col("total") <= manifest.piece).select(F.col("group").alias("h"))
        known = lone.join(groups, F.col("h").eqNullSafe(F.col("group"))).select(F.col("group").alias("g"), F.lit(0).cast("long").alias("p"), "path", "subroot")
        if reached is not None:
            above = _paths(reached, manifest.arity)
            known = known.unionAll(above.select(F.col("group").alias("g"), F.col("pos").alias("p"), "path", "subroot"))
        reached = tier.join(known, F.col("group").eqNullSafe(F.col("g")) & (F.col("piece") == F.col("p"))).drop("g", "p")
    return reached


def audit(manifest: Manifest) -> DataFrame:
    """One row per leaf: group, id, leaf, subroot, root, proof, folded_root and verified.

    ``proof``: the siblings from the leaf to the root, level by level and left to right, as one hex text.
    ``folded_root`` follows from the replacement (or the leaf itself) and the siblings; verified if it is the root.
    """
    nothing = manifest.above[-1].select("group").distinct().select("group", F.lit(None).cast("string").alias("subroot"), F.expr(f"cast(array() as {_STEP})").alias("path"))
    reached = _paths(_downward(manifest, manifest.above, nothing), manifest.arity).select(F.col("id").alias("group"), "path")
    named = manifest.subroots.select(F.col("group").alias("s"), F.lower(F.hex("top")).alias("subroot"))
    groups = materialize(reached.join(named, F.col("group").eqNullSafe(F.col("s"))).select("group", "subroot", "path"), "group-paths")
    lowest = _downward(manifest, manifest.tiers, groups)
    made = f"`group` {dict(lowest.dtypes)['group']}, id {_id_type(lowest)}, leaf string, subroot string, proof string, folded_root string"
    folded = lowest.mapInArrow(_folder(manifest.arity), made)
    return folded.withColumn("root", F.lit(manifest.root)).withColumn("verified", F.col("folded_root") == F.col("root"))
