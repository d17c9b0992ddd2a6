"""SentencePiece encoding and decoding with sampled segmentations.

A text is cut into chunks of leading blanks and other characters; no piece of the vocabulary goes past
the end of a chunk (checked when the file is read), so the lattice of all segmentations of a text is
the chain of the lattices of its chunks. Forward filtering sums the weights of all ways to each
place of a chunk, for all distinct chunks of a batch at once. Backward sampling goes from the end of the chunk to
its start and draws each piece with its share of that sum, for all chunks of a batch at once. The
draws are hashes of (seed, row key, chunk, step): the same row is always segmented the same, wherever
and with whatever other rows it is processed.

The weight of a piece follows Zipf's law in the order of the vocabulary, to the power ``sharpness``.
Pieces of one byte stand for the characters that no other piece covers, so decoding gives back every
text: one blank is put before the text and taken away again. A null text has null ids and decodes to
null; an empty text has the id of the blank alone. Row keys may be null or repeated: draws also
depend on the text. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.llm import words as wd
from flowwatch.llm.tables import fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SLICE = 1 << 20
_DECODED = 1 << 18
_SEEN_BITS = 18
_LONGEST = 256
_G1, _G2 = np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F


class Vocabulary:
    """Pieces as bytes, with a blank for each blank mark: their hashes by length, and their weights."""

    def __init__(self, model: str, sharpness: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.byte = np.zeros(256, np.int64)
        self.bytes: list[bytes] = []
        self.pieces: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                plain = piece.replace("▁", " ")
                if plain.lstrip(" ").find(" ") >= 0:
                    raise ValueError(f"piece {i} goes past the end of a chunk")
                self.pieces[plain] = i
                self.bytes.append(plain.encode())
        self.log_weight = -sharpness * np.log1p(np.arange(len(self.bytes)))
        if max(map(len, self.bytes)) >= _LONGEST:
            raise ValueError(f"a piece has {_LONGEST} bytes or more")
        by_length: dict[int, list[int]] = {}
        for i in self.pieces.values():
            by_length.setdefault(len(self.bytes[i]), []).append(i)
        # Hashes and ids by length, and a table by the first bits of a hash that rules most texts out.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, ids in sorted(by_length.items()):
            data = np.frombuffer(b"".join(self.bytes[i] for i in ids), np.uint8)
            at = np.arange(len(ids)) * n
            hashes = wd.Spans(data, wd.EXACT).hash(at, at + n)
            order = np.argsort(hashes)
            seen = np.zeros(1 << _SEEN_BITS, bool)
            seen[hashes >> np.uint64(64 - _SEEN_BITS)] = True
            self.by_length[n] = hashes[order], np.array(ids, np.int64)[order], seen
        self.spelt = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.spelt_size = np.array([len(x) for x in self.bytes], np.int64)
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size


_B = np.arange(256)
_CHAR_BYTES = np.where(_B < 0xC0, 1, np.where(_B < 0xE0, 2, np.where(_B < 0xF0, 3, 4)))


class Lattices:
    """The lattices of distinct chunks in flat arrays.

    Each byte place of a chunk is a node; its incoming edges (piece, source) stand together, with
    the running share of the ways that come in by them, so that a uniform number picks one.
    """

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, sizes: np.ndarray):
        """``data``: the bytes of all chunks; ``sizes``: how many each has."""
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes
        left = np.repeat(begin + sizes, sizes) - np.arange(len(data))
        whole = (data & 0xC0) != 0x80
        covered = np.zeros(len(data), bool)
        spans = wd.Spans(data, wd.EXACT)
        at, size, piece = [], [], []

        def add(start: np.ndarray, length: int, ids: np.ndarray) -> None:
            at.append(start), size.append(np.full(len(start), length)), piece.append(ids)

        start = np.flatnonzero(whole)
        for n, (hashes, ids, seen) in vocabulary.by_length.items():
            start = start[left[start] >= n]
            if not len(start):
                break
            found = spans.hash(start, start + n)
            some = seen[found >> np.uint64(64 - _SEEN_BITS)]
            found, at_n = found[some], start[some]
            spot = np.searchsorted(hashes, found)
            spot[spot == len(hashes)] = 0
            same = hashes[spot] == found
            at_n = at_n[same]
            add(at_n, n, ids[spot[same]])
            covered[at_n[_CHAR_BYTES[data[at_n]] == n]] = True
        bare = np.flatnonzero(whole & ~covered)
        for k in range(4):
            one = bare[_CHAR_BYTES[data[bare]] > k] + k
            add(one, 1, vocabulary.byte[data[one]])

        start, length, piece_id = (np.concatenate(x) for x in (at, size, piece))
        mine = chunk[start]
        end = start + length + mine
        # By place in the chunk, then by node, then by source: nodes at one place stand together.
        order = np.argsort(((start + length - begin[mine]) << 40) + (end * _LONGEST + (_LONGEST - length)))
        length, end, self.piece = length[order], end[order], piece_id[order]
        self.source = end - length
        log_weight = vocabulary.log_weight[self.piece]
        place = end - (begin + np.arange(len(sizes)))[mine[order]]
        ways = np.full(len(data) + len(sizes), -np.inf)
        ways[begin + np.arange(len(sizes))] = 0.0
        # Forward filtering: the nodes at one place of all chunks at a time.
        steps = np.searchsorted(place, np.arange(1, (place[-1] if len(place) else 0) + 2))
        for a, b in zip(steps, steps[1:]):
            if a == b:
                continue
            node = end[a:b]
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            way = ways[self.source[a:b]] + log_weight[a:b]
            top = np.maximum.reduceat(way, first)
            rest = np.exp(way - np.repeat(top, np.diff(np.append(first, len(way)))))
            ways[node[first]] = top + np.log(np.add.reduceat(rest, first))
        share = np.exp(ways[self.source] + log_weight - ways[end])
        first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else end
        degree = np.diff(np.append(first, len(end)))
        for k in range(1, int(degree.max()) if len(degree) else 0):
            more = first[degree > k] + k
            share[more] += share[more - 1]
        share[first + degree - 1] = 1.0
        self.share = share
        self.first = np.full(len(ways), -1, np.int64)
        self.first[end[first]] = first
        self.last = begin + sizes + np.arange(len(sizes))


def _draws(row: np.ndarray, chunk: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on row, chunk and step alone."""
    at = row + chunk.astype(np.uint64) * _G1 + np.uint64(step * _G2 % (1 << 64))
    return (wd.mix(at) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _pick(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of ranges, one after the other."""
    return np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def sample(texts: pa.Array, rows: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """A segmentation of each text, as flat ids and how many each text has; ``rows``: 64-bit row seeds."""
    raw, at = wd.text_bytes(texts)
    data = np.insert(raw, at[:-1], 32)
    at = at + np.arange(len(at))
    blank = data == 32
    starts = blank.copy()
    starts[1:] &= ~blank[:-1]
    starts[at[:-1]] = True
    start = np.flatnonzero(starts)
    sizes = np.diff(np.append(start, len(data)))
    hashes = wd.Spans(data, wd.EXACT).hash(start, start + sizes)
    _, chosen, which = np.unique(hashes, return_index=True, return_inverse=True)
    lattices = Lattices(vocabulary, data[_pick(start[chosen], sizes[chosen])], sizes[chosen])

    owner = np.searchsorted(at, start, "right") - 1
    per_row = np.bincount(owner, minlength=len(texts))
    number = np.arange(len(start)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    row, node, live = rows[owner], lattices.last[which], np.arange(len(start))
    steps, count = [], np.zeros(len(start), np.int64)
    while len(live):
        edge = lattices.first[node]
        u = _draws(row[live], number[live], len(steps))
        late = np.flatnonzero(u >= lattices.share[edge])
        while len(late):
            edge[late] += 1
            late = late[u[late] >= lattices.share[edge[late]]]
        steps.append((live, lattices.piece[edge]))
        count[live] += 1
        node = lattices.source[edge]
        more = lattices.first[node] >= 0
        live, node = live[more], node[more]
    # The last drawn piece is the first of its chunk.
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    for i, (which_chunk, ids) in enumerate(steps):
        out[begin[which_chunk] + count[which_chunk] - 1 - i] = ids
    return out, np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)


_loaded: dict[tuple[str, float], Vocabulary] = {}


def _vocabulary(model: str, sharpness: float = 1.0) -> Vocabulary:
    """Kept by the worker: reading the file takes longer than a batch."""
    if (model, sharpness) not in _loaded:
        _loaded[model, sharpness] = Vocabulary(model, sharpness)
    return _loaded[model, sharpness]


def _encoder(model: str, sharpness: float):
    def run(batches):
        vocabulary = _vocabulary(model, sharpness)
        for b in wd.slices(batches, "text", _SLICE):
            missing = b.column("text").is_null().to_numpy(zero_copy_only=False)
            some = np.flatnonzero(~missing)
            seeds = b.column("seed").to_numpy().view(np.uint64)[some]
            flat, found = sample(b.column("text").take(pa.array(some)), wd.mix(seeds), vocabulary)
            counts = np.zeros(b.num_rows, np.int64)
            counts[some] = found
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(at, pa.array(flat), mask=pa.array(missing))
            made = {"ids": ids}
            if "decoded" in b.schema.names:
                made["decoded"] = _texts(ids, vocabulary)
            yield pa.RecordBatch.from_arrays([made.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "piece_ids", seed: int = 0, model: str = MODEL, sharpness: float = 1.0, decoded: str | None = None) -> DataFrame:
    """The rows with the ids of one sampled segmentation each; a column named ``out`` is replaced.

    With ``decoded`` also with a column of that name, the text that the ids spell, made by the same task.
    """
    t, s, i = "text", "seed", "ids"
    rest = [c for c in docs.columns if c.lower() not in (out.lower(), (decoded or out).lower())]
    kept = [f"c{n}" for n in range(len(rest))]
    given = docs.select(
        *(F.col(f"`{c}`").alias(k) for c, k in zip(rest, kept)),
        F.col(text).alias(t),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias(s),
        F.lit(None).cast("array<int>").alias(i),
        *([F.lit(None).cast("string").alias("decoded")] if decoded else []),
    )
    made = given.mapInArrow(_encoder(model, sharpness), given.schema)
    return made.select(*(F.col(k).alias(c) for c, k in zip(rest, kept)), F.col(i).alias(out), *([F.col("decoded").alias(decoded)] if decoded else []))


def _decoder(model: str):
    def run(batches):
        vocabulary = _vocabulary(model)
        for column in batches:
            yield _texts(column, vocabulary)

    return run


def _texts(column: pa.ListArray, vocabulary: Vocabulary) -> pa.Array:
    return pa.concat_arrays([pa.array([], pa.large_string()), *_decoded(column, vocabulary)]).cast(pa.string())


def _decoded(column: pa.ListArray, vocabulary: Vocabulary) -> Iterator[pa.Array]:
    """The texts, about ``_DECODED`` ids at a time."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    flat, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
    group = at[:-1] // _DECODED
    cuts = [*np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(column)] if len(column) else [0]
    for a, b in zip(cuts, cuts[1:]):
        ids = flat[at[a] : at[b]]
        size = vocabulary.spelt_size[ids]
        data = vocabulary.spelt[_pick(vocabulary.spelt_at[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[at[a : b + 1] - at[a]]
        # Without the first byte of each text, the blank put before it.
        lead = ends[:-1][np.diff(ends) > 0]
        kept = ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])
        texts = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(np.delete(data, lead)))
        yield pc.if_else(pa.array(missing[a:b]), pa.scalar(None, pa.large_string()), texts)


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text that the ids spell."""
    run = _decoder(model)

    @F.arrow_udf("string")
    def decoded(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(column)

    return decoded(ids)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0, model: str = MODEL) -> DataFrame:
    """The documents with a struct ``pieces``: ids, decoded and lossless (decoded is the text again)."""
    ids, text_again = fresh(docs, "_ids", "_decoded")
    both = encode(docs, key, text, ids, seed, model, decoded=text_again)
    lossless = F.col(text_again).eqNullSafe(F.col(text))
    return both.withColumn("pieces", F.struct(F.col(ids).alias("ids"), F.col(text_again).alias("decoded"), lossless.alias("lossless"))).drop(ids, text_again)
