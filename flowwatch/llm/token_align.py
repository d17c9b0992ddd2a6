"""Alignment of two tokenizers' tokens by the bytes that they stand for.

A is a byte-level BPE of the ``tokenizers`` library, B a ``sentencepiece`` model; A reads a blank and the
text, B the text before which it puts that blank itself. The character offsets of A and the proto spans of
B give coarse ends. Where a token's coarse end is not as many bytes past the one before as the token spells (part of a character, a byte
piece, trimmed blanks), its end follows from the last good one and the decoded bytes since. Where tokens of
both end at one byte, a group of tokens ends, and the two tokens are linked.

Both tokenizers treat a text as a chain of chunks, cut before a blank that follows a character other than white
space: A's pre-tokenizer ends there, and no piece of B goes past it (both checked when the files are
read; otherwise a text is one chunk). So each distinct chunk is encoded and aligned once, and texts are put together from
chunks. Chunks that are new go to the libraries many at a time, as one text. A worker keeps what it knows, up to a bound.

Every text is encoded once, into one narrow row: its sizes and its distinct linked pairs with their
number. Pairs are summed over the corpus by Spark. Of two linked tokens one spells an end of the other, so
there are at most as many pairs as the vocabularies have bytes: a table of proven size, which is checked and broadcast.

A null or empty text, or one that the bytes of A or B do not spell, has no tokens. Special tokens' strings in texts are plain text. Keys may
be null or repeated: each row is its own. Other columns are not read.
"""

from __future__ import annotations

import json
import os
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowwatch.llm import words as wd
from flowwatch.session import materialize

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SLICE = 2 << 20
_KNOWN = 1 << 20
_LEARN = 1 << 15
_TOGETHER = 1 << 14
_MARK = "▁".encode()
#: The flat arrays of known chunks, and which counts say how much of them each chunk has.
_FLAT = {"ids_a": "n_a", "ids_b": "n_b", "group_a": "n_groups", "group_b": "n_groups", "pairs": "n_groups", "text": "n_text"}
_KINDS = dict.fromkeys([*_FLAT, *_FLAT.values()], np.int32) | {"pairs": np.int64, "text": np.uint8, "good": bool}


def _alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 is itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges [begin, begin + size), one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def refined(chunk_first: np.ndarray, coarse: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ends of tokens in bytes from their chunk's start.

    ``chunk_first``: each token's chunk's first token; ``coarse``: the ends that the library gives; ``size``: bytes that the token spells.
    """
    at = np.arange(len(coarse))
    before = np.where(at == chunk_first, 0, np.concatenate([[0], coarse[:-1]]) if len(coarse) else coarse)
    good = np.maximum.accumulate(np.where(coarse - before == size, at, -1))
    known = good >= chunk_first
    total = np.cumsum(size)
    return np.where(known, coarse[good], 0) + total - np.where(known, total[good], (total - size)[chunk_first])


def _closed(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is neither white space nor the blank mark.

    A few other characters that share their last bytes with these count as such too.
    """
    last, second, third = (data[np.maximum(ends - k, 0)] for k in (1, 2, 3))
    two = (ends > 1) & (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    three = (ends > 2) & (third >= 0xE1) & (third <= 0xE3) & np.isin(second, (0x80, 0x81, 0x96, 0x9A))
    return (last > 32) & ~((last >= 0x80) & (two | three))


class _Spelling:
    """The bytes of each id, flat."""

    def __init__(self, entries: list[bytes]):
        if not all(entries):
            raise ValueError("a token without bytes")
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.size = np.array([len(x) for x in entries], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def wrong(self, ids: np.ndarray, chunk: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which chunks the ids do not spell."""
        spelt = np.zeros(len(begin), np.int64)
        np.add.at(spelt, chunk, self.size[ids])
        bad = spelt != length
        some = ids[~bad[chunk]]
        differ = self.data[_ranges(self.at[some], self.size[some])] != data[_ranges(begin[~bad], length[~bad])]
        bad[np.repeat(np.flatnonzero(~bad), length[~bad])[differ]] = True
        return bad


class Aligner:
    """Aligned chunks: of each its ids, how many of A and B each group has, its linked pairs and its groups as text."""

    def __init__(self, byte_model: str, piece_model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_model)
        self.a.encode_special_tokens = True
        alphabet = _alphabet()
        entries = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            entries[i] = bytes(alphabet[c] for c in token)
        self.spelt_a = _Spelling(entries)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spelt_b = _Spelling([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.cuts = self._cuts_a(byte_model) and all("▁" not in p.lstrip("▁") for p in pieces)
        self.clear()

    @staticmethod
    def _cuts_a(byte_model: str) -> bool:
        with open(byte_model) as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        return not said.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")

    @property
    def most_pairs(self) -> int:
        return len(self.spelt_a.data) + len(self.spelt_b.data)

    def clear(self) -> None:
        #: Hashes of known chunks in order, and their numbers.
        self.names, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int32)
        for name, kind in _KINDS.items():
            setattr(self, name, np.empty(0, kind))

    def chunks(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where chunks begin in the texts [at[i], at[i + 1]) of the data; each text has a blank first."""
        starts = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data) > 2:
            starts[1:-2] = (data[1:-1] == 32) & _closed(data, np.arange(1, len(data) - 1))
            starts[at[1:][at[1:] > 0] - 1] = False  # a blank at the very end stays with the chunk before it
        starts[at[:-1]] = True
        return np.flatnonzero(starts[:-1])

    def learn(self, names: np.ndarray, chunks: list[bytes]) -> None:
        """Encodes and aligns distinct chunks that are not known yet, many in one text where another may follow. ``names``: their hashes."""
        size = np.array([len(c) for c in chunks], np.int64)
        follows = _closed(np.frombuffer(b"".join(chunks), np.uint8), np.cumsum(size)) if self.cuts else np.zeros(len(chunks), bool)
        follows &= np.array([_MARK not in c for c in chunks], bool)
        order = np.argsort(~follows, kind="stable")
        together = np.cumsum(size[order]) // _TOGETHER
        alone = (together.max(initial=0) + 1) + np.arange(len(chunks))
        left = self._align(names[order], [chunks[i] for i in order], np.where(follows[order], together, alone))
        if len(left):
            left = order[left]
            self._align(names[left], [chunks[i] for i in left], np.arange(len(left)))

    def _align(self, names: np.ndarray, chunks: list[bytes], group: np.ndarray) -> np.ndarray:
        """Learns chunks, those of a group as one text. Returns the places of those in groups that are not spelt, unless they are alone."""
        data = np.frombuffer(b"".join(chunks), np.uint8)
        length = np.array([len(c) for c in chunks], np.int64)
        begin = np.cumsum(length) - length
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        many = np.diff(np.append(first, len(chunks)))
        from_, size = begin[first], np.add.reduceat(length, first)
        whole = data.tobytes()
        texts = [whole[x : x + n].decode() for x, n in zip(from_.tolist(), size.tolist())]
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        ids_a, ends_a, many_a = [], [], []
        for e in self.a.encode_batch(texts, add_special_tokens=False):
            ids_a += e.ids
            ends_a += [y for _, y in e.offsets]
            many_a.append(len(e.ids))
        ids_b, ends_b, many_b = [], [], []
        for p in self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1):
            # Spans count from behind the blank that B puts first.
            pieces = list(p.pieces)
            ids_b += [x.id for x in pieces]
            ends_b += [x.end + 1 for x in pieces]
            many_b.append(len(pieces))
        ids_a, ids_b, n_a, n_b = (np.array(x, np.int64) for x in (ids_a, ids_b, many_a, many_b))
        in_a, in_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
        good = ~(self.spelt_a.wrong(ids_a, in_a, data, from_, size) | self.spelt_b.wrong(ids_b, in_b, data, from_, size))
        coarse_a = chars[np.searchsorted(chars, from_)[in_a] + np.array(ends_a, np.int64)] - from_[in_a]
        end_a = refined((np.cumsum(n_a) - n_a)[in_a], coarse_a, self.spelt_a.size[ids_a]) + from_[in_a]
        end_b = refined((np.cumsum(n_b) - n_b)[in_b], np.array(ends_b, np.int64), self.spelt_b.size[ids_b]) + from_[in_b]
        ids_a, end_a, ids_b, end_b = ids_a[good[in_a]], end_a[good[in_a]], ids_b[good[in_b]], end_b[good[in_b]]
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        group_a, group_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        said_a, said_b = map(str, ids_a.tolist()), map(str, ids_b.tolist())
        said = [
            f"{next(said_a)}|{next(said_b)}" if u == v == 1 else f"{','.join(islice(said_a, u))}|{','.join(islice(said_b, v))}"
            for u, v in zip(group_a.tolist(), group_b.tolist())
        ]
        of = lambda at: np.bincount(np.searchsorted(begin, at - 1, "right") - 1, minlength=len(chunks))
        new = {"ids_a": ids_a, "ids_b": ids_b, "group_a": group_a, "group_b": group_b, "n_a": of(end_a), "n_b": of(end_b), "n_groups": of(ends)}
        new["pairs"] = ids_a[last_a] * len(self.spelt_b.size) + ids_b[last_b]
        good, lone = np.repeat(good, many), np.repeat(many == 1, many)
        known = np.flatnonzero(good | lone)
        at = np.cumsum(new["n_groups"]) - new["n_groups"]
        texts = [";".join(said[x : x + n]).encode() for x, n in zip(at[known].tolist(), new["n_groups"][known].tolist())]
        new |= {name: new[name][known] for name in ("n_a", "n_b", "n_groups")} | {"good": good[known]}
        new |= {"text": np.frombuffer(b"".join(texts), np.uint8), "n_text": np.array([len(t) for t in texts], np.int64)}
        # Chunks that are tried again have nothing in the flat arrays.
        for name, values in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), values.astype(_KINDS[name])]))
        all_names = np.concatenate([self.names, names[known]])
        order = np.argsort(all_names, kind="stable")
        numbers = np.concatenate([self.numbers, len(self.names) + np.arange(len(known), dtype=np.int32)])
        self.names, self.numbers = all_names[order], numbers[order]
        return np.flatnonzero(~(good | lone))

    def find(self, names: np.ndarray) -> np.ndarray:
        """The numbers of chunks, or -1."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.numbers[at], -1)

    def place(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, known chunk) of all chunks of the texts in order, and which rows have tokens. Holds until the next call."""
        raw, at = wd.text_bytes(texts)
        size = np.diff(at)
        full = size > 0
        at = np.concatenate([[0], np.cumsum(size + full)])
        data = np.full(int(at[-1]), 32, np.uint8)
        data[_ranges(at[:-1] + full, size)] = raw
        begin = self.chunks(data, at[np.concatenate([full, [True]])])
        length = np.diff(np.append(begin, len(data)))
        row = np.searchsorted(at, begin, "right") - 1
        hashes = wd.Spans(data, wd.EXACT).hash(begin, begin + length)
        names, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.names) > _KNOWN:
            self.clear()
        new = np.flatnonzero(self.find(names) < 0)
        if len(new):
            whole, first = data.tobytes(), one[new]
            for start in range(0, len(new), _LEARN):
                some = slice(start, start + _LEARN)
                ends = (begin + length)[first[some]].tolist()
                self.learn(names[new[some]], [whole[a:b] for a, b in zip(begin[first[some]].tolist(), ends)])
        chunk = self.find(names)[which]
        self.text_at = np.cumsum(self.n_text, dtype=np.int64) - self.n_text
        has = full.copy()
        has[row[~self.good[chunk]]] = False
        some = has[row]
        return row[some], chunk[some], has

    def gather(self, name: str, chunk: np.ndarray) -> np.ndarray:
        """One of the flat arrays for a run of chunks."""
        size = getattr(self, _FLAT[name]).astype(np.int64)
        return getattr(self, name)[_ranges((np.cumsum(size) - size)[chunk], size[chunk])]


    def said(self, chunk: np.ndarray) -> bytes:
        """The groups of a run of chunks as text."""
        size = self.n_text[chunk].astype(np.int64)
        out = np.full(int(size.sum()) + len(chunk), ord(";"), np.uint8)
        begin = np.cumsum(size + 1) - (size + 1)
        out[_ranges(begin, size)] = self.text[_ranges(self.text_at[chunk], size)]
        return out[:-1].tobytes()


_loaded: dict[tuple[str, str], Aligner] = {}


def _aligner(byte_model: str, piece_model: str) -> Aligner:
    key = (byte_model, piece_model)
    if key not in _loaded:
        _loaded[key] = Aligner(byte_model, piece_model)
    return _loaded[key]


def _sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Exact sums of the values of each row; rows ascend."""
    total = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(row, np.arange(rows + 1))
    return total[at[1:]] - total[at[:-1]]


def _aligned(byte_model: str, piece_model: str):
    def run(batches):
        known = _aligner(byte_model, piece_model)
        for b in wd.slices(batches, "text", _SLICE):
            row, chunk, _ = known.place(b.column("text"))
            columns = [b.column("id")]
            for name in ("ids_a", "ids_b", "group_a", "group_b"):
                counts = _FLAT[name]
                columns.append(wd.lists(known.gather(name, chunk).astype(np.int32), _sums(getattr(known, counts)[chunk], row, b.num_rows), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "a", "b", "group_a", "group_b"])

    return run


def _summaries(byte_model: str, piece_model: str):
    def run(batches):
        known = _aligner(byte_model, piece_model)
        for b in wd.slices(batches, "text", _SLICE):
            row, chunk, has = known.place(b.column("text"))
            n_a, n_b, n_groups = (_sums(getattr(known, c)[chunk], row, b.num_rows) for c in ("n_a", "n_b", "n_groups"))
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            digest = [sha256(known.said(chunk[x:y])).hexdigest() if h else "" for x, y, h in zip(at, at[1:], has)]
            pair = known.gather("pairs", chunk)
            of = np.repeat(row, known.n_groups[chunk])
            order = np.lexsort((pair, of))
            pair, of = pair[order], of[order]
            first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])])) if len(pair) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(pair)))
            many = np.bincount(of[first], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digest, pa.string()), wd.lists(pair[first], many, pa.int64()), wd.lists(times.astype(np.int32), many, pa.int32())],
                names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
            )

    return run


def _scored(table):
    def run(batches):
        pair, count, best = table.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times").flatten().to_numpy().astype(np.int64)
            many = pairs.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), many)
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            sums = [_sums(x, row, b.num_rows) for x in (times, times * best[at], times * count[at])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _KEPT), *map(pa.array, sums)], names=[*_KEPT, "n_links", "n_best", "count_sum"])

    return run


_KEPT = ("id", "n_a", "n_b", "n_groups", "groups_sha256")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """One row per document: id, the ids of both tokenizers (a, b) and how many of them each group has (group_a, group_b)."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_aligned(byte_model, piece_model), f"id {dict(rows.dtypes)['id']}, a array<int>, b array<int>, group_a array<int>, group_b array<int>")


def pair_counts(summaries: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold each pair, which is id A * size of B + id B."""
    each = summaries.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy("x.pairs").agg(F.sum("x.times").alias("n"))
    return each.withColumnRenamed("pairs", "pair")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, groups_sha256, n_links, n_best and count_sum.

    n_best: links whose pair is linked most often of all pairs of its B id, over the corpus; count_sum: how often the pairs of its links are linked, summed.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    kept = f"id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string"
    summaries = materialize(rows.mapInArrow(_summaries(byte_model, piece_model), f"{kept}, pairs array<long>, times array<int>"), "links")
    most = _aligner(byte_model, piece_model)
    counted = materialize(pair_counts(summaries), "pairs")
    if counted.count() > most.most_pairs:
        raise ValueError("more pairs than the vocabularies allow")
    counted = counted.toArrow()
    pair, n = (counted.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    of_b = pair % len(most.spelt_b.size)
    top = np.zeros(len(most.spelt_b.size), np.int64)
    np.maximum.at(top, of_b, n)
    table = docs.sparkSession.sparkContext.broadcast((pair, n, n == top[of_b]))
    return summaries.mapInArrow(_scored(table), f"{kept}, n_links long, n_best long, count_sum long")
