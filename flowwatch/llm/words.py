"""Words of an Arrow text column as flat numpy arrays.

A word is a maximal run of bytes of one class, so that whole batches are cut without a loop over
rows. Every non-ASCII byte belongs to words in both classes, hence no character is ever split.
A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: ASCII letters and digits, and everything outside ASCII.
ALNUM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90))
#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
SOLID = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
#: The same with every byte for itself.
EXACT = mix((_BYTES.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
_powers: list[np.ndarray] = []


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
        del _powers[:-2]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """The words of ``rows`` texts in order: row, byte range in ``data`` and hash of each."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def first(self) -> np.ndarray:
        """Index of each row's first word; one more entry than rows."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def position(self) -> np.ndarray:
        """Index of each word in its own row."""
        return np.arange(len(self.row)) - self.first()[self.row]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts and their offsets; null is the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def cut(texts: pa.Array, kind: np.ndarray = SOLID, also: int | None = None) -> Words:
    """All words of the texts. ``also``: a byte at which rows are cut as well (a line feed)."""
    data, at = text_bytes(texts)
    n = len(data)
    solid = kind[data]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = solid[:-1], solid[1:]
    edges = at[:-1][at[:-1] < n]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    row = np.searchsorted(at, start, "right") - 1
    return Words(data, row, start, end, Spans(data).hash(start, end), len(at) - 1)


class Spans:
    """64-bit hashes of byte ranges from one running sum over the bytes."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = _CODES):
        up, self.down = _powers_of(len(data))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64) * _GOLDEN)


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words inside a row, and the index of each one's first word."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, (n * int(_GOLDEN)) % (1 << 64), np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + size]) * _BASE + np.uint64(i)
        out ^= out >> np.uint64(29)
    at = np.flatnonzero(row[:size] == row[n - 1 : n - 1 + size]) if size else np.empty(0, np.int64)
    return mix(out[at]), at


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each n-word shingle; a row of fewer words gives its whole sequence."""
    found, at = grams(words.hash, words.row, n)
    parts, rows = [found], [words.row[at]]
    counts, first = words.counts(), words.first()
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            whole, _ = grams(words.hash[(first[short][:, None] + np.arange(k)).ravel()], np.repeat(short, k), k)
            parts.append(whole)
            rows.append(short)
    if len(parts) == 1:
        return found, rows[0]
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.concatenate(parts)[order], row[order]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``limit`` bytes of text, to bound what numpy holds at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // limit
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        for a, b in zip(begins, [*begins[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def long_lists(found: list[np.ndarray]) -> pa.Array:
    """An Arrow column of lists of 64-bit integers."""
    if any(x.dtype != np.int64 for x in found):
        raise TypeError("64-bit integers only: others would lose digits")
    return lists(np.concatenate([np.empty(0, np.int64), *found]), np.array([len(x) for x in found], np.int64), pa.int64())
