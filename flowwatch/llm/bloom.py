"""A blocked Bloom filter: eight bits of each key in one 256-bit block, so a lookup touches one place.

The filter has a fixed largest size, whatever the number of keys, so it may be broadcast. Beyond that
size it lets more keys pass; callers join what passes with the exact keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from flowwatch.llm.words import mix

BITS_PER_KEY = 64
MOST_BLOCKS = 1 << 17  # 4 MB
_WORDS = 8  # of 32 bits
_SALTS = mix(np.arange(1, _WORDS + 1))


def blocks_for(keys: int, most: int = MOST_BLOCKS) -> int:
    return max(1, min(most, -(-keys * BITS_PER_KEY // (32 * _WORDS))))


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key, and one bit in each of the block's words."""
    keys = mix(keys)
    at = ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bit = (keys[:, None] * (_SALTS | np.uint64(1))[None, :]) >> np.uint64(59)
    return at.astype(np.int64), np.uint32(1) << bit.astype(np.uint32)


def _partial(column: str, blocks: int):
    """Each task's filter: one row for each block it has touched."""

    def run(batches):
        import pyarrow as pa

        table = np.zeros((blocks, _WORDS), np.uint32)
        for b in batches:
            at, bits = _places(b.column(column).to_numpy().view(np.uint64), blocks)
            for w in range(_WORDS):
                np.bitwise_or.at(table[:, w], at, bits[:, w])
        used = np.flatnonzero(table.any(axis=1))
        words = [pa.array(table[used, w].astype(np.int64)) for w in range(_WORDS)]
        yield pa.RecordBatch.from_arrays([pa.array(used), *words], names=["block", *(f"w{i}" for i in range(_WORDS))])

    return run


def build(keys: DataFrame, column: str, most: int = MOST_BLOCKS) -> np.ndarray:
    """The filter of a column of 64-bit hashes: at most ``most`` rows of eight words reach the driver."""
    blocks = blocks_for(keys.count(), most)
    names = [f"w{i}" for i in range(_WORDS)]
    parts = keys.select(column).mapInArrow(_partial(column, blocks), "block long, " + ", ".join(f"{n} long" for n in names))
    rows = parts.groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names)).toPandas()
    table = np.zeros((blocks, _WORDS), np.uint32)
    table[rows["block"].to_numpy(np.int64)] = rows[names].to_numpy(np.int64).astype(np.uint32)
    return table


def maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a key is certainly not among those the filter was built from."""
    at, bits = _places(keys.view(np.uint64), len(table))
    return ((table[at] & bits) == bits).all(axis=1) if len(keys) else np.empty(0, bool)
