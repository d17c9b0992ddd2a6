"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits: bit i is set if it is set in over half of the hashes of the text's word
shingles (XXH64 of the words joined by single blanks, repeats included). Two fingerprints link if they
differ in ``within`` bits or fewer.

Anchors are the code words of a covering code: the binary Golay code, of length 23 and covering radius 3,
on bits 0 to 22 and once more on bits 23 to 45, so 2^24 anchors in all. The code is perfect: each half of a
fingerprint has one code word at distance 3 or less, and the pair of them is its home. Another fingerprint that differs in t bits
is at distance 3 + t1 and 3 + t2 at most from the halves of that home, with t1 + t2 <= t. So each
distinct fingerprint is replicated to every anchor within covering radius plus threshold in this sense, and each anchor compares
those at home with all that came. The pair (smaller, larger) meets at the home of the smaller one: every link is found, once.

Copies share a fingerprint and travel once. A fingerprint has 64 + 2,016 others within two bits, so links
grow with the fingerprints whatever the size of a group; anchors are joined by Spark, which splits
large ones. No candidate is capped.

A null, empty or wordless text has the fingerprint zero and links like any other; a text of fewer words than n is one shingle. Ids may be null or repeated:
a component is named by its smallest id that is not null. Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowwatch.llm import words as wd
from flowwatch.llm.graph import components
from flowwatch.session import materialize

SEED = 42
#: The Golay code's length, its check bits, covering radius and generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b110001110101
_MASK = (1 << LENGTH) - 1
_CHUNK = 1 << 16
_A_Z = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def _shingles(w: wd.Words, n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words in lower case with single blanks between, and the row and byte range of each shingle."""
    size = w.end - w.start
    begin = np.cumsum(size + 1) - (size + 1)
    data = np.full(int((size + 1).sum()), 32, np.uint8)
    inside = np.repeat(w.start - begin, size) + _places(begin, size)
    data[_places(begin, size)] = _A_Z[w.data[inside]]
    counts = w.counts()
    shingled = np.maximum(counts - n + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(w.rows), shingled)
    first = _places(w.first()[:-1], shingled)
    last = first + np.minimum(n, counts[row]) - 1
    return data.tobytes(), row, begin[first], begin[last] + size[last]


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges [begin, begin + size), one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _fingerprints(n: int):
    def run(batches):
        for b in wd.slices(batches, "text"):
            data, row, start, end = _shingles(wd.cut(b.column("text")), n)
            ones, many = np.zeros((b.num_rows, 64), np.int64), np.bincount(row, minlength=b.num_rows)
            for at in range(0, len(row), _CHUNK):
                some = slice(at, at + _CHUNK)
                hashes = np.array([xxhash.xxh64_intdigest(data[x:y], SEED) for x, y in zip(start[some].tolist(), end[some].tolist())], np.uint64)
                bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                here = row[some]
                begins = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
                ones[here[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
            found = np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").reshape(-1).view("<i8")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.int64())], names=["id", "print"])

    return run


@lru_cache(1)
def _remainders() -> np.ndarray:
    """The remainder of each single bit by the generator."""
    out = []
    for i in range(LENGTH):
        x = 1 << i
        for j in range(LENGTH - 1, CHECKS - 1, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - CHECKS)
        out.append(x)
    return np.array(out, np.int64)


def _remainder(halves: np.ndarray) -> np.ndarray:
    out = np.zeros(len(halves), np.int64)
    for i, r in enumerate(_remainders()):
        out ^= np.where(halves >> i & 1, r, 0)
    return out


@lru_cache(4)
def _steps(within: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences of weight up to radius + within, by remainder and then by weight; and where those of each remainder
    with an excess over the radius of 0, 1, ... end.

    The code words near a half are the half plus each difference of its own remainder.
    """
    steps = np.array([sum(1 << i for i in c) for k in range(RADIUS + within + 1) for c in combinations(range(LENGTH), k)], np.int64)
    excess = np.maximum(np.bitwise_count(steps).astype(np.int64) - RADIUS, 0)
    kind = _remainder(steps) * (within + 1) + excess
    order = np.argsort(kind, kind="stable")
    return steps[order], np.searchsorted(kind[order], np.arange((1 << CHECKS) * (within + 1)), "right").reshape(-1, within + 1)


def anchors(prints: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, whether it is its home) for every anchor it goes to."""
    steps, ends = _steps(within)
    low, high = prints & _MASK, prints >> LENGTH & _MASK
    a, b = _remainder(low), _remainder(high)
    begin_a, begin_b = (np.where(x > 0, ends[x - 1, -1], 0) for x in (a, b))
    out = []
    for spent in range(within + 1):
        from_a = ends[a, spent - 1] if spent else begin_a
        n_a, n_b = ends[a, spent] - from_a, ends[b, within - spent] - begin_b
        row = np.repeat(np.arange(len(prints)), n_a)
        one = low[row] ^ steps[_places(from_a, n_a)]
        many = n_b[row]
        two_of = np.repeat(np.arange(len(row)), many)
        two = _places(begin_b[row], many)
        home = (two == begin_b[row[two_of]]) if spent == 0 else np.zeros(len(two), bool)
        row = row[two_of]
        out.append((row, one[two_of] | (high[row] ^ steps[two]) << LENGTH, home))
    return tuple(np.concatenate(x) for x in zip(*out))


def _replicated(within: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                prints = batch.column("print").slice(at, 1 << 12)
                row, anchor, home = anchors(prints.to_numpy(), within)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), prints.take(pa.array(row)), pa.array(home)], names=["anchor", "print", "home"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """One row per document: id and print, the fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints(n), f"id {dict(rows.dtypes)['id']}, print long")


def links(prints: DataFrame, within: int = 2) -> DataFrame:
    """All pairs (a, b) of different fingerprints, a < b, that differ in ``within`` bits or fewer. ``prints``: distinct ones."""
    if not 0 <= within <= 3:
        raise ValueError("between 0 and 3 bits")
    sent = materialize(prints.select("print").mapInArrow(_replicated(within), "anchor long, print long, home boolean"), "anchors")
    home = sent.where("home").select("anchor", F.col("print").alias("a"))
    return sent.select("anchor", F.col("print").alias("b")).join(home, "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= within)).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, within: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id and n_links (other fingerprints linked with its own)."""
    rows = materialize(fingerprints(docs, key, text, n), "fingerprints")
    prints = materialize(rows.groupBy("print").agg(F.min("id").alias("least")), "prints")
    pairs = materialize(links(prints, within), "links")
    # Components go by hashes: contraction is fast where names are in no order.
    name = lambda c: F.xxhash64(F.col(c))  # noqa: E731  of one number, so no two share a name
    roots = components(pairs.select(name("a").alias("a"), name("b").alias("b")))
    n_links = pairs.select(F.explode(F.array("a", "b")).alias("linked")).groupBy("linked").agg(F.count(F.lit(1)).alias("n_links"))
    named = prints.withColumn("name", name("print")).join(roots, F.col("name") == F.col("node"), "left").withColumn("root", F.coalesce("root", "name"))
    lowest = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = named.join(lowest, F.col("root") == F.col("r")).join(n_links, F.col("print") == F.col("linked"), "left")
    named = named.select(F.col("print").alias("p"), "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    joined = rows.join(named, F.col("print") == F.col("p"))
    return joined.select("id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "n_links")
