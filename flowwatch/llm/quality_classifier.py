"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Random indexing gives every word a fixed sparse vector of a few +1 and -1, drawn from its hash. A word's
context vector is the sum of those of its neighbours over all documents, so it has a fixed width
and needs no training. Each word also has a shape (letter case, digits, symbols, whether it repeats
the word before it), with context vectors of its own. Words are hashed into a fixed number of rows, so
the summed table has a fixed size and is broadcast; its sums are integers, hence exact in any order.

A document is the mean of its words' normalised vectors and of their shapes'. A network with one hidden
layer, in numpy, is fitted on at most ``most_rows`` labelled documents (those with the smallest
hashes); one in five of them is held back to choose the temperature by which its logits are divided,
so that scores are calibrated probabilities.

Only text is read. A null, empty or wordless text has the zero vector and gets the network's answer to it.
Ids may be null or repeated; labels of one id that differ count with the larger. With labels of
one class only, or none, all scores are that class's share, or 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.llm import words as wd
from flowwatch.session import materialize

WORDS = 1 << 15
SHAPES = 1 << 8
WIDTH = 32
NONZERO = 4
MOST_ROWS = 20_000
_ROWS = WORDS + SHAPES

_B = np.arange(256)
_LOWER = (_B >= 97) & (_B <= 122)
_UPPER = (_B >= 65) & (_B <= 90)
_DIGIT = (_B >= 48) & (_B <= 57)
_SYMBOL = (_B >= 33) & (_B <= 126) & ~_LOWER & ~_UPPER & ~_DIGIT


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's random vector."""
    draw = wd.mix(np.arange(_ROWS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(_ROWS, NONZERO)
    return (draw % np.uint64(WIDTH)).astype(np.int64), np.where(draw >> np.uint64(63), 1, -1).astype(np.int64)


def _rows_of(w: wd.Words) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word and of its shape."""

    def has(kind: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(kind[w.data])])
        return upto[w.end] - upto[w.start]

    again = np.zeros(len(w.row), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    upper, symbols = has(_UPPER), has(_SYMBOL)
    # Mixed radix: lower 2, upper 3, digit 2, symbols 4, repeats 2.
    shape = (has(_LOWER) > 0) + 2 * np.minimum(upper, 2) + 6 * (has(_DIGIT) > 0) + 12 * np.minimum(symbols, 3) + 48 * again
    return (w.hash >> np.uint64(64 - 15)).astype(np.int64), WORDS + shape


def _contexts(batches):
    """Each task's context sums."""
    place, sign = _index_vectors()
    table = np.zeros(_ROWS * WIDTH, np.int64)

    def add(at: np.ndarray, of: np.ndarray) -> None:
        for i in range(NONZERO):
            cell = at * WIDTH + place[of, i]
            plus = sign[of, i] > 0
            table[:] += np.bincount(cell[plus], minlength=len(table)) - np.bincount(cell[~plus], minlength=len(table))

    for b in wd.slices(batches, "text", 1 << 22):
        w = wd.cut(b.column("text"))
        word, shape = _rows_of(w)
        beside = np.flatnonzero(w.row[1:] == w.row[:-1])
        add(word, shape)
        add(shape, shape)
        for own, other in ((beside, beside + 1), (beside + 1, beside)):
            add(word[own], word[other])
            add(shape[own], shape[other])
    table = table.reshape(_ROWS, WIDTH)
    some = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(table[some, i]) for i in range(WIDTH))], names=["at", *(f"d{i}" for i in range(WIDTH))])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The normalised context vectors of all rows: a table of fixed size."""
    names = [f"d{i}" for i in range(WIDTH)]
    sums = texts.mapInArrow(_contexts, "at long, " + ", ".join(f"{n} long" for n in names))
    got = sums.groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    table = np.zeros((_ROWS, WIDTH))
    table[got["at"].to_numpy(np.int64)] = got[names].to_numpy(np.float64)
    table = np.sign(table) * np.log1p(np.abs(table))
    for part in (slice(0, WORDS), slice(WORDS, None)):
        used = table[part].any(axis=1)
        if used.any():
            table[part][used] -= table[part][used].mean(axis=0)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _pooled(vectors):
    def run(batches):
        table = vectors.value
        for b in wd.slices(batches, "text"):
            w = wd.cut(b.column("text"))
            word, shape = _rows_of(w)
            counts, first = w.counts(), w.first()[:-1]
            some = counts > 0
            out = np.zeros((b.num_rows, 2 * WIDTH), np.float32)
            if some.any():
                for part, rows in ((slice(0, WIDTH), word), (slice(WIDTH, None), shape)):
                    out[some, part] = np.add.reduceat(table[rows], first[some], axis=0) / counts[some][:, None]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), wd.lists(out.ravel(), np.full(b.num_rows, 2 * WIDTH), pa.float32())], names=["id", "pooled"]
            )

    return run


@dataclass
class Network:
    """Two layers over standardised inputs; logits are divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    a: np.ndarray
    a0: np.ndarray
    b: np.ndarray
    b0: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.a + self.a0) @ self.b + self.b0

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 16, epochs: int = 60, rate: float = 0.01, seed: int = 0) -> Network:
    """Adam on the log loss, then the temperature with the least log loss on the rows held back."""
    share = float(y.mean()) if len(y) else 0.5
    rng = np.random.default_rng(seed)
    d = 2 * WIDTH
    net = Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if share in (0.0, 1.0) or len(y) < 2:
        net.b0 = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -40, 40))
        return net
    held = np.arange(len(y)) % 5 == 4
    tx, ty = x[~held], y[~held]
    net.mean, net.scale = tx.mean(axis=0), tx.std(axis=0) + 1e-6
    net.a, net.b = rng.normal(0, d**-0.5, (d, hidden)), rng.normal(0, hidden**-0.5, hidden)
    tx = (tx - net.mean) / net.scale
    params = [net.a, net.a0, net.b, np.array([net.b0])]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(ty))
        for at in np.array_split(order, max(1, len(order) // 256)):
            h = np.tanh(tx[at] @ params[0] + params[1])
            g = (_sigmoid(h @ params[2] + params[3][0]) - ty[at]) / len(at)
            back = np.outer(g, params[2]) * (1 - h**2)
            grads = [tx[at].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            t += 1
            for i, one in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * one
                v[i] = 0.999 * v[i] + 0.001 * one**2
                params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.a, net.a0, net.b, net.b0 = params[0], params[1], params[2], float(params[3][0])
    if held.any():
        z, hy = net.logits(x[held]), y[held]

        def loss(temperature: float) -> float:
            p = np.clip(_sigmoid(z / temperature), 1e-9, 1 - 1e-9)
            return -float(np.mean(hy * np.log(p) + (1 - hy) * np.log(1 - p)))

        net.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return net


def _scores(network):
    def run(batches):
        for b in batches:
            x = b.column("pooled").flatten().to_numpy().reshape(b.num_rows, 2 * WIDTH) if b.num_rows else np.zeros((0, 2 * WIDTH))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.round(network.value.score(x), 6))], names=["id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per document: id and score. Only labels for which ``learn`` holds are looked at."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    id_type = dict(texts.dtypes)["id"]
    vectors = sc.broadcast(word_vectors(texts.select("text")))
    pooled = materialize(texts.mapInArrow(_pooled(vectors), f"id {id_type}, pooled array<float>"), "pooled")
    known = (labels if learn is None else labels.where(learn)).where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("id")).agg(F.max(label).cast("double").alias("label"))
    draw = F.xxhash64("id", "pooled")
    sample = pooled.join(known, "id").withColumn("draw", draw).orderBy("draw", "id").limit(most_rows).toPandas()
    x = np.stack(sample["pooled"].to_list()).astype(np.float64) if len(sample) else np.zeros((0, 2 * WIDTH))
    network = sc.broadcast(fit(x, sample["label"].to_numpy(np.float64)))
    return pooled.mapInArrow(_scores(network), f"id {id_type}, score double")
