"""Small tables with the rows that break things."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def texts(seed=1):
    """Unrelated texts, near copies, exact copies, shared lines, and odd ones."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randrange(40, 160)) for _ in range(12)]
    stem = prose(rng, 150).split()
    for _ in range(25):  # a dense group
        copy = list(stem)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(copy))
    pair = prose(rng, 300).split()
    out += [" ".join(pair), " ".join(pair[:150] + ["other"] + pair[151:])]
    out += [out[0]] * 4 + [out[1].upper()]
    for i in range(14):
        out.append(f"Page {i} of 20\nhome about contact news\n{prose(rng, 70)}\nuser u{i} logged in at {i}:00\n{prose(rng, 30)}")
    out += [None, "", " \n\t\n", "one", "one two", "one two", "ünï ☃ ▁ \x00 é", "a b " * 400, "x" * 70_000, prose(rng, 20_000, 5_000)]
    return out


def documents(spark, seed=1):
    """Documents with null and repeated ids, null hosts, repeated rows and columns named as the operators' own."""
    rows = []
    for i, t in enumerate(texts(seed)):
        rows.append((None if i == 5 else i, t, "en", None if i % 7 == 3 else f"src{i % 3}", len(t or "")))
    rows += [rows[2], rows[2], rows[30], (3, "one two", "en", "src0", 7)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def clashing(docs):
    """The same rows under extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "text_key", "_key", "_found", "_gone", "_w", "_h", "_s", "_p", "_host", "_ids", "_url", "set_id", "base", "lines", "word", "count", "rank", "part", "seed", "ids", "unit", "n", "Item"]
    return docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})
