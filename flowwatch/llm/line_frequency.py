"""Quality rules by the frequency of lines across documents, in DataFrame functions only.

Lines are normalised (A-Z as a-z, digits as 0, runs of white space as one space) and hashed. For each
host the distinct documents that have a line are counted. A line of up to ``max_words`` words that
more than ``max_docs`` documents of the host share is page furniture and is removed; longer lines are
passages, whose copies the near-duplicate operators handle. With ``long_lines`` lines of every length are
counted. So that copies are not rejected with their representative, the documents of which frequent lines
make up more than half then count as one document for longer lines. A document that loses more than
half of its words is depleted and is rejected, as are the documents that fail the base rules: fewer than
50 words, or more than half of the words in three-word windows that occur twice or more.

Documents are counted by text, so exact copies count once and repeated rows change nothing. A null
host is a host of its own. A null text has no words and fails the base rules, as the empty text does.
Words are runs of anything but ASCII white space; lines end at line feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.llm.tables import fresh, held, lower_ascii, text_key
from flowwatch.session import materialize

MAX_WORDS = 25
MAX_DOCS = 10
SPACE = " \t\n\u000b\f\r"
def _spaced(text: Column, kinds: str) -> Column:
    """One space for each run of these kinds of white space and of spaces. Literal replacements take a fraction of a pattern's time."""
    for c in kinds:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.regexp_replace(text, "  +", " ")


def _without(text: Column, kinds: str) -> Column:
    for c in kinds:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _flat(text: Column) -> Column:
    """The words with one space between them."""
    return F.trim(_spaced(text, SPACE[1:]))


def _n_words(flat: Column) -> Column:
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(_without(flat, " ")) + 1)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _even(text: Column) -> Column:
    """The text with its lines normalised, but for a space at their ends."""
    # In ASCII there is no other case than A-Z and a-z; going through a text letter by letter takes many times longer.
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower_ascii(text))
    return _spaced(F.regexp_replace(lower, "[0-9]+", "0"), SPACE.replace("\n", "")[1:])


def _normal(line: Column) -> Column:
    return F.trim(_even(line))


def base_rules(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """The documents with a struct of counts and the verdict ``failed``; no shuffle."""
    docs = docs.drop(out)
    f, w, n, c, h, s, p = fresh(docs, "_f", "_w", "_n", "_c", "_h", "_s", "_p")
    t = F.coalesce(F.col(text), F.lit(""))
    flat = held(docs, f, _flat(t))
    with_words = held(flat, w, F.when(F.col(f) != "", F.split(f, " ")).otherwise(F.array().cast("array<string>")))
    # Hashes of three-word windows, in order of hash and place, so that equal ones stand together.
    hashed = held(with_words, h, F.expr(f"if(size({w}) < 3, array(), transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])))"))
    # The words themselves go no further.
    n_words = F.size(w)
    hashed = hashed.withColumns({n: n_words, c: F.length(f) - F.greatest(n_words - 1, F.lit(0))}).drop(f, w)
    placed = held(hashed, s, F.expr(f"if(size(array_distinct({h})) = size({h}), array(), sort_array(transform({h}, (x, i) -> struct(x as x, i as i))))")).drop(h)
    # Windows that occur twice: each that equals the one before it in that order, and that one.
    again = f"filter(sequence(1, size({s}) - 1), j -> {s}[j].x = {s}[j - 1].x)"
    twice = held(placed, p, F.expr(f"if(size({s}) = 0, array(), sort_array(array_distinct(flatten(transform({again}, j -> array({s}[j - 1].i, {s}[j].i))))))")).drop(s)
    covered = F.expr(f"if(size({p}) = 0, 0, aggregate(sequence(0, size({p}) - 1), 0, (n, j) -> n + if(j = 0, 3, least(3, {p}[j] - {p}[j - 1]))))")
    lines = F.filter(_lines(t), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = held(twice, s, covered)
    n_words, n_repeat = F.col(n), F.col(s)
    base = F.struct(
        n_words.cast("long").alias("n_words"),
        F.col(c).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        n_repeat.cast("long").alias("n_repeat_words"),
        ((n_words < 50) | (n_repeat * 100 > n_words * 50)).alias("failed"),
    )
    return held(counted, out, base).drop(n, c, s, p)


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def _counted_lines(docs: DataFrame, host: str, text: str, max_words: int | None) -> DataFrame:
    """host, text_key, words of the text, place, hash and words of each normalised line of 1 to ``max_words`` words, or of 1 or more.

    Written once, as it is small: texts are cut into lines in one pass, whatever is asked of the lines.
    """
    key, total, even = fresh(docs, "_key", "_total", "_even")
    docs = docs.where(F.col(text).isNotNull()).select(_host(host).alias("host"), text_key(F.col(text)).alias(key), F.col(text).alias("text"))
    docs = held(held(docs, even, _even(F.col("text"))), total, _n_words(F.trim(_spaced(F.col(even), "\n"))))
    lines = docs.select("host", F.col(key).alias("text_key"), F.col(total).alias("total"), F.posexplode(_lines(F.col(even))).alias("place", "line"))
    fits = F.col("words") > 0 if max_words is None else (F.col("words") > 0) & (F.col("words") <= max_words)
    lines = held(held(lines, "flat", F.trim("line")), "words", _n_words(F.col("flat"))).where(fits)
    return materialize(lines.select("host", "text_key", "total", "place", F.xxhash64("flat").alias("line"), "words"), "lines")


def _frequent(lines: DataFrame, max_docs: int) -> DataFrame:
    """(host, line): lines that more texts have."""
    seen = lines.select("host", "line", "text_key", "words").distinct()
    return seen.groupBy("host", "line", "words").count().where(F.col("count") > max_docs).select("host", "line")


def _places(docs: DataFrame, host: str, text: str, max_docs: int) -> DataFrame:
    """All places of frequent lines of any length."""
    lines = _counted_lines(docs, host, text, None)
    return materialize(lines.join(materialize(_frequent(lines, max_docs), "often"), ["host", "line"]).distinct(), "places")


def _not_of_copies(places: DataFrame, max_words: int, max_docs: int) -> DataFrame:
    """(host, line): of frequent lines those above the limit when copies count as one document for long lines."""
    lost = places.groupBy("host", "text_key", "total").agg(F.sum("words").alias("lost")).where("lost * 2 > total")
    shown = places.where(F.col("words") > max_words).select("host", "line", "text_key").distinct().join(lost.select("host", "text_key", F.lit(1).alias("copy")), ["host", "text_key"], "left")
    n = F.count_if(F.col("copy").isNull()) + F.coalesce(F.max("copy"), F.lit(0))
    counted = shown.groupBy("host", "line").agg(n.alias("n")).where(F.col("n") > max_docs)
    return places.where(F.col("words") <= max_words).select("host", "line").distinct().unionAll(counted.select("host", "line"))


def furniture(
    docs: DataFrame, host: str = "source", text: str = "text", max_words: int = MAX_WORDS, max_docs: int = MAX_DOCS, long_lines: bool = False
) -> DataFrame:
    """(host, line): hashes of the lines above the limit."""
    if long_lines:
        return _not_of_copies(_places(docs, host, text, max_docs), max_words, max_docs)
    return _frequent(_counted_lines(docs, host, text, max_words), max_docs)


def judge(
    docs: DataFrame, host: str = "source", text: str = "text", max_words: int = MAX_WORDS, max_docs: int = MAX_DOCS, long_lines: bool = False
) -> DataFrame:
    """The documents with structs ``base`` and ``lines``.

    ``lines`` holds removed (hashes of the lines to remove, or null), n_removed_words and kept, the
    verdict on the document. Columns of these two names are replaced.
    """
    h, k, gone = fresh(docs, "_host", "_key", "_gone")
    if long_lines:
        places = _places(docs, host, text, max_docs)
        often = _not_of_copies(places, max_words, max_docs)
    else:
        places = _counted_lines(docs, host, text, max_words)
        often = _frequent(places, max_docs)
    hit = places.join(materialize(often, "furniture"), ["host", "line"]).distinct()  # repeated rows fall together
    lost = hit.groupBy("host", "text_key").agg(F.sum("words").alias("words"), F.collect_set("line").alias("removed"))
    lost = lost.select(F.col("host").alias(h), F.col("text_key").alias(k), F.struct("words", "removed").alias(gone))
    # The base rules come before the join: a caller who drops the text does not shuffle it.
    rows = base_rules(docs, text).withColumns({h: _host(host), k: text_key(F.col(text))}).join(lost, [h, k], "left")
    n_removed = F.coalesce(F.col(f"{gone}.words"), F.lit(0)).cast("long")
    verdict = F.struct(
        F.col(f"{gone}.removed").alias("removed"),
        n_removed.alias("n_removed_words"),
        (~F.col("base.failed") & (n_removed * 2 <= F.col("base.n_words"))).alias("kept"),
    )
    return rows.withColumn("lines", verdict).drop(h, k, gone)


def clean(
    docs: DataFrame, host: str = "source", text: str = "text", max_words: int = MAX_WORDS, max_docs: int = MAX_DOCS, long_lines: bool = False
) -> DataFrame:
    """The kept documents, without the lines above the limit; same columns."""
    judged = judge(docs, host, text, max_words, max_docs, long_lines).where("lines.kept")
    stays = F.filter(_lines(F.col(text)), lambda x: (F.lit(not long_lines) & (_n_words(_flat(x)) > max_words)) | ~F.array_contains("lines.removed", F.xxhash64(_normal(x))))
    cleaned = F.when(F.col("lines.removed").isNull(), F.col(text)).otherwise(F.array_join(stays, "\n"))
    return judged.withColumn(text, cleaned).select(*docs.columns)
