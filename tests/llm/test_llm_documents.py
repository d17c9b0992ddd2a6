"""Operators on documents against brute force, on rows that break things and on several settings."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import samples  # noqa: E402
from flowwatch.llm import decontaminate, jaccard_join, licences, line_frequency, line_templates, lm_score, sharding  # noqa: E402
from flowwatch.session import shared_dir  # noqa: E402


@pytest.fixture(scope="module")
def data(spark):
    rows, docs = samples.documents(spark)
    return rows, samples.clashing(docs).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return samples.clashing(spark.createDataFrame([], samples.SCHEMA))


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_decontamination(spark, data, empty):
    rows, docs = data
    words = (rows[0][1] or "").split()
    items = [(1, " ".join(words[3:30])), (2, "one"), (3, "w1 w2"), (None, " ".join(words[10:23])), (4, None), (5, " .. "), (2, " ".join(words[25:39]) + " tail")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("text_key", F.lit(1))
    got = decontaminate.judge(docs, table)
    assert set(docs.columns) | {"overlap"} == set(got.columns)
    want = brute.contamination([r[1] for r in rows], items)
    picked = [(r.doc_id, r.text, (r.o.n_words, r.o.n_hit, r.o["items"], r.o.contaminated)) for r in got.select("doc_id", "text", F.col("overlap").alias("o")).collect()]
    same(picked, [(r[0], r[1], w) for r, w in zip(rows, want)])
    for r in got.where("overlap.n_hit > 0").select("overlap").collect():
        assert sum(s.end - s.first for s in r.overlap.spans) == r.overlap.n_hit
    assert decontaminate.judge(empty, table).count() == 0
    assert decontaminate.judge(docs, table.limit(0)).where("overlap.contaminated").count() == 0


@pytest.mark.parametrize("together", [1, 7, 64])
def test_a_phrase_that_many_items_share(spark, monkeypatch, together):
    import random

    monkeypatch.setattr(decontaminate, "ITEMS_TOGETHER", together)
    rng = random.Random(together)
    phrase = samples.prose(rng, 20)
    items = [(i, f"{samples.prose(rng, 15)} {phrase} {samples.prose(rng, 15)}") for i in range(60)]
    texts = [(j, f"{samples.prose(rng, 40)} {phrase if j % 3 else ''} {samples.prose(rng, 30)} {items[j][1] if j % 2 else ''}") for j in range(20)]
    got = decontaminate.judge(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    want = brute.contamination([t for _, t in texts], items)
    same([(r.doc_id, (r.o.n_words, r.o.n_hit, r.o["items"], r.o.contaminated)) for r in got.select("doc_id", F.col("overlap").alias("o")).collect()], [(t[0], w) for t, w in zip(texts, want)])


@pytest.mark.parametrize("span", [1, 2, 5, 13])
def test_winnowing_misses_no_span(span):
    import numpy as np

    rng = np.random.default_rng(span)
    for _ in range(60):
        a, b = rng.integers(0, 3, 60).astype(np.uint64), rng.integers(0, 3, 60).astype(np.uint64)
        one, two = (set(decontaminate.winnow(x, np.zeros(60, int), span)[0].tolist()) for x in (a, b))
        windows = [{tuple(x[i : i + span]) for i in range(60 - span + 1)} for x in (a, b)]
        assert one & two or not windows[0] & windows[1]


@pytest.mark.parametrize(("n", "percent", "long_list", "block", "spare"), [(3, 90, 64, 1 << 16, 100), (3, 90, 2, 700, 50), (5, 80, 3, 300, 0), (2, 60, 1, 500, 200)])
def test_join(data, empty, n, percent, long_list, block, spare):
    rows, docs = data
    got = jaccard_join.join(docs, n=n, percent=percent, long_list=long_list, block=block, spare=spare).collect()
    want = brute.linked([(r[0], r[1]) for r in rows], n, percent)
    key = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    same([(r.id, r.text_key, r.n_shingles, r.component_id, r.n_links) for r in got], [(r[0], key(r[1]), *w) for r, w in zip(rows, want)])
    assert jaccard_join.join(empty, n=n, percent=percent).count() == 0


def test_a_text_of_one_frequent_shingle(spark):
    """Its only shingle is in more sets than a short list holds, so it is dense and shares one shingle at least with any similar set."""
    phrase = ["so it goes", "on and on"]
    texts = [*phrase, phrase[0], *(f"{p} a{i} b{i}" for i in range(70) for p in phrase)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for percent in (80, 50):
        got = jaccard_join.join(docs, n=3, percent=percent)
        want = brute.linked(list(enumerate(texts)), 3, percent)
        same([(r.id, r.n_shingles, r.component_id, r.n_links) for r in got.collect()], [(i, *w) for i, w in enumerate(want)])


def test_a_join_leaves_no_shingles(spark, data):
    """Sketches and sets, most of what a join writes, go before it returns."""
    shared = Path(shared_dir(spark))
    before = set(shared.iterdir())
    got = jaccard_join.join(data[1], n=2, percent=60)
    left = {p.name.split("-")[0] for p in set(shared.iterdir()) - before}
    assert "members" in left and not left & {"scratch", "sketches", "sets", "dense", "whole", "pairs", "links"}
    assert got.count() == len(data[0])


def test_line_frequency(data, empty):
    rows, docs = data
    got = line_frequency.judge(docs, max_docs=4).select("doc_id", "text", "source", F.col("base").alias("b"), "lines.kept").collect()
    verdicts = brute.line_frequency([(r[3], r[1]) for r in rows], max_docs=4)
    want = [(r[0], r[1], r[3], brute.base(r[1]), v[0]) for r, v in zip(rows, verdicts)]
    same([(r.doc_id, r.text, r.source, tuple(r.b), r.kept) for r in got], want)
    cleaned = line_frequency.clean(docs, max_docs=4)
    assert cleaned.columns == docs.columns
    same([(r.doc_id, r.text) for r in cleaned.collect()], [(r[0], v[1]) for r, v in zip(rows, verdicts) if v[0]])
    assert any(v[1] != r[1] for r, v in zip(rows, verdicts) if v[0]), "no line is above the limit"
    assert line_frequency.clean(empty).count() == 0


def test_long_lines_that_many_documents_share(spark):
    """A long notice goes, pages of little else are depleted, a group of near copies stays whole."""
    import random

    rng = random.Random(6)
    prose = lambda n: samples.prose(rng, n, 100_000).replace("w", "").translate(str.maketrans("0123456789", "abcdefghij"))
    notice, copies = prose(40), [prose(30) for _ in range(4)]
    rows = [(i, f"{prose(60)}\n{notice}\n{prose(5)}", "h") for i in range(12)]
    want = {i: "\n".join(t.split("\n")[::2]) for i, t, _ in rows}
    rows.append((12, f"{notice}\n{prose(20)}", "h"))
    rows.append((13, f"{notice}\n{prose(20)}", "other"))
    rows += [(i, "\n".join([*copies, prose(8)]), "h") for i in range(20, 35)]
    want |= {r[0]: r[1] for r in rows if r[0] >= 13}
    docs = samples.clashing(spark.createDataFrame(rows * 2, "doc_id long, text string, source string").repartition(3))
    assert {r.doc_id: r.text for r in line_frequency.clean(docs, long_lines=True).collect()} == want
    import corpus_pipeline

    assert {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, "").collect()} == want
    plan = line_frequency.clean(docs, long_lines=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_are_cut_into_lines_once(spark, monkeypatch):
    """All steps read one small table of lines, which knows odd white space, digits and letters outside ASCII."""
    shared = ["Ab\t 12\x0bC\r", " É 7 é\u212a ", "k K  00"]
    rows = [(i, "\n".join([f"w{i} " * 60, *shared, "é 1 É"]).replace("12", "9" * (i + 1)), "h") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cut, cuts = line_frequency._counted_lines, []
    monkeypatch.setattr(line_frequency, "_counted_lines", lambda *args: cuts.append(args) or cut(*args))
    got = line_frequency.judge(docs, max_docs=4, long_lines=True).select("text", F.col("base").alias("b"), "lines.n_removed_words").collect()
    assert len(cuts) == 1
    same([(r.text, tuple(r.b), r.n_removed_words) for r in got], [(t, brute.base(t), 12) for _, t, _ in rows])
    verdicts = brute.line_frequency([(r[2], r[1]) for r in rows], max_docs=4)
    same([r.text for r in line_frequency.clean(docs, max_docs=4).collect()], [v[1] for v in verdicts if v[0]])


def test_quality_rules_run_no_python(data):
    plan = line_frequency.clean(data[1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_templates(data, empty):
    rows, docs = data
    want = brute.line_templates([(r[0], r[1]) for r in rows])
    got = line_templates.dedup_lines(docs)
    same([(r.doc_id, r.text) for r in got.collect()], [(r[0], w) for r, w in zip(rows, want)])
    found = {t for r in got.select("line_dedup.templates").collect() for t in r.templates}
    assert "user <*> logged in at <*>" in found and "home about contact news" in found
    nowhere = line_templates.dedup_lines(docs, keep_first=False).where(F.col("text").contains("home about contact news"))
    assert nowhere.count() == 0
    assert line_templates.dedup_lines(empty).count() == 0


def test_passages_of_few_documents(spark):
    """Passages of two to four otherwise different documents stay in the first; near copies and tables of numbers stay whole."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(3)]
    own = lambda: prose(70)
    rows, want = [], {}

    def add(text, left):
        want[len(rows)] = left
        rows.append((len(rows), text))

    for n, passage in zip((2, 3, 4), passages):
        for i in range(n):
            a, b = own(), own()
            add(f"{a}\n{passage if i % 2 else passage.upper()}\n{b}", f"{a}\n{passage.upper()}\n{b}" if i == 0 else f"{a}\n{b}")
    short, table = prose(49), [" ".join(str(rng.randrange(1000)) for _ in range(60)) for _ in range(2)]
    for i in range(2):
        same = f"{own()}\n{short}\n{table[i]}"
        add(same, same)
    copy = [own() for _ in range(8)]
    for last in ("one", "two"):
        same = "\n".join([*copy, last])
        add(same, same)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_templates.dedup_lines(docs).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert sum(r.line_dedup.n_dropped for r in got) == 6 and {t for r in got for t in r.line_dedup.templates} == set(passages)
    nowhere = line_templates.dedup_lines(docs, keep_first=False).collect()
    assert sum(r.line_dedup.n_dropped for r in nowhere) == 9


def test_licences(spark, data, empty):
    rows, docs = data
    odd = [(900, f"{licences.TEMPLATES[1][1]}\nfoo\nALL rights   Reserved!", "en", None, 1), (901, licences.TEMPLATES[9][1].replace("software", "program"), "en", None, 1), (902, "License", "en", None, 1)]
    docs = docs.select(*samples.SCHEMA.replace(",", "").split()[::2]).unionAll(spark.createDataFrame(odd, samples.SCHEMA))
    got = licences.label(samples.clashing(docs), licences.TEMPLATES).select("doc_id", "text", "licences.matches").collect()
    want = [(r[0], r[1], brute.licences(r[1], licences.TEMPLATES, 80)) for r in [*rows, *odd]]
    same([(r.doc_id, r.text, [tuple(m) for m in r.matches]) for r in got], want)
    assert sum(bool(w[2]) for w in want) == 2
    assert licences.label(empty, licences.TEMPLATES).count() == 0
    assert licences.label(docs, []).where("size(licences.matches) > 0").count() == 0
    plan = licences.label(docs, licences.TEMPLATES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_wrapped_licences(spark):
    """Notices and licence texts broken into lines inside a long file."""
    import random
    import textwrap

    rng = random.Random(7)
    known = dict(licences.TEMPLATES)
    filler = lambda: "\n".join(samples.prose(rng, 12) for _ in range(40))
    wrap = lambda name, width: "\n".join("# " + x for x in textwrap.wrap(known[name], width))
    wanted = {0: "apache-2.0-header", 1: "mit-text", 2: "isc", 3: "mpl-2.0-notice", 4: "apache-2.0-notice"}
    rows = [(i, f"{filler()}\n{wrap(name, 40 + i)}\n{filler()}") for i, name in wanted.items()] + [(9, filler())]
    got = {r.doc_id: r.licences for r in licences.label(spark.createDataFrame(rows * 2, "doc_id long, text string"), licences.TEMPLATES).collect()}
    for i, name in wanted.items():
        hits = [m for m in got[i].matches if m.licence == name]
        assert [(m.unit, m.dice) for m in hits] == [(40, 1.0)], name
    assert got[9].matches == []


def test_lm_score(spark, data, empty, monkeypatch):
    rows, docs = data
    targets = {0, 1, 2, 14, 15, 31}
    table = spark.createDataFrame([(i,) for i in targets] + [(0,), (None,)], "doc_id long")
    want = brute.losses([(r[0], r[1]) for r in rows], targets, None, lm_score.MU, lm_score.ADD)
    got = {(r.id, r.n_words): r for r in lm_score.score(docs, table).collect()}
    for r, (n, one, two) in zip(rows, want):
        g = got[r[0], n]
        assert (g.score is None) == (n == 0)
        assert n == 0 or abs(g.target_loss - one) < 2e-6 and abs(g.background_loss - two) < 2e-6
    assert lm_score.score(empty, table).count() == 0
    assert lm_score.score(docs, table.limit(0)).where("score is not null").count() == sum(w[0] > 0 for w in want)


def test_lm_score_tells_all_words_apart(spark, data, monkeypatch):
    """Also words that share the first 20 bits of their hash."""
    import pyarrow as pa

    from flowwatch.llm import words as wd

    names = [f"q{i}" for i in range(6000)]
    short, alike = {}, []
    for name, h in zip(names, wd.cut(pa.array(names)).hash >> 44):
        alike += [(short[h], name)] if h in short else []
        short[h] = name
    assert alike
    one, two = alike[0]
    rows = [(r[0], r[1]) for r in data[0] if r[0] is not None] + [(900, f"{one} " * 30 + "w1"), (901, f"{two} " * 30 + "w1"), (902, f"{one} {two}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    targets = {0, 1, 900}
    table = spark.createDataFrame([(i,) for i in targets], "doc_id long")
    want = sorted((r[0], n, a, b) for r, (n, a, b) in zip(rows, brute.losses(rows, targets, None, lm_score.MU, lm_score.ADD)) if n)
    for hot, paired, marked in ((1 << 16, 512, 100), (1 << 16, 5, 2), (40, 40, 100), (3, 512, 100), (3, 1, 0), (200, 0, 100)):
        monkeypatch.setattr(lm_score, "HOT", hot)
        monkeypatch.setattr(lm_score, "PAIRED", paired)
        monkeypatch.setattr(lm_score, "MARKED", marked)
        got = sorted((r.id, r.n_words, r.target_loss, r.background_loss) for r in lm_score.score(docs, table).collect() if r.n_words)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(x - y) < 2e-6 for g, w in zip(got, want) for x, y in zip(g[2:], w[2:]))


def _zipf_batch(n_docs, size, vocabulary, seed=5):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    texts = [" ".join(f"v{i}" for i in rng.zipf(1.2, size) % vocabulary) for _ in range(n_docs)]
    return pa.RecordBatch.from_pydict({"ref": pa.array(np.arange(n_docs)), "is_target": pa.array(np.arange(n_docs) % 3 == 0), "text": pa.array(texts)})


def test_lm_score_holds_little_text_at_once():
    import tracemalloc

    batch = _zipf_batch(2000, 1200, 100_000)
    assert batch.column("text").nbytes > 8 << 20
    tracemalloc.start()
    try:
        for _ in lm_score._words(None)(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150 << 20


def test_lm_score_moves_no_more_by_more_groups():
    """Nor does a bigram that a run has a thousand times."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow.compute as pc

    from flowwatch.llm import words as wd

    batch = _zipf_batch(1000, 100, 5000)
    words, counts = np.unique(wd.cut(batch.column("text")).hash, return_counts=True)
    hot = np.argsort(-counts, kind="stable")[:400]
    counts = np.stack([counts, counts]).astype(float)
    model = SimpleNamespace(value=lm_score._Model(counts.sum(axis=1, keepdims=True), len(words), words[hot], counts[:, hot]))

    def moved(groups, *batches):
        rows = [r for b in batches for r in lm_score._deal(model, None, groups)(iter([b]))]
        return sum(pc.sum(pc.binary_length(c)).as_py() or 0 for r in rows for c in r.columns[1:] if "binary" in str(c.type))

    few, many = moved(8, batch), moved(1024, batch)
    assert many < 1.5 * few  # 16 bytes are the numbers of each row
    copies = batch.take(np.zeros(1000, int))
    assert moved(8, copies) < 0.1 * few


def test_lm_score_fails_where_rows_of_a_run_are_lost():
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from flowwatch.llm import words as wd

    batch = _zipf_batch(20, 100, 5000)
    words, counts = np.unique(wd.cut(batch.column("text")).hash, return_counts=True)
    hot = np.argsort(-counts, kind="stable")[:30]
    counts = np.stack([counts, counts]).astype(float)
    model = SimpleNamespace(value=lm_score._Model(counts.sum(axis=1, keepdims=True), len(words), words[hot], counts[:, hot]))
    back = lm_score._count(model)(pa.Table.from_batches(lm_score._deal(model, None, 8)(iter([batch]))))
    assert lm_score._add(model)(back)["n"].to_pylist() == [100] * 20
    for rows in (back.slice(1), back.slice(0, len(back) - 1), pa.concat_tables([back, back])):
        with pytest.raises(RuntimeError, match="has changed"):
            lm_score._add(model)(rows)


@pytest.mark.parametrize(("shards", "each"), [(8, 100_000), (3, 4), (200, 7)])
def test_sharding(data, empty, shards, each):
    rows, docs = data
    got = sharding.shard(docs, shards, rows_per_part=each).collect()
    assert sorted(r.order for r in got) == list(range(len(rows)))
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.size == len((dict_text(rows, r) or "").encode()) + 1
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    for s, mine in by.items():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        for source in {r[3] for r in rows}:
            share = sum(r[3] == source for r in rows) * len(mine) / len(rows)
            assert abs(sum(r.source == source for r in mine) - share) <= 2
    again = sharding.shard(docs.repartition(9), shards, rows_per_part=each).collect()
    same([(r.id, r.text_crc32, r.shard) for r in got], [(r.id, r.text_crc32, r.shard) for r in again])
    assert sharding.shard(empty, shards).count() == 0


def dict_text(rows, r):
    import zlib

    return next(x[1] for x in rows if x[0] == r.id and zlib.crc32((x[1] or "").encode()) == r.text_crc32)
