"""Registered queries against their SQL twins, and the pipeline against brute force."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import oracle  # noqa: E402
import samples  # noqa: E402
from flowwatch.llm import oracles, registry  # noqa: E402
from flowwatch.llm.tables import read  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_twin(spark, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    assert oracle.differences(got, oracle.connect(SMALL).sql(oracles.SQL[name]).df()) == []


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def cleaned(rows, items):
    """Stages one to four over (id, text, host) rows."""
    rows = [(r[0], v[1], r[2]) for r, v in zip(rows, brute.line_frequency([(r[2], r[1]) for r in rows])) if v[0]]
    rows = [(r[0], t, r[2]) for r, t in zip(rows, brute.line_templates([r[:2] for r in rows]))]
    classes = brute.linked([r[:2] for r in rows], 5, 80)
    order = lambda r: (r[0] is None, r[0] or 0)
    best: dict = {}
    for i, (r, c) in enumerate(zip(rows, classes)):
        if c[0] and (c[1] not in best or order(r) < order(rows[best[c[1]]])):
            best[c[1]] = i
    rows = [r for i, (r, c) in enumerate(zip(rows, classes)) if not c[0] or best[c[1]] == i]
    return [r for r, c in zip(rows, brute.contamination([r[1] for r in rows], items)) if not c[3]]


def check(spark, docs, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    items = [tuple(r) for r in read(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    made = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, made, sf_dir)
        assert made.columns == docs.columns, name
    encoded = corpus_pipeline.STAGES[-1][1](spark, made, sf_dir).collect()
    want = cleaned(rows, items)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in encoded))) == sorted(map(repr, (r[:2] for r in want)))
    assert all(r.lossless for r in encoded)
    return want


def test_pipeline(spark):
    want = check(spark, read(spark, SMALL, "documents"), SMALL)
    assert 0 < len(want) < 200
    assert corpus_pipeline.run(spark, SMALL).count() == len(want)


def test_pipeline_on_odd_rows(spark):
    docs = samples.documents(spark)[1].where("doc_id is not null")
    check(spark, samples.clashing(docs), SMALL)
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SMALL)
        assert nothing.count() == 0
