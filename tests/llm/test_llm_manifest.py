"""The manifest, fingerprints and token alignment against plain slow versions."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import samples  # noqa: E402
from flowwatch.llm import merkle, registry, sha_states, simhash, token_align  # noqa: E402
from flowwatch.llm.tables import read  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    rows, docs = samples.documents(spark)
    return rows, samples.clashing(docs).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return samples.clashing(spark.createDataFrame([], samples.SCHEMA))


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def slow_tree(nodes, arity):
    """Levels from the leaves up."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def slow_path(levels, at, arity):
    """(left siblings, right siblings) of each level."""
    out = []
    for level in levels[:-1]:
        first = at // arity * arity
        out.append((level[first:at], level[at + 1 : first + arity]))
        at //= arity
    return out


def slow_audit(rows, arity=2):
    """rows: (group, key, leaf, replacement or None)."""
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    groups = sorted({r[0] for r in rows}, key=order)
    members = {g: sorted((r for r in rows if r[0] == g), key=lambda r: (order(r[1]), r[2])) for g in groups}
    trees = {g: slow_tree([r[2] for r in members[g]], arity) for g in groups}
    above = slow_tree([trees[g][-1][0] for g in groups], arity) if groups else [[None]]
    out = []
    for i, g in enumerate(groups):
        for k, r in enumerate(members[g]):
            path = slow_path(trees[g], k, arity) + slow_path(above, i, arity)
            now = r[3] or r[2]
            for left, right in path:
                now = H(*left, now, *right)
            proof = "".join("".join(left + right) for left, right in path)
            out.append((g, r[1], r[2], trees[g][-1][0], proof, now, above[-1][0], now == above[-1][0]))
    return out


def test_states_are_those_of_sha256():
    rng = np.random.default_rng(0)
    digests = rng.integers(0, 1 << 32, (50, 8), dtype=np.uint64).astype(np.uint32)
    assert [bytes(x).decode() for x in sha_states.hex_bytes(digests)] == [sha_states.pack(d).hex() for d in digests]
    for n in (1, 2, 3, 7):
        state = sha_states.started(10)
        for i in range(n):
            state = sha_states.absorb(state, digests[i * 2 : i * 2 + 10])
        got = [sha_states.pack(d).hex() for d in sha_states.finish(state, n)]
        assert got == [H(*(sha_states.pack(digests[i * 2 + k]).hex() for i in range(n))) for k in range(10)]


@pytest.mark.parametrize(("arity", "piece"), [(2, 4096), (2, 4), (3, 9), (4, 5), (2, 2)])
def test_manifest(spark, data, empty, arity, piece):
    rows, docs = data
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    changed = F.when(F.col("doc_id") % 3 == 0, merkle.leaf(F.col("doc_id"), F.lit("x")))
    for group, at in (("lang", 2), ("source", 3)):
        manifest = merkle.build(docs, group, "doc_id", merkle.leaf(*map(F.col, fields)), changed, arity, piece)
        got = merkle.audit(manifest).select("group", "id", "leaf", "subroot", "proof", "folded_root", "root", "verified").collect()
        want = slow_audit([(r[at], r[0], slow_leaf((r[0], r[3], r[2], r[4], r[1])), slow_leaf((r[0], "x")) if r[0] is not None and r[0] % 3 == 0 else None) for r in rows], arity)
        same([tuple(r) for r in got], want)
        assert any(r.verified for r in got) and not all(r.verified for r in got)
    nothing = merkle.build(empty, "lang", "doc_id", F.md5("text"), arity=arity, piece=piece)
    assert nothing.root is None and merkle.audit(nothing).count() == 0


def test_a_single_leaf_is_the_root(spark):
    one = spark.createDataFrame([(None, None, "ab" * 32)], "g string, k long, d string")
    manifest = merkle.build(one, "g", "k", F.col("d"))
    r = merkle.audit(manifest).first()
    assert (r.subroot, r.root, r.proof, r.folded_root, r.verified) == ("ab" * 32, "ab" * 32, "", "ab" * 32, True)


def test_manifest_query(spark):
    docs = [tuple(r) for r in read(spark, SMALL, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    rows = [(r[2], r[0], slow_leaf(r), slow_leaf((*r[:3], r[3] + 1, r[4])) if zlib.crc32(str(r[0]).encode()) % 7 == 0 else None) for r in docs]
    want = [(d, leaf, sub, root, H(proof), fold, ok) for _, d, leaf, sub, proof, fold, root, ok in slow_audit(rows)]
    got = registry.QUERIES["op11_merkle_manifest"](spark, SMALL).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    same([tuple(r) for r in got.collect()], want)


def slow_print(text, n):
    words = brute.solid((text or "").translate(brute.AZ))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def slow_classes(prints, within):
    """Each distinct fingerprint's component and links."""
    distinct = sorted(set(prints))
    parent = {x: x for x in distinct}
    many = Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[i + 1 :]:
            if (x ^ y).bit_count() <= within:
                many[x] += 1
                many[y] += 1
                parent[root(x)] = root(y)
    return {x: root(x) for x in distinct}, many


def slow_simhash(rows, n, within):
    prints = [slow_print(t, n) for _, t in rows]
    roots, many = slow_classes(prints, within)
    least: dict = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return [(i, f"{p:016x}", least.get(roots[p]), many[p]) for (i, _), p in zip(rows, prints)]


@pytest.mark.parametrize(("n", "within"), [(3, 2), (1, 3), (5, 0), (2, 1)])
def test_simhash(data, empty, n, within):
    rows, docs = data
    got = simhash.near_duplicates(docs, n=n, within=within).collect()
    same([tuple(r) for r in got], slow_simhash([(r[0], r[1]) for r in rows], n, within))
    assert simhash.near_duplicates(empty, n=n, within=within).count() == 0


def test_simhash_query(spark):
    docs = [tuple(r) for r in read(spark, SMALL, "documents").select("doc_id", "text").collect()]
    same([tuple(r) for r in registry.QUERIES["op12_simhash"](spark, SMALL).collect()], slow_simhash(docs, 3, 2))


@pytest.mark.parametrize("within", [0, 1, 2, 3])
def test_links_of_a_dense_cloud(spark, within):
    rng = random.Random(within)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = {0, (1 << 64) - 1, *seeds}
    for _ in range(600):
        p = rng.choice(seeds)
        for _ in range(rng.randrange(5)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(p),) for p in prints], "print long").repartition(5)
    got = [tuple(r) for r in simhash.links(table, within).collect()]
    ordered = sorted(map(signed, prints))
    want = [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= within]
    same(got, want)


def test_every_half_has_one_home():
    """The code is perfect: 2^11 remainders, each with one difference of weight 3 or less."""
    steps, ends = simhash._steps(2)
    begins = np.concatenate([[0], ends[:-1, -1]])
    assert (ends[:, 0] - begins == 1).all()
    assert len(steps) == 1 + 23 + 253 + 1771 + 8855 + 33649


def slow_ends(aligner, text):
    """Ids and byte ends of both tokenizers on a whole text, by decoding alone; None if they don't spell it."""
    whole = " " + text
    out = []
    for ids, spelt in ((aligner.a.encode(whole, add_special_tokens=False).ids, aligner.spelt_a), (aligner.b.encode(text), aligner.spelt_b)):
        parts = [bytes(spelt.data[spelt.at[i] : spelt.at[i] + spelt.size[i]]) for i in ids]
        if b"".join(parts) != whole.encode():
            return None
        out.append((ids, np.cumsum([len(p) for p in parts]).tolist()))
    return out


def slow_groups(aligner, text):
    found = slow_ends(aligner, text) if text else None
    if not found:
        return [], [], [], []
    (a, ends_a), (b, ends_b) = found
    groups, x, y = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        u, v = ends_a.index(e, x) + 1, ends_b.index(e, y) + 1
        groups.append((a[x:u], b[y:v]))
        x, y = u, v
    return a, b, groups, [(g[0][-1], g[1][-1]) for g in groups]


def slow_alignment(rows):
    aligner = token_align.Aligner(token_align.BYTE_MODEL, token_align.PIECE_MODEL)
    found = [slow_groups(aligner, t) for _, t in rows]
    count = Counter(p for f in found for p in f[3])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, found):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, len(a), len(b), len(groups), H(said) if a else "", len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links)))
    return found, out


ODD = [
    "<|endoftext|> <s> </s> <unk> <0x0A> x <|endoftext|>y", "a é ☃ 🜁 x\x00y 🜁🜁", "▁ mark", "a▁ b", "one  two   three \n\n four\t five \n six", " lead", "trail ", "trail  ", "  ", " ",
    "  nbsp  x   y　 z — d", "日本語 テスト です。 漢字", "I'll don't we've 'tis '", "x" * 3000, "é " * 50, "﻿ bom", "é combining", "ﬁ ligature ½ Å", "\r\n a \r b", "👩‍👩‍👧 family 🇩🇪 flag", "12 345 6789 ... !!! ?!",
]


def test_alignment(spark, data, empty):
    rows, docs = data
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    plain = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)]
    found, want = slow_alignment(plain)
    got = token_align.score(both).collect()
    same([tuple(r) for r in got], want)
    full = token_align.align(both).collect()
    same([(r.id, r.a, r.b, r.group_a, r.group_b) for r in full], [(i, a, b, [len(x) for x, _ in g], [len(y) for _, y in g]) for (i, _), (a, b, g, _) in zip(plain, found)])
    assert token_align.score(empty).count() == 0
    assert token_align.score(docs).count() == len(rows)


def test_random_texts_align_chunk_by_chunk():
    aligner = token_align.Aligner(token_align.BYTE_MODEL, token_align.PIECE_MODEL)
    assert aligner.cuts
    rng = random.Random(5)
    pool = [" ", " ", " ", "  ", "\n", "\t", "a", "the", "é", "▁", "🜁", "'s", "9", "-", " ", " ", " ", "　", "\x85", "—", "語", "\x00", "S"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    import pyarrow as pa

    row, chunk, has = aligner.place(pa.array(texts))
    for i, t in enumerate(texts):
        a, b, groups, links = slow_groups(aligner, t)
        mine = chunk[row == i]
        assert aligner.gather("ids_a", mine).tolist() == a, t
        assert aligner.gather("ids_b", mine).tolist() == b, t
        assert aligner.gather("group_a", mine).tolist() == [len(x) for x, _ in groups], t
        assert bool(has[i]) == bool(a), t


def test_alignment_query(spark):
    docs = [tuple(r) for r in read(spark, SMALL, "documents").select("doc_id", "text").collect()]
    same([tuple(r) for r in registry.QUERIES["op13_token_align"](spark, SMALL).collect()], slow_alignment(docs)[1])
