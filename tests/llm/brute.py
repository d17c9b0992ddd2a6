"""The operators once more, over Python lists, with sets and loops."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def solid(text):
    return SOLID.findall(text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate(AZ))


def contamination(texts, items, span=13):
    """For each text: n_words, n_hit, item ids, contaminated. Items are (id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for text in texts:
        w = alnum(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    found |= windows[tuple(w[i : i + n])]
                    hit |= set(range(i, i + n))
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(text, n):
    w = solid((text or "").translate(AZ))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(rows, n, percent):
    """For each (id, text): n_shingles, component id, number of links."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[root(i)] = min(low.get(root(i), key), key)
    return [(len(s), low.get(root(i)) if s else rows[i][0], links[i]) for i, s in enumerate(sets)]


def base(text):
    w = solid(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if solid(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice),
        len(w) < 50 or 100 * len(twice) > 50 * len(w),
    )


def normal(line):
    return re.sub("0+", "0", re.sub("[0-9]", "0", " ".join(solid(line.translate(AZ)))))


def line_frequency(rows, max_words=25, max_docs=10):
    """For each (host, text): kept and the text without the lines above the limit."""
    seen = defaultdict(set)
    for host, text in rows:
        for line in (text or "").split("\n"):
            if 1 <= len(solid(line)) <= max_words:
                seen[host, normal(line)].add(text)
    out = []
    for host, text in rows:
        lines = (text or "").split("\n")
        gone = [x for x in lines if 1 <= len(solid(x)) <= max_words and len(seen[host, normal(x)]) > max_docs]
        b = base(text)
        kept = not b[5] and 2 * sum(len(solid(x)) for x in gone) <= b[0]
        out.append((kept, text if text is None else "\n".join(x for x in lines if x not in gone)))
    return out


def line_templates(rows, min_docs=5, depth=3):
    """For each (id, text) the text without lines of recurring templates."""

    def tokens(line):
        return tuple("<*>" if re.search("[0-9]", t) else t for t in solid(line.translate(AZ)))

    lines = [(key, text, tokens(x)) for key, text in rows if text is not None for x in text.split("\n") if solid(x)]
    leaf = lambda t: (len(t), t[:depth])
    leaf_docs, line_docs = defaultdict(set), defaultdict(set)
    for _, text, t in lines:
        leaf_docs[leaf(t)].add(text)
        line_docs[t].add(text)
    at = Counter()
    for t, docs in line_docs.items():
        for i, x in enumerate(t):
            at[leaf(t), i, x] += len(docs)

    def template(t):
        shown = tuple(x if at[leaf(t), i, x] >= min_docs else "<*>" for i, x in enumerate(t))
        lost = sum(at[leaf(t), i, x] < min_docs for i, x in enumerate(t))
        return t if 2 * lost > len(t) else shown

    holders = defaultdict(dict)
    for key, text, t in lines:
        if len(leaf_docs[leaf(t)]) >= min_docs:
            mine = holders[template(t)]
            order = (key is None, key or 0, hashlib.md5(text.encode()).hexdigest())
            mine[text] = min(mine.get(text, order), order)
    first = {t: min(docs, key=docs.get) for t, docs in holders.items() if len(docs) >= min_docs}
    out = []
    for _, text in rows:
        if text is None:
            out.append(None)
            continue
        stays = [x for x in text.split("\n") if not solid(x) or first.get(template(tokens(x)), text) == text]
        out.append("\n".join(stays))
    return out


def losses(rows, targets, vocabulary, mu, add):
    """For each (id, text) the mean target and background loss; words are never unknown."""
    uni, bi = (Counter(), Counter()), (Counter(), Counter())
    for key, text in rows:
        w = solid((text or "").translate(AZ))
        for k in (0, 1) if key in targets else (1,):
            uni[k].update(w)
            bi[k].update(zip(w, w[1:]))
    total = [sum(u.values()) for u in uni]
    vocabulary = vocabulary or len(uni[1])
    out = []
    for _, text in rows:
        w = solid((text or "").translate(AZ))
        both = []
        for k in (0, 1):
            p = lambda x: (uni[k][x] + add) / (total[k] + add * vocabulary)  # noqa: B023, E731
            ps = [p(w[0])] + [(bi[k][v, x] + mu * p(x)) / (uni[k][v] + mu) for v, x in zip(w, w[1:])] if w else []
            both.append(-sum(map(math.log, ps)) / len(ps) if ps else None)
        out.append((len(w), *both))
    return out


def bigrams(text):
    w = alnum(text)
    return set(zip(["^", *w], [*w, "$"])) if w else set()


def licences(text, templates, percent):
    """(unit, licence, dice) of all units that match."""
    if text is None:
        return []
    lines = text.split("\n")
    units = list(enumerate(lines)) + ([(-1, text)] if len(lines) > 1 else [])
    out = []
    for unit, body in units:
        a = bigrams(body)
        for name, t in templates:
            b = bigrams(t)
            if a and 200 * len(a & b) >= percent * (len(a) + len(b)):
                out.append((unit, name, 2 * len(a & b) / (len(a) + len(b))))
    return sorted(out)
