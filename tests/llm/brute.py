"""Plain versions of the operators for small inputs: loops over all rows and pairs."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return WORD.findall(low)


def groups(nodes, links):
    """Least member of the component of every node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def contamination(text, items, span=13):
    """(n_words, n_hit, sorted item ids as text, contaminated)."""
    ws = words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t)
        n = min(span, len(iw))
        wins = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1):
            if n and tuple(ws[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add("null" if item is None else str(item))
    listed = sorted(found)
    return (len(ws), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(ws))


def dedup_lines(docs):
    """[(doc_id, text)] in any order -> {doc_id: (n_lines, n_removed, text)}, ids distinct."""
    key = lambda d: (d[0] is not None, d[0])
    first, gone, lines = {}, collections.defaultdict(set), {}
    for i, text in sorted(docs, key=key):
        ls = [(n, x.strip(" \t\r")) for n, x in enumerate((text or "").split("\n"))]
        ls = [x for x in ls if x[1]]
        lines[i] = ls
        for p in range(len(ls) - 2):
            w = tuple(x for _, x in ls[p:p + 3])
            if w not in first:
                first[w] = (i, p)
            else:
                a = max(p, first[w][1] + 3) if first[w][0] == i else p
                gone[i] |= {ls[q][0] for q in range(a, p + 3)}
    return {i: (len(lines[i]), len(gone[i]), t if t is None else
                "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])) for i, t in docs}


def shingles(text, k=5):
    ws = words(text)
    if not ws:
        return {}
    c = collections.Counter(tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1)))
    return {s: 1 + math.log(n) for s, n in c.items()}


def prob_jaccard(x, y):
    both = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in both) for i in x if i in y)


def near_groups(docs, threshold=0.8):
    """{doc_id: least id of its group} for distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    where = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    pairs = {p for ids in where.values() for p in itertools.combinations(sorted(ids), 2)}
    # J_P is at most the plain share of the larger set, up to the weights: a cheap first test
    near = [(a, b) for a, b in pairs if len(sets[a].keys() & sets[b].keys()) >= 0.3 * max(len(sets[a]), len(sets[b]))]
    return groups(sets, [(a, b) for a, b in near if prob_jaccard(sets[a], sets[b]) >= threshold])


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def url_verdict(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, default)
