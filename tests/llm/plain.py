"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near(rows, k, threshold):
    """doc_id -> (set size, smallest doc_id reachable), by comparing all pairs."""
    sets = {}
    for d, t in rows:
        w = WORD.findall(lower(t))
        sets[d] = frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeats(rows, length):
    """doc_id -> (bytes, removed, spans, sha256 of the rest)."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(b[s:s + length])
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def targets(sizes, weights=(5, 2, 1), cap=3):
    """source -> target, by filling up round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full = float(sum(sizes.values())), {}
    while True:
        live = [s for s in order if s not in full]
        rate = left / sum(w[s] for s in live) if live else 0
        over = [s for s in live if rate * w[s] > cap * sizes[s]]
        if not over:
            return full | {s: rate * w[s] for s in live}
        for s in over:
            full[s] = float(cap * sizes[s])
            left -= full[s]


def secrets(text):
    """The base spans, rule by rule."""
    found = []
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for no, (kind, pattern, group, least) in enumerate((("assign", assign, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
                                                        ("hex", re.compile("[0-9a-f]+"), 0, 16))):
        found += [(m.start(), no, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def subsequence(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def line_windows(rows, window=3):
    """doc_id -> (lines, removed, kept text)."""
    lines = {d: (t or "").split("\n") for d, t in rows}
    first = {}
    for d in sorted(lines):
        for i in range(len(lines[d]) - window + 1):
            first.setdefault(tuple(lines[d][i:i + window]), (d, i))
    out = {}
    for d, x in lines.items():
        gone = {i + j for i in range(len(x) - window + 1) if first[tuple(x[i:i + window])] != (d, i) for j in range(window)}
        out[d] = (len(x), len(gone), "\n".join(l for i, l in enumerate(x) if i not in gone))
    return out


def counted(items):
    return collections.Counter(items)
