"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import periodic
from tests.llm import plain
from tests.llm.conftest import edge_rows, words


def plain_runs(w, least=6, exponent=4):
    """(start, length, period), by trying every period from the smallest on."""
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and not any(
                q % d == 0 and all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)
            ):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc, text, edit=True):
    w = plain.WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if edit and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = plain_runs(w)
    drop = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q or (length * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, length, q)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *four, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def as_tuples(a):
    return [tuple(map(int, r)) for r in a]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_runs_of_few_letters(w):
    assert as_tuples(periodic.runs_of(np.array(w, np.int64))) == plain_runs(w)
    assert as_tuples(periodic.find_runs(np.array(w, np.int64))) == plain_runs(w)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 9), min_size=1, max_size=7), st.integers(1, 7)), max_size=8))
def test_runs_of_repeated_pieces(pieces):
    w = [x for piece, times in pieces for x in piece * times]
    assert as_tuples(periodic.find_runs(np.array(w, np.int64))) == plain_runs(w)


def test_nested_runs():
    rng = random.Random(3)
    for _ in range(60):
        w = [rng.randint(0, 1) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(1, 3)):
            w = w * rng.randint(1, 5) + [rng.randint(0, 2) for _ in range(rng.randint(0, 3))]
        w = w[:400]
        assert as_tuples(periodic.find_runs(np.array(w, np.int64))) == plain_runs(w)


def test_common_extensions():
    rng = random.Random(4)
    s = [rng.randint(1, 2) for _ in range(60)]
    tree = periodic.SuffixTree(s)
    lce = periodic.Extensions(*tree.tour())
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(61) for j in range(61) if i != j]))

    def plain_lce(i, j):
        k = 0
        while max(i, j) + k < 60 and s[i + k] == s[j + k]:
            k += 1
        return k

    assert lce(a, b).tolist() == [plain_lce(i, j) for i, j in zip(a.tolist(), b.tolist())]
    assert tree.tour()[0].tolist() == sorted(range(61), key=lambda i: s[i:])
    assert tree.tour(inverse=True)[0].tolist() == sorted(range(61), key=lambda i: [-x for x in s[i:]])


def test_stretches_leave_prose_out():
    rng = random.Random(5)
    prose = [rng.randint(0, 500) for _ in range(3000)]
    w = np.array(prose + prose[:50] * 9 + prose[100:1500], np.int64)
    kept = sum(b - a for a, b in periodic.stretches(w))
    assert 450 <= kept < 600


def test_edges(edge, none):
    out = periodic.run_digests(periodic.periodic_runs(edge, periodic.repeat_tail))
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([plain_row(r[0], r[1]) for r in edge_rows() if len(r[1] or "") < 99_999] + [
        t for t in got if t[0] in (9, 10)], key=repr)
    assert len(got) == len(edge_rows()) and periodic.periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(edge, exponent=2)


def test_long_text(frame):
    """A text of 200,000 words with a run of 120,000: far above one Arrow batch of usual texts."""
    rng = random.Random(6)
    head, piece, tail = words(rng, 40_000), words(rng, 1000), words(rng, 40_000)
    out = periodic.periodic_runs(frame([(1, " ".join([head, *[piece] * 120, tail])), (2, "a " * 50_000)])).collect()
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in out}
    assert got[2] == [(0, 50_000, 1)]
    (start, length, period), = got[1]
    assert period == 1000 and 39_990 <= start <= 40_000 and length >= 120_000
    assert {r.doc_id: len(r.collapsed.split()) for r in out} == {1: 200_000 - length + 1000, 2: 1}


def test_query(spark, frame):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        t = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(t))
            t[k:k] = [rng.choice("xyz") for _ in range(rng.randint(1, 4))] * rng.randint(2, 7)
        rows.append((i, re.sub(" ", lambda m: rng.choice([" ", "\n", "\t\x0b "]), " ".join(t))))
    out = periodic.run_digests(periodic.periodic_runs(frame(rows), periodic.repeat_tail))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(plain_row(*r) for r in rows)
