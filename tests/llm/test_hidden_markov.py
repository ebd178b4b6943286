"""The hidden Markov language model against plain recursions over single documents."""

import collections
import math
import os
import random
import zlib

import numpy as np
import pytest

from attestor.llm import hidden_markov as hm
from attestor.llm.textops import Powers, word_hashes
from tests.llm import plain
from tests.llm.conftest import edge_rows, words

SF = "/root/testdata/sf0.001"


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def tokens(text):
    return [*plain.WORD.findall(plain.lower(text)), None]


def base(rows):
    """Per row: n_tokens, n_known, train_tokens, base_score."""
    c = collections.Counter(t for d, text in rows if not held(d) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(c[t] > 0 for t in w), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w))
            for w in (tokens(text) for _, text in rows)]


def some_model(rng, states):
    emit = rng.random((hm.CLASSES + 1, states)) + 1e-3
    return hm.Model(*(x / x.sum(axis=-1, keepdims=True) for x in (rng.random(states), rng.random((states, states)))), emit / emit.sum(axis=0))


def plain_forward(codes, m):
    a = m.start * m.emit[codes[0]]
    for c in codes[1:]:
        a = (a @ m.move) * m.emit[c]
    return math.log10(a.sum())


def plain_expected(codes, m):
    """Expected starts, moves and emissions of a short document, by summing over all state paths' two tables."""
    n, k = len(codes), len(m.start)
    fwd, bwd = np.zeros((n, k)), np.ones((n, k))
    fwd[0] = m.start * m.emit[codes[0]]
    for t in range(1, n):
        fwd[t] = (fwd[t - 1] @ m.move) * m.emit[codes[t]]
    for t in range(n - 2, -1, -1):
        bwd[t] = m.move @ (m.emit[codes[t + 1]] * bwd[t + 1])
    p = fwd[-1].sum()
    there = fwd * bwd / p
    moves = sum(np.outer(fwd[t], m.emit[codes[t + 1]] * bwd[t + 1]) * m.move / p for t in range(n - 1)) if n > 1 else np.zeros((k, k))
    return there, moves


@pytest.mark.parametrize("block", [7, 40, 100_000])
def test_recursions(block):
    rng = np.random.default_rng(1)
    m = some_model(rng, 3)
    codes = [rng.integers(0, 12, n).astype(np.uint16) for n in (0, 1, 5, 30, 5, 17, 2)]
    total, fits = hm.Expected(3), {}
    for some, g in hm.groups(codes, 60):
        total.add(g, m, block)
        fits |= dict(zip(some.tolist(), hm.likelihoods(g, m, block).tolist()))
    whole = [np.append(c.astype(int), hm.END) for c in codes]
    assert np.allclose([fits[i] for i in range(len(codes))], [plain_forward(c, m) for c in whole])
    assert math.isclose(total.fit, sum(plain_forward(c, m) for c in whole))
    emit, moves, start = np.zeros_like(total.emit), np.zeros((3, 3)), np.zeros(3)
    for c in whole:
        there, mv = plain_expected(c, m)
        np.add.at(emit, c, there)
        moves += mv
        start += there[0]
    assert np.allclose(total.emit, emit) and np.allclose(total.start, start)
    ids, values = total.rows(m)
    assert np.allclose(values[[list(ids).index(hm.MOVES - s) for s in range(3)]], moves)


def test_no_underflow():
    rng = np.random.default_rng(2)
    m = some_model(rng, 2)
    code = rng.integers(0, 50, 20_000).astype(np.uint16)
    (_, g), = hm.groups([code])
    fit = hm.likelihoods(g, m, 1000)[0]
    assert math.isfinite(fit) and fit < -20_000


def mixed_rows(documents=160, most=50):
    """Two invented languages; documents of one keep to it."""
    rng = random.Random(3)
    vocabulary = [words(rng, 60).split() for _ in range(2)]
    return [(i, " ".join(rng.choice(vocabulary[i % 2]) for _ in range(rng.randint(0, most)))) for i in range(documents)]


@pytest.mark.parametrize("hot_share", [1, 30, hm.HOT_SHARE])
def test_base_and_parts(frame, hot_share):
    """Whatever is hot, all words count: sums equal a plain count, and the score the plain forward of the same model."""
    rows = mixed_rows() + [(1000, "Neverseen ONE the"), (1001, None)]
    docs = frame(rows)
    counts_of = hm.word_counts(docs)
    counts = hm.gather_counts(docs, counts_of, hot_share)
    assert len(counts.hot) < max(hot_share, 1) + (hot_share == 1)
    encoded = hm.encode(docs, counts)
    model = hm.train(encoded, counts, 2, 3)
    got = {r.doc_id: r for r in hm.score_encoded(encoded, counts_of, counts, model).collect()}
    want = dict(zip([d for d, _ in rows], base(rows)))
    c = collections.Counter(t for d, text in rows if not held(d) for t in tokens(text))
    powers, total = Powers(), counts.class_total
    for d, text in rows:
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*want[d][:3], held(d))
        assert math.isclose(r.base_score, want[d][3], rel_tol=1e-9)
        data = np.frombuffer((text or "").encode(), np.uint8)
        h, _ = word_hashes(data, np.array([0, len(data)]), powers)
        codes = (h >> np.uint64(48)).astype(int)
        inside = sum(math.log10((c[w] + 0.5) / total[k]) for w, k in zip(tokens(text), codes))
        assert math.isclose(r.score, plain_forward(np.append(codes, hm.END), model) + inside, rel_tol=1e-9)


def test_training_rises_and_generalises(frame):
    docs = frame(mixed_rows(2000, 100))
    table = hm.word_counts(docs)
    counts = hm.gather_counts(docs, table)
    encoded = hm.encode(docs, counts)
    model, fits = hm.first_model(counts.shares(), 4), []
    for _ in range(6):
        model, fit = hm.improved(encoded, model, counts, prior=1.0)
        fits.append(fit)
    assert all(b > a - 1 for a, b in zip(fits, fits[1:])) and fits[-1] > fits[0] + 100
    out = [r for r in hm.score_documents(docs, states=4).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edges(edge, none):
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in hm.score_documents(edge).collect()), key=repr)
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert got == sorted(((d, n, k, t, round(b, 6)) for (d, _), (n, k, t, b) in zip(rows, base(rows))), key=repr)
    assert hm.score_documents(none).collect() == []


def test_nothing_to_learn(frame):
    doc = next(i for i in range(100) if held(i))
    r, = hm.score_documents(frame([(doc, "one two")], 1)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
def test_held_out_documents(spark):
    """Held-out texts are likelier under the chain than under word counts alone."""
    out = [r for r in hm.op11_hidden_markov(spark, SF).collect() if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)
