"""Language-model scores by a hidden Markov model, trained by Baum-Welch over all training documents.

A latent state gives a class of words, and the class gives the word:

    P(word | state) = emission[state, class(word)] * (c(word) + 0.5) / (C(class) + 0.5 * (V(class) + 1))

c is the word's count in the training documents, C and V are the tokens and distinct words of the class; a word that
training never saw takes the place with c = 0. Classes are the first 16 bits of a word's hash, so the tables of
the chain have a fixed size, while the counts have a row for every word of the corpus, none of them dropped.
The end of a document is a token with a class of its own. Words are told apart by 64 bits of hash.

1. Counts of all words: merged per task, then by word.
2. Each text is read once more and written as class numbers (two bytes a word). The words that hold more than
   1 / HOT_SHARE of all tokens are fewer than HOT_SHARE, whatever the data: their counts go to the tasks, which add up that
   part of a document's score at once. Only the other words are kept beside the classes, for a join by word
   in which no word can be hot.
3. Baum-Welch: each task runs scaled forward and backward recursions over its documents, many at a time, and gives its
   expected counts, at most CLASSES + STATES + 3 rows; these are summed by Spark, and their fixed-size sum makes the next
   model on the driver. A text longer than a block keeps the forward state at block borders only.
4. The scaled forward recursion of the last model gives the likelihood of the class sequence, in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, ship, write_through
from attestor.llm.textops import Powers, chunks, text_bytes, word_hashes

ship(__name__)

STATES, ITERATIONS = 8, 5
#: Classes of words (the first 16 bits of the hash); the end of a document is class number CLASSES.
CLASSES = END = 1 << 16
#: Words with more than 1 / HOT_SHARE of all tokens are looked up in the tasks: fewer than 200,000 pairs of numbers.
HOT_SHARE = 200_000
#: Tokens that the corpus-wide class shares weigh in each state's emissions, and the pseudo-counts of transitions.
PRIOR, PRIOR_MOVES = 1_000.0, 1.0
#: Chance of staying in a state, and spread of the emissions' logarithms, before training.
STAY, SPREAD = 0.8, 0.5
#: Tokens whose forward states are held at once.
BLOCK = 300_000
FOLDS, HELD = 5, 1
STARTS, MOVES, FIT = -1, -2, -100


def held_out() -> Column:
    """Whether crc32 of the doc_id as text, modulo FOLDS, is HELD; a row without an id is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _merged(hashes: list[np.ndarray], learned: list[np.ndarray]) -> pa.RecordBatch:
    words, at = np.unique(np.concatenate(hashes), return_inverse=True)
    c = np.bincount(at, np.concatenate(learned), len(words)).astype(np.int64)
    n = np.bincount(at, minlength=len(words))
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c), pa.array(n)], ["word", "c", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, hashes, learned, held = Powers(), [], [], 0
    for b in batches:
        train = ~np.asarray(b.column(0).to_numpy(zero_copy_only=False), bool)
        data, offs = text_bytes(b.column(1))
        for i, j, d, o in chunks(data, offs):
            h, counts = word_hashes(d, o, powers)
            hashes.append(h)
            learned.append(np.repeat(train[i:j], counts))
            held += len(h)
            if held > 1_000_000:
                yield _merged(hashes, learned)
                hashes, learned, held = [], [], 0
    if held:
        yield _merged(hashes, learned)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (its hash), c (occurrences in training documents), n (in all): a row for every word."""
    rows = docs.select(held_out().alias("held_out"), "text").mapInArrow(_count, "word long, c long, n long")
    return write_through(rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-words")


def class_of(word: Column) -> Column:
    return F.shiftrightunsigned(word, 48).cast("int")


@dataclass
class Counts:
    """What every task needs of the counts: totals, class sums and the hot words."""

    tokens: int
    distinct: int
    ends: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    hot: np.ndarray
    hot_c: np.ndarray

    @property
    def base_total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    @property
    def class_total(self) -> np.ndarray:
        return self.class_tokens + 0.5 * (self.class_words + 1)

    def shares(self) -> np.ndarray:
        """Share of each class, the end last, of all tokens, each word's and the unknown ones' half a token included."""
        mass = np.append(self.class_total, self.ends + 0.5)
        return mass / mass.sum()

    def halves(self) -> np.ndarray:
        """These half tokens of each class, per token of the corpus."""
        return np.append(0.5 * (self.class_words + 1), 0.5) / max(self.tokens, 1)


def gather_counts(docs: DataFrame, words: DataFrame, hot_share: int = HOT_SHARE) -> Counts:
    """Class sums (CLASSES rows) and hot words (fewer than ``hot_share``) come to the driver, whatever the data."""
    ends = docs.where(~held_out()).count()
    known = F.sum((F.col("c") > 0).cast("long"))
    sums = words.groupBy(class_of(F.col("word")).alias("class")).agg(
        F.sum("c").alias("c"), known.alias("v"), F.sum("n").alias("n")).toPandas()
    tokens, words_of = np.zeros(CLASSES), np.zeros(CLASSES)
    tokens[sums["class"]], words_of[sums["class"]] = sums["c"], sums["v"]
    hot = words.where(F.col("n") * hot_share > int(sums["n"].sum())).select("word", "c").toPandas()
    hashes = hot["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Counts(
        int(tokens.sum()) + ends, int(words_of.sum()) + (ends > 0), ends, tokens, words_of,
        hashes[order], hot["c"].to_numpy(np.int64)[order],
    )


_ENCODED = (
    "at long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, "
    "codes binary, rare array<long>, times array<int>"
)


def _encode(counts: Counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        hot = np.append(counts.hot, np.uint64(2**64 - 1))
        base = np.log10((counts.hot_c + 0.5) / counts.base_total)
        inside = np.log10((counts.hot_c + 0.5) / counts.class_total[(counts.hot >> np.uint64(48)).astype(np.int64)])
        values = np.column_stack([counts.hot_c > 0, base, inside, np.zeros(len(base))]) if len(base) else np.zeros((0, 4))
        values = np.vstack([values, np.zeros((1, 4))])
        end_known, end_base = int(counts.ends > 0), np.log10((counts.ends + 0.5) / counts.base_total)
        for b in batches:
            data, offs = text_bytes(b.column(3))
            for i, j, d, o in chunks(data, offs):
                h, n = word_hashes(d, o, powers)
                doc = np.repeat(np.arange(j - i), n)
                at = np.searchsorted(hot[:-1], h)
                miss = hot[at] != h
                if len(counts.hot) == 0:
                    miss[:] = True
                at[miss] = len(hot) - 1
                known, base_sum, inside_sum = (np.bincount(doc, values[at, k], j - i) for k in range(3))
                pairs = np.column_stack([doc[miss], h[miss].view(np.int64)])
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                pairs = pairs[order]
                new = np.ones(len(pairs), bool)
                new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(pairs))).astype(np.int32)
                bounds = pa.array(np.searchsorted(pairs[first, 0], np.arange(j - i + 1)).astype(np.int32))
                codes = (h >> np.uint64(48)).astype("<u2")
                ends = np.concatenate(([0], np.cumsum(n) * 2)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *[b.column(k).slice(i, j - i) for k in range(3)], pa.array(n + 1), pa.array(known.astype(np.int64) + end_known),
                    pa.array(base_sum + end_base), pa.array(inside_sum),
                    pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(codes.tobytes())]),
                    pa.ListArray.from_arrays(bounds, pa.array(pairs[first, 1])), pa.ListArray.from_arrays(bounds, pa.array(times)),
                ], ["at", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "codes", "rare", "times"])

    return run


def encode(docs: DataFrame, counts: Counts) -> DataFrame:
    """Per row: its number, the sums over hot words and the end, class numbers, and the words that aren't hot."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return write_through(rows.mapInArrow(_encode(counts), _ENCODED), "lm-encoded")


@dataclass
class Model:
    """start (states), move (from, to), emit (class, state)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(shares: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    """Each state's emissions are the class shares, shaken."""
    emit = shares[:, None] * np.exp(SPREAD * np.random.default_rng(seed).standard_normal((len(shares), states)))
    move = np.full((states, states), (1 - STAY) / states) + STAY * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class Group:
    """Documents that are run in lock-step: tokens by time, longest document first, so those still running are a prefix."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        steps = int(lengths[0])
        self.active = np.searchsorted(-lengths, -np.arange(steps), "left")
        self.first = np.concatenate(([0], np.cumsum(self.active)))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        time = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.codes = np.empty(len(doc), np.int64)
        self.codes[self.first[time] + doc] = tokens[np.repeat(starts, lengths) + time]

    def blocks(self, most: int) -> list[tuple[int, int]]:
        """Ranges of steps of at most ``most`` tokens, or one step."""
        out, t, steps = [], 0, len(self.active)
        while t < steps:
            u = min(steps, max(t + 1, int(np.searchsorted(self.first, self.first[t] + most, "right")) - 1))
            out.append((t, u))
            t = u
        return out


def groups(codes: list[np.ndarray], most: int = BLOCK) -> Iterator[tuple[np.ndarray, Group]]:
    """(documents, their group): each document's classes and the end; documents of like length together."""
    lengths = np.array([len(c) + 1 for c in codes], np.int64)
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        total = np.cumsum(lengths[order[i:]])
        j = i + max(1, int(np.searchsorted(total, most, "right")))
        some = order[i:j]
        tokens = np.concatenate([x for d in some for x in (codes[d].astype(np.int64), [END])])
        size = lengths[some]
        yield some, Group(tokens, np.cumsum(size) - size, size)
        i = j


def _forward(g: Group, m: Model, t0: int, t1: int, state: np.ndarray | None, fit: np.ndarray, keep: bool):
    """Scaled forward recursion over steps t0 to t1; adds log10 of the scales to ``fit``. ``keep``: all states and scales."""
    emit = m.emit[g.codes[g.first[t0]:g.first[t1]]]
    at = g.first[t0]
    states = np.empty_like(emit) if keep else None
    scales = np.empty(len(emit), emit.dtype)
    for t in range(t0, t1):
        lo, n = g.first[t] - at, g.active[t]
        e = emit[lo:lo + n]
        a = e * m.start if state is None else (state[:n] @ m.move) * e
        s = a.sum(axis=1)
        a /= s[:, None]
        scales[lo:lo + n] = s
        if keep:
            states[lo:lo + n] = a
        state = a
    logs = np.log10(scales, dtype=np.float64)
    docs = np.arange(len(emit)) - np.repeat(g.first[t0:t1] - at, g.active[t0:t1])
    fit += np.bincount(docs, logs, len(fit))
    return state, emit, states, scales


def likelihoods(g: Group, m: Model, most: int = BLOCK) -> np.ndarray:
    """log10 of the probability of each document's classes."""
    fit, state = np.zeros(g.active[0]), None
    for t0, t1 in g.blocks(most):
        state = _forward(g, m, t0, t1, state, fit, False)[0]
    return fit


class Expected:
    """Expected counts of starts, moves and emissions, and the log10 likelihood."""

    def __init__(self, states: int):
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES + 1, states))
        self.fit = 0.0

    def add(self, g: Group, m: Model, most: int = BLOCK) -> None:
        fit, state, borders, blocks = np.zeros(g.active[0]), None, [], g.blocks(most)
        for k, (t0, t1) in enumerate(blocks):
            borders.append(state)
            state, *last = _forward(g, m, t0, t1, state, fit, k == len(blocks) - 1)
        self.fit += float(fit.sum())
        after = np.zeros((0, len(self.start)))
        for k in range(len(blocks) - 1, -1, -1):
            t0, t1 = blocks[k]
            emit, states, scales = last if k == len(blocks) - 1 else _forward(g, m, t0, t1, borders[k], np.zeros(len(fit)), True)[1:]
            at, there = g.first[t0], np.empty_like(emit)
            for t in range(t1 - 1, t0 - 1, -1):
                lo, n = g.first[t] - at, g.active[t]
                a = states[lo:lo + n]
                self.move += a[:len(after)].T @ after
                beta = np.ones_like(a)
                beta[:len(after)] = after @ m.move.T
                there[lo:lo + n] = a * beta
                after = emit[lo:lo + n] * beta / scales[lo:lo + n, None]
            if t0 == 0:
                self.start += there[:g.active[0]].sum(axis=0)
            codes = g.codes[g.first[t0]:g.first[t1]]
            for s in range(there.shape[1]):
                self.emit[:, s] += np.bincount(codes, there[:, s], CLASSES + 1)

    def rows(self, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, values): emissions that occur, the starts, a row of moves per state, and the fit."""
        used = np.flatnonzero(self.emit.any(axis=1))
        fit = np.zeros((1, len(self.start)))
        fit[0, 0] = self.fit
        return (
            np.concatenate([used, [STARTS], MOVES - np.arange(len(self.start)), [FIT]]),
            np.vstack([self.emit[used], self.start, self.move * m.move, fit]),
        )


def _codes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in column]


def _expect(model: Model):
    # Half the memory; sums of expected counts are made in doubles.
    model = Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, states = None, len(model.start)
        for b in batches:
            total = total or Expected(states)
            for _, g in groups(_codes(b.column(0))):
                total.add(g, model)
        if total:
            ids, values = total.rows(model)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.astype(np.int32)), *[pa.array(values[:, s]) for s in range(states)]], ["id", *[f"v{s}" for s in range(states)]])

    return run


def improved(encoded: DataFrame, model: Model, counts: Counts, prior: float = PRIOR) -> tuple[Model, float]:
    """One round of Baum-Welch over all training rows: (the next model, log10 likelihood under the given one).

    Each state takes its part of the half tokens that words get beside their counts, so that unknown words are no
    less likely in a state than in the corpus.
    """
    states = len(model.start)
    schema = "id int, " + ", ".join(f"v{s} double" for s in range(states))
    parts = encoded.where(~F.col("held_out")).select("codes").mapInArrow(_expect(model), schema)
    got = parts.groupBy("id").agg(*[F.sum(f"v{s}").alias(f"v{s}") for s in range(states)]).toPandas()
    ids, values = got["id"].to_numpy(), got.drop(columns="id").to_numpy(np.float64)
    emit, start, move = np.zeros((CLASSES + 1, states)), np.ones(states), np.full((states, states), PRIOR_MOVES)
    emit[ids[ids >= 0]] = values[ids >= 0]
    emit += counts.halves()[:, None] * emit.sum(axis=0) + prior * counts.shares()[:, None]
    start += values[ids == STARTS].sum(axis=0)
    for s in range(states):
        move[s] += values[ids == MOVES - s].sum(axis=0)
    fit = float(values[ids == FIT].sum())
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)), fit


def train(encoded: DataFrame, counts: Counts, states: int = STATES, iterations: int = ITERATIONS, prior: float = PRIOR) -> Model:
    model = first_model(counts.shares(), states)
    for _ in range(iterations):
        model, _ = improved(encoded, model, counts, prior)
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for some, g in groups(_codes(b.column(b.num_columns - 1))):
                out[some] = likelihoods(g, model)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*b.schema.names[:-1], "chain"])

    return run


def score_encoded(encoded: DataFrame, words: DataFrame, counts: Counts, model: Model) -> DataFrame:
    """Adds up the chain, the hot words and, joined by word, the others."""
    spark = encoded.sparkSession
    kept = ["at", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside"]
    chain = encoded.select(*kept, "codes").mapInArrow(_score(model), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema[:len(kept)])
                                                      + ", chain double")
    whole = chain.select("at", "doc_id", "held_out", "n_tokens", "n_known", "base", (F.col("inside") + F.col("chain")).alias("score"))
    totals = spark.createDataFrame([(k, float(x)) for k, x in enumerate(counts.class_total)], "class int, total double")
    logs = words.join(F.broadcast(totals), class_of(words["word"]) == totals["class"]).select(
        "word", (F.col("c") > 0).cast("long").alias("known"),
        F.log10((F.col("c") + 0.5) / F.lit(counts.base_total)).alias("base"), F.log10((F.col("c") + 0.5) / F.col("total")).alias("inside"),
    )
    rare = encoded.select("at", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("at", F.col("x.rare").alias("word"), "x.times")
    part = rare.join(logs, "word").select(
        "at", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
        (F.col("known") * F.col("times")).alias("n_known"), (F.col("base") * F.col("times")).alias("base"),
        (F.col("inside") * F.col("times")).alias("score"),
    )
    return whole.unionByName(part).groupBy("at").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    ).drop("at")


def score_documents(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, hot_share: int = HOT_SHARE,
                    prior: float = PRIOR) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on the rows that aren't held out and scores all. Null and empty texts hold the end only; rows that share an id or
    a text are learned from and scored each, rows without an id too. Where nothing is to be learned from, every token has the
    same share. An empty table gives no rows; other columns are ignored.
    """
    words = word_counts(docs)
    counts = gather_counts(docs, words, hot_share)
    encoded = encode(docs, counts)
    return score_encoded(encoded, words, counts, train(encoded, counts, states, iterations, prior))


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
