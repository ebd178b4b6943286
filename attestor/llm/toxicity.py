"""Toxicity: non-negative positive-unlabelled learning on word features.

Positives are documents confirmed toxic; unlabelled are documents of the same folds whose labels
are not looked at, toxic ones among them. With class prior p, the risk of a linear score f under
the logistic loss is

    p * mean over positives of loss(f)  +  max(0, mean over unlabelled of loss(-f) - p * mean over positives of loss(-f))

The second part estimates the risk on negatives; where it turns negative, the fit has begun to
learn unlabelled texts by heart, and the step goes the other way. The prior is the share of toxic
rows among the labelled rows of the training folds, or a parameter.

Features are whether a document holds a word (lower-cased runs of letters and digits). Words are
ranked by the likelihood ratio (G2) of positives against unlabelled; the best FEATURES words that
enough positives hold, and that stand out from chance, are used. The fit reads at most POSITIVES and UNLABELLED documents, chosen by
a hash of doc_id; the model is a few hundred numbers and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, ship, table, write_through
from attestor.llm.textops import PLAIN_BREAK, Powers, chunks, distinct_runs, text_bytes, word_hashes

ship(__name__)

POSITIVES, UNLABELLED = 4_000, 12_000
FEATURES = 256
#: Least G2 of a word that is used; chance gives so much to about one word in two hundred.
LEAST_G2 = 8.0
FOLDS = 5
_DOC = "doc_id long, kind int, word long"


def fold(folds: int = FOLDS) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; fold 0 is held out. A null id is in fold -1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for b in batches:
        data, offs = text_bytes(b.column(2))
        for i, j, d, o in chunks(data, offs):
            values, runs = distinct_runs(*word_hashes(d, o, powers, PLAIN_BREAK))
            at = pa.array(np.repeat(np.arange(i, j), runs + 1))
            # Each document starts with a null word, so that documents without words count, too.
            out = np.insert(values.view(np.int64), np.cumsum(runs) - runs, 0)
            null = np.zeros(len(out), bool)
            null[np.cumsum(runs + 1) - runs - 1] = True
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at).cast(pa.int64()), b.column(1).take(at), pa.array(out, mask=null)], ["doc_id", "kind", "word"]
            )


def fit_words(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """(doc_id, kind 1 positive or 0 unlabelled, word) of the documents the fit reads."""
    train = fold() != 0
    known = labels.where(train & (F.col("toxic") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    some = lambda d, n, salt: d.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(n)
    p = some(known, positives, 1).withColumn("kind", F.lit(1))
    u = some(docs.where(train & F.col("doc_id").isNotNull()).select("doc_id").distinct(), unlabelled, 2).withColumn("kind", F.lit(0))
    # At most ``positives`` + ``unlabelled`` ids, whatever the data.
    chosen = write_through(p.union(u), "toxic-fit-ids")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "kind", "text")
    return write_through(rows.mapInArrow(_words, _DOC), "toxic-fit-words")


def best_words(rows: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, int, int]:
    """(hashes of the best words, positives, unlabelled)."""
    n = {r["kind"]: r["n"] for r in rows.where("word is null").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    p, u = n.get(1, 0), n.get(0, 0)
    if not p or not u:
        return np.zeros(0, np.uint64), p, u
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    share = (a + b) / float(p + u)
    g2 = part(a, share * p) + part(p - a, (1 - share) * p) + part(b, share * u) + part(u - b, (1 - share) * u)
    least = max(3, p // 500)
    best = rows.where("word is not null").groupBy("word").agg(
        F.sum("kind").alias("a"), F.sum(1 - F.col("kind")).alias("b")
    ).where(F.col("a") >= least).withColumn("g", g2).where(F.col("g") >= LEAST_G2).orderBy(F.desc("g"), "word").limit(features)
    return np.sort(np.array([r["word"] for r in best.select("word").collect()], np.int64).view(np.uint64)), p, u


def design(rows: DataFrame, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of the fit documents, their kinds): at most FEATURES columns and POSITIVES + UNLABELLED rows."""
    wanted = rows.sparkSession.createDataFrame([(int(w), i) for i, w in enumerate(words.view(np.int64))], "word long, no int")
    held = rows.join(F.broadcast(wanted), "word", "left").groupBy("kind", "doc_id").agg(F.collect_set("no").alias("nos"))
    got = held.orderBy("kind", "doc_id").toPandas()
    x = np.zeros((len(got), len(words)), np.float32)
    for i, nos in enumerate(got["nos"]):
        x[i, list(nos)] = 1
    return x, got["kind"].to_numpy(np.int64)


def fit_nnpu(x: np.ndarray, kind: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4,
             slack: float = 0.0) -> np.ndarray:
    """Weights and, last, the bias, by Adam on the non-negative risk."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    xp, xu = x[kind == 1], x[kind == 0]
    w = np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        narrow = w.astype(np.float32)
        fp, fu = (xp @ narrow).astype(np.float64), (xu @ narrow).astype(np.float64)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        pull = lambda x, by: (by.astype(np.float32) @ x) / len(x)
        g_positive = prior * pull(xp, sigmoid(fp) - 1)
        g_negative = pull(xu, sigmoid(fu)) - prior * pull(xp, sigmoid(fp))
        g = g_positive + g_negative if negative >= -slack else -g_negative
        g = g + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray):
        self.words, self.weights = words, weights

    def scores(self, data: np.ndarray, offs: np.ndarray, powers: Powers) -> np.ndarray:
        hashes, counts = word_hashes(data, offs, powers, PLAIN_BREAK)
        total = np.full(len(counts), self.weights[-1])
        if len(self.words) and len(hashes):
            at = np.searchsorted(self.words, hashes)
            at[at == len(self.words)] = 0
            hit = np.flatnonzero(self.words[at] == hashes)
            text = np.repeat(np.arange(len(counts)), counts)[hit]
            pairs = np.unique(text * len(self.words) + at[hit])
            np.add.at(total, pairs // len(self.words), self.weights[pairs % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES,
        unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    """Labels are read from rows outside fold 0 only. Without positives or documents, every text scores the prior."""
    if prior is None:
        prior = labels.where(fold() != 0).agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    prior = min(max(prior, 1e-3), 0.45)  # what holds no known word is never called toxic for the prior alone
    rows = fit_words(docs, labels, positives, unlabelled)
    words, p, u = best_words(rows, features)
    if not len(words):
        return Model(words, np.array([np.log(prior / (1 - prior))]))
    x, kind = design(rows, words)
    return Model(words, fit_nnpu(x, kind, prior))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            data, offs = text_bytes(b.column(b.num_columns - 1))
            scores = [model.scores(d, o, powers) for _, _, d, o in chunks(data, offs)]
            out = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], [*b.schema.names[:-1], "score"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. Null and empty texts score the bias alone."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    scored = rows.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Fits on ``labels`` and scores every row of ``docs``.

    Rows with a null doc_id are scored but never fitted; null labels count as not confirmed; rows that repeat
    an id are scored each. An empty ``docs`` gives no rows; other columns are ignored.
    """
    return score_documents(docs, fit(docs, labels, **settings))


def _keep(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            data, offs = text_bytes(b.column(b.schema.get_field_index("text")))
            scores = [model.scores(d, o, powers) for _, _, d, o in chunks(data, offs)]
            yield b.filter(pa.array(np.concatenate(scores) < 0.5 if scores else np.zeros(0, bool)))

    return run


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents that score 0.5 or more; all columns stay."""
    return docs.mapInArrow(_keep(model), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
