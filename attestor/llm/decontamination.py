"""Benchmark decontamination: latent semantic retrieval, then longest common subsequences.

1. Documents become passages of 2 * STEP words, one every STEP words. Words are weighted by their
   inverse document frequency over all documents; only words that some benchmark item holds can
   tell an item from others, so these are the terms.
2. A randomised SVD of the passages' TF-IDF matrix A: each task adds up its share of Y = A'A S for a
   random S with SKETCH columns, Spark sums the shares, and the Nystroem factor of Y gives the
   leading directions of all passages. Together with the benchmark's own passages, which weigh as
   much as the corpus, they give the latent space of RANK dimensions at most.
3. Each passage is projected and compared with every item (a stated query set, against all rows, in
   blocks); passages with a cosine of COSINE or more are candidates.
4. A candidate is verified on the words around it: within some stretch of 1.5 times the item's words,
   the longest common subsequence must hold COVERAGE percent of the item's words, and ANSWER percent of
   its answer (the item's last sentence; of three words at least), so that rewording and small
   insertions don't hide an item while texts on the same subject stay.

The benchmark is read in parts of about PART_BYTES, so what travels to tasks is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, numbered, ship, table, write_through
from attestor.llm.textops import PLAIN_BREAK, Powers, chunks, text_bytes, word_hashes

ship(__name__)

STEP = 32
SKETCH = 32
RANK = 256
COSINE = 0.35
COVERAGE, ANSWER = 70, 60
PART_BYTES = 1 << 18
#: Bytes of text worked on at once: each word holds RANK numbers while it is projected.
SLICE = 1 << 18


class Item:
    """A benchmark item: word hashes, and bit masks of its words for the subsequence."""

    def __init__(self, item_id: int, words: list[int], answer: list[int]):
        self.item_id, self.words, self.answer = item_id, words, answer or words
        self.masks, self.answer_masks = masks(self.words), masks(self.answer)
        self.distinct, self.times = np.unique(np.array(words, np.uint64), return_counts=True)

    def may_reach(self, words: np.ndarray) -> bool:
        """Whether enough of the item's words occur at all; a common subsequence has no more of them."""
        at = np.searchsorted(self.distinct, words)
        at[at == len(self.distinct)] = 0
        held = np.bincount(at[self.distinct[at] == words], minlength=len(self.distinct))
        return int(np.minimum(held, self.times).sum()) * 100 >= COVERAGE * len(self.words)


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def common(length: int, held: dict[int, int], words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    full = (1 << length) - 1
    v = full
    for w in words:
        y = v & held.get(w, 0)
        v = ((v + y) | (v - y)) & full
    return length - v.bit_count()


def plain_words(text: str, powers: Powers) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    return [int(h) for h in word_hashes(data, np.array([0, len(data)]), powers, PLAIN_BREAK)[0]]


def make_items(rows: list) -> list[Item]:
    """Items with words; of the sentences, the last one is the answer."""
    powers, out = Powers(), []
    for r in rows:
        words = plain_words(r["text"] or "", powers)
        if words:
            last = [s for s in re.split(r"[.!?]+", r["text"]) if len(plain_words(s, powers)) >= 3]
            out.append(Item(r["item_id"], words, plain_words(last[-1], powers) if last else []))
    return out


def blocks(data: np.ndarray, offs: np.ndarray, terms: np.ndarray, powers: Powers):
    """(word hashes, words per text, term of each word or -1, block of each word, first block of each text and the end).

    A block is STEP words of a text; a passage is a block and its next one. A text without words has no block.
    """
    hashes, counts = word_hashes(data, offs, powers, PLAIN_BREAK)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    term = np.where(terms[at] == hashes, at, -1)
    per = -(-counts // STEP)
    first = np.concatenate(([0], np.cumsum(per)))
    begin = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    block = first[text] + (np.arange(len(hashes)) - begin[text]) // STEP
    return hashes, counts, term, block, first


def _frequencies(terms: np.ndarray):
    """Documents that hold each term; their number as term -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, docs = Powers(), np.zeros(len(terms), np.int64), 0
        for b in batches:
            data, offs = text_bytes(b.column(0))
            for _, _, d, o in chunks(data, offs):
                _, counts, term, _, _ = blocks(d, o, terms, powers)
                hit = np.flatnonzero(term >= 0)
                text = np.repeat(np.arange(len(counts)), counts)[hit]
                held += np.bincount(np.unique(text * len(terms) + term[hit]) % len(terms), minlength=len(terms))
                docs += len(counts)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(held[some], docs))], ["term", "docs"])

    return run


def block_sums(values: np.ndarray, term: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Sum of the terms' rows of ``values`` for each of n blocks."""
    out = np.zeros((n, values.shape[1]), np.float32)
    hit = np.flatnonzero(term >= 0)
    if len(hit):
        b = block[hit]
        starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        out[b[starts]] = np.add.reduceat(values[term[hit]], starts, axis=0)
    return out


def passages(sums: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A block and its next one in the same text; the last block of a text stands alone."""
    out = sums.copy()
    if len(sums) > 1:
        follows = np.ones(len(sums) - 1, bool)
        ends = first[1:-1] - 1
        follows[ends[(ends >= 0) & (ends < len(follows))]] = False
        out[:-1][follows] += sums[1:][follows]
    return out


def sketch_matrix(terms: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((terms, SKETCH)).astype(np.float32)


def _sketch(terms: np.ndarray, idf: np.ndarray):
    """Each task's share of A'A S; passages are scaled to about unit length by their number of terms."""
    names = ["term", *(f"y{i}" for i in range(SKETCH))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, y = Powers(), np.zeros((len(terms), SKETCH))
        weighted = np.hstack([sketch_matrix(len(terms)) * idf[:, None], (idf ** 2)[:, None]]).astype(np.float32)
        for b in batches:
            data, offs = text_bytes(b.column(0))
            for _, _, d, o in chunks(data, offs):
                _, _, term, block, first = blocks(d, o, terms, powers)
                n = int(first[-1])
                if not n:
                    continue
                z = passages(block_sums(weighted, term, block, n), first)
                z = z[:, :-1] / np.maximum(z[:, -1:], 1e-6)
                # A block lies in its own passage and in the one before it.
                both = z.copy()
                prior = np.ones(n, bool)
                prior[first[:-1][first[:-1] < n]] = False
                both[prior] += z[np.flatnonzero(prior) - 1]
                hit = np.flatnonzero(term >= 0)
                order = hit[np.argsort(term[hit], kind="stable")]
                if len(order):
                    t = term[order]
                    starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                    y[t[starts]] += np.add.reduceat(both[block[order]], starts, axis=0) * idf[t[starts], None]
        some = np.flatnonzero(np.abs(y).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(np.ascontiguousarray(c)) for c in y[some].T)], names)

    return run


def latent_space(items: list[Item], terms: np.ndarray, idf: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms to latent dimensions with idf applied, unit items in the latent space)."""
    t = np.zeros((len(items), len(terms)))
    for i, item in enumerate(items):
        np.add.at(t[i], np.searchsorted(terms, np.array(item.words, np.uint64)), 1)
    t *= idf
    t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-9)
    # Nystroem: A'A is close to Y (S'Y)^-1 Y', so Y R^-1 with R'R = S'Y is a factor of it.
    core = sketch_matrix(len(terms)).T.astype(np.float64) @ y
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    good = values > max(values.max(), 0) * 1e-6
    factor = y @ vectors[:, good] / np.sqrt(values[good]) if good.any() else np.zeros((len(terms), 0))
    weight = np.linalg.norm(factor) / np.sqrt(len(items)) if factor.size and factor.any() else 1.0
    u, s, _ = np.linalg.svd(np.hstack([t.T * weight, factor]), full_matrices=False)
    u = u[:, s > s[0] * 1e-6][:, :RANK]
    latent = t @ u
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return (u * idf[:, None]).astype(np.float32), latent.astype(np.float32)


def verified(item: Item, words: list[int]) -> tuple[int, int] | None:
    """(common words, common words of the answer) in the best stretch of 1.5 times the item's words, if they suffice."""
    n = len(item.words)
    if common(n, item.masks, words) * 100 < COVERAGE * n:
        return None
    size, best = n + (n + 1) // 2, None
    for at in range(0, max(len(words) - size, 0) + max(n // 4, 1), max(n // 4, 1)):
        part = words[at:at + size]
        got = common(n, item.masks, part)
        if got * 100 >= COVERAGE * n:
            answer = common(len(item.answer), item.answer_masks, part)
            if answer * 100 >= ANSWER * len(item.answer):
                best = max(best or (0, 0), (got, answer))
    return best


_FOUND = "doc_id long, item_id long, cosine double, common_words int, answer_words int, word long"


def _search(items: list[Item], terms: np.ndarray, space: np.ndarray, latent: np.ndarray, cosine: float):
    names = ["doc_id", "item_id", "cosine", "common_words", "answer_words", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            ids, (data, offs), found = b.column(0), text_bytes(b.column(1)), {}
            for i, j, d, o in chunks(data, offs, SLICE):
                hashes, counts, term, block, first = blocks(d, o, terms, powers)
                n = int(first[-1])
                if not n:
                    continue
                p = passages(block_sums(space, term, block, n), first)
                p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
                close = p @ latent.T
                begin = np.cumsum(counts) - counts
                for k, m in zip(*np.nonzero(close >= cosine)):
                    text = int(np.searchsorted(first, k, "right")) - 1
                    item, at = items[m], (int(k) - int(first[text])) * STEP
                    around = len(item.words)
                    lo, hi = max(at - around, 0), min(at + 2 * STEP + around, int(counts[text]))
                    near = hashes[begin[text] + lo:begin[text] + hi]
                    got = verified(item, near.tolist()) if item.may_reach(near) else None
                    if got:
                        key = (i + text, m)
                        if key not in found or got > found[key][0]:
                            found[key] = (got, float(close[k, m]), at)
            rows = sorted(found.items())
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array([k[0] for k, _ in rows], pa.int64())).cast(pa.int64()), pa.array([items[k[1]].item_id for k, _ in rows], pa.int64()),
                pa.array([v[1] for _, v in rows], pa.float64()), pa.array([v[0][0] for _, v in rows], pa.int32()),
                pa.array([v[0][1] for _, v in rows], pa.int32()), pa.array([v[2] for _, v in rows], pa.int64()),
            ], names)

    return run


def _part(docs: DataFrame, items: list[Item], cosine: float) -> DataFrame:
    terms = np.unique(np.array([w for i in items for w in i.words], np.uint64))
    text = docs.select("text")
    counts = text.mapInArrow(_frequencies(terms), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toPandas()
    held = np.zeros(len(terms))
    got = counts[counts["term"] >= 0]
    held[got["term"].to_numpy(np.int64)] = got["docs"].to_numpy()
    total = float(counts.loc[counts["term"] < 0, "docs"].sum())
    idf = np.log((total + 1) / (held + 1)) + 0.05
    cols = [f"y{i}" for i in range(SKETCH)]
    shares = text.mapInArrow(_sketch(terms, idf), "term long, " + ", ".join(f"{c} double" for c in cols))
    sums = shares.groupBy("term").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
    y = np.zeros((len(terms), SKETCH))
    y[sums["term"].to_numpy(np.int64)] = sums[cols].to_numpy()
    space, latent = latent_space(items, terms, idf, y)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_search(items, terms, space, latent, cosine), _FOUND)


def find_contamination(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, cosine, common_words, answer_words, word (place of the passage).

    Null and empty texts, on either side, match nothing. Rows that repeat a doc_id, and items of equal text, are reported
    each. Rows with a null doc_id are reported with a null id. Empty tables give no rows; other columns are ignored.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, out = int(size // PART_BYTES) + 1, None
    for k in range(parts):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).select("item_id", "text").orderBy("item_id", "text").collect()
        items = make_items(rows)
        if items:
            found = write_through(_part(docs, items, cosine), "contamination")
            out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], _FOUND) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, whether or not their id is null or repeats; all columns stay."""
    rows = numbered(docs, "leak-rows")
    found = find_contamination(rows.select(F.col("__place").alias("doc_id"), "text"), benchmark, **settings)
    return rows.join(found.select(F.col("doc_id").alias("__place")).distinct(), "__place", "left_anti").select(docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
