"""Periodic runs of words: constant-time common extensions on suffix trees, started at Lyndon roots.

A run is a stretch of words with a smallest period q that repeats at least EXPONENT times, is at least
LEAST words long and can't be made longer either way. Every run holds, for one of the two orders of the
alphabet, a longest Lyndon word of length q that starts inside it. So it's enough to take, at each place and in both orders,
the longest Lyndon word there, and to extend it both ways as far as its period holds:

1. Ukkonen's algorithm builds the suffix tree of the words, and that of the reversal.
2. An Euler tour visits the leaves; of the nodes between two leaves only the shallowest is kept, which is
   their lowest common ancestor. A sparse table over these depths answers the common extension of any two places
   at once (numpy, all candidates together).
3. Leaf order gives the order of suffixes; the longest Lyndon word at a place ends where the next smaller suffix
   starts. A second tour, children the other way round, serves the inverse order.

Before that, words that can't lie in any run are left out, which loses nothing: in a run of period q that has
EXPONENT >= 4 repeats within a stretch of L words, every four words stand again at a distance of q <= L / EXPONENT.
Four words that don't are a border, and the same is asked again of the stretches between borders. A run lies in one
stretch as a whole, so trees are built for stretches and not for plain prose.

A document is worked on by one task and never leaves it; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, ship
from attestor.llm.textops import PLACE, U, mix

ship(__name__)

#: Least words of a run, and how often its period must be repeated at least.
LEAST, EXPONENT = 6, 4
#: Words that must stand again together, and rounds of leaving out; more rounds find nothing wrong, only less.
GRAM, ROUNDS = 4, 12
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def stretches(ids: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """(start, end) of the parts that may hold runs; they overlap by less than GRAM words."""
    m = len(ids) - GRAM + 1
    if len(ids) < least:
        return []
    grams = np.zeros(m, U)
    words = mix(ids.astype(U) + U(1))
    for j in range(GRAM):
        grams += words[j:m + j] * PLACE[j]
    at = np.arange(m)
    for _ in range(ROUNDS):
        part = np.cumsum(np.diff(at, prepend=-2) != 1) - 1
        sizes = np.bincount(part) if len(part) else np.zeros(0, np.int64)
        keys = mix(grams[at]) ^ (part.astype(U) * PLACE[GRAM])
        order = np.argsort(keys, kind="stable")
        gap = np.diff(at[order])
        gap[keys[order][1:] != keys[order][:-1]] = len(ids) + 1
        most = (sizes + GRAM - 1) // exponent
        near = np.full(len(at) + 1, len(ids) + 1)
        near[1:-1] = gap
        closest = np.minimum(near[:-1], near[1:])
        keep = np.zeros(len(at), bool)
        keep[order] = closest <= most[part[order]]
        keep &= sizes[part] >= least - GRAM + 1
        if keep.all():
            break
        at = at[keep]
    if not len(at):
        return []
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    last = np.append(first[1:], len(at)) - 1
    return [(int(at[a]), int(at[b]) + GRAM) for a, b in zip(first, last) if at[b] + GRAM - at[a] >= least]


class SuffixTree:
    """Ukkonen's suffix tree of ``symbols`` (1 and up); 0 ends the text and is smallest.

    Leaves are made in the order of their suffixes, so the k-th leaf is suffix k.
    """

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        self.n = n = len(s)
        size = max(s) + 1
        edges: dict[int, int] = {}
        start, end, link, suffix = [0], [0], [0], [-1]
        node = edge = length = waiting = leaves = 0
        for i, c in enumerate(s):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    edge = i
                key = node * size + s[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    suffix.append(leaves)
                    leaves += 1
                    if last:
                        link[last] = node
                        last = 0
                else:
                    span = end[child] - start[child]
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    middle = start[child] + length
                    if s[middle] == c:
                        if last:
                            link[last] = node
                        length += 1
                        break
                    split = len(start)
                    edges[key] = split
                    start += (start[child], i)
                    end += (middle, n)
                    link += (0, 0)
                    suffix += (-1, leaves)
                    leaves += 1
                    start[child] = middle
                    edges[split * size + s[middle]] = child
                    edges[split * size + c] = split + 1
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        child = np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys)
        self.parent, self.symbol, self.child = keys[order] // size, keys[order] % size, child[order]
        self.spans = np.asarray(end) - np.asarray(start)
        self.suffix = suffix

    def tour(self, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in leaf order, string depth of the common ancestor of neighbouring leaves).

        ``inverse``: children in falling order, but the end of the text still first.
        """
        # A stack takes children last first.
        by = np.where(self.symbol == 0, -self.n - 1, -self.symbol if inverse else self.symbol)
        order = np.lexsort((-by, self.parent))
        kids = self.child[order].tolist()
        bounds = np.searchsorted(self.parent[order], np.arange(len(self.spans) + 1)).tolist()
        spans, suffix = self.spans.tolist(), self.suffix
        depth = [0] * len(spans)
        leaves, common, stack, above, after_leaf = [], [], [0], [0], False
        while stack:
            node, up = stack.pop(), above.pop()
            if after_leaf:
                common.append(up)
                after_leaf = False
            if suffix[node] >= 0:
                leaves.append(suffix[node])
                after_leaf = True
            else:
                here = depth[node] = up + spans[node] if node else 0
                below = kids[bounds[node]:bounds[node + 1]]
                stack += below
                above += [here] * len(below)
        return np.array(leaves), np.array(common, np.int64)


class Extensions:
    """How far the text reads alike from two places, by the lowest common ancestor of their leaves."""

    def __init__(self, leaves: np.ndarray, common: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.table = [common.astype(np.int32)]
        step = 1
        while 2 * step <= len(common):
            row = self.table[-1]
            self.table.append(np.minimum(row[:-step], row[step:]))
            step *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = self.rank[a], self.rank[b]
        lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            on = level == k
            row = self.table[k]
            out[on] = np.minimum(row[lo[on]], row[hi[on] - (1 << k)])
        return out


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place, from the ranks of the suffixes (the empty one last in the text)."""
    ranks = rank.tolist()
    n = len(ranks) - 1
    ends = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, r = i + 1, ranks[i]
        while ranks[j] > r:
            j = ends[j]
        ends[i] = j
    return np.array(ends[:n], np.int64) - np.arange(n)


def runs_of(symbols: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs of a text of integers, by start and period."""
    n = len(symbols)
    if n < least:
        return np.zeros((0, 3), np.int64)
    codes = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    tree = SuffixTree(codes)
    tour = tree.tour()
    forward = Extensions(*tour)
    periods = [lyndon_lengths(forward.rank)]
    other, _ = tree.tour(inverse=True)
    rank = np.empty(n + 1, np.int64)
    rank[other] = np.arange(n + 1)
    periods.append(lyndon_lengths(rank))
    del tree
    at = np.concatenate([np.arange(n)] * 2)
    q = np.concatenate(periods)
    fits = exponent * q <= n
    at, q = at[fits], q[fits]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    backward = Extensions(*SuffixTree(codes[::-1]).tour())
    after = forward(at, at + q)
    before = np.zeros(len(at), np.int64)
    inner = at > 0
    before[inner] = backward(n - at[inner], n - at[inner] - q[inner])
    start, length = at - before, before + q + after
    real = (length >= least) & (length >= exponent * q)
    return np.unique(np.column_stack([start, q, length])[real], axis=0)[:, [0, 2, 1]]


def find_runs(ids: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """The runs of a document's word numbers: those of its stretches."""
    found = [runs_of(ids[a:b], least, exponent) + [a, 0, 0] for a, b in stretches(ids, least, exponent)]
    found = [f for f in found if len(f)]
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run repeats: of each run its first period stays, unless another run repeats it."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def strongest(runs: np.ndarray) -> int | None:
    """The run with the greatest exponent; ties go to the smallest start, then period."""
    if not len(runs):
        return None
    rows = runs.tolist()
    return max(range(len(rows)), key=lambda k: (Fraction(rows[k][1], rows[k][2]), -rows[k][0], -rows[k][2]))


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of one in ten documents, by a hash of the id, the words from some place on become repeats of the first ones there."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def _search(edit: Callable | None, least: int, exponent: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("strongest", pa.int32()), ("collapsed", pa.large_string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            out, size = [], 0
            for doc, text in zip(b.column(0).to_pylist(), texts):
                # Splits at blank, tab, line breaks, vertical tab and form feed.
                words = (text.as_py() or b"").split()
                if edit:
                    words = edit(doc, words)
                numbers: dict[bytes, int] = {}
                ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                runs = find_runs(ids, least, exponent)
                kept = b" ".join(collapsed(words, runs))
                size += len(kept)
                out.append((doc, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], strongest(runs), kept.decode()))
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def periodic_runs(docs: DataFrame, edit: Callable | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (by start, then period), strongest (its place in ``runs``), collapsed.

    ``edit`` takes a doc_id and its words and gives the words to search. ``least`` and ``exponent`` are 6 and 4 at
    least; below, plain stretches could be left out. Null and empty texts have no words and no runs; rows that repeat a doc_id
    are searched each, null ids too; an empty table gives no rows; other columns are ignored.
    """
    if least < LEAST or exponent < EXPONENT:
        raise ValueError(f"runs are found from {LEAST} words and {EXPONENT} repeats on")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _search(edit, least, exponent), f"doc_id long, n_words long, runs {RUNS}, strongest int, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run (nulls without), and digests of all runs and of what is left of the text."""
    best = F.get("runs", F.col("strongest"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    sha: Callable[[Column], Column] = lambda c: F.sha2(c, 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * runs[strongest].length div runs[strongest].period").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(documents(spark, sf_dir), repeat_tail))
