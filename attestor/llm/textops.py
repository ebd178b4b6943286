"""Whole batches of texts as bytes: words, rolling hashes and slices in numpy, for Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from attestor.llm.common import ship

ship(__name__)

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20
U = np.uint64


def byte_table(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], dtype=bool)


#: Blank, tab, line breaks, vertical tab, form feed.
SPACE = byte_table(lambda b: b == 0x20 or 9 <= b <= 13)
#: ASCII letters and digits, and all bytes of other characters, make up plain words.
PLAIN_BREAK = byte_table(lambda b: b < 128 and not chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 2**64, 256, dtype=U)
PLACE = _rng.integers(0, 2**63, 64, dtype=U) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15 | 5)
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit hangs on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if a.null_count:
        a = a.fill_null(b"")
    offs = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def chunks(data: np.ndarray, offs: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, their bytes, their offsets) of runs of texts of about ``most`` bytes."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


class Powers:
    """Powers of BASE and of its inverse, kept as long as the longest chunk so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def powers(b):
                out = np.empty(n, U)
                out[0] = 1
                np.multiply.accumulate(np.full(n - 1, b, U), out=out[1:])
                return out
            self.up, self.down = powers(BASE), powers(BASE_INVERSE)
        return self.up[:n], self.down[:n]


def rolling(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(sums, down): the hash of data[s:e] is (sums[e] - sums[s]) * down[s], modulo 2**64."""
    up, down = powers.get(len(data) + 1)
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[data] * up[:-1], out=sums[1:])
    return sums, down


def words(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts): the words of all texts in order, and how many each text has."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    gap = breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    before |= edge[:n]
    starts = np.flatnonzero(before & ~gap)
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after |= edge[1:]
    ends = np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def word_hashes(data: np.ndarray, offs: np.ndarray, powers: Powers, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word, lower-cased in A-Z; words per text)."""
    starts, ends, counts = words(data, offs, breaks)
    sums, down = rolling(LOWER[data], powers)
    return mix((sums[ends] - sums[starts]) * down[starts]), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, runs per text). A text of fewer words, but some, has one run of all of them."""
    n = len(hashes)
    ends = np.cumsum(counts)
    starts = ends - counts
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(runs.sum()), U)
    if not len(out):
        return out, runs
    long = np.zeros(n, U)
    if n >= k:
        m = n - k + 1
        acc = hashes[:m] * PLACE[0]
        for j in range(1, k):
            acc += hashes[j:m + j] * PLACE[j]
        long[:m] = acc
    text = np.repeat(np.arange(len(counts)), runs)
    first = np.cumsum(runs) - runs
    at = starts[text] + (np.arange(len(out)) - first[text])
    out[:] = long[at]
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        w = hashes[starts[t]:ends[t]]
        out[first[t]] = (w * PLACE[:len(w)] + PLACE[60 + len(w) % 4]).sum(dtype=U)
    return mix(out), runs


def distinct_runs(values: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and how many."""
    bounds = np.concatenate(([0], np.cumsum(runs)))
    parts = [np.unique(values[bounds[i]:bounds[i + 1]]) for i in range(len(runs))]
    return (np.concatenate(parts) if parts else values[:0]), np.array([len(p) for p in parts], np.int64)
