"""Suffix-array duplicates: removes every byte of a LENGTH-byte string that also starts earlier.

A suffix array of the whole corpus would be one task. Instead, suffixes meet only where they can match:

1. Every window of LENGTH bytes has a smallest hash among its GRAM-byte grams. Equal windows have
   the same smallest hash, and neighbouring windows mostly share it, so a document becomes runs of
   windows (about one per 35 bytes), each with its hash and a hash of all bytes it covers.
2. Runs meet by smallest hash. Hashes that occur once are done: they are most of a corpus. Of equal
   runs, all but the first in (document, offset) order are covered as a whole.
3. Where different runs share a hash (ends of copied passages), their bytes meet. The suffixes that start there are put
   in suffix order; common prefixes of neighbours and the previous and next smaller text positions in that order give the longest
   previous factor of each, up to LENGTH bytes. Suffixes whose factor reaches LENGTH are covered: the first copy stays.
   Equal runs (step 2) and the windows of hot hashes go by 64-bit hash alone, without factors.
4. Covered windows merge to spans, and the spans are cut from the document.

Every step keeps the first of equal keys in its own batch and passes on only that one, so a passage that a third of
all documents share sends one row per task. A hash that very many different runs share (the end of
such a passage) is hot: its runs are spread by their bytes, and its windows meet one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, numbered, ship, text_of, write_through
from attestor.llm.textops import PLACE, Powers, U, chunks, mix, rolling, text_bytes

ship(__name__)

LENGTH = 100
GRAM = 32
#: One document in HOT_SAMPLE is looked at to find hot hashes; this decides how runs are spread, never the result.
HOT_SAMPLE = 16
HOT_LEAST = 64
#: At most so many hashes are hot (8 bytes each in a task's closure).
HOT_MOST = 1_000_000
#: Windows whose suffixes are sorted at once.
SORTED = 400_000
_BIG = np.iinfo(np.int64).max


def window_runs(data: np.ndarray, offs: np.ndarray, powers: Powers, length: int, gram: int):
    """(hash, hash of the bytes, text, offset, windows) of the runs of windows with one smallest hash."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z.view(U), z.view(U), z, z, z
    sums, down = rolling(data, powers)
    grams = low = mix((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[:size - width], low[width - size:])
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.maximum(offs[:-1], offs[1:] - (length - 1)), 1)
    np.add.at(mark, offs[1:], -1)
    inside = np.cumsum(mark[:-1])[:len(low)] == 0
    # A window whose least gram is its first one ends its run, so a run holds each of its windows once.
    other = (low[1:] != low[:-1]) | (grams[:len(low) - 1] == low[:-1])
    first, last = inside.copy(), inside.copy()
    first[1:] &= other | ~inside[:-1]
    last[:-1] &= other | ~inside[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    whole = mix((sums[hi + length] - sums[lo]) * down[lo] + (hi - lo).astype(U) * PLACE[1])
    text = np.searchsorted(offs, lo, "right") - 1
    return low[lo], whole, text, lo - offs[text], hi - lo + 1


def later(order: np.ndarray, new: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows, in ``order`` (by key, ``new`` at each key's first row), stand after the first place of their key."""
    if not len(order):
        return np.zeros(0, bool)
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    d, a = doc[order], at[order].astype(np.int64)
    same = d == np.minimum.reduceat(d, starts)[group]
    return ~(same & (a == np.minimum.reduceat(np.where(same, a, _BIG), starts)[group]))


def shared_rows(h: np.ndarray) -> np.ndarray:
    """Rows, sorted by h, whose h occurs more than once."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return order[twice]


def starts_of(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def merged(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered windows with touching or overlapping ones of a document as one."""
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], (at + n)[order]
    # The furthest end so far, within each document: offsets are far below 2**40.
    no = np.cumsum(starts_of(doc)) if len(doc) else doc
    far = np.maximum.accumulate((no << 40) + end) - (no << 40) if len(doc) else end
    new = starts_of(doc)
    new[1:] |= at[1:] > far[:-1]
    first = np.flatnonzero(new)
    return doc[first], at[first], far[np.append(first[1:], len(doc)) - 1] - at[first] if len(doc) else n


_RUNS = "key long, h long, c long, doc long, at int, n int, done boolean"


def _emit(names, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names)


def _runs(hot: np.ndarray, length: int, gram: int):
    """Runs of each document; of equal runs in a batch, those after the first are done: covered."""
    names = ["key", "h", "c", "doc", "at", "n", "done"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            ids = b.column(0).to_numpy()
            data, offs = text_bytes(b.column(1))
            parts = [(h, c, t + i, a, n) for i, _, d, o in chunks(data, offs) for h, c, t, a, n in [window_runs(d, o, powers, length, gram)]]
            if not parts:
                continue
            h, c, t, at, n = (np.concatenate(x) for x in zip(*parts))
            doc = ids[t]
            rows = shared_rows(h)
            rows = rows[np.lexsort((c[rows], h[rows]))]
            done = np.zeros(len(h), bool)
            done[rows] = later(rows, starts_of(h[rows], c[rows]), doc, at)
            key = h.copy()
            if len(hot):
                spot = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                is_hot = hot[spot] == h
                key[is_hot] = mix(h[is_hot] ^ c[is_hot])
            if done.any():
                d, a, k = merged(doc[done], at[done], n[done])
                live = ~done
                key, h, c = (np.append(x[live], z) for x, z in ((key, mix(d.view(U))), (h, np.zeros(len(d), U)), (c, np.zeros(len(d), U))))
                doc, at, n = np.append(doc[live], d), np.append(at[live], a), np.append(n[live], k)
                done = np.arange(len(doc)) >= live.sum()
            yield _emit(names, key.view(np.int64), h.view(np.int64), c.view(np.int64), doc, at.astype(np.int32), n.astype(np.int32), done)

    return run


def _columns(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def _meet(hot: np.ndarray):
    """Covered runs, and the first of each of several runs that share a hash (h set)."""
    names = ["doc", "at", "n", "h", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _columns(batches)
        if t is None:
            return
        h, c, doc, at, n, done = (t[x].to_numpy() for x in ("h", "c", "doc", "at", "n", "done"))
        out = np.flatnonzero(done)
        yield _emit(names, doc[out], at[out], n[out], pa.nulls(len(out), pa.int64()), np.zeros(len(out), bool))
        live = np.flatnonzero(~done)
        is_hot = np.isin(h[live], hot.view(np.int64))
        rows = live[np.union1d(shared_rows(h[live]), np.flatnonzero(is_hot)).astype(np.int64)]
        if not len(rows):
            return
        rows = rows[np.lexsort((c[rows], h[rows]))]
        gone = later(rows, starts_of(h[rows], c[rows]), doc, at)
        out = rows[gone]
        yield _emit(names, doc[out], at[out], n[out], pa.nulls(len(out), pa.int64()), np.zeros(len(out), bool))
        rest = rows[~gone]
        # Several different runs: the hash has rows of another c.
        new, fresh = starts_of(h[rest]), starts_of(h[rest], c[rest])
        group = np.cumsum(new) - 1
        several = (np.bincount(group[fresh], minlength=group[-1] + 1) > 1)[group]
        kind = np.isin(h[rest], hot.view(np.int64))
        keep = several | kind
        rest, kind = rest[keep], kind[keep]
        yield _emit(names, doc[rest], at[rest], n[rest], h[rest], kind)

    return run


_OPEN = "key long, doc long, at int, n int, bytes binary, done boolean"


def _open_runs(length: int):
    """Bytes of the runs that share a hash; the windows of hot ones, hashed one by one."""
    names = ["key", "doc", "at", "n", "bytes", "done"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            ids, (data, offs), lists = b.column(0).to_numpy(), text_bytes(b.column(1)), b.column(2)
            flat = lists.flatten()
            if not len(flat):
                continue
            row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
            h, at, n, hot = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("h", "at", "n", "hot"))
            at, n = at.astype(np.int64), n.astype(np.int64)
            fits = at + n + length - 1 <= (offs[1:] - offs[:-1])[row]
            cool = np.flatnonzero(fits & ~hot)
            if len(cool):
                begin = offs[row[cool]] + at[cool]
                size = n[cool] + length - 1
                bounds = np.concatenate(([0], np.cumsum(size)))
                body = data[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])]
                blob = pa.Array.from_buffers(pa.binary(), len(cool), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(body)])
                yield _emit(names, h[cool].astype(np.int64), ids[row[cool]], at[cool].astype(np.int32), n[cool].astype(np.int32), blob, np.zeros(len(cool), bool))
            warm = np.flatnonzero(fits & hot)
            if len(warm):
                source = np.repeat(warm, n[warm])
                spot = at[source] + np.arange(len(source)) - np.repeat(np.cumsum(n[warm]) - n[warm], n[warm])
                key = np.empty(len(source), U)
                for i, j, d, o in chunks(data, offs):
                    mine = np.flatnonzero((row[source] >= i) & (row[source] < j))
                    if len(mine):
                        sums, down = rolling(d, powers)
                        p = o[row[source[mine]] - i] + spot[mine]
                        key[mine] = mix((sums[p + length] - sums[p]) * down[p])
                doc = ids[row[source]]
                order = np.argsort(key, kind="stable")
                done = np.zeros(len(key), bool)
                done[order] = later(order, starts_of(key[order]), doc, spot)
                key[done] = mix(doc[done].view(U))
                yield _emit(names, key.view(np.int64), doc, spot.astype(np.int32), np.ones(len(key), np.int32), pa.nulls(len(key), pa.binary()), done)

    return run


def common_prefixes(suffixes: np.ndarray) -> np.ndarray:
    """How many bytes each row (of one width) has in common with the row before it; 0 for the first."""
    lcp = np.zeros(len(suffixes), np.int64)
    if len(suffixes) > 1:
        other = suffixes[1:] != suffixes[:-1]
        lcp[1:] = np.where(other.any(1), other.argmax(1), suffixes.shape[1])
    return lcp


def previous_factors(lcp: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, all in suffix order (Crochemore and Ilie, IPL 2008).

    ``lcp``: common prefix with the suffix before; ``place``: where each stands in the text, all different. Of all suffixes that stand
    earlier in the text, the nearest before and after it in suffix order (previous and next smaller places) share most with it.
    """
    factor = np.zeros(len(place), np.int64)
    # Suffixes whose next smaller place is still to come, their places rising; each with the prefix it shares with the one below.
    stack: list[tuple[int, int, int]] = []
    for i, (at, shared) in enumerate(zip([*place.tolist(), -1], [*lcp.tolist(), 0])):
        while stack and stack[-1][0] > at:
            _, j, below = stack.pop()
            factor[j] = max(below, shared)
            shared = min(below, shared)
        stack.append((at, i, shared))
    return factor


def factor_reaches(data: np.ndarray, starts: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """Which suffixes (bytes from ``starts``, standing at (doc, at)) have a longest previous factor of ``length`` or more.

    Suffixes are told apart by their first ``length`` bytes, so longer factors count as ``length``. Those whose first ``length`` bytes
    hash like no other's are left out of the order: none of them reaches it, nor gives another one such a factor.
    """
    reaches = np.zeros(len(starts), bool)
    sums, down = rolling(data, powers)
    rows = shared_rows(mix((sums[starts + length] - sums[starts]) * down[starts]))
    if len(rows):
        rows = rows[np.lexsort((at[rows], doc[rows]))]
        # A place that is given twice is one suffix.
        new = starts_of(doc[rows], at[rows])
        once, place = rows[new], np.cumsum(new) - 1
        suffix = np.ascontiguousarray(data[starts[once][:, None] + np.arange(length)])
        order = np.argsort(suffix.view(f"S{length}")[:, 0], kind="stable")
        factor = np.empty(len(once), np.int64)
        factor[order] = previous_factors(common_prefixes(suffix[order]), order)
        reaches[rows] = (factor >= length)[place]
    return reaches


def _factors(length: int):
    names = ["doc", "at", "n"]

    def spans(doc, at):
        doc, at, n = merged(doc, at, np.ones(len(at), np.int64))
        return _emit(names, doc, at.astype(np.int32), n.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, t = Powers(), _columns(batches)
        if t is None:
            return
        key, doc, at, n, done = (t[x].to_numpy() for x in ("key", "doc", "at", "n", "done"))
        at, n = at.astype(np.int64), n.astype(np.int64)
        cool = t["bytes"].is_valid().to_numpy()
        if done.any():
            yield spans(doc[done], at[done])
        warm = np.flatnonzero(~cool & ~done)
        if len(warm):
            warm = warm[np.argsort(key[warm], kind="stable")]
            gone = warm[later(warm, starts_of(key[warm]), doc, at)]
            if len(gone):
                yield spans(doc[gone], at[gone])
        rows = np.flatnonzero(cool)
        rows = rows[np.argsort(key[rows], kind="stable")]
        if not len(rows):
            return
        new = starts_of(key[rows])
        # Whole groups of one hash, about SORTED windows at a time.
        group_end = np.append(np.flatnonzero(new)[1:], len(rows))
        total = np.cumsum(n[rows])
        i = 0
        while i < len(rows):
            base = total[i - 1] if i else 0
            k = int(np.searchsorted(total[group_end - 1], base + SORTED, "right"))
            j = int(group_end[max(k - 1, int(np.searchsorted(group_end, i, "right")))])
            part = rows[i:j]
            data, offs = text_bytes(t["bytes"].take(pa.array(part)))
            data, offs = data[offs[0]:offs[-1]], offs - offs[0]
            per = n[part]
            owner = np.repeat(np.arange(len(part)), per)
            off = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
            where = at[part][owner] + off
            hit = factor_reaches(data, offs[owner] + off, doc[part][owner], where, length, powers)
            if hit.any():
                yield spans(doc[part][owner[hit]], where[hit])
            i = j

    return run


def _cut(length: int, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_bytes(b.column(1))
            lists = [(c.offsets.to_numpy(), c.values.field("at").to_numpy(zero_copy_only=False), c.values.field("n").to_numpy(zero_copy_only=False))
                     for c in (b.column(2), b.column(3))]
            rows, texts = [], []
            for i in range(b.num_rows):
                x = data[offs[i]:offs[i + 1]]
                edge = np.zeros(len(x) + 1, np.int32)
                for o, at, n in lists:
                    begin = at[o[i]:o[i + 1]].astype(np.int64)
                    np.add.at(edge, np.minimum(begin, len(x)), 1)
                    np.add.at(edge, np.minimum(begin + n[o[i]:o[i + 1]] + length - 1, len(x)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                kept = x[~gone].tobytes()
                rows.append((int(gone.sum()), len(turn) // 2, hashlib.sha256(kept).hexdigest(), turn.reshape(-1, 2).tolist()))
                texts.append(kept)
            removed, count, sha, spans = zip(*rows) if rows else ([], [], [], [])
            yield _emit(
                names, b.column(0), np.diff(offs), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))), *([pa.array(texts, pa.binary())] if with_text else []),
            )

    return run


def hot_hashes(rows: DataFrame, length: int, gram: int, sample: int = HOT_SAMPLE, least: int = HOT_LEAST) -> np.ndarray:
    """Hashes of very many runs, sorted; fewer than HOT_MOST of them, whatever the data."""
    some = rows.where(F.pmod(F.xxhash64("_doc"), F.lit(sample)) == 0)
    found = some.mapInArrow(_runs(np.zeros(0, U), length, gram), _RUNS)
    counts = write_through(found.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= least), "repeat-hot")
    total = counts.agg(F.sum("k")).first()[0] or 0
    got = counts.where(F.col("k") * HOT_MOST > F.lit(total)).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(got.view(U))


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True, hot_least: int = HOT_LEAST,
                hot_sample: int = HOT_SAMPLE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans ([start, end) pairs in bytes), kept (bytes).

    Null texts count as empty; texts below ``length`` bytes stay whole. Order is by doc_id, null ids last; rows that
    share an id, or have none, are documents of their own, ordered by a hash of the text. An empty table gives no rows;
    other columns are ignored. Strings never cross documents, and are judged on the input.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = numbered(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), "repeat-rows").select(
        F.col("__place").alias("_doc"), "text", "doc_id"
    )
    hot = hot_hashes(rows, length, gram, hot_sample, hot_least)
    runs = rows.mapInArrow(_runs(hot, length, gram), _RUNS).repartition(n, "key")
    met = runs.mapInArrow(_meet(hot), "doc long, at int, n int, h long, hot boolean")
    marks = met.groupBy("doc").agg(
        F.collect_list(F.when(F.col("h").isNotNull(), F.struct("h", "at", "n", "hot"))).alias("opened"),
        F.collect_list(F.when(F.col("h").isNull(), F.struct("at", "n"))).alias("covered"),
    )
    touched = write_through(rows.join(marks, rows["_doc"] == marks["doc"]).select("doc", "text", "opened", "covered", "doc_id"), "repeat-texts")
    factors = touched.where(F.size("opened") > 0).select("doc", "text", "opened").mapInArrow(_open_runs(length), _OPEN).repartition(n, "key")
    more = factors.mapInArrow(_factors(length), "doc long, at int, n int").groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("more"))
    joined = touched.select("doc", "text", "covered", "doc_id").join(more, "doc", "left").select(
        "doc_id", "text", "covered", F.coalesce("more", F.expr("cast(array() as array<struct<at: int, n: int>>)")).alias("more")
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>" + ", kept binary" * with_text
    cut = joined.mapInArrow(_cut(length, with_text), schema)
    whole = rows.select(
        F.col("_doc").alias("doc"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"),
        *([F.col("text").cast("binary").alias("kept")] if with_text else []),
    ).join(touched.select("doc").distinct(), "doc", "left_anti").drop("doc").withColumns({
        "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<array<bigint>>)"),
    })
    return cut.unionByName(whole)


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(documents(spark, sf_dir), with_text=False).drop("spans")
