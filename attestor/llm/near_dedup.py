"""Near duplicates: MinHash bands, sequential Bayesian pruning, exact verification.

1. Every document gets its set of distinct word shingles, a 128-bit key of that set, and BANDS *
   ROWS + EXTRA MinHash values of which 8 bits each are kept. Equal sets form a class; its smallest doc_id
   stands for it.
2. A band's bytes are its bucket. Each member of a bucket is compared with the bucket's smallest
   member only, so a bucket of n members gives n - 1 pairs, however large it is.
3. Pairs are compared in batches of signature bytes. After each batch the posterior probability
   that the similarity reaches the threshold is known from the matches so far (uniform prior,
   corrected for chance matches of 8 bits); below MISS the pair goes.
4. Survivors are verified on the full shingle sets of the whole texts.
5. Verified links give components. Where a bucket still holds several components, its members are
   compared in blocks: a pair of different components goes unless its shared shingles can
   reach the threshold given what either shares with its anchor, the smallest document in any of
   its buckets, if both have the same one (a member that step 3 pruned there shares less than
   PIVOT_BAR allows); then steps 3 and 4 decide. Pairs inside one
   component can't change the result, so no pair of the bucket that matters is left out.

A pair at the threshold itself shares no band with probability (1 - 0.8^ROWS)^BANDS = 5e-7 for
the default numbers, and is pruned with a probability of the order of MISS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, numbered, ship, write_through
from attestor.llm.components import components
from attestor.llm.textops import chunks, distinct_runs, mix, Powers, shingles, text_bytes, U, word_hashes

ship(__name__)

BANDS, ROWS = 48, 6
#: Further MinHash values, which only sharpen the pruning.
EXTRA = 224
BATCH = 32
MISS = 1e-6
THRESHOLD = 80
SHINGLE = 5
#: Pairs with a bucket's smallest member are measured exactly down to this similarity (percent).
PIVOT_BAR = 50
#: Members of a bucket that are compared with each other at once.
BLOCK = 1_000
_SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, sig binary"


def _factors(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def document_shingles(data: np.ndarray, offs: np.ndarray, powers: Powers, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their numbers."""
    return distinct_runs(*shingles(*word_hashes(data, offs, powers), shingle))


def _sign(shingle: int, hashes: int):
    a, b = _factors(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            for i, j, d, o in chunks(data, offs):
                values, counts = document_shingles(d, o, powers, shingle)
                some = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[some]
                sig = np.zeros((j - i, hashes), np.uint8)
                k1, k2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                if len(some):
                    x = (values >> U(32)).astype(np.uint32)
                    for h in range(hashes):
                        low = np.minimum.reduceat(x * a[h] + b[h], starts)
                        sig[some, h] = (low ^ (low >> np.uint32(8)) ^ (low >> np.uint32(16)) ^ (low >> np.uint32(24))).astype(np.uint8)
                    k1[some] = np.add.reduceat(mix(values), starts).view(np.int64)
                    k2[some] = np.add.reduceat(mix(values ^ U(0x5851F42D4C957F2D)), starts).view(np.int64)
                size = pa.array(np.arange(j - i + 1, dtype=np.int32) * hashes).buffers()[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(counts), pa.array(k1), pa.array(k2),
                     pa.Array.from_buffers(pa.binary(), j - i, [None, size, pa.py_buffer(sig.tobytes())])],
                    ["doc_id", "n_shingles", "k1", "k2", "sig"],
                )

    return run


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches among n signature bytes for which P(similarity >= threshold) is at least ``miss``.

    A byte matches with probability q = s + (1 - s) / 256 at similarity s; s has a uniform prior.
    """
    s = np.linspace(0, 1, 4001)[1:-1]
    q = s + (1 - s) / 256
    lq, lr = np.log(q), np.log(1 - q)
    for m in range(n + 1):
        log = m * lq + (n - m) * lr
        p = np.exp(log - log.max())
        if p[s >= threshold].sum() >= miss * p.sum():
            return m
    return n


class Pruning:
    """Sequential comparison of signatures against a threshold in percent."""

    def __init__(self, threshold: int, hashes: int, batch_size: int = BATCH, miss: float = MISS):
        ends = [(at, min(at + batch_size, hashes)) for at in range(0, hashes, batch_size)]
        self.steps = [(at, end, least_matches(end, threshold / 100, miss)) for at, end in ends]

    def survivors(self, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of the pairs (x[i], y[j]) that no batch prunes."""
        live, hits = np.arange(len(i)), np.zeros(len(i), np.int64)
        for at, end, need in self.steps:
            hits[live] += (x[i[live], at:end] == y[j[live], at:end]).sum(1)
            live = live[hits[live] >= need]
        return live


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    data, offs = text_bytes(column)
    return data[offs[0]:offs[-1]].reshape(-1, hashes)


def _prune(pruning: Pruning, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                all_rows = np.arange(b.num_rows)
                live = pruning.survivors(_matrix(b.column(2), hashes), _matrix(b.column(3), hashes), all_rows, all_rows)
                yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(live)) for i in (0, 1)], ["a", "b"])

    return run


def _overlaps(shingle: int):
    """Exact sizes of the shingle sets of both texts and of what they share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            (dx, ox), (dy, oy) = text_bytes(b.column(2)), text_bytes(b.column(3))
            out = np.zeros((b.num_rows, 3), np.int64)
            for i in range(b.num_rows):
                x, y = (document_shingles(d[o[i]:o[i + 1]], np.array([0, o[i + 1] - o[i]]), powers, shingle)[0] for d, o in ((dx, ox), (dy, oy)))
                out[i] = len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(c)) for c in out.T)], ["a", "b", "na", "nb", "both"]
            )

    return run


def _cross(pruning: Pruning, threshold: int, hashes: int, band_rows: int):
    """Pairs of one block of a bucket, of different components, that may reach the threshold.

    A pair is given in the first of the buckets that it shares only. If one of the two is the
    smallest member there, the pair has been measured.
    """
    def pairs(t: pa.Table) -> np.ndarray:
        c, n, anchor, share, side, pivot = (t[k].to_numpy() for k in ("c", "n", "anchor", "share", "side", "pivot_row"))
        sig, band = _matrix(t["sig"], hashes), t["band"][0].as_py()
        found = []
        for i in range(len(c)):
            j = np.arange(i + 1, len(c))
            # Of two blocks, only pairs across them: either alone is a group of its own.
            j = j[(c[j] != c[i]) & ~pivot[j] & ~pivot[i] & ((side[j] != side[i]) | (t["lo"][0].as_py() == t["hi"][0].as_py()))]
            most = np.where(
                anchor[j] == anchor[i], np.minimum(share[i], share[j]) + np.minimum(n[i] - share[i], n[j] - share[j]), np.minimum(n[i], n[j])
            )
            j = j[most * (100 + threshold) >= threshold * (n[i] + n[j])]
            if len(j) and band:
                before = (sig[j, :band * band_rows] == sig[i, :band * band_rows]).reshape(len(j), band, band_rows)
                j = j[~before.all(2).any(1)]
            if len(j):
                j = j[pruning.survivors(sig, sig, np.full(len(j), i), j)]
                found.append(np.stack([np.full(len(j), i), j]))
        return np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            done, rest = split_last(t)
            yield from groups(done)
        if rest is not None:
            yield from groups(rest)

    def split_last(t: pa.Table):
        """Whole groups, and the last one, which may go on in the next batch."""
        if not t.num_rows:
            return t, None
        k, lo, hi = (t[x].to_numpy() for x in ("key", "lo", "hi"))
        last = np.flatnonzero((k != k[-1]) | (lo != lo[-1]) | (hi != hi[-1]))
        at = int(last[-1]) + 1 if len(last) else 0
        return t.slice(0, at), t.slice(at)

    def groups(t: pa.Table):
        if not t.num_rows:
            return
        t = t.combine_chunks()
        k, lo, hi, ids = (t[x].to_numpy() for x in ("key", "lo", "hi", "id"))
        new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
        out = []
        for s, e in zip(new, np.append(new[1:], len(k))):
            if e - s > 1:
                i, j = pairs(t.slice(s, e - s))
                out.append(np.stack([np.minimum(ids[s + i], ids[s + j]), np.maximum(ids[s + i], ids[s + j])]))
        if out:
            a, b = np.unique(np.concatenate(out, 1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def signed(docs: DataFrame, shingle: int = SHINGLE, hashes: int = BANDS * ROWS) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign(shingle, hashes), _SIGNED)


def _buckets(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    key = F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * rows + 1, F.lit(rows)))
    ))
    return reps.select(F.col("doc_id").alias("id"), key.alias("band", "key"))


def _measured(live: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, na, nb, both): exact sizes, from the whole texts."""
    text = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}")).hint("merge")
    return live.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(
        _overlaps(shingle), "a long, b long, na long, nb long, both long"
    )


def _reaches(threshold: int) -> Column:
    return (F.col("both") > 0) & (F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * threshold)


def near_classes(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
                 miss: float = MISS, block: int = BLOCK, extra: int = EXTRA) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed documents, classes k1 k2 rep of equal sets, component of each linked class: node, component)."""
    hashes = bands * rows + extra
    all_signed = write_through(signed(docs, shingle, hashes), "near-signed")
    classes = write_through(
        all_signed.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "near-classes"
    )
    reps = write_through(
        all_signed.join(classes.where("rep is not null").hint("merge"), ["k1", "k2"]).where("doc_id = rep").select(
            "doc_id", F.col("n_shingles").alias("n"), "sig"
        ).dropDuplicates(["doc_id"]), "near-reps",
    )
    buckets = _buckets(reps, bands, rows)
    shared = buckets.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_last")).where("pivot != _last").drop("_last")
    members = write_through(buckets.join(shared.hint("merge"), "key"), "near-members")

    bar = min(PIVOT_BAR, threshold)
    pairs = members.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda k: reps.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")).hint("merge")
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(
        (F.col("na") * 100 >= F.col("nb") * bar) & (F.col("nb") * 100 >= F.col("na") * bar)
    )
    live = write_through(
        sized.select("a", "b", "sa", "sb").mapInArrow(_prune(Pruning(bar, hashes, BATCH, miss), hashes), "a long, b long"), "near-survivors"
    )
    # Later steps compare members of buckets only, so all texts that may be read again are these.
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    texts = write_through(
        docs.select(F.col("doc_id").cast("long"), "text").join(wanted.hint("merge"), "doc_id").dropDuplicates(["doc_id"]), "near-texts"
    )
    measured = write_through(_measured(live, texts, shingle), "near-measured")
    known = write_through(components(measured.where(_reaches(threshold)).select("a", "b")), "near-components")

    # Members of one bucket but of different components.
    placed = members.join(known.withColumnRenamed("node", "id").hint("merge"), "id", "left").select(
        "key", "band", "pivot", "id", F.coalesce("component", "id").alias("c")
    )
    mixed = placed.groupBy("key").agg(F.min("c").alias("_l"), F.max("c").alias("_h"), F.count("*").alias("_k")).where(
        "_l != _h and _k > 2"
    ).select("key", F.expr(f"cast(ceil(_k / {block}D) as int)").alias("_blocks"))
    anchors = members.groupBy("id").agg(F.min("pivot").alias("anchor"))
    share = measured.select(F.col("a").alias("anchor"), F.col("b").alias("id"), "both")
    size = lambda k, n: reps.select(F.col("doc_id").alias(k), F.col("n").alias(n)).hint("merge")
    # One row per member of an open bucket, then what is known of each member.
    opened = placed.join(mixed.hint("merge"), "key")
    about = anchors.join(share.hint("merge"), ["anchor", "id"], "left").join(size("anchor", "np"), "anchor").join(
        reps.withColumnRenamed("doc_id", "id").hint("merge"), "id"
    )
    opened = opened.join(about.hint("merge"), "id")
    # Where the anchor was pruned, what is shared with it stays below the bar.
    below = F.floor((F.col("n") + F.col("np")) * bar / (100 + bar))
    rows_ = opened.select(
        "key", "band", "id", "c", "n", "anchor", "sig", (F.col("id") == F.col("pivot")).alias("pivot_row"), "_blocks",
        F.when(F.col("id") == F.col("anchor"), F.col("n")).otherwise(F.coalesce("both", F.least(below, "n"))).cast("long").alias("share"),
        F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int").alias("side"),
    ).withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)"))).select(
        "key", F.least("side", "_other").alias("lo"), F.greatest("side", "_other").alias("hi"), "band", "id", "c", "n", "anchor", "share", "side", "pivot_row", "sig"
    )
    dealt = rows_.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "key", "lo", "hi")
    cross = write_through(
        dealt.sortWithinPartitions("key", "lo", "hi").mapInArrow(_cross(Pruning(threshold, hashes, BATCH, miss), threshold, hashes, rows), "a long, b long"),
        "near-cross",
    ).distinct()
    more = _measured(cross, texts, shingle).where(_reaches(threshold)).select("a", "b")
    links = more.union(known.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a != b"))
    return all_signed, classes, components(links)


def near_dedup(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
               miss: float = MISS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * shared shingles >= threshold * shingles of either; components
    carry the smallest doc_id they reach. Null and empty texts, and texts of blanks only, have no shingles and are linked with
    nothing. Rows that repeat a doc_id get the same answer if their texts are equal; a row with a null id joins its
    class but never stands for it, and stays alone (null component, kept) if its class has no id. An empty table gives no
    rows; other columns are ignored.
    """
    rows_, classes, linked = near_classes(docs, threshold, shingle, bands, rows, miss)
    slim = rows_.select("doc_id", "n_shingles", "k1", "k2")
    placed = classes.join(linked.hint("merge"), classes["rep"] == linked["node"], "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    some = slim.where("n_shingles > 0").join(placed, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    none = slim.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    same: Column = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return some.unionByName(none).withColumn("kept", same)


def drop_near_duplicates(docs: DataFrame, null_ids: bool = False, **settings) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id, null ids last.

    Rows that share an id are documents of their own; of those without shingles, one per id stays. Rows with
    a null doc_id stay; with ``null_ids`` they are compared like all others, and only those without shingles stay anyway.
    """
    rows = numbered(docs, "near-rows")
    some = rows if null_ids else rows.where("doc_id is not null")
    near = near_dedup(some.select(F.col("__place").alias("doc_id"), "text"), **settings)
    bare = near.where("n_shingles = 0").select(F.col("doc_id").alias("__place")).join(rows.select("__place", "doc_id"), "__place")
    first = bare.where("doc_id is not null").groupBy("doc_id").agg(F.min("__place").alias("__first"))
    again = bare.join(first, "doc_id").where("__place > __first").select("__place")
    kept = near.where("kept").select(F.col("doc_id").alias("__place")).join(again, "__place", "left_anti")
    found = rows.join(kept.hint("merge"), "__place").select(docs.columns)
    return found if null_ids else found.unionByName(docs.where("doc_id is null"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), shingle=4)
