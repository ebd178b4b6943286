"""The Merkle manifest against a plain version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from attestor.llm import merkle
from tests.llm import plain
from tests.llm.conftest import SCHEMA, words

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    parts = [text if f == "text" else row[f] for f in FIELDS]
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def tree(nodes, fan):
    """(root, path of each node)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // fan * fan
            paths[k].append(("".join(level[first:i]), "".join(level[i + 1:first + fan])))
            at[k] = i // fan
        level = [sha("".join(level[i:i + fan])) for i in range(0, len(level), fan)]
    return level[0], paths


def plain_manifest(rows, fan):
    """Sorted tuples of the query's columns, tampered rows folded from their changed leaf."""
    last = 1 << 70
    leaves = [(r, leaf(r, r["text"])) for r in rows]
    trees = {}
    for r, h in sorted(leaves, key=lambda x: (last if x[0]["doc_id"] is None else x[0]["doc_id"], x[1])):
        trees.setdefault(r["lang"], []).append((r, h))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {g: tree([h for _, h in trees[g]], fan) for g in langs}
    root, tops = tree([subs[g][0] for g in langs], fan) if langs else (None, [])
    out = []
    for g, top in zip(langs, tops):
        for (r, h), way in zip(trees[g], subs[g][1]):
            way = way + top
            node = h
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                node = leaf(r, None if r["text"] is None else plain.lower(r["text"]))
            for a, b in way:
                node = sha(a + node + b)
            out.append((r["doc_id"], h, subs[g][0], root, sha("".join(a + b for a, b in way)), node, node == root))
    return sorted(out, key=repr)


def check(docs, fan=8, depth=3):
    out = merkle.verify(merkle.manifest(docs, fan, depth))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == plain_manifest([r.asDict() for r in docs.select(*FIELDS).collect()], fan)
    return got


def test_edges(edge, none):
    got = check(edge)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    assert check(none) == []


@pytest.mark.parametrize("fan, depth", [(2, 1), (2, 2), (3, 2), (8, 3)])
def test_tiers(spark, fan, depth):
    """Blocks of two to 512 nodes, so that up to seven tiers lie above a hot language; languages of 1 to FAN + 1 rows."""
    rng = random.Random(7)
    sizes = {"en": 70, None: 9, "de": 8, "fr": 1, "é": 2, "z": 65}
    rows = [(g, words(rng, rng.randint(0, 9)).title() if i % 5 else None) for g, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i * 3 - 50, t, g, rng.choice(["a", None]), rng.choice([1, None])) for i, (g, t) in enumerate(rows)], SCHEMA)
    check(docs.repartition(5), fan, depth)


def test_a_single_row(frame):
    got = check(frame([(1, "Text")], 1))
    assert got[0][4] == sha("") and got[0][1] == got[0][2] == got[0][3]


def test_no_join(frame):
    docs = frame([(i, f"text {i}") for i in range(40)])
    nodes = docs.select(F.lit("x").alias("tree"), F.col("doc_id").alias("rank"), F.sha2("text", 256).alias("node"), F.struct("doc_id").alias("item"))
    out = merkle.prove(nodes, lambda r: r.select("tree", F.lit(0).cast("long").alias("block"), F.expr(merkle.NO_PATH).alias("path"),
                                                  F.struct(F.col("node").alias("root")).alias("head")), fan=2, depth=2)
    assert "Join" not in out._jdf.queryExecution().toString()
    assert out.where(merkle.fold(F.col("node"), F.col("path")) != F.col("head.root")).count() == 0
