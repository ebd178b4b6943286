"""Merkle manifest of a dataset: a nested-struct rollup whose proofs come out without joins.

Each row is a leaf. Leaves are ranked per language, and the rank is read as digits of base FAN. The
digits are grouped away one after the other, lowest first: a group of at most FAN nodes becomes a
parent, which keeps its children as an array of structs. After DEPTH digits a row is a block: the
root of at most FAN ** DEPTH leaves with the whole tree below it, so its size is bounded.

The roots of blocks are leaves of the next tier, which is built alike, until a language has one root;
the languages' roots form one more tree of the same kind. On the way down a tier's paths are put beside
the blocks they belong to (a union, and a look at the row before within a block of two rows), and
``transform`` and ``explode`` turn a block into its leaves with their siblings. No step joins, and no
row holds more than one block.

A node alone at its level (place 0, no sibling) is the root of its tree already and is not hashed
again; every other group is, also a group of one at the end of a level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.llm.common import documents, lower_ascii, running_start, write_through

#: Children of a node, and levels that one block holds.
FAN, DEPTH = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def encoded(value: Column) -> Column:
    """Byte count, colon, value; ``-`` if null. Two different rows never give the same bytes."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[encoded(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def tampered() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf, bad (the digest of the row as it was tampered with, null where it wasn't)."""
    return docs.select(
        "lang", "doc_id", leaf_digest(F.col("text")).alias("leaf"),
        F.when(tampered(), leaf_digest(lower_ascii(F.col("text")))).alias("bad"),
    )


def joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def nest(nodes: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """tree, block, node, kids: blocks of fan ** depth nodes (``nodes``: tree, rank, node, item).

    Rows are dealt by block once; that dealing serves all groupings. A hot tree has many blocks.
    """
    up = F.expr(f"rank div {fan}")
    rows = nodes.select(
        "tree", F.expr(f"rank div {fan ** depth}").alias("block"), up.alias("up"),
        F.struct((F.col("rank") % fan).cast("int").alias("place"), "node", "item").alias("kid"),
    ).repartition("tree", "block")
    for level in range(depth):
        groups = rows.groupBy("tree", "block", "up").agg(F.array_sort(F.collect_list("kid")).alias("kids"))
        alone = (F.col("up") == 0) & (F.size("kids") == 1)
        groups = groups.withColumn("node", F.when(alone, F.col("kids")[0]["node"]).otherwise(F.sha2(joined(F.col("kids.node")), 256)))
        if level < depth - 1:
            rows = groups.select(
                "tree", "block", F.expr(f"up div {fan}").alias("up"),
                F.struct((F.col("up") % fan).cast("int").alias("place"), "node", "kids").alias("kid"),
            )
    return groups.select("tree", "block", "node", "kids")


def _spread(kids: Column, index: Column, path: Column, fan: int, depth: int) -> Column:
    """item, node, path of all leaves below ``kids``, the children of the node with number ``index`` on its level."""
    alone = (index == 0) & (F.size(kids) == 1)

    def one(kid: Column, i: Column) -> Column:
        names = kids["node"]
        step = F.struct(
            joined(F.slice(names, F.lit(1), i)).alias("left"), joined(F.slice(names, i + 2, F.lit(fan))).alias("right")
        )
        way = F.when(alone, path).otherwise(F.concat(F.array(step), path))
        if depth == 1:
            return F.struct(kid["item"].alias("item"), kid["node"].alias("node"), way.alias("path"))
        return _spread(kid["kids"], index * fan + kid["place"], way, fan, depth - 1)

    out = F.transform(kids, one)
    return out if depth == 1 else F.flatten(out)


def emit(blocks: DataFrame, heads: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """tree, item, node, path, head of every node below ``blocks``; ``heads``: tree, block, path, head.

    Each block meets its head as the row before it among the two rows of (tree, block).
    """
    kids = blocks.schema["kids"].dataType.simpleString()
    path, head = (heads.schema[c].dataType.simpleString() for c in ("path", "head"))
    both = blocks.select(
        "tree", "block", F.lit(1).alias("side"), "kids", F.lit(None).cast(path).alias("path"), F.lit(None).cast(head).alias("head")
    ).unionByName(heads.select("tree", "block", F.lit(0).alias("side"), F.lit(None).cast(kids).alias("kids"), "path", "head"))
    pair = W.partitionBy("tree", "block").orderBy("side")
    met = both.select(
        "tree", "block", "side", "kids", F.lag("path").over(pair).alias("path"), F.lag("head").over(pair).alias("head")
    ).where("side = 1")
    out = met.select("tree", "head", F.explode(_spread(F.col("kids"), F.col("block"), F.col("path"), fan, depth)).alias("leaf"))
    return out.select("tree", "leaf.item", "leaf.node", "leaf.path", "head")


def prove(nodes: DataFrame, top: Callable[[DataFrame], DataFrame], fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """tree, item, node, path (siblings left and right of the way up, lowest first), head.

    ``nodes``: tree, rank, node, item. ``top`` takes the roots (tree, node) and gives what lies above them:
    tree, block (0), path, head. A tier holds a ``fan ** depth``-th of the rows of the one below.
    """
    blocks = write_through(nest(nodes, fan, depth), "merkle-blocks")
    if blocks.where("block > 0").isEmpty():
        return emit(blocks, top(blocks.select("tree", "node")), fan, depth)
    above = blocks.select("tree", F.col("block").alias("rank"), "node", F.struct(F.col("block").alias("rank")).alias("item"))
    heads = prove(above, top, fan, depth).select("tree", F.col("item.rank").alias("block"), "path", "head")
    return emit(blocks, heads, fan, depth)


def _above_languages(fan: int, depth: int) -> Callable[[DataFrame], DataFrame]:
    def root(roots: DataFrame) -> DataFrame:
        return roots.select("tree", F.lit(0).cast("long").alias("block"), F.expr(NO_PATH).alias("path"), F.struct(F.col("node").alias("root")).alias("head"))

    def top(subroots: DataFrame) -> DataFrame:
        named = subroots.withColumns({"named": F.col("tree").isNotNull().cast("int"), "one": F.lit(1)})
        ranked = running_start(named, ["named", "tree"], "one", out="rank", label="merkle-languages")
        nodes = ranked.select(
            F.lit(0).alias("tree"), "rank", "node", F.struct(F.col("tree").alias("lang"), F.col("node").alias("subroot")).alias("item"))
        return prove(nodes, root, fan, depth).select(
            F.col("item.lang").alias("tree"), F.lit(0).cast("long").alias("block"), "path",
            F.struct("item.subroot", "head.root").alias("head"),
        )

    return top


def manifest(docs: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, leaf, bad, subroot, root, path.

    ``path`` lists, from the leaf to the root, the siblings (digests in hex) left and right of the way. Nulls
    in any column are part of the leaf; rows without a language form a tree of their own, which comes first. Rows that
    share an id, null ids last, stand by their leaf; equal rows take neighbouring places. An empty table gives no
    rows; other columns are ignored.
    """
    # Written first: dealing them by range looks at the rows twice, and the texts are to be hashed once.
    found = write_through(leaves(docs).withColumn("one", F.lit(1)), "merkle-digests")
    ranked = running_start(found, ["doc_id", "leaf"], "one", "lang", out="rank", label="merkle-leaves")
    nodes = ranked.select(F.col("lang").alias("tree"), "rank", F.col("leaf").alias("node"), F.struct("doc_id", "bad").alias("item"))
    return prove(nodes, _above_languages(fan, depth), fan, depth).select(
        "item.doc_id", F.col("tree").alias("lang"), F.col("node").alias("leaf"), "item.bad", "head.subroot", "head.root", "path"
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def verify(proofs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf, if there is one), verified."""
    siblings = joined(F.flatten(F.transform("path", lambda p: F.array(p["left"], p["right"]))))
    folded = proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.coalesce("bad", "leaf"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(manifest(documents(spark, sf_dir)))


def _field(c: str, value: str | None = None) -> str:
    v = value or f"cast({c} as varchar)"
    return f"case when {c} is null then '-' else strlen({v}) || ':' || {v} end"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = " || ".join(_field(c) for c in FIELDS)
_BAD = " || ".join(_field(c, _LOWERED if c == "text" else None) for c in FIELDS)
_CRC = (
    "xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)), "
    "lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x // 2, 3988292384 * (x % 2)), xor(a, b)), 4294967295), 4294967295)"
)
SQL = f"""
with recursive leaves as (
  select lang, doc_id, sha256({_LEAF}) as leaf, case when {_CRC} % 3 = 0 then sha256({_BAD}) end as bad from documents
), ranked as (
  select *, row_number() over (partition by lang order by doc_id nulls last, leaf) - 1 as r from leaves
), n as (
  select lang, 0 as lvl, r as idx, leaf as node from ranked
  union all
  select lang, lvl + 1, idx // 8, sha256(string_agg(node, '' order by idx))
  from (select *, count(*) over (partition by lang, lvl) as c from n) where c > 1 group by lang, lvl, idx // 8
), heights as (select lang, max(lvl) as top from n group by lang
), subroots as (
  select n.lang, n.node, row_number() over (order by n.lang is not null, encode(n.lang)) - 1 as r
  from n join heights h on n.lang is not distinct from h.lang and n.lvl = h.top
), m as (
  select 0 as lvl, r as idx, node from subroots
  union all
  select lvl + 1, idx // 8, sha256(string_agg(node, '' order by idx))
  from (select *, count(*) over (partition by lvl) as c from m) where c > 1 group by lvl, idx // 8
), top as (select max_by(node, lvl) as root, max(lvl) as top from m
), low as (
  select lang, lvl, idx,
    coalesce(string_agg(node, '') over (partition by lang, lvl, idx // 8 order by idx rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(node, '') over (partition by lang, lvl, idx // 8 order by idx rows between 1 following and unbounded following), '') as g
  from n
), high as (
  select lvl, idx,
    coalesce(string_agg(node, '') over (partition by lvl, idx // 8 order by idx rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(node, '') over (partition by lvl, idx // 8 order by idx rows between 1 following and unbounded following), '') as g
  from m
), steps as (
  select k.lang, k.r, low.lvl, low.l, low.g
  from ranked k join heights h on k.lang is not distinct from h.lang
  join low on low.lang is not distinct from k.lang and low.lvl < h.top and low.idx = k.r // cast(pow(8, low.lvl) as bigint)
  union all
  select k.lang, k.r, 1000 + high.lvl, high.l, high.g
  from ranked k join subroots s on k.lang is not distinct from s.lang cross join top t
  join high on high.lvl < t.top and high.idx = s.r // cast(pow(8, high.lvl) as bigint)
), ways as (
  select lang, r, string_agg(l || g, '' order by lvl) as siblings, list(struct_pack(l := l, g := g) order by lvl) as path from steps group by lang, r
)
select k.doc_id, k.leaf, s.node as subroot, t.root, sha256(coalesce(w.siblings, '')) as proof_sha256,
  case when w.path is null then coalesce(k.bad, k.leaf) else
  list_reduce(list_prepend(struct_pack(l := '', g := '', v := coalesce(k.bad, k.leaf)), list_transform(w.path, lambda p: struct_pack(l := p.l, g := p.g, v := ''))),
    lambda a, p: struct_pack(l := '', g := '', v := sha256(p.l || a.v || p.g))).v end as folded_root,
  folded_root = t.root as verified
from ranked k join subroots s on k.lang is not distinct from s.lang cross join top t
left join ways w on w.lang is not distinct from k.lang and w.r = k.r
"""
