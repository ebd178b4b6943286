"""Exact duplicates: skew-safe combining with full content compared at every stage.

1. Each map task merges the equal texts it reads (the partial half of the aggregation).
2. Texts are merged per (digest, salt, text). The salt spreads a text that a third of all rows
   may share over many tasks, and stays 0 for digests that are not hot.
3. The winners of the salts are merged per (digest, text).

The text itself is a grouping key in stages 1 to 3, so equal digests of different texts never
merge. Rows then look up their group by digest; rows of a digest that has more than one text (a
collision) look it up by digest and text.

Hot digests are those with more than 1/HOT_SHARE of all rows: there are fewer than HOT_SHARE of
them, whatever the data, so their list may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, lower_ascii, text_of, write_through

HOT_SHARE = 2_000
SALTS = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, norm (A-Z lower-cased; null is empty), digest."""
    norm = lower_ascii(text_of())
    return docs.select("doc_id", norm.alias("norm"), digest(norm).alias("digest"))


def hot_digests(rows: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """Digests that hold more than 1/share of the rows."""
    counts = write_through(rows.groupBy("digest").agg(F.count("*").alias("n")), "digest-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where((F.col("n") * share > F.lit(total)) & (F.col("n") > 1)).select("digest", F.lit(True).alias("_hot"))


def duplicate_groups(rows: DataFrame, salts: int = SALTS, share: int = HOT_SHARE) -> DataFrame:
    """One row per distinct text of ``normalised`` rows: digest, norm, keep_id (largest doc_id), group_size."""
    salted = rows.join(F.broadcast(hot_digests(rows.select("digest"), share)), "digest", "left").withColumn(
        "salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    )
    winners = salted.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("w"), F.count("*").alias("n"))
    return winners.groupBy("digest", "norm").agg(F.max("w").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = SALTS, share: int = HOT_SHARE,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal. Rows that repeat a doc_id count as rows of their own; if the
    id stays, each of them is ``kept``. A group whose ids are all null has a null keep_id, and its
    rows are kept. An empty table gives no rows; other columns are ignored.
    """
    rows = normalised(docs, digest)
    groups = duplicate_groups(rows, salts, share)
    narrow = write_through(groups.select("digest", "keep_id", "group_size"), "text-groups")
    collided = narrow.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    sha = F.lower(F.hex("digest")) if digest is sha256 else F.sha2("norm", 256)
    slim = rows.select("doc_id", "digest", sha.alias("text_sha256"))
    if collided.isEmpty():
        found = slim.join(narrow, "digest")
    else:
        alone = slim.join(collided, "digest", "left_anti").join(narrow, "digest")
        texts = rows.join(collided, "digest", "left_semi").withColumn("text_sha256", sha)
        found = alone.unionByName(texts.join(groups, ["digest", "norm"]).drop("norm"))
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents
), g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
select n.doc_id, g.keep_id, g.group_size, n.doc_id is not distinct from g.keep_id as kept, sha256(n.t) as text_sha256
from n join g on n.t = g.t
"""
