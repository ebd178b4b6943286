"""Substring search of report text by a stored trigram index.

Rows are kept in blocks (a hash of the record id, one folder each), with postings (trigram, field, record) in a folder per block,
sorted by trigram. Rows are dealt by block before postings are made of them, so postings, tens per row, are never
shuffled. A record stands there as a 32-bit hash: two records of a block that share one are a candidate too many. A search takes the rarest trigrams of its text by stored counts, intersects their postings within a field, reads the
blocks that are left and verifies each candidate by ``contains``. Texts shorter than a trigram are looked for in all rows.

A batch adds the postings of new and changed rows only. Postings of older texts stay; they can only name a
candidate too many, since a record's latest row is what is verified. A version counts once its commit is written, last.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.views import SEARCH_FIELDS, search

GRAM = 3
BLOCKS = 256
#: Postings of this many grams are intersected; more seldom shorten the list.
RAREST = 3


def _grams(field: str) -> Column:
    text = F.lower(F.coalesce(F.col(field), F.lit("")))
    at = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM)))))


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, blocks: int = BLOCKS):
        self.spark, self.root, self.blocks = spark, root.rstrip("/"), blocks

    def _versions(self) -> list[int]:
        try:
            return sorted(r.version for r in self.spark.read.parquet(f"{self.root}/commits").select("version").collect())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _read(self, name: str) -> DataFrame:
        paths = [f"{self.root}/{name}/version={v}" for v in self._versions()]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("record_id"), F.lit(self.blocks)).cast("int")

    def update(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Index new and changed rows (``record_id`` unique, searched fields); ``gone``: record ids that left the report."""
        version = len(self._versions())
        at = f"version={version}"
        kept = rows.select("record_id", *SEARCH_FIELDS)
        if gone is not None:
            kept = kept.unionByName(gone.select("record_id", *[F.lit(None).cast("string").alias(f) for f in SEARCH_FIELDS]))
        deal = lambda df: df.withColumn("block", self._block()).repartition(self.blocks, "block")
        deal(kept).write.mode("overwrite").option(
            "partitionOverwriteMode", "static").partitionBy("block").parquet(f"{self.root}/rows/{at}")
        fields = F.array(*[F.struct(F.lit(n).alias("field"), _grams(f).alias("grams")) for n, f in enumerate(SEARCH_FIELDS)])
        postings = deal(rows.select("record_id", *SEARCH_FIELDS)).select("block", F.hash("record_id").alias("key"), F.inline(fields)).select(
            F.explode("grams").alias("gram"), "field", "key", "block")
        postings.sortWithinPartitions("block", "gram", "key").write.mode("overwrite").option(
            "partitionOverwriteMode", "static").partitionBy("block").parquet(f"{self.root}/postings/{at}")
        stored = self.spark.read.schema(postings.schema).parquet(f"{self.root}/postings/{at}")
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        stored.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(n, "gram").sortWithinPartitions("gram").write.mode(
            "overwrite").parquet(f"{self.root}/counts/{at}")
        done = self.spark.createDataFrame([(self.blocks,)], "blocks int").coalesce(1)
        done.write.mode("overwrite").parquet(f"{self.root}/commits/{at}")
        return version

    def rarest(self, text: str) -> list[tuple[str, int]] | None:
        """The grams of ``text`` with the fewest postings and their number, rarest first; None if it is too short."""
        low = text.lower()
        grams = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not grams:
            return None
        counts = self._read("counts").where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n"))
        found = {r.gram: r.n for r in counts.collect()}  # at most as many as the text has grams
        return sorted(((g, found.get(g, 0)) for g in grams), key=lambda x: (x[1], x[0]))[:RAREST]

    def candidates(self, grams: list[str]) -> DataFrame:
        """(block, key) of the records that hold all the grams in one field."""
        postings = self._read("postings").drop("version")
        out = None
        for g in grams:
            one = postings.where(F.col("gram") == g).select("field", "block", "key")
            out = one if out is None else out.join(one, ["field", "block", "key"], "left_semi")
        return out.select("block", "key").distinct()

    def _latest(self, rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*SEARCH_FIELDS), "version").alias("row")
        return rows.groupBy("record_id").agg(last).select("record_id", "row.*")

    def to_verify(self, text: str) -> DataFrame:
        """Latest rows that may hold ``text``; the others can't."""
        rows, grams = self._read("rows"), self.rarest(text)
        if grams is None:
            return self._latest(rows)
        if grams[0][1] == 0:
            return self._latest(rows.limit(0))
        found = self.candidates([g for g, _ in grams])
        blocks = [r.block for r in found.select("block").distinct().collect()]  # at most BLOCKS
        near = rows.where(F.col("block").isin(blocks)).withColumn("key", F.hash("record_id"))
        return self._latest(near.join(found, ["block", "key"], "left_semi"))

    def search(self, text: str) -> DataFrame:
        """``record_id`` and the searched fields of the rows that ``views.search`` finds; blank text finds all rows."""
        if not self._versions():
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in ("record_id", *SEARCH_FIELDS)))
        present = F.coalesce(*[F.col(f) for f in SEARCH_FIELDS]).isNotNull()
        if not text.strip():
            return self._latest(self._read("rows")).where(present)
        return self.to_verify(text).where(search(text))
