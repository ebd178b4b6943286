"""The employee index as stored tables that follow the employee list by its changes.

``fuzzy.candidate_pairs`` cuts every employee name anew. Here the piece keys are tables that only grow by version:

- ``names``: change rows (name_key, holders, sot, live). The latest row of a name tells whether it counts: a name that left
  has a tombstone, and its pieces stay where they are. If it comes back, nothing is cut again.
- ``pieces``: the block keys of every name ever seen, cut in the version that saw it first.
- ``counts``: how many names each version added to a block. Sums over versions say which blocks are crowded (``hot``).
- ``triples``: the finer keys of every name that holds a crowded block, cut when the block becomes crowded.

A search leaves crowded blocks out on its own side, finds their names by triples, and looks up who is alive only for
verified pairs. So its work grows with the probes and what they meet. A crowded block stays crowded when names leave: either
set of keys finds every similar name, so this decides the plan and never the result.

A version counts once its commit is written, last; an interrupted update is repeated and overwrites its tables.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.fuzzy import (
    FuzzyRules, _full_width, _indexed_blocks, _indexed_triples, _probe_blocks, _probe_triples, meet, near_crowded, verified,
)
from attestor.operators.identity import IdentityIndex, build_index

_COMMIT = "source string, threshold double, hot_block int, since int"


def source_of(table: DataFrame) -> str:
    """Tells one written table from another: a digest of its files' names, which every write makes anew."""
    return hashlib.sha256("\n".join(sorted(table.inputFiles())).encode()).hexdigest()


class NameIndex:
    def __init__(self, spark: SparkSession, root: str, rules: FuzzyRules = FuzzyRules()):
        self.spark, self.root, self.rules = spark, root.rstrip("/"), rules

    def _write(self, name: str, version: int, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}/version={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _commits(self) -> list:
        """One small row per version."""
        try:
            return self.spark.read.parquet(f"{self.root}/commits").orderBy("version").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _read(self, name: str, versions: list[int]) -> DataFrame:
        paths = [f"{self.root}/{name}/version={v}" for v in versions]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _versions(self) -> list[int]:
        found = self._commits()
        if found and (found[-1].threshold, found[-1].hot_block) != (self.rules.threshold, self.rules.hot_block):
            raise ValueError(f"the index at {self.root} was cut for other rules: {found[-1]}")
        return [r.version for r in found if r.version >= found[-1].since]

    def _commit(self, version: int, source: str, since: int) -> None:
        done = self.spark.createDataFrame([(source, self.rules.threshold, self.rules.hot_block, since)], _COMMIT)
        self._write("commits", version, done.coalesce(1))

    def source(self) -> str | None:
        """What ``update`` was last given as its source."""
        found = self._commits()
        return found[-1].source if found else None

    def _state(self, versions: list[int]) -> DataFrame:
        rows = self._read("names", versions)
        if len(versions) > 1:
            last = F.max_by(F.struct("holders", "sot", "live"), "version").alias("s")
            rows = rows.groupBy("name_key").agg(last).select("name_key", "s.*")
        return rows.drop("version")

    def names(self) -> DataFrame:
        """(name_key, holders, sot) of the names that count: ``by_name`` of the index."""
        return self._state(self._versions()).where("live").drop("live")

    def update(self, identity: DataFrame, source: str = "") -> int:
        """Follow an employee list; returns the new version. Only names never seen before are cut."""
        known = self._versions()
        version = known[-1] + 1 if known else 0
        index = build_index(identity)
        now = index.by_name.withColumn("live", F.lit(True))
        if not known:
            changes = self._write("names", version, now)
            fresh = changes
        else:
            old = self._state(known).select("name_key", F.struct("holders", "sot", "live").alias("old"))
            both = now.select("name_key", F.struct("holders", "sot", "live").alias("new")).join(old, "name_key", "full_outer")
            gone = F.struct("old.holders", "old.sot", F.lit(False).alias("live"))
            value = F.coalesce("new", F.when(F.col("old").isNotNull(), gone))
            moved = both.where(~value.eqNullSafe(F.col("old"))).select("name_key", value.alias("v"), F.col("old").isNull().alias("fresh"))
            marked = self._write("changes", version, moved)
            changes = self._write("names", version, marked.select("name_key", "v.*"))
            fresh = marked.where("fresh").select("name_key", "v.*")
        cut = fresh.select("name_key", "holders", F.col("sot.sot_ord").alias("sot_ord"))
        pieces = self._write("pieces", version, _indexed_blocks(cut, self.rules).select("block", "name_key").sortWithinPartitions("block"))
        counts = self._write("counts", version, pieces.groupBy("block").agg(F.count(F.lit(1)).alias("n")))
        if known:
            before = self._read("counts", known).join(counts.select("block"), "block", "left_semi").groupBy("block").agg(F.sum("n").alias("m"))
            totals = counts.join(before, "block", "left").select("block", F.coalesce("m", F.lit(0)).alias("m"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        else:
            totals = counts.withColumn("m", F.lit(0))
        limit = self.rules.hot_block
        hot = self._write("hot", version, totals.where((F.col("n") > limit) & (F.col("m") <= limit)).select("block"))
        # Names of newly crowded blocks, old and new, and new names in blocks that were crowded before.
        crowded = pieces.join(totals.where(F.col("n") > limit).select("block"), "block", "left_semi").select("name_key")
        if known:
            earlier = self._read("pieces", known).join(hot, "block", "left_semi").select("name_key")
            crowded = crowded.unionByName(earlier).distinct().join(self._read("crowded", known).select("name_key"), "name_key", "left_anti")
        crowded = self._write("crowded", version, crowded.distinct())
        triples = _indexed_triples(crowded.select("name_key", F.lit(0).alias("holders"), F.lit(0).alias("sot_ord")), self.rules)
        self._write("triples", version, triples.select("block", "name_key").sortWithinPartitions("block"))
        self._write("by_email", version, index.by_email)
        self._write("by_id", version, index.by_id)
        self._commit(version, source, known[0] if known else 0)
        return version

    def adopt(self, source: str) -> None:
        """The list the index follows is now stored as ``source``; its content is the same."""
        last = self._commits()[-1]
        self._commit(last.version, source, last.since)

    def candidates(self, probes: DataFrame) -> DataFrame:
        """What ``candidate_pairs`` gives for the names that count, from stored keys."""
        versions, rules = self._versions(), self.rules
        probes = _full_width(probes.select("probe"), "probe")
        read = lambda name: self._read(name, versions).drop("version")
        sought, crowded = _probe_blocks(probes, rules), read("crowded")
        if crowded.isEmpty():
            pairs = meet(sought, read("pieces")).select("probe", "name_key")
        else:
            near = near_crowded(sought, read("pieces").join(crowded, "name_key", "left_semi"))
            single = meet(sought.join(read("hot"), "block", "left_anti"), read("pieces"))
            triple = meet(_probe_triples(near, rules), read("triples"))
            pairs = single.select("probe", "name_key").unionByName(triple.select("probe", "name_key"))
        live = self.names().select("name_key", "holders", F.col("sot.sot_ord").alias("sot_ord"))
        return verified(pairs, ("name_key",), rules).join(live, "name_key").select("probe", "name_key", "holders", "sot_ord", "score")

    def identity_index(self, identity: DataFrame) -> IdentityIndex:
        """The stored tables as an index for ``match_accounts``; nothing is aggregated or cut."""
        last = self._versions()[-1:]
        read = lambda name: self._read(name, last).drop("version")
        return IdentityIndex(identity, read("by_email"), read("by_id"), self.names(), self)

    def compact(self) -> int:
        """One version that holds what counts, read alone from then on: names that left and their keys go, superseded rows too."""
        versions = self._versions()
        version = versions[-1] + 1
        live = self._write("names", version, self._state(versions).where("live"))
        keep = lambda name: self._read(name, versions).drop("version").join(live.select("name_key"), "name_key", "left_semi")
        pieces = self._write("pieces", version, keep("pieces").select("block", "name_key").sortWithinPartitions("block"))
        self._write("counts", version, pieces.groupBy("block").agg(F.count(F.lit(1)).alias("n")))
        self._write("hot", version, self._read("hot", versions).select("block"))
        self._write("crowded", version, keep("crowded"))
        self._write("triples", version, keep("triples").select("block", "name_key").sortWithinPartitions("block"))
        for name in ("by_email", "by_id"):
            self._write(name, version, self._read(name, versions[-1:]).drop("version"))
        self._commit(version, self.source() or "", version)
        return version
