"""Report store: versioned Parquet, one partition per system, committed last.

A batch only touches the systems its files belong to. It writes its matches under
``matched/version=V/part=S`` (kept for later re-merges), those systems' complete new rows under ``report/version=V/part=S`` and then a commit row per system. Readers take the
latest committed version of each system, so an interrupted batch is invisible and can be
repeated: it reads the state before V and overwrites V.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.schema import REPORT_COLUMNS
from attestor.session import write_through


def _part():
    """Partition value of a system, prefixed so that "007" is not read back as a number."""
    return F.concat(F.lit("s-"), F.col("system"))



class ReportStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", False).parquet(self._path(table))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # unreadable is not absent
                raise
            return None

    def _latest(self, before: int | None) -> DataFrame | None:
        commits = self._read("commits")
        if commits is None:
            return None
        if before is not None:
            commits = commits.where(F.col("version") < before)
        return commits.groupBy("part").agg(F.max("version").alias("version"))

    def report(self, systems: list[str] | None = None, before: int | None = None) -> DataFrame | None:
        """The current report, or of some systems, or as it was before a version.

        The join is on the partition columns, so unread versions and systems are pruned.
        """
        latest = self._latest(before)
        rows = self._read("report")
        if latest is None or rows is None:
            return None
        if systems is not None:
            wanted = F.col("part").isin([f"s-{s}" for s in systems])
            rows, latest = rows.where(wanted), latest.where(wanted)
        return rows.join(latest, ["part", "version"], "left_semi").select(*REPORT_COLUMNS)

    def _exists(self, path: str) -> bool:
        try:
            self.spark.read.format("binaryFile").load(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def _write_parts(self, rows: DataFrame, path: str, systems: list[str] | None) -> None:
        """A folder per system; what an interrupted batch left is replaced.

        Spark sorts whole rows by system for that. The rows of a single one are written into its folder as they come.
        """
        if systems is not None and len(systems) == 1 and re.fullmatch(r"[\w.-]+", systems[0], re.ASCII) and not self._exists(path):
            rows.write.parquet(f"{path}/part=s-{systems[0]}")
            return
        rows.withColumn("part", _part()).write.mode("overwrite").partitionBy("part").option("partitionOverwriteMode", "static").parquet(path)

    def save_matched(self, matched: DataFrame, version: int, systems: list[str] | None = None) -> None:
        """The matches of one batch; repeating the batch replaces them. ``systems``: all that the rows are of, if known."""
        self._write_parts(matched, f"{self._path('matched')}/version={version}", systems)

    def matched(self, systems: list[str], version: int) -> DataFrame:
        """All matches of the systems: committed earlier batches and batch ``version`` itself."""
        rows = self._seen(self._read("matched").where(F.col("part").isin([f"s-{s}" for s in systems])), version)
        gone = self._read("superseded")
        if gone is not None:
            gone = self._seen(gone, version).select(F.col("hash").alias("file_hash"), F.col("version").alias("until"))
            gone = gone.groupBy("file_hash").agg(F.max("until").alias("until"))
            rows = rows.join(gone, "file_hash", "left").where(
                F.col("until").isNull() | (F.col("version") >= F.col("until"))).select(*rows.columns)
        again = self._read("rematched")
        if again is not None:
            again = self._seen(again, version).groupBy("part").agg(F.max("version").alias("since"))
            rows = rows.join(again, "part", "left").where(F.col("version") >= F.coalesce("since", F.lit(0)))
        return rows.drop("part", "version", "since")

    def save_rematched(self, matched: DataFrame, version: int) -> None:
        """All matches of some systems anew: earlier batches of these systems no longer count from this version on."""
        self.save_matched(matched, version)
        matched.select(_part().alias("part")).distinct().write.mode("overwrite").parquet(f"{self._path('rematched')}/version={version}")

    def systems(self) -> list[str]:
        """Systems with a committed report."""
        commits = self._read("commits")
        return [] if commits is None else sorted(r.part[2:] for r in commits.select("part").distinct().collect())

    def _seen(self, rows: DataFrame, version: int) -> DataFrame:
        """Rows of batch ``version`` itself and of committed earlier ones."""
        own = rows.where(F.col("version") == version)
        commits = self._read("commits")
        if commits is None:
            return own
        earlier = rows.where(F.col("version") < version).join(commits.select("version").distinct(), "version", "left_semi")
        return own.unionByName(earlier)

    def save_parts(self, parts: DataFrame, version: int) -> DataFrame | None:
        """Keep where each part of a batch's units stands; rows of units that have grown since: hash, low, high, by.

        A unit that is read again has another fingerprint. Matches under the old one no longer count from this version on; its
        rows ``low`` < row <= ``high`` now stand ``by`` rows later.
        """
        columns = ["unit", "uri", "hash", "start", "n"]
        parts.select(*columns).write.mode("overwrite").parquet(f"{self._path('unit_parts')}/version={version}")
        known = self._seen(self._read("unit_parts"), version)
        new = known.where(F.col("version") == version).select("unit", "uri", F.col("hash").alias("now"), F.col("start").alias("moved"))
        last = known.where(F.col("version") < version).groupBy("unit").agg(F.max("version").alias("version"))
        old = known.join(last, ["unit", "version"], "left_semi").join(new, ["unit", "uri"]).where(F.col("hash") != F.col("now"))
        old = old.select("hash", F.col("start").alias("low"), (F.col("start") + F.col("n")).alias("high"), (F.col("moved") - F.col("start")).alias("by"))
        if old.isEmpty():
            return None
        old.select("hash").distinct().write.mode("overwrite").parquet(f"{self._path('superseded')}/version={version}")
        return old

    def with_ingest_order(self, rows: DataFrame, version: int) -> DataFrame:
        """Adds ``ingest_ord``: the batch and the place that each row's file was read at (null for files of no batch)."""
        parts = self._read("unit_parts")
        if parts is None:
            return rows
        order = self._seen(parts, version).groupBy(F.col("hash").alias("file_hash")).agg(F.max(F.struct("version", "unit")).alias("ingest_ord"))
        return rows.join(order, "file_hash", "left")

    def outdated(self, systems: list[str], moved: DataFrame, version: int) -> DataFrame:
        """Earlier matches of units that have grown, with ``by``."""
        rows = self._seen(self._read("matched").where(F.col("part").isin([f"s-{s}" for s in systems])), version).where(F.col("version") < version)
        inside = (F.col("file_hash") == F.col("hash")) & (F.col("source_row") > F.col("low")) & (F.col("source_row") <= F.col("high"))
        return rows.join(moved, inside).drop("part", "version", "hash", "low", "high")

    def commit(self, report: DataFrame, version: int, systems: list[str]) -> None:
        """Replace the given systems' rows as version ``version``."""
        self._write_parts(report.select(*REPORT_COLUMNS), f"{self._path('report')}/version={version}", systems)
        done = self.spark.createDataFrame([(s,) for s in systems], "system string")
        done.select(_part().alias("part")).coalesce(1).write.mode("overwrite").parquet(
            f"{self._path('commits')}/version={version}"
        )

    def next_version(self) -> int:
        commits = self._read("commits")
        top = commits.agg(F.max("version")).first()[0] if commits is not None else None
        return 0 if top is None else top + 1

    def save_table(self, name: str, df: DataFrame) -> None:
        """Whole-table outputs: identity, file registry, review log snapshots."""
        df.write.mode("overwrite").parquet(self._path(name))

    def move_log(self, log: DataFrame, version: int) -> None:
        """Replace the review log once per version, after its commit: a repeated batch must not move ids twice."""
        if self._read(f"log_moved/version={version}") is None:
            log = write_through(log, "review-log")
            self.save_table("review_log", log)
            log.limit(0).write.mode("overwrite").parquet(f"{self._path('log_moved')}/version={version}")

    def append_table(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self._path(name))

    def clear_table(self, name: str) -> None:
        """Remove a table's rows; it loads as absent until it is saved again."""
        self.spark.createDataFrame([], "cleared boolean").write.mode("overwrite").parquet(self._path(name))

    def load_table(self, name: str) -> DataFrame | None:
        df = self._read(name)
        return None if df is None or df.columns == ["cleared"] else df
