"""Rollups of entries kept as partials that later batches add to.

Each batch leaves counts by system, match type and risk level, a summary per system and user, and the set of a system's users
as bitmaps over user numbers. Counts add up, bitmaps are united, summaries are merged; so totals come from partials alone and a
batch aggregates its own rows only. ``replace`` sets a system's earlier partials aside, for systems that were rebuilt.

Users get dense numbers when they are first seen; a number is never given twice, so counts of distinct users are exact. A
batch reads the stored numbers (ids only) to find its new users. A version counts once its commit is written, last; an
interrupted step is repeated and overwrites its tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.identity import distinct_people
from attestor.operators.views import positions
from attestor.schema import RISK_LEVELS

_ORDER = ("system", "source_row")


def _first(column: str) -> Column:
    """The first non-blank value with its place; a struct's minimum is mergeable."""
    return F.min(F.when(F.col(column) != "", F.struct(*_ORDER, F.col(column).alias("value"))))


class Rollups:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _write(self, name: str, version: int, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}/version={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _versions(self) -> list:
        """One small row per version."""
        try:
            return self.spark.read.parquet(f"{self.root}/commits").orderBy("version").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _read(self, name: str, versions: list[int], schema: str) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], f"{schema}, version int")
        paths = [f"{self.root}/{name}/version={v}" for v in versions]
        return self.spark.read.schema(f"{schema}, version int").option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _live(self, name: str, schema: str) -> DataFrame:
        """Partials that count: a system's since it was replaced last."""
        found = [r.version for r in self._versions() if r.kind == "entries"]
        rows = self._read(name, found, schema)
        since = self._read("replaced", found, "system string").groupBy("system").agg(F.max("version").alias("since"))
        return rows.join(since, "system", "left").where(F.col("version") >= F.coalesce("since", F.lit(0))).drop("since")

    _COUNTS = "system string, match_type string, risk_level string, n long, conflicts long"
    _PLACE = "struct<system: string, source_row: long, value: string>"
    _USERS = f"system string, canonical_id string, name {_PLACE}, mail {_PLACE}, risk struct<score: int, level: string>, entries long"
    _BITS = "system string, bucket long, bits binary"

    def _numbered(self, ids: DataFrame, version: int) -> DataFrame:
        """(canonical_id, number) of ``ids`` (distinct); new ones are numbered on and kept."""
        known = self._read("numbers", [r.version for r in self._versions()], "canonical_id string, number long").drop("version")
        top = known.agg(F.max("number")).first()[0]
        base = -1 if top is None else top
        new = positions(ids.join(known, "canonical_id", "left_anti").orderBy("canonical_id"))
        new = self._write("numbers", version, new.select("canonical_id", (F.col("position") + base).alias("number")))
        return known.unionByName(new).join(ids, "canonical_id", "left_semi")

    def _commit(self, version: int, kind: str) -> int:
        self._write("commits", version, self.spark.createDataFrame([(kind,)], "kind string").coalesce(1))
        return version

    def _bits(self, users: DataFrame) -> DataFrame:
        """(system, canonical_id, number) as bitmaps of 32,768 numbers each."""
        return users.groupBy("system", F.bitmap_bucket_number("number").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))

    def add(self, entries: DataFrame, replace: list[str] | None = None) -> int:
        """Count the entries of a batch; returns the version.

        ``entries`` are accounts (match type other than ``no_access``, for which see ``set_people``) with a system; read
        twice. Earlier partials of the systems in ``replace`` no longer count. Orphans belong to no user.
        """
        version = len(self._versions())
        counts = entries.groupBy("system", "match_type", "risk_level").agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("conflicts")), F.lit(0)).cast("long").alias("conflicts"))
        users = entries.where(F.col("match_type") != "orphan").groupBy("system", "canonical_id").agg(
            _first("display_name").alias("name"), _first("email").alias("mail"),
            F.max(F.struct(F.col("risk_score").alias("score"), F.col("risk_level").alias("level"))).alias("risk"),
            F.count(F.lit(1)).alias("entries"))
        return self._keep(version, counts, users, replace or [])

    def _keep(self, version: int, counts: DataFrame, users: DataFrame, replaced: list[str]) -> int:
        self._write("counts", version, counts.select(*[c.split()[0] for c in self._COUNTS.split(", ")]))
        users = self._write("users", version, users.select("system", "canonical_id", "name", "mail", "risk", "entries"))
        numbers = self._numbered(users.select("canonical_id").distinct(), version)
        self._write("bits", version, self._bits(users.select("system", "canonical_id").join(numbers, "canonical_id")))
        self._write("replaced", version, self.spark.createDataFrame([(s,) for s in replaced], "system string"))
        return self._commit(version, "entries")

    def set_people(self, identity: DataFrame) -> int:
        """The employee list, whose people without access ``totals`` counts; the last one counts."""
        version = len(self._versions())
        people = distinct_people(identity).select("canonical_id")
        numbers = self._numbered(people, version).withColumn("system", F.lit(""))
        self._write("people", version, self._bits(numbers))
        return self._commit(version, "people")

    def compact(self) -> int:
        """Fold each system's partials into one."""
        version = len(self._versions())
        counts = self._live("counts", self._COUNTS).groupBy("system", "match_type", "risk_level").agg(
            F.sum("n").alias("n"), F.sum("conflicts").alias("conflicts"))
        users = self._merged_users("system", "canonical_id")
        systems = [r.system for r in counts.select("system").distinct().collect()]  # few
        return self._keep(version, counts, users, systems)

    def _merged_users(self, *keys: str) -> DataFrame:
        return self._live("users", self._USERS).groupBy(*keys).agg(
            F.min("name").alias("name"), F.min("mail").alias("mail"), F.max("risk").alias("risk"), F.sum("entries").alias("entries"))

    def join_stats(self) -> DataFrame:
        """``match.join_stats`` of all accounts."""
        n = lambda kind: F.sum(F.when(F.col("match_type") == kind, F.col("n")).otherwise(0))
        return self._live("counts", self._COUNTS).groupBy("system").agg(
            F.sum("n").alias("total_processed"), n("exact_email").alias("exact_email"), n("exact_id").alias("exact_id"),
            n("fuzzy_name").alias("fuzzy_name"), n("fuzzy_ambiguous").alias("ambiguous"), n("orphan").alias("orphans"))

    def risk_summary(self) -> DataFrame:
        """(risk_level, records) of all accounts, for all five levels."""
        levels = self.spark.createDataFrame([(x,) for x in RISK_LEVELS], "risk_level string")
        counts = self._live("counts", self._COUNTS).groupBy("risk_level").agg(F.sum("n").alias("n"))
        return levels.join(counts, "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("records"))

    def user_summary(self) -> DataFrame:
        """``rollups.user_summary`` of the users with access."""
        text = lambda c: F.coalesce(F.col(f"{c}.value"), F.lit(""))
        return self._merged_users("canonical_id").select(
            "canonical_id", text("name").alias("display_name"), text("mail").alias("email"),
            F.col("risk.level").alias("max_risk_level"), F.col("risk.score").alias("max_risk_score"), "entries")

    def totals(self) -> DataFrame:
        """``rollups.report_totals``: users (with access, or without any but on the list), matched, orphans, no_access."""
        people = [r.version for r in self._versions() if r.kind == "people"][-1:]
        listed = self._read("people", people, self._BITS).select("bucket", "bits", F.lit(True).alias("listed"))
        seen = self._live("bits", self._BITS).select("bucket", "bits", F.lit(False).alias("listed"))
        sets = seen.unionByName(listed).groupBy("bucket", "listed").agg(F.bitmap_or_agg("bits").alias("bits")).groupBy("bucket").agg(
            F.bitmap_count(F.bitmap_or_agg("bits")).alias("either"),
            F.sum(F.when(~F.col("listed"), F.bitmap_count("bits")).otherwise(0)).alias("seen"))
        users = sets.agg(F.coalesce(F.sum("either"), F.lit(0)).alias("users"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"))
        n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n")).otherwise(0)), F.lit(0))
        counts = self._live("counts", self._COUNTS)
        return users.select(
            "users", counts.agg(n(F.col("match_type") != "orphan")).scalar().alias("matched"),
            counts.agg(n(F.col("match_type") == "orphan")).scalar().alias("orphans"), (F.col("users") - F.col("seen")).alias("no_access"))
