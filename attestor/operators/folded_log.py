"""The review log's fold as a stored table that follows the log.

``review.fold_state`` folds the whole log. Here each version holds the records that the log's tail touched, folded up to a watermark
(the highest ``seq`` seen); the latest row of a record counts. A tail is folded by itself and laid over the rows of its records.

An undo or redo may reach behind the watermark. Then the records that its batches touched there, and only those, are folded
again from the log. Whether a batch counts is kept in ``switches``, also by version.

Events come with rising ``seq``: one that is appended later has a higher one than all that were folded. Name events carry a name.
A version counts once its commit is written, last; an interrupted step is repeated and overwrites its tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.review import _batch, _switches, effective_events, fold_events

_FIELDS = ("rec", "name", "last_role_seq", "role_note", "touched")


def _laid_over(old: Column, new: Column) -> Column:
    """Roles touched before and after the watermark: first place of either, last action."""
    old, new = F.coalesce(old, F.array()), F.coalesce(new, F.array())

    def moved(o):
        later = F.get(F.filter(new, lambda n: n["role"].eqNullSafe(o["role"])), F.lit(0))
        return F.struct(
            o["first_seq"].alias("first_seq"), o["role"].alias("role"), F.coalesce(later["seq"], o["seq"]).alias("seq"),
            F.when(later.isNotNull(), later["action"]).otherwise(o["action"]).alias("action"))

    added = F.filter(new, lambda n: ~F.exists(old, lambda o: o["role"].eqNullSafe(n["role"])))
    return F.array_sort(F.concat(F.transform(old, moved), added))


def merge_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """States of an earlier and a later stretch of the log as one; records of ``new`` only."""
    both = new.alias("n").join(old.alias("o"), "record_id", "left")
    columns = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in _FIELDS[:-1]]
    return both.select("record_id", *columns, _laid_over(F.col("o.touched"), F.col("n.touched")).alias("touched"))


class FoldedLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

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

    def _read(self, name: str, versions: int) -> DataFrame:
        paths = [f"{self.root}/{name}/version={v}" for v in range(versions)]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _latest(self, rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*_FIELDS), "version").alias("s")
        return rows.groupBy("record_id").agg(last).select("record_id", "s.*")

    def watermark(self) -> int | None:
        found = self._commits()
        return found[-1].watermark if found else None

    def state(self) -> DataFrame:
        """``fold_state`` of the log up to the watermark, for ``apply_state``; records whose events were all undone have an empty one."""
        return self._latest(self._read("state", len(self._commits())))

    def advance(self, log: DataFrame) -> int | None:
        """Fold what the log holds beyond the watermark; returns the new version, None if there is nothing."""
        found = self._commits()
        version = len(found)
        tail = log.where(F.col("seq") > found[-1].watermark) if found else log
        top = tail.agg(F.max("seq")).first()[0]
        if top is None:
            return None
        log, tail = log.where(F.col("seq") <= top), tail.where(F.col("seq") <= top)
        switched = self._write("switches", version, _switches(tail))
        if not found:
            self._write("state", version, fold_events(effective_events(tail, switched)))
        else:
            before = self._read("switches", version).groupBy("batch").agg(F.max_by("state", "at").alias("state"))
            known = self._read("switches", version).drop("version").unionByName(switched)
            switches = known.groupBy("batch").agg(F.max_by("state", "at").alias("state"))
            undone = lambda c: F.coalesce(F.col(c) == "undo", F.lit(False))
            flipped = switched.join(before.withColumnRenamed("state", "was"), "batch", "left").where(undone("state") != undone("was"))
            earlier = log.where((F.col("seq") <= found[-1].watermark) & ~F.col("kind").isin("undo", "redo")).withColumn("batch", _batch())
            again = self._write("again", version, earlier.join(flipped.select("batch"), "batch", "left_semi").select("record_id").distinct())
            new = fold_events(effective_events(tail.join(again, "record_id", "left_anti"), switches))
            old = self._read("state", version).join(
                tail.select("record_id").distinct().join(again, "record_id", "left_anti"), "record_id", "left_semi")
            state = merge_states(self._latest(old), new)
            if not again.isEmpty():
                whole = fold_events(effective_events(log.join(again, "record_id", "left_semi"), switches))
                state = state.unionByName(again.join(whole, "record_id", "left"))
            self._write("state", version, state)
        done = self.spark.createDataFrame([(top,)], "watermark long")
        self._write("commits", version, done.coalesce(1))
        return version
