"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.session import write_through

__all__ = ["ship", "documents", "table", "let", "text_of", "lower_ascii", "write_through", "running_start", "numbered", "word_array"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Functions of this module travel to executors by value, so these need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, _UPPER, _LOWER)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once: a lambda variable isn't copied where plans are rewritten."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """The words of a text, in order: runs of anything but blank, tab, line breaks and form feed."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def running_start(df: DataFrame, order: list[str], value: str, group: str | None = None, out: str = "start",
                  label: str = "running") -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in ``order`` (per ``group``).

    Rows are dealt by range of (group, order), so a hot group spreads over tasks; each range is
    summed by itself, and the few sums of ranges give the offsets. The ranges are written once,
    because both steps must see the same borders. Rows equal in ``order`` follow one another in
    any order; give enough columns to tell rows apart where that matters.
    """
    spark = df.sparkSession
    keys = ([group] if group else []) + order
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = write_through(
        df.repartitionByRange(n, *[F.col(k).asc_nulls_last() for k in keys]).withColumn("_range", F.spark_partition_id()),
        label,
    )
    names = ", ".join(f"`{k}` asc nulls last" for k in order)
    by = f"_range, `{group}`" if group else "_range"
    inside = ranged.withColumn(
        "_inside", F.expr(f"sum(`{value}`) over (partition by {by} order by {names} rows between unbounded preceding and current row)")
        - F.col(value),
    )
    sums = ranged.groupBy(*(["_range", group] if group else ["_range"])).agg(F.sum(value).alias("_sum"))
    part = f"partition by `{group}` " if group else ""
    offsets = sums.withColumn(
        "_before",
        F.expr(f"coalesce(sum(_sum) over ({part}order by _range rows between unbounded preceding and 1 preceding), 0)"),
    ).drop("_sum")
    on = inside["_range"] == offsets["_range"]
    if group:
        on = on & inside[group].eqNullSafe(offsets[group])
    joined = inside.join(offsets, on)
    return joined.select(*[inside[c] for c in df.columns], (F.col("_inside") + F.col("_before")).alias(out))


def numbered(docs: DataFrame, label: str = "numbered") -> DataFrame:
    """Adds __place, which tells rows apart and orders them: by doc_id, null ids last, then by a hash of the text.

    Where every row has an id of its own, the id is the place. Otherwise rows are sorted by range and
    written once with a number that grows with (range, row), so that later reads see the same places. Ranges
    spread rows that share an id and a text, too.
    """
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 or doc_id is null")
    if shared.isEmpty():
        return docs.withColumn("__place", F.col("doc_id"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("doc_id").asc_nulls_last(), F.col("__hash"), F.col("__nth")]
    rows = docs.withColumns({"__hash": F.md5(text_of()), "__nth": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return write_through(rows.withColumn("__place", F.monotonically_increasing_id()).drop("__hash", "__nth"), label)
