"""Lookup joins that survive hot and blank keys.

The looked-up side has one row per key. A row whose key is blank cannot match, so it is
spread by a hash of the row instead of landing in one task with all other blanks. Keys that
hold many rows are found with a mergeable frequent-items sketch (bounded size, one column
read), and both sides of only those keys are salted. Nothing is dropped: the sketch only
decides how keys are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the rows in memory, which are sent through the driver and kept by every task.
BROADCAST_LIMIT = 16 * 1024 * 1024
ROWS_PER_SPLIT = 2_000_000
SKETCH_ITEMS = 8192
SKETCH_KEYS = 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of the plan (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    return estimated_bytes(df) <= limit


def counted_bytes(df: DataFrame) -> int:
    """The size in memory from a row count (one job, of footers only for a stored table).

    The optimizer goes by file sizes, which say little: repeated values take next to no room in a file. Twice the
    schema's default size is what a row takes in a broadcast table.
    """
    return df.count() * 2 * int(df._jdf.schema().defaultSize())


def fits_counted(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    return fits_broadcast(df, limit) and counted_bytes(df) <= limit


def hot_keys(df: DataFrame, *keys: str, rows_per_split: int = ROWS_PER_SPLIT) -> dict[str, DataFrame]:
    """Per key column: (key, _splits) of values above ``rows_per_split`` rows.

    One pass over the key columns; at most SKETCH_KEYS values per column come back.
    """
    found = df.agg(
        *[
            F.expr(
                f"approx_top_k(`{k}`, {SKETCH_KEYS}, {SKETCH_ITEMS}) FILTER (WHERE `{k}` != '')"
            ).alias(k)
            for k in keys
        ]
    ).first()
    spark = df.sparkSession
    return {
        k: spark.createDataFrame(
            [
                (i["item"], -(-i["count"] // rows_per_split))
                for i in (found[k] or [])
                if i["count"] > rows_per_split
            ],
            f"`{k}` string, _splits int",
        )
        for k in keys
    }


def hot_counts(counts: DataFrame, key: str, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """The same from exact counts (key, rows) the caller has anyway; at most SKETCH_KEYS rows."""
    return (
        counts.where((F.col("rows") > rows_per_split) & (F.col(key) != ""))
        .orderBy(F.desc("rows"), key)
        .limit(SKETCH_KEYS)
        .select(key, F.ceil(F.col("rows") / rows_per_split).cast("int").alias("_splits"))
    )


def spread(row_id: list[str]) -> Column:
    return F.xxhash64(*row_id)


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    row_id: list[str],
    how: str = "left",
    rows_per_split: int = ROWS_PER_SPLIT,
    broadcast_limit: int = BROADCAST_LIMIT,
    hot: DataFrame | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Join ``left`` to the key-unique ``right``. ``how``: left, inner, left_semi or left_anti.

    A blank key matches nothing, however the join is run: a left row with one stays unmatched, and a
    right row with one is left out. Callers to whom blank is a key like others prefix it.
    ``hot`` is a result of ``hot_keys`` or ``hot_counts`` found earlier. ``right`` is counted first if
    its estimated size is small, so pass a stored table when it is costly to compute; ``small`` tells what the caller knows.
    """
    if small is None:
        small = fits_counted(right, broadcast_limit)
    right = right.where(F.col(key) != "")
    if small:
        return left.join(F.broadcast(right), key, how)
    if hot is None:
        hot = hot_keys(left, key, rows_per_split=rows_per_split)[key]
    hot = F.broadcast(hot)
    blank = F.col(key) == ""
    salted_left = left.join(hot, key, "left").withColumn(
        "_salt",
        F.when(blank, F.pmod(spread(row_id), F.lit(2**31 - 1)))
        .when(F.col("_splits").isNotNull(), F.pmod(spread(row_id), F.col("_splits")))
        .otherwise(F.lit(0))
        .cast("long"),
    ).drop("_splits")
    salted_right = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)))
        .withColumn("_salt", F.col("_salt").cast("long"))
        .drop("_splits")
    )
    # Counted as large, whatever the optimizer thinks.
    return salted_left.join(salted_right.hint("merge"), [key, "_salt"], how).drop("_salt")
