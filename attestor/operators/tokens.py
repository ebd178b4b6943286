"""Order-preserving union of delimited lists over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import split_tokens, when_single


def group_token_union(rows: DataFrame, key: str, order: Column, fields: list[str]) -> DataFrame:
    """(key, <field>_union …): case-insensitive union per group, first casing and order kept.

    Values are reduced to one row per (group, value) before a group is put together, so a
    group's list is only as long as its result.
    """
    def tag(n: int):
        return lambda v, i: F.struct(F.lit(n).alias("field"), i.alias("pos"), v.alias("value"))

    tagged = [
        when_single(F.col(f), lambda v: tag(n)(v, F.lit(0)), F.transform(split_tokens(F.col(f)), tag(n)))  # noqa: B023
        for n, f in enumerate(fields)
    ]
    values = rows.select(key, order.alias("ord"), F.explode(F.concat(*tagged)).alias("t"))
    at = F.struct("ord", F.col("t.pos"))
    first = values.groupBy(key, F.col("t.field").alias("field"), F.lower("t.value").alias("folded")).agg(
        F.min(F.struct(at.alias("at"), F.col("t.value").alias("value"))).alias("first")
    )
    lists = first.groupBy(key).agg(
        *[
            # sort_array compares structs natively, array_sort by a lambda; there are no nulls in the list.
            F.sort_array(F.collect_list(F.when(F.col("field") == n, F.col("first")))).alias(f"_{f}")
            for n, f in enumerate(fields)
        ]
    )
    return lists.select(
        key, *[F.array_join(F.col(f"_{f}.value"), ", ").alias(f"{f}_union") for f in fields]
    )
