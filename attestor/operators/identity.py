"""The employee index: unique by e-mail, unique by id, grouped by normalised name."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.schema import IDENTITY_COLUMNS, blank_to_null


def _record():
    return F.struct(*IDENTITY_COLUMNS)


@dataclass(frozen=True)
class IdentityIndex:
    """Lazy lookup tables over one identity DataFrame.

    ``by_email`` (email, sot), ``by_id`` (user_id, sot), ``by_name`` (name_key, holders, sot):
    one row per key; the lowest ``sot_ord`` wins. ``pieces``: a stored piece index of the names
    (``name_index.NameIndex``); the tables are then stored ones, too.
    """

    identity: DataFrame
    by_email: DataFrame
    by_id: DataFrame
    by_name: DataFrame
    pieces: Any = None


def first_by(identity: DataFrame, key: str, alias: str) -> DataFrame:
    return (
        identity.where(F.col(key) != "")
        .groupBy(F.col(key).alias(alias))
        .agg(F.min_by(_record(), "sot_ord").alias("sot"))
    )


def build_index(identity: DataFrame) -> IdentityIndex:
    rows = identity.select(*IDENTITY_COLUMNS)
    by_name = (
        rows.where(F.col("normalized_name") != "")
        .groupBy(F.col("normalized_name").alias("name_key"))
        .agg(F.count(F.lit(1)).alias("holders"), F.min_by(_record(), "sot_ord").alias("sot"))
    )
    return IdentityIndex(
        identity=rows,
        by_email=first_by(rows.withColumn("email", F.lower("email")), "email", "email"),
        by_id=first_by(rows, "employee_id", "user_id"),
        by_name=by_name,
    )


def index_stats(identity: DataFrame) -> DataFrame:
    """One row: every status other than terminated counts as active."""
    gone = F.lower("employment_status") == "terminated"
    return identity.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(~gone).alias("active_count"),
        F.count_if(gone).alias("terminated_count"),
        F.count_distinct(blank_to_null(F.lower("email"))).alias("unique_emails"),
    )


def distinct_people(identity: DataFrame) -> DataFrame:
    """One record per canonical id among records some lookup table can reach.

    A record is reachable when it won its e-mail or its id, or has a name. Winners of an
    e-mail come before winners of an id, then records only reachable by name.
    """
    index = build_index(identity)
    mail = index.by_email.select(F.col("sot.sot_ord").alias("sot_ord"), F.lit(0).alias("rank"))
    ids = index.by_id.select(F.col("sot.sot_ord").alias("sot_ord"), F.lit(1).alias("rank"))
    named = index.identity.where(F.col("normalized_name") != "").select(
        "sot_ord", F.lit(2).alias("rank")
    )
    reach = mail.unionByName(ids).unionByName(named).groupBy("sot_ord").agg(F.min("rank").alias("rank"))
    return (
        index.identity.join(reach, "sot_ord")
        .groupBy("canonical_id")
        .agg(F.min_by(_record(), F.struct("rank", "sot_ord")).alias("sot"))
        .select("sot.*")
    )
