"""Reviewer views of the report: presets, search, sort, selection, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.risk import is_privileged_row
from attestor.operators.rollups import admin_roles, own_system_cell
from attestor.operators.skew import salted_lookup
from attestor.session import write_through

PRESETS = ("all", "orphans", "conflicts", "terminated_active", "admins")
SEARCH_FIELDS = ("display_name", "email", "system", "role", "entitlement")
NUMERIC_FIELDS = ("risk_score", "source_row")
DEFAULT_COLUMNS = (
    "display_name", "email", "department", "employment_status", "*systems",
    "risk_level", "risk_score", "review_action", "review_note",
)
OPTIONAL_COLUMNS = (
    "employee_id", "manager", "match_type", "account_status", "last_login", "source_file",
)


def preset(name: str, keywords=None) -> Column:
    if name == "all":
        return F.lit(True)
    if name == "orphans":
        return F.col("match_type") == "orphan"
    if name == "conflicts":
        return F.col("match_type") == "fuzzy_ambiguous"
    if name == "terminated_active":
        return (F.col("employment_status") == "terminated") & (F.col("account_status") == "active")
    if name == "admins":
        return is_privileged_row(F.col("role"), F.col("entitlement"), keywords)
    raise ValueError(f"unknown preset {name!r}; one of {PRESETS}")


def search(text: str) -> Column:
    """Case-insensitive literal substring of any searched field; blank text matches all."""
    if not text.strip():
        return F.lit(True)
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for f in SEARCH_FIELDS:
        hit = hit | F.contains(F.lower(f), needle)
    return hit


def filter_report(
    report: DataFrame,
    tab: str = "all",
    text: str = "",
    risk_level: str | None = None,
    system: str | None = None,
    keywords=None,
) -> DataFrame:
    out = report
    if system is not None:
        out = out.where(F.col("system") == system)
    if risk_level is not None:
        out = out.where(F.col("risk_level") == risk_level)
    return out.where(preset(tab, keywords)).where(search(text))


def sort_report(report: DataFrame, field: str = "risk_score", descending: bool = True) -> DataFrame:
    """Sort by any field: numbers by value, text by locale, nulls lowest.

    The record id is part of the key, so rows sharing a value are spread over many ranges.
    """
    c = F.col(field) if field in NUMERIC_FIELDS else F.collate(F.col(field), "UNICODE")
    return report.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), F.asc("record_id"))


def positions(ordered: DataFrame) -> DataFrame:
    """Adds ``position``, from 1, in the order of ``ordered``: place in the range plus rows of earlier ranges."""
    rows = write_through(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    task = F.shiftright("_at", 33).alias("_task")
    before = rows.groupBy(task).agg(F.count(F.lit(1)).alias("_n")).select(
        "_task", F.expr("coalesce(sum(_n) over (order by _task rows between unbounded preceding and 1 preceding), 0)").alias("_before")
    )
    # One row per range.
    placed = rows.withColumn("_task", task).join(F.broadcast(before), "_task")
    return placed.withColumn("position", F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + F.col("_before") + 1).drop("_at", "_task", "_before")


def select_by_ids(report: DataFrame, ids: DataFrame) -> DataFrame:
    return report.join(ids.select("record_id"), "record_id", "left_semi")


def select_filtered(report: DataFrame, excluded: DataFrame, **criteria) -> DataFrame:
    """All rows matching the filter except the excluded ids."""
    return filter_report(report, **criteria).join(excluded.select("record_id"), "record_id", "left_anti")


def project(
    report: DataFrame,
    systems: list[str],
    columns=DEFAULT_COLUMNS,
    extra=(),
    hidden=(),
    with_admin_roles: bool = False,
    keywords=None,
) -> DataFrame:
    """Chosen columns in order; ``*systems`` stands for one access column per system."""
    wanted: list[str] = []
    for c in (*columns, *extra):
        if c not in hidden:
            wanted += systems if c == "*systems" else [c]
    out = report
    if with_admin_roles:
        # Read three times: counted, looked up, and the blank e-mail's row.
        lookup = write_through(admin_roles(report, keywords).withColumnRenamed("email", "_mail"), "admin-roles")
        out = salted_lookup(out.withColumn("_mail", F.lower("email")), lookup, "_mail", ["record_id"])
        # The blank e-mail is spread as "no key" by the lookup; its one row is read apart.
        nobody = lookup.where(F.col("_mail") == "").select("admin_roles").scalar()
        out = out.withColumn(
            "admin_roles", F.when(F.col("_mail") == "", nobody).otherwise(F.col("admin_roles"))
        )
        at = 2 if "email" in wanted[:2] else 1
        wanted = wanted[:at] + ["admin_roles"] + wanted[at:]
    return out.select(
        "record_id",
        *[own_system_cell(c).alias(c) if c in systems else F.col(c) for c in wanted],
    )
