"""Raw rows → identity and account rows, one projection each.

Rows come with a column per header (``normalize_*``) or as arrays with places per file (``place_*``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import joined_non_blank, normalize_name, trim_blanks
from attestor.schema import ACCOUNT_COLUMNS, IDENTITY_COLUMNS, blank_to_null
from attestor.sources.mapping import ColumnMapping, admin_headers, mapped_fields, placed_fields, raw


def _field(fields: dict[str, Column], name: str, fold: bool = False) -> Column:
    c = F.coalesce(fields.get(name, F.lit("")), F.lit(""))
    return trim_blanks(F.lower(c) if fold else c)


def _admin_values(headers: list[str]) -> Column:
    names = admin_headers(headers)
    return joined_non_blank([raw(h) for h in names]) if names else F.lit("")


def canonical_id() -> Column:
    return F.coalesce(blank_to_null("email"), "employee_id")


def normalize_identity(
    rows: DataFrame, headers: list[str], mapping: ColumnMapping | str | None = None
) -> DataFrame:
    """``rows``: raw header columns plus ``_row`` (position in the file)."""
    return _identity(rows, mapped_fields(headers, mapping), _admin_values(headers))


def place_identity(rows: DataFrame, mapping: ColumnMapping | str | None = None) -> DataFrame:
    return _identity(rows, placed_fields(mapping), _placed_admin())


def _placed_admin() -> Column:
    values = F.transform("_admin", lambda i: trim_blanks(F.coalesce(F.get("_fields", i), F.lit(""))))
    return F.array_join(F.filter(values, lambda v: v != ""), "; ")


def _identity(rows: DataFrame, f: dict[str, Column], admin: Column) -> DataFrame:
    base = rows.select(
        _field(f, "employeeId").alias("employee_id"),
        _field(f, "displayName").alias("display_name"),
        _field(f, "email", fold=True).alias("email"),
        _field(f, "department").alias("department"),
        _field(f, "manager").alias("manager"),
        _field(f, "employmentStatus", fold=True).alias("employment_status"),
        admin.alias("admin_info"),
        F.col("_row").alias("sot_ord"),
    )
    return base.withColumns(
        {"canonical_id": canonical_id(), "normalized_name": normalize_name(F.col("display_name"))}
    ).select(*IDENTITY_COLUMNS)


def normalize_accounts(
    rows: DataFrame,
    headers: list[str],
    mapping: ColumnMapping | str | None = None,
    id_fields: tuple[str, ...] = ("userId",),
) -> DataFrame:
    """``rows``: raw header columns plus ``_system``, ``_row`` and ``_hash``.

    ``id_fields``: fields tried for the account id, first non-blank wins; add ``employeeId`` to
    also match exports whose id column is an employee number.
    """
    return _accounts(rows, mapped_fields(headers, mapping), _admin_values(headers), id_fields)


def place_accounts(rows: DataFrame, mapping: ColumnMapping | str | None = None, id_fields: tuple[str, ...] = ("userId",)) -> DataFrame:
    return _accounts(rows, placed_fields(mapping), _placed_admin(), id_fields)


def _accounts(rows: DataFrame, f: dict[str, Column], admin: Column, id_fields: tuple[str, ...]) -> DataFrame:
    ids = [blank_to_null(_field(f, name)) for name in id_fields]
    role, admin = blank_to_null(_field(f, "role")), blank_to_null(admin)
    return rows.select(
        _field(f, "email", fold=True).alias("email"),
        F.coalesce(*ids, F.lit("")).alias("user_id"),
        _field(f, "displayName").alias("display_name"),
        F.concat_ws("; ", role, admin).alias("role"),
        _field(f, "entitlement").alias("entitlement"),
        _field(f, "lastLogin").alias("last_login"),
        _field(f, "accountStatus", fold=True).alias("account_status"),
        F.col("_system").alias("system"),
        F.col("_row").alias("source_row"),
        F.col("_hash").alias("file_hash"),
    ).select(*ACCOUNT_COLUMNS)
