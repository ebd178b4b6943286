"""Column layouts and enumerations shared by the whole package.

Data columns are non-null strings (missing = ``''``); nulls only mean "no review
action" and "no role actions".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY_TEXT = (
    "canonical_id", "employee_id", "display_name", "normalized_name", "email",
    "department", "manager", "employment_status", "admin_info",
)
IDENTITY_COLUMNS = (*IDENTITY_TEXT, "sot_ord")

ACCOUNT_TEXT = (
    "email", "user_id", "display_name", "role", "entitlement", "last_login", "account_status",
)
ACCOUNT_COLUMNS = (*ACCOUNT_TEXT, "system", "source_row", "file_hash")

REPORT_COLUMNS = (
    "record_id", "employee_id", "display_name", "email", "department", "manager",
    "employment_status", "system", "role", "entitlement", "last_login", "account_status",
    "review_action", "review_note", "role_actions", "source_file", "source_row",
    "match_type", "risk_level", "risk_score", "file_hash",
)

CONFLICT_TYPE = (
    "array<struct<field:string,sot_value:string,satellite_value:string,resolution:string>>"
)
ROLE_ACTIONS_TYPE = "map<string,string>"

# Enumerations of the report format.
MATCH_TYPES = ("exact_email", "exact_id", "fuzzy_name", "fuzzy_ambiguous", "orphan", "no_access")
RISK_LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
REVIEW_ACTIONS = ("approve", "revoke", "flag")

# The eleven mappable target fields and our column for each.
TARGET_FIELDS = {
    "email": "email",
    "userId": "user_id",
    "employeeId": "employee_id",
    "displayName": "display_name",
    "department": "department",
    "manager": "manager",
    "employmentStatus": "employment_status",
    "accountStatus": "account_status",
    "role": "role",
    "entitlement": "entitlement",
    "lastLogin": "last_login",
}


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def no_null_text(df: DataFrame, columns) -> DataFrame:
    """Replace NULL by ``''`` in the named columns, adding absent ones as ``''``."""
    present = set(df.columns)
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) if c in present else F.lit("") for c in columns}
    )


def row_order() -> Column:
    """Total order of account rows inside one system; breaks every tie."""
    return F.struct("source_row", "file_hash")
