"""Report outputs: master CSV, orphan, conflict and run-metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.review import role_action_text
from attestor.operators.rollups import export_totals

# The report's column headings in order, with our column for each.
MASTER_COLUMNS = {
    "Canonical ID": "record_id",
    "Employee ID": "employee_id",
    "Display Name": "display_name",
    "Email": "email",
    "Department": "department",
    "Manager": "manager",
    "Employment Status": "employment_status",
    "System": "system",
    "Role": "role",
    "Entitlement": "entitlement",
    "Last Login": "last_login",
    "Account Status": "account_status",
    "Match Type": "match_type",
    "Risk Level": "risk_level",
    "Risk Score": "risk_score",
    "Review Action": None,
    "Review Note": "review_note",
    "Source File": "source_file",
    "Source Row": "source_row",
}
# Headings of the orphan and conflict sheets.
ORPHAN_HEADINGS = (
    "Source File", "Source System", "User ID", "Display Name", "Role", "Account Status", "Last Login",
    "Attempted Match Keys",
)
CONFLICT_HEADINGS = ("Canonical ID", "Field", "SoT Value", "Satellite Value", "Resolution")


def master_sheet(report: DataFrame) -> DataFrame:
    def cell(column: str | None) -> Column:
        return role_action_text() if column is None else F.col(column).cast("string")

    return report.select(*[cell(c).alias(h) for h, c in MASTER_COLUMNS.items()])


def orphan_sheet(matched: DataFrame) -> DataFrame:
    values = (
        F.col("system"), F.col("system"), F.col("user_id"), F.col("display_name"), F.col("role"),
        F.col("account_status"), F.col("last_login"), F.array_join("attempted", "; "),
    )
    rows = matched.where(F.col("match_type") == "orphan")
    return rows.select(*[v.alias(h) for h, v in zip(ORPHAN_HEADINGS, values)])


def conflict_sheet(matched: DataFrame) -> DataFrame:
    rows = matched.where(F.size("conflicts") > 0).select(
        F.col("sot.canonical_id").alias("canonical_id"), F.inline("conflicts")
    )
    source = ("canonical_id", "field", "sot_value", "satellite_value", "resolution")
    return rows.select(*[F.col(c).alias(h) for h, c in zip(CONFLICT_HEADINGS, source)])


def metadata_sheet(
    report: DataFrame, matched: DataFrame, identity: DataFrame, registry: DataFrame, processing_ms: int
) -> tuple[DataFrame, DataFrame]:
    """(one row of run facts, one row per file)."""
    when = F.timestamp_millis(F.lit(processing_ms).cast("long"))
    run = export_totals(report, matched).withColumns({
        "generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"),
        "processing_timestamp": F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"),
        "total_sot_users": identity.agg(F.count(F.lit(1))).scalar(),
    })
    files = registry.select(
        F.col("name").alias("File Name"),
        F.when(F.col("is_sot"), F.lit("Source of Truth")).otherwise(F.lit("Satellite")).alias("Type"),
        F.col("hash").alias("SHA-256 Hash"),
    )
    return run, files


def write_csv(sheet: DataFrame, path: str) -> None:
    """RFC 4180 text: CRLF line ends, quotes only where needed and doubled inside.

    One part file per task, each with the header; numbers of parts follow the data.
    """
    (
        sheet.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("lineSep", "\r\n")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
