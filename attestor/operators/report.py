"""Report assembly: canonical rows, consolidation per user and system, policy entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.risk import DORMANCY_DAYS, live_risk, policy_risk, risk_rank
from attestor.functions.text import token_set, trim_blanks, union_tokens
from attestor.operators.match import no_access
from attestor.operators.skew import hot_counts, salted_lookup
from attestor.operators.tokens import group_token_union
from attestor.session import write_through
from attestor.schema import (
    CONFLICT_TYPE, REPORT_COLUMNS, ROLE_ACTIONS_TYPE, blank_to_null, row_order,
)

POLICY_COLUMNS = (
    "canonical_id", "employee_id", "display_name", "email", "department", "manager",
    "employment_status", "system", "role", "entitlement", "last_login", "account_status",
    "match_type", "risk_level", "risk_score", "conflicts", "source_file", "source_row",
)


def _of_sot(field: str) -> Column:
    return F.coalesce(F.col(f"sot.{field}"), F.lit(""))


def live_rows(matched: DataFrame) -> DataFrame:
    """One canonical row per account: employee identity plus account access, live risk model."""
    orphan = F.col("match_type") == "orphan"
    fill = ~orphan & (trim_blanks(_of_sot("display_name")) == "") & (trim_blanks(F.col("display_name")) != "")
    admin = _of_sot("admin_info")
    risk = live_risk(_of_sot("employment_status"), F.col("account_status"), F.col("match_type"))
    owner = F.when(orphan, F.lit("orphan")).otherwise(_of_sot("canonical_id"))
    return matched.select(
        F.concat_ws("::", owner, "system", F.col("source_row").cast("string")).alias("record_id"),
        F.when(orphan, F.col("user_id")).otherwise(_of_sot("employee_id")).alias("employee_id"),
        F.when(orphan | fill, F.col("display_name")).otherwise(_of_sot("display_name")).alias("display_name"),
        F.when(orphan, F.col("email")).otherwise(_of_sot("email")).alias("email"),
        _of_sot("department").alias("department"),
        _of_sot("manager").alias("manager"),
        _of_sot("employment_status").alias("employment_status"),
        "system",
        F.concat_ws("; ", blank_to_null("role"), blank_to_null(admin)).alias("role"),
        "entitlement", "last_login", "account_status",
        F.when(fill, F.lit("flag")).alias("review_action"),
        F.when(
            fill,
            F.concat(F.lit("Display name sourced from satellite ("), "system", F.lit("), not present in SoT")),
        ).otherwise(F.lit("")).alias("review_note"),
        F.lit(None).cast(ROLE_ACTIONS_TYPE).alias("role_actions"),
        F.col("system").alias("source_file"),
        "source_row", "match_type",
        risk["risk_level"].alias("risk_level"),
        risk["risk_score"].alias("risk_score"),
        "file_hash",
    )


def identity_key() -> Column:
    """One user in one system: by e-mail, or by display name where there is none."""
    user = F.when(F.col("email") != "", F.lower("email")).otherwise(
        F.concat(F.lit("name:"), F.lower("display_name"))
    )
    return F.concat_ws("::", user, "system")


def dedupe(report: DataFrame) -> DataFrame:
    """Consolidate rows of the same user and system.

    The lowest source row is kept; roles and entitlements are united, the highest risk and the
    latest login win, differing role sets flag the row. All per-group values are mergeable
    aggregates. Value lists are only taken apart for groups whose texts differ. ``report`` is
    read twice: pass a stored table when it is costly to compute. The groups are written at once, so that
    they are put together once and counted before they are looked up.
    """
    rows = report.select(*REPORT_COLUMNS, identity_key().alias("_key"))
    access = F.struct("role", "entitlement")
    groups = rows.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct(*REPORT_COLUMNS), row_order()).alias("first"),
        F.max_by(
            F.struct("risk_level", "risk_score"), F.struct(F.col("risk_score"), risk_rank(F.col("risk_level")))
        ).alias("risk"),
        F.max(blank_to_null("last_login")).alias("login"),
        (F.min(access) != F.max(access)).alias("mixed"),
        (F.min(token_set(F.col("role"))) != F.max(token_set(F.col("role")))).alias("roles_differ"),
    )
    groups = write_through(groups, "groups")
    # Rows without e-mail and name share one key per system: that group may be huge.
    mixed_rows = salted_lookup(
        rows.select("_key", "role", "entitlement", "source_row", "file_hash"), groups.where("mixed").select("_key"), "_key", ["source_row", "file_hash"], "left_semi",
        hot=hot_counts(groups.select("_key", F.col("n").alias("rows")), "_key"),
    )
    united = group_token_union(mixed_rows, "_key", row_order(), ["role", "entitlement"])

    def access_of(field: str) -> Column:
        raw = F.col(f"first.{field}")
        return (
            F.when(F.col("n") == 1, raw)
            .when(~F.col("mixed"), union_tokens(raw))
            .otherwise(F.coalesce(f"{field}_union", F.lit("")))
        )

    note = F.concat(
        F.lit("Duplicate entries found with different roles ("), F.col("n").cast("string"), F.lit(" rows merged)")
    )
    new = {
        "role": access_of("role"),
        "entitlement": access_of("entitlement"),
        "risk_level": F.col("risk.risk_level"),
        "risk_score": F.col("risk.risk_score"),
        "last_login": F.coalesce("login", F.lit("")),
        "review_action": F.when(F.col("roles_differ"), F.lit("flag")).otherwise(F.col("first.review_action")),
        "review_note": F.when(F.col("roles_differ"), note).otherwise(F.col("first.review_note")),
    }
    # As many rows as there are mixed groups, whatever the planner makes of file sizes: never sent through the driver.
    return groups.join(united.hint("merge"), "_key", "left").select(
        *[new.get(c, F.col(f"first.{c}")).alias(c) for c in REPORT_COLUMNS]
    )


def policy_entries(
    matched: DataFrame,
    identity: DataFrame,
    now_ms: int,
    dormancy_days: int = DORMANCY_DAYS,
    keywords=None,
) -> DataFrame:
    """Policy report: every account scored by the policy model, plus employees without access."""
    risk = policy_risk(
        _of_sot("employment_status"), F.col("account_status"), F.col("role"), F.col("entitlement"),
        F.col("last_login"), F.col("match_type"), now_ms, dormancy_days, keywords,
    )
    orphan = F.col("match_type") == "orphan"
    # A column of its own: written out under both fields, the login would be parsed for each of them.
    accounts = matched.withColumn("_risk", risk).select(
        _of_sot("canonical_id").alias("canonical_id"),
        _of_sot("employee_id").alias("employee_id"),
        F.when(orphan, F.col("display_name")).otherwise(_of_sot("display_name")).alias("display_name"),
        F.when(orphan, F.col("email")).otherwise(_of_sot("email")).alias("email"),
        _of_sot("department").alias("department"),
        _of_sot("manager").alias("manager"),
        _of_sot("employment_status").alias("employment_status"),
        "system", "role", "entitlement", "last_login", "account_status", "match_type",
        F.col("_risk.risk_level"),
        F.col("_risk.risk_score"),
        "conflicts",
        F.col("system").alias("source_file"),
        "source_row",
    )
    empty = ("system", "role", "entitlement", "last_login", "account_status", "source_file")
    idle = no_access(matched, identity).select(
        "canonical_id", "employee_id", "display_name", "email", "department", "manager", "employment_status",
        *[F.lit("").alias(c) for c in empty],
        F.lit("no_access").alias("match_type"),
        F.lit("INFO").alias("risk_level"),
        F.lit(0).alias("risk_score"),
        F.array().cast(CONFLICT_TYPE).alias("conflicts"),
        F.lit(0).cast(accounts.schema["source_row"].dataType).alias("source_row"),
    )
    return accounts.select(*POLICY_COLUMNS).unionByName(idle.select(*POLICY_COLUMNS))
