"""Aggregations over the report: risk counts, per-user summaries, totals, admin roles, matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.risk import is_privileged_row, privileged_tokens
from attestor.operators.skew import salted_lookup
from attestor.schema import RISK_LEVELS, blank_to_null
from attestor.session import write_through


def risk_summary(report: DataFrame) -> DataFrame:
    """(risk_level, records) for all five levels, zero included; one pass, one row per task shuffled."""
    counts = report.agg(*[F.count_if(F.col("risk_level") == x).alias(x) for x in RISK_LEVELS])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(x).alias("risk_level"), F.col(x).alias("records")) for x in RISK_LEVELS]))
    )


def user_summary(entries: DataFrame) -> DataFrame:
    """Per employee: highest risk, first non-blank name and e-mail, number of entries.

    Orphans belong to nobody. The entries themselves stay in the entry table (``user_entries``
    nests them in bounded chunks).
    """
    order = F.struct("system", "source_row")
    return (
        entries.where(F.col("match_type") != "orphan")
        .groupBy("canonical_id")
        .agg(
            F.coalesce(
                F.min_by("display_name", F.when(F.col("display_name") != "", order)), F.lit("")
            ).alias("display_name"),
            F.coalesce(F.min_by("email", F.when(F.col("email") != "", order)), F.lit("")).alias("email"),
            F.max_by("risk_level", "risk_score").alias("max_risk_level"),
            F.max("risk_score").alias("max_risk_score"),
            F.count(F.lit(1)).alias("entries"),
        )
    )


def user_entries(entries: DataFrame, chunk_rows: int = 1000) -> DataFrame:
    """(canonical_id, chunk, chunks, entries[]): nested entries, split for users with very many."""
    # A blank id is a user like others here, so the key is prefixed.
    mine = entries.where(F.col("match_type") != "orphan").withColumn("_user", F.concat(F.lit("u"), "canonical_id"))
    large = (
        mine.groupBy("_user").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > chunk_rows)
        .select("_user", F.ceil(F.col("n") / chunk_rows).cast("int").alias("_chunks"))
    )
    large = write_through(large, "large-users")
    chunks = F.coalesce("_chunks", F.lit(1))
    return (
        salted_lookup(mine, large, "_user", ["system", "source_row"])
        .withColumns({
            "chunks": chunks,
            "chunk": F.pmod(F.xxhash64("system", "source_row"), chunks).cast("int"),
        })
        .groupBy("canonical_id", "chunk", "chunks")
        .agg(F.array_sort(F.collect_list(F.struct("system", "source_row", *[
            c for c in entries.columns if c not in ("canonical_id", "system", "source_row")
        ]))).alias("entries"))
    )


def report_totals(entries: DataFrame) -> DataFrame:
    kind = F.col("match_type")
    return entries.agg(
        F.count_distinct(F.when(kind != "orphan", F.col("canonical_id"))).alias("users"),
        F.count_if(~kind.isin("orphan", "no_access")).alias("matched"),
        F.count_if(kind == "orphan").alias("orphans"),
        F.count_if(kind == "no_access").alias("no_access"),
    )


def export_totals(report: DataFrame, matched: DataFrame) -> DataFrame:
    """One row of run totals; field conflicts come from the matches behind the report."""
    kind = F.col("match_type")
    totals = report.agg(
        F.count_if(~kind.isin("orphan", "no_access")).alias("total_matched"),
        F.count_if(kind == "orphan").alias("total_orphans"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_findings"),
    )
    conflicts = matched.agg(F.coalesce(F.sum(F.size("conflicts")), F.lit(0)).alias("total_conflicts"))
    return totals.withColumn("total_conflicts", conflicts.scalar())


def systems(report: DataFrame) -> DataFrame:
    return report.where(F.col("system") != "").select("system").distinct().orderBy("system")


def system_names(report: DataFrame) -> list[str]:
    """System names as column headings. ``access_cells`` has no columns per system and suits any number."""
    return [r.system for r in systems(report).collect()]


def admin_role_entries(report: DataFrame, keywords=None) -> DataFrame:
    """(email, entry, at): distinct ``system: role`` of privileged roles and where each comes first.

    One row per entry, so the blank e-mail of all orphans is no group of its own.
    """
    rows = report.where(is_privileged_row(F.col("role"), F.col("entitlement"), keywords)).select(
        F.lower("email").alias("email"),
        "system", "source_row", "record_id",
        F.posexplode(privileged_tokens(F.col("role"), keywords)).alias("pos", "token"),
    )
    at = F.struct("system", "source_row", "record_id", "pos")
    return rows.groupBy("email", F.concat_ws(": ", "system", "token").alias("entry")).agg(F.min(at).alias("at"))


def admin_roles(report: DataFrame, keywords=None) -> DataFrame:
    """(email, admin_roles): the entries of each e-mail as a list, in report order.

    The list of the blank e-mail holds every distinct role of all orphans; where those may be
    very many, use ``admin_role_entries``.
    """
    return admin_role_entries(report, keywords).groupBy("email").agg(
        F.array_sort(F.collect_list(F.struct("at", "entry"))).alias("l")
    ).select("email", F.col("l.entry").alias("admin_roles"))


def _cell():
    return F.concat(
        F.col("role"),
        F.when(F.col("entitlement") != "", F.concat(F.lit(" ("), "entitlement", F.lit(")"))).otherwise(F.lit("")),
    )


def own_system_cell(system: str, blank: str = "—"):
    return F.when(F.col("system") == system, _cell()).otherwise(F.lit(blank))


def access_matrix_rows(report: DataFrame, names: list[str], blank: str = "—") -> DataFrame:
    """Row view: the row's access under its own system, a dash under the others."""
    return report.select(
        "record_id", "display_name", "email",
        *[own_system_cell(s, blank).alias(s) for s in names],
    )


def _user():
    return F.when(F.col("email") != "", F.lower("email")).otherwise(F.concat(F.lit("name:"), F.lower("display_name")))


def access_cells(report: DataFrame) -> DataFrame:
    """The matrix in long form: (user, system, cell), one row per user and system that holds access."""
    cell = blank_to_null(F.array_join(F.array_sort(F.collect_set(_cell())), " | "))
    return report.groupBy(_user().alias("user"), "system").agg(cell.alias("cell")).where(F.col("cell").isNotNull())


def access_matrix(report: DataFrame, names: list[str], blank: str = "—") -> DataFrame:
    """User view: one row per user, one column per system; several rows of a cell are listed."""
    return report.groupBy(_user().alias("user")).agg(
        *[
            F.coalesce(
                blank_to_null(
                    F.array_join(F.array_sort(F.collect_set(F.when(F.col("system") == s, _cell()))), " | ")
                ),
                F.lit(blank),
            ).alias(s)
            for s in names
        ]
    )
