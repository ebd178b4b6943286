"""The match cascade: e-mail, then id, then name, else orphan.

Output: the account columns, ``match_type``, ``sot`` (struct, null for orphans),
``conflicts`` and ``attempted``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import normalize_name
from attestor.operators.fuzzy import FuzzyRules, resolve_names
from attestor.operators.identity import IdentityIndex, build_index, distinct_people
from attestor.operators.skew import (
    BROADCAST_LIMIT, ROWS_PER_SPLIT, fits_counted, hot_counts, hot_keys, salted_lookup,
)
from attestor.schema import ACCOUNT_COLUMNS, CONFLICT_TYPE
from attestor.session import write_through

ROW_ID = ["system", "source_row", "file_hash"]


def field_conflicts(sot_name: Column, account_name: Column) -> Column:
    """Display names that differ beyond case; the employee record always wins."""
    differs = (
        (sot_name != "") & (account_name != "") & (F.lower(sot_name) != F.lower(account_name))
    )
    entry = F.struct(
        F.lit("displayName").alias("field"),
        sot_name.alias("sot_value"),
        account_name.alias("satellite_value"),
        F.lit("sot_wins").alias("resolution"),
    )
    return F.when(F.coalesce(differs, F.lit(False)), F.array(entry)).otherwise(
        F.array().cast(CONFLICT_TYPE)
    )


def attempted_keys(match_type: Column) -> Column:
    """Keys tried in order until the first success; blank source fields are not tried.

    ``name_key`` holds the normalised name of rows that got as far as the name.
    """
    past_email = match_type != "exact_email"
    past_id = past_email & (match_type != "exact_id")

    def tried(cond: Column, kind: str, value: Column) -> Column:
        return F.when(cond, F.array(F.concat(F.lit(kind), value))).otherwise(F.array().cast("array<string>"))

    return F.concat(
        tried(F.col("email") != "", "email:", F.lower("email")),
        tried(past_email & (F.col("user_id") != ""), "employeeId:", F.col("user_id")),
        tried(past_id & (F.col("display_name") != "") & F.col("name_key").isNotNull(), "name:", F.col("name_key")),
    )


def _resolved(rows: DataFrame, index: IdentityIndex, rules: FuzzyRules) -> tuple[DataFrame, DataFrame]:
    """(distinct open names with row counts, their resolution), both written tables.

    Each is read several times and is small next to the accounts; written, they cost one pass,
    and the size of the resolution is known when the lookup is planned.
    """
    counts = rows.where(F.col("name_key") != "").groupBy("name_key").agg(F.count(F.lit(1)).alias("rows"))
    counts = write_through(counts, "open-names")
    return counts, write_through(resolve_names(counts, index, rules), "resolved-names")


def _single_pass(accounts, index: IdentityIndex, rules, rows_per_split, limit) -> DataFrame:
    """All accounts flow through broadcast lookups: no shuffle of the accounts at all."""
    opts = dict(rows_per_split=rows_per_split, broadcast_limit=limit)
    j = salted_lookup(accounts, index.by_email.withColumnRenamed("sot", "by_mail"), "email", ROW_ID, small=True, **opts)
    j = salted_lookup(j, index.by_id.withColumnRenamed("sot", "by_uid"), "user_id", ROW_ID, small=True, **opts)
    open_row = F.col("by_mail").isNull() & F.col("by_uid").isNull()
    j = j.withColumn(
        "name_key", F.when(open_row, normalize_name(F.col("display_name"))).otherwise(F.lit(""))
    )
    counts, names = _resolved(j, index, rules)
    names = names.select("name_key", F.col("match_type").alias("name_type"), F.col("sot").alias("by_nm"))
    j = salted_lookup(j, names, "name_key", ROW_ID, hot=hot_counts(counts, "name_key", rows_per_split), **opts)
    return j.select(
        *ACCOUNT_COLUMNS,
        F.when(F.col("by_mail").isNotNull(), F.lit("exact_email"))
        .when(F.col("by_uid").isNotNull(), F.lit("exact_id"))
        .otherwise(F.coalesce("name_type", F.lit("orphan")))
        .alias("match_type"),
        F.coalesce("by_mail", "by_uid", "by_nm").alias("sot"),
        "name_key",
    )


def _staged(accounts, index: IdentityIndex, rules, rows_per_split, limit) -> DataFrame:
    """Shuffled lookups: each stage passes on only the rows it could not match.

    A stage's rows are written with what they found, so an account is shuffled once per stage it takes part in: hits and
    misses are read from there. Rows with a blank key have no part in a stage and are not moved.
    """
    opts = dict(rows_per_split=rows_per_split, broadcast_limit=limit)
    hot = hot_keys(accounts, "email", "user_id", rows_per_split=rows_per_split)
    done, rest = [], accounts
    for table, key, label in ((index.by_email, "email", "exact_email"), (index.by_id, "user_id", "exact_id")):
        keyed = F.coalesce(F.col(key) != "", F.lit(False))
        found = salted_lookup(rest.where(keyed), table, key, ROW_ID, "left", hot=hot[key], small=False, **opts)
        # Misses are told by a flag: their records, all null, are not read.
        found = write_through(found.select(*ACCOUNT_COLUMNS, "sot", F.col("sot").isNotNull().alias("hit")), f"{label}-stage")
        hit = found.where("hit")
        done.append(hit.select(*ACCOUNT_COLUMNS, F.lit(label).alias("match_type"), "sot", F.lit("").alias("name_key")))
        rest = rest.where(~keyed).unionByName(found.where("not hit").select(*ACCOUNT_COLUMNS))
    # Counted and looked up: written, so that names are not normalised again for either.
    rest = write_through(rest.withColumn("name_key", normalize_name(F.col("display_name"))), "open-accounts")
    counts, names = _resolved(rest, index, rules)
    last = salted_lookup(
        rest, names, "name_key", ROW_ID, hot=hot_counts(counts, "name_key", rows_per_split), **opts
    ).select(
        *ACCOUNT_COLUMNS, F.coalesce("match_type", F.lit("orphan")).alias("match_type"), "sot", "name_key"
    )
    for part in done:
        last = last.unionByName(part)
    return last


def match_accounts(
    accounts: DataFrame,
    identity: DataFrame | IdentityIndex,
    rules: FuzzyRules = FuzzyRules(),
    rows_per_split: int = ROWS_PER_SPLIT,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Run the cascade. The size of the exact indexes picks broadcast or shuffled lookups.

    The name stage runs at once (its tables are written); the pass over the accounts that
    joins everything is lazy.
    """
    index = identity if isinstance(identity, IdentityIndex) else build_index(identity)
    if index.pieces is not None and index.pieces.rules.threshold != rules.threshold:
        raise ValueError("the stored index was cut for another threshold")
    if index.pieces is None:
        index = replace(index, by_name=write_through(index.by_name, "names"))
    rows = accounts.select(*ACCOUNT_COLUMNS).withColumn("email", F.lower("email"))
    # No key table has more rows than there are employees.
    small = fits_counted(index.identity, broadcast_limit)
    run = _single_pass if small else _staged
    matched = run(rows, index, rules, rows_per_split, broadcast_limit)
    return matched.select(
        *ACCOUNT_COLUMNS, "match_type", "sot",
        field_conflicts(F.col("sot.display_name"), F.col("display_name")).alias("conflicts"),
        attempted_keys(F.col("match_type")).alias("attempted"),
    )


def email_matches(accounts: DataFrame, identity: DataFrame, **opts) -> DataFrame:
    rows = accounts.where(F.col("email") != "").withColumn("email", F.lower("email"))
    return salted_lookup(rows, build_index(identity).by_email, "email", ROW_ID, "inner", **opts)


def id_matches(accounts: DataFrame, identity: DataFrame, **opts) -> DataFrame:
    rows = accounts.where(F.col("user_id") != "")
    return salted_lookup(rows, build_index(identity).by_id, "user_id", ROW_ID, "inner", **opts)


def orphans(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("match_type") == "orphan")


def no_access(matched: DataFrame, identity: DataFrame) -> DataFrame:
    """Reachable employees no account of any system was matched to."""
    seen = matched.where(F.col("sot").isNotNull()).select(F.col("sot.canonical_id").alias("canonical_id")).distinct()
    return distinct_people(identity).join(seen, "canonical_id", "left_anti")


def join_stats(matched: DataFrame) -> DataFrame:
    """Per system: rows processed and rows per outcome."""
    def of(kind: str) -> Column:
        return F.count_if(F.col("match_type") == kind)

    return matched.groupBy("system").agg(
        F.count(F.lit(1)).alias("total_processed"),
        of("exact_email").alias("exact_email"),
        of("exact_id").alias("exact_id"),
        of("fuzzy_name").alias("fuzzy_name"),
        of("fuzzy_ambiguous").alias("ambiguous"),
        of("orphan").alias("orphans"),
    )
