"""Matches kept current under a changing employee list: only accounts whose match may change are matched again.

An account's match hangs on the employees that share its e-mail or id, or whose name is equal or similar to its own; and
on those only as far as the cascade gets. So the keys of added, removed and changed records, looked up backwards in
the stored matches, name every account to look at:

- by e-mail, whatever the match was;
- by id, if the e-mail didn't decide;
- by name, if neither did: names equal to a changed one, or similar to it by the same lossless join as the search itself.

The second best name counts only above the threshold, so names farther away have no say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import normalize_name
from attestor.operators.fuzzy import FuzzyRules, candidate_pairs
from attestor.operators.identity import IdentityIndex, build_index, first_by
from attestor.operators.match import ROW_ID, match_accounts
from attestor.operators.name_index import NameIndex
from attestor.operators.skew import BROADCAST_LIMIT, ROWS_PER_SPLIT, salted_lookup
from attestor.schema import ACCOUNT_COLUMNS, IDENTITY_COLUMNS
from attestor.session import write_through

BY_NAME = ("fuzzy_name", "fuzzy_ambiguous", "orphan")


def identity_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of one list that the other lacks, with ``change``: removed or added (a changed record is both)."""
    counted = lambda df, sign: df.select(*IDENTITY_COLUMNS, F.lit(sign).alias("_n"))
    left = counted(old, -1).unionByName(counted(new, 1)).groupBy(*IDENTITY_COLUMNS).agg(F.sum("_n").alias("_n")).where("_n != 0")
    return left.withColumn("change", F.when(F.col("_n") > 0, F.lit("added")).otherwise(F.lit("removed"))).drop("_n")


def _name_stage() -> Column:
    return F.col("match_type").isin(*BY_NAME)


def affected_names(matched: DataFrame, changes: DataFrame, rules: FuzzyRules = FuzzyRules()) -> DataFrame:
    """Distinct ``name_key`` of accounts in the name stage that a changed name equals or resembles."""
    changed = changes.where(F.col("normalized_name") != "").groupBy(F.col("normalized_name").alias("name_key")).agg(
        F.count(F.lit(1)).alias("holders"), F.min("sot_ord").alias("sot_ord"))
    changed = write_through(changed, "changed-names")
    sought = matched.where(_name_stage()).select(normalize_name(F.col("display_name")).alias("probe")).where("probe != ''").distinct()
    similar = candidate_pairs(write_through(sought, "open-names"), changed, rules).select(F.col("probe").alias("name_key"))
    return changed.select("name_key").unionByName(similar).distinct()


def mark_touched(
    matched: DataFrame, changes: DataFrame, rules: FuzzyRules = FuzzyRules(),
    rows_per_split: int = ROWS_PER_SPLIT, broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """``matched`` with ``touched``: whether a change may decide the account otherwise. Small change sets move no account."""
    opts = dict(rows_per_split=rows_per_split, broadcast_limit=broadcast_limit)
    keys = lambda c, alias: changes.select(c.alias(alias)).where(F.col(alias) != "").distinct()
    stage = F.when(_name_stage(), normalize_name(F.col("display_name"))).otherwise(F.lit(""))
    rows = matched.withColumn("name_key", stage)
    for table, key, flag in (
        (keys(F.lower("email"), "email"), "email", "_mail"), (keys(F.col("employee_id"), "user_id"), "user_id", "_uid"),
        (affected_names(matched, changes, rules), "name_key", "_name"),
    ):
        table = write_through(table, "touched-keys").withColumn(flag, F.lit(True))
        rows = salted_lookup(rows, table, key, ROW_ID, **opts)
    by_id = F.col("_uid").isNotNull() & (F.col("match_type") != "exact_email")
    touched = F.col("_mail").isNotNull() | by_id | F.col("_name").isNotNull()
    return rows.select(*matched.columns, touched.alias("touched"))


def narrow_index(identity: DataFrame, accounts: DataFrame, names: NameIndex | None = None) -> IdentityIndex:
    """The index of an employee list as far as ``accounts`` look it up by e-mail and id; names are whole, or those stored in ``names``."""
    rows = identity.select(*IDENTITY_COLUMNS)
    sought = lambda c, alias: accounts.select(F.col(c).alias(alias)).where(F.col(alias) != "").distinct()
    mail = rows.withColumn("email", F.lower("email")).join(sought("email", "email"), "email", "left_semi")
    uid = rows.join(sought("user_id", "employee_id"), "employee_id", "left_semi")
    return IdentityIndex(rows, first_by(mail, "email", "email"), first_by(uid, "employee_id", "user_id"), (names.names() if names else build_index(identity).by_name), names)


def rematch(
    matched: DataFrame, old: DataFrame, new: DataFrame, rules: FuzzyRules = FuzzyRules(), names: NameIndex | None = None, **opts,
) -> tuple[DataFrame, DataFrame]:
    """(matches under the new employee list, the touched accounts): equal to a full run, row by row.

    ``matched``: stored matches under ``old``. Without changes nothing is matched again. ``names``: a stored index that follows ``new``.
    """
    changes = write_through(identity_changes(old, new), "identity-changes")
    if changes.isEmpty():
        return matched, matched.limit(0).select(*ACCOUNT_COLUMNS)
    marked = mark_touched(matched, changes, rules, **opts)
    again = write_through(marked.where("touched").select(*ACCOUNT_COLUMNS), "touched-accounts")
    redone = match_accounts(again, narrow_index(new, again, names), rules, **opts)
    return marked.where("not touched").select(*matched.columns).unionByName(redone.select(*matched.columns)), again
