"""Risk models as single projections: struct<risk_level, risk_score>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.dates import is_dormant
from attestor.functions.text import split_tokens

# Default keywords marking privileged access.
PRIVILEGED_KEYWORDS = (
    "admin", "root", "superuser", "owner", "global_admin", "domain_admin", "system", "privileged",
)
DORMANCY_DAYS = 90


def _verdict(level: str, score: int) -> Column:
    return F.struct(F.lit(level).alias("risk_level"), F.lit(score).alias("risk_score"))


def contains_any(text: Column, keywords) -> Column:
    """Case-insensitive substring test against a keyword list (short, so OR-ed)."""
    lowered = F.lower(text)
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(lowered, F.lit(k.lower()))
    return hit


def is_privileged(role: Column, entitlement: Column, keywords=None) -> Column:
    """Either field holds a keyword. ``None`` means the default list, an empty list matches nothing."""
    words = PRIVILEGED_KEYWORDS if keywords is None else tuple(keywords)
    return contains_any(role, words) | contains_any(entitlement, words)


def is_privileged_row(role: Column, entitlement: Column, keywords=None) -> Column:
    """Report-view test: keywords are looked up in ``role + ' ' + entitlement``."""
    words = PRIVILEGED_KEYWORDS if keywords is None else tuple(keywords)
    return contains_any(F.concat(role, F.lit(" "), entitlement), words)


def privileged_tokens(role: Column, keywords=None) -> Column:
    words = PRIVILEGED_KEYWORDS if keywords is None else tuple(keywords)
    return F.filter(split_tokens(role), lambda v: contains_any(v, words))


def policy_risk(
    employment_status: Column,
    account_status: Column,
    role: Column,
    entitlement: Column,
    last_login: Column,
    match_type: Column,
    now_ms: int,
    dormancy_days: int = DORMANCY_DAYS,
    keywords=None,
) -> Column:
    """Policy model. A contractor with privileged access is MEDIUM like any privileged account."""
    privileged = is_privileged(role, entitlement, keywords)
    dormant = is_dormant(last_login, now_ms, dormancy_days)
    open_account = F.lower(account_status).isin("active", "enabled", "")
    return (
        F.when(match_type == "orphan", _verdict("HIGH", 80))
        .when(match_type == "no_access", _verdict("INFO", 0))
        .when((F.lower(employment_status) == "terminated") & open_account, _verdict("CRITICAL", 100))
        .when(privileged, F.when(dormant, _verdict("HIGH", 80)).otherwise(_verdict("MEDIUM", 50)))
        .when(dormant, _verdict("MEDIUM", 50))
        .when(match_type == "fuzzy_ambiguous", _verdict("LOW", 20))
        .otherwise(_verdict("INFO", 0))
    )


def live_risk(employment_status: Column, account_status: Column, match_type: Column) -> Column:
    """Live model: the match quality sets the base, an active leaver is critical."""
    leaver = (F.lower(employment_status) == "terminated") & (F.lower(account_status) == "active")
    return (
        F.when(match_type == "orphan", _verdict("HIGH", 75))
        .when(leaver, _verdict("CRITICAL", 95))
        .when(match_type == "fuzzy_ambiguous", _verdict("HIGH", 70))
        .when(match_type == "fuzzy_name", _verdict("MEDIUM", 50))
        .when(match_type == "exact_id", _verdict("LOW", 25))
        .when(match_type == "exact_email", _verdict("INFO", 10))
        .otherwise(_verdict("MEDIUM", 50))
    )


def risk_rank(level: Column) -> Column:
    """INFO 0 … CRITICAL 4."""
    return F.array_position(
        F.array(*[F.lit(x) for x in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")]), level
    ).cast("int") - 1
