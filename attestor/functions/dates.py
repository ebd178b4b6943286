"""Last-login parsing without formatters: guarded casts, so bad text is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names accepted in text dates.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

_DATE = r"\d{4}-\d{2}-\d{2}"
_TIME = r"\d{2}:\d{2}:\d{2}(?:\.\d+)?"
ISO_ZONED = rf"^{_DATE}T{_TIME}(?:Z|[+-]\d{{2}}:\d{{2}})\z"
ISO_PLAIN = rf"^{_DATE}[T ]{_TIME}\z"
ISO_DATE = rf"^{_DATE}\z"
US_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{4})\z"
TEXT_DATE = (
    r"(?i)^(" + "|".join(MONTHS) + "|" + "|".join(m[:3] for m in MONTHS) + r") (\d{1,2}), (\d{4})\z"
)
DAY_MON_YEAR = r"(?i)^(\d{2})-(" + "|".join(m[:3] for m in MONTHS) + r")-(\d{4})\z"


def _month_number(name: Column) -> Column:
    short = F.lower(F.substring(name, 1, 3))
    return ((F.instr(F.lit("".join(m[:3] for m in MONTHS)), short) + 2) / 3).cast("int")


def _utc_midnight(year: Column, month: Column, day: Column) -> Column:
    text = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit("T00:00:00Z"))
    return text.try_cast("timestamp")


def parse_login(c: Column) -> Column:
    """Instant of a login text in any accepted layout (zone-less text is UTC); NULL otherwise."""
    us = [F.regexp_extract(c, US_DATE, i) for i in (1, 2, 3)]
    text = [F.regexp_extract(c, TEXT_DATE, i) for i in (1, 2, 3)]
    dmy = [F.regexp_extract(c, DAY_MON_YEAR, i) for i in (1, 2, 3)]
    return (
        F.when(c.rlike(ISO_ZONED), c.try_cast("timestamp"))
        .when(c.rlike(ISO_PLAIN), F.concat(c, F.lit("Z")).try_cast("timestamp"))
        .when(c.rlike(ISO_DATE), F.concat(c, F.lit("T00:00:00Z")).try_cast("timestamp"))
        .when(c.rlike(US_DATE), _utc_midnight(us[2], us[0], us[1]))
        .when(c.rlike(TEXT_DATE), _utc_midnight(text[2], _month_number(text[0]).cast("string"), text[1]))
        .when(c.rlike(DAY_MON_YEAR), _utc_midnight(dmy[2], _month_number(dmy[1]).cast("string"), dmy[0]))
    )


def is_dormant(c: Column, now_ms: int, days: int = 90) -> Column:
    """Parsed login strictly before ``now − days``; blank or unreadable text is not dormant."""
    days = days if days > 0 else 90
    limit = F.timestamp_millis(F.lit(now_ms - days * 86_400_000).cast("long"))
    return F.coalesce(parse_login(c) < limit, F.lit(False))
