"""Text expressions: name normalisation, accent folding, delimited lists, similarity."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters treated as blank when trimming.
BLANKS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Name suffixes, removed once each in this order.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "phd", "md", "dds", "esq", "cpa")

_ASCII_BLANK = r"[\t\n\f\r ]"
_BLANK_CLASS = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def suffix_pattern(end: str = r"\z") -> str:
    """One anchored pattern for the ordered, once-each removal.

    Stripping works from the end of the string outwards, so the outermost suffix comes
    first in NAME_SUFFIXES; read left to right the optional parts are in reverse order.
    """
    parts = [f"(?:,{s})?(?: {s})?" for s in reversed(NAME_SUFFIXES)]
    return "".join(parts) + end


# Where a suffix can start at all; lets the scan skip every other position at once.
SUFFIX_START = r"(?=[ ,](?:" + "|".join(NAME_SUFFIXES) + r")(?:[ ,]|\z))"
INITIAL_PATTERN = r"(?<![A-Za-z0-9_])[a-z]\.?" + _ASCII_BLANK
LAST_FIRST_PATTERN = (
    rf"(?s)^[{_BLANK_CLASS}]*([^,{_BLANK_CLASS}](?:[^,]*[^,{_BLANK_CLASS}])?)[{_BLANK_CLASS}]*,"
    rf"[{_BLANK_CLASS}]*([^{_BLANK_CLASS}](?:.*[^{_BLANK_CLASS}])?)[{_BLANK_CLASS}]*\z"
)


def trim_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


@lru_cache(maxsize=1)
def _folding_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to, multi): one-character foldings for ``translate`` and the few longer ones.

    Derived from the Unicode data: canonical decomposition minus nonspacing marks.
    """
    single, deleted, multi = [], [], {}
    # Planes beyond these hold no letters; Hangul syllables are decomposed by arithmetic.
    for cp in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000), *range(0xE0100, 0xE01F0)):
        ch = chr(cp)
        if not unicodedata.decomposition(ch) and unicodedata.category(ch) != "Mn":
            continue
        kept = "".join(
            x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn"
        )
        if kept == ch:
            continue
        if not kept:
            deleted.append(ch)
        elif len(kept) == 1:
            single.append((ch, kept))
        else:
            multi[ch] = kept
    source = "".join(a for a, _ in single) + "".join(deleted)
    return source, "".join(b for _, b in single), multi


def _decompose_long(c: Column) -> Column:
    """Characters whose decomposition keeps several letters (Hangul by arithmetic)."""
    _, _, multi = _folding_tables()
    lead = "".join(chr(0x1100 + i) for i in range(19))
    vowel = "".join(chr(0x1161 + i) for i in range(21))
    tail = "".join(chr(0x11A8 + i) for i in range(27))
    table = F.create_map(*[F.lit(x) for kv in multi.items() for x in kv])

    def one(ch: Column) -> Column:
        n = F.ascii(ch) - F.lit(0xAC00)
        t = F.pmod(n, F.lit(28))
        hangul = F.concat(
            F.substring(F.lit(lead), F.floor(n / 588).cast("int") + 1, F.lit(1)),
            F.substring(F.lit(vowel), F.floor(F.pmod(n, F.lit(588)) / 28).cast("int") + 1, F.lit(1)),
            F.when(t > 0, F.substring(F.lit(tail), t.cast("int"), F.lit(1))).otherwise(F.lit("")),
        )
        is_hangul = (ch >= F.lit("가")) & (ch <= F.lit("힣"))
        return F.when(is_hangul, hangul).otherwise(F.coalesce(F.try_element_at(table, ch), ch))

    return F.array_join(F.transform(F.split(c, ""), one), "")


def strip_diacritics(c: Column) -> Column:
    """Canonical decomposition without nonspacing marks; plain ASCII text passes untouched."""
    source, target, multi = _folding_tables()
    long_class = "[가-힣" + "".join(multi) + "]"
    decomposed = F.when(c.rlike(long_class), _decompose_long(c)).otherwise(c)
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(
        F.translate(decomposed, source, target)
    )


def normalize_name(c: Column) -> Column:
    """Lower, fold accents, drop suffixes and initials, collapse blanks, ``last, first`` → ``first last``."""
    s = strip_diacritics(F.lower(trim_blanks(c)))
    s = F.regexp_replace(s, SUFFIX_START + suffix_pattern(), "")
    s = F.regexp_replace(s, INITIAL_PATTERN, "")
    s = F.regexp_replace(s, _ASCII_BLANK + "+", " ")
    s = F.regexp_replace(s, LAST_FIRST_PATTERN, "$2 $1")
    return trim_blanks(s)


def similarity(a: Column, b: Column) -> Column:
    """1 − edit distance / longer length, in characters; equal strings score 1."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest.cast("double")
    )


def _has_delimiter(c: Column) -> Column:
    return F.contains(c, F.lit(",")) | F.contains(c, F.lit(";"))


def when_single(c: Column, item, several: Column) -> Column:
    """``several``, or for a text without a delimiter the array of ``item`` of its trimmed value (empty if that is blank).

    Most texts are one value; those go without a pattern and lambdas, which Spark interprets row by row.
    """
    one = trim_blanks(c)
    single = F.slice(F.array(item(one)), F.lit(1), F.when(one == "", F.lit(0)).otherwise(F.lit(1)))
    return F.when(~_has_delimiter(c), single).otherwise(several)


def split_tokens(c: Column) -> Column:
    """Values of a list delimited by comma or semicolon: trimmed, blanks dropped, order kept."""
    return F.filter(F.transform(F.split(c, "[,;]"), trim_blanks), lambda v: v != "")


def token_set(c: Column) -> Column:
    """Canonical text of the case-folded value set; equal text ⇔ equal set."""
    folded = F.transform(split_tokens(c), F.lower)
    return F.when(~_has_delimiter(c), F.lower(trim_blanks(c))).otherwise(F.array_join(F.array_sort(F.array_distinct(folded)), ","))


def union_tokens(*columns: Column) -> Column:
    """Case-insensitive union of delimited lists of one row, first casing and order kept."""
    values = F.flatten(F.array(*[split_tokens(c) for c in columns]))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        values,
        empty,
        lambda acc, v: F.when(F.exists(acc, lambda k: F.lower(k) == F.lower(v)), acc).otherwise(
            F.array_append(acc, v)
        ),
    )
    return F.array_join(kept, ", ")


def joined_non_blank(columns: list[Column], sep: str = "; ") -> Column:
    """Trimmed non-blank values joined by ``sep`` (``concat_ws`` skips nulls)."""
    return F.concat_ws(sep, *[F.nullif(trim_blanks(c), F.lit("")) for c in columns])
