"""Column mapping: which raw header feeds which canonical field.

Planning works on header names only (driver metadata); the result is a list of columns.
``infer_targets`` is the same inference as a column expression, for tables of many files.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.schema import TARGET_FIELDS

# Headers (lower case, without blanks, underscores and hyphens) with a known meaning.
KNOWN_HEADERS = {
    "email": ("email", "emailaddress", "mail", "userprincipalname", "upn"),
    "userId": ("userid", "username", "samaccountname", "login", "uid", "account", "accountname"),
    "employeeId": ("employeeid", "personnelnumber"),
    "displayName": ("displayname", "fullname", "name", "cn"),
    "department": ("department", "dept", "division", "org", "organizationalunit", "ou"),
    "manager": ("manager", "managername", "supervisor", "reportsto"),
    "accountStatus": ("status", "accountstatus", "enabled", "active"),
    "employmentStatus": ("employmentstatus", "empstatus"),
    "role": ("role", "rolename", "group", "groupname", "memberof"),
    "entitlement": ("entitlement", "permission", "access", "accesslevel", "privilege"),
    "lastLogin": ("lastlogin", "lastlogon", "lastlogontimestamp", "lastsignin", "lastactivity"),
}
# Text parts looked for, in this order, when a header is not known.
HEADER_PARTS = (
    ("email", "email"), ("mail", "email"), ("upn", "email"),
    ("employeeid", "employeeId"), ("empid", "employeeId"),
    ("userid", "userId"), ("username", "userId"), ("login", "userId"),
    ("displayname", "displayName"), ("fullname", "displayName"), ("name", "displayName"),
    ("department", "department"), ("dept", "department"), ("division", "department"),
    ("manager", "manager"), ("supervisor", "manager"), ("reportsto", "manager"),
    ("employmentstatus", "employmentStatus"), ("empstatus", "employmentStatus"),
    ("accountstatus", "accountStatus"), ("status", "accountStatus"), ("enabled", "accountStatus"),
    ("entitlement", "entitlement"), ("permission", "entitlement"), ("privilege", "entitlement"),
    ("accesslevel", "entitlement"),
    ("role", "role"), ("group", "role"), ("memberof", "role"),
    ("lastlogin", "lastLogin"), ("lastlogon", "lastLogin"), ("lastsignin", "lastLogin"),
    ("lastactivity", "lastLogin"),
)
_PLACEHOLDER = re.compile(r"\{([^{}]*)\}")
_TARGET_OF = {h: t for t, headers in KNOWN_HEADERS.items() for h in headers}


@dataclass(frozen=True)
class Concat:
    sources: tuple[str, ...]
    separator: str
    target: str


@dataclass(frozen=True)
class Split:
    source: str
    separator: str
    index: int
    target: str


@dataclass(frozen=True)
class Template:
    """``template`` holds ``{header}`` placeholders."""

    template: str
    target: str


@dataclass(frozen=True)
class ColumnMapping:
    direct: dict[str, str] = field(default_factory=dict)
    concat: tuple[Concat, ...] = ()
    split: tuple[Split, ...] = ()
    template: tuple[Template, ...] = ()

    def is_empty(self) -> bool:
        return not (self.direct or self.concat or self.split or self.template)


def load_mapping(text: str | None) -> ColumnMapping:
    """Mapping from its JSON form; blank or invalid JSON is the empty mapping."""
    try:
        raw = json.loads(text or "{}")
        return ColumnMapping(
            direct=dict(raw.get("direct") or {}),
            concat=tuple(
                Concat(tuple(c["sourceColumns"]), c.get("separator", ""), c["targetField"])
                for c in raw.get("concat") or ()
            ),
            split=tuple(
                Split(c["sourceColumn"], c.get("separator", ""), int(c.get("index", 0)), c["targetField"])
                for c in raw.get("split") or ()
            ),
            template=tuple(Template(c["template"], c["targetField"]) for c in raw.get("template") or ()),
        )
    except (ValueError, TypeError, KeyError, AttributeError):
        return ColumnMapping()


def validate_mapping(mapping: ColumnMapping) -> None:
    """Each target at most once among direct mappings, and only known targets."""
    seen: dict[str, str] = {}
    problems = []
    for source, target in mapping.direct.items():
        if target in seen:
            problems.append(f'{source!r}: "{target}" already mapped to {seen[target]}')
        seen.setdefault(target, source)
    targets = [*mapping.direct.values(), *[t.target for t in (*mapping.concat, *mapping.split, *mapping.template)]]
    problems += [f"unknown field {t!r}" for t in targets if t not in TARGET_FIELDS]
    if problems:
        raise ValueError("; ".join(problems))


def mapping_problems(entries: DataFrame) -> DataFrame:
    """The entries of many mappings that ``validate_mapping`` rejects; ``entries``: unit, pos, source, target.

    Adds ``problem``. A field belongs to the first entry that names it.
    """
    first = F.first("source").over(W.partitionBy("unit", "target").orderBy("pos"))
    owned = entries.withColumn("_owner", first).withColumn("_at", F.row_number().over(W.partitionBy("unit", "target").orderBy("pos")))
    problem = F.when(~F.col("target").isin(*TARGET_FIELDS), F.concat(F.lit("unknown field "), "target")).when(
        F.col("_at") > 1, F.concat("target", F.lit(" already mapped to "), "_owner"))
    return owned.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("_owner", "_at")


def normalize_header(header: str) -> str:
    return header.strip().lower().translate({ord(c): None for c in " _-"})


def known_target(header: str) -> str | None:
    return _TARGET_OF.get(normalize_header(header))


def auto_mapping(headers: list[str]) -> dict[str, str]:
    """Known headers only; the leftmost header gets the field."""
    result: dict[str, str] = {}
    for h in headers:
        target = known_target(h)
        if target and target not in result.values():
            result[h] = target
    return result


def infer_mapping(headers: list[str]) -> dict[str, str]:
    """In header order: the known field if free, else the first matching part whose field is free."""
    result: dict[str, str] = {}
    for h in headers:
        n = normalize_header(h)
        candidates = [_TARGET_OF[n]] if n in _TARGET_OF else []
        candidates += [target for part, target in HEADER_PARTS if part in n]
        free = [t for t in candidates if t not in result.values()]
        if free:
            result[h] = free[0]
    return result


def normalized_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[ _-]", "")


def infer_targets(headers: Column) -> Column:
    """Array of the inferred field per header ('' = unmapped) for an array of one file's headers."""
    known = F.create_map(*[F.lit(x) for h, t in _TARGET_OF.items() for x in (h, t)])
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(t).alias("target")) for p, t in HEADER_PARTS])

    def step(done: Column, header: Column) -> Column:
        n = normalized_header(header)
        by_part = F.transform(F.filter(parts, lambda r: F.contains(n, r["part"])), lambda r: r["target"])
        candidates = F.concat(F.array_compact(F.array(F.try_element_at(known, n))), by_part)
        free = F.filter(candidates, lambda t: ~F.array_contains(done, t))
        return F.array_append(done, F.coalesce(F.get(free, F.lit(0)), F.lit("")))

    return F.aggregate(headers, F.array().cast("array<string>"), step)


def raw(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def mapped_fields(headers: list[str], mapping: ColumnMapping | str | None = None) -> dict[str, Column]:
    """{field: column} for a file. ``mapping``: None/"auto", "infer" or a ColumnMapping."""
    if mapping == "infer":
        direct = infer_mapping(headers)
    elif mapping in (None, "auto") or mapping.is_empty():
        direct = auto_mapping(headers)
    else:
        direct = mapping.direct
    fields: dict[str, Column] = {}
    for h in headers:
        if h in direct:
            fields.setdefault(direct[h], raw(h))
    if isinstance(mapping, ColumnMapping):
        present = set(headers)
        for t in mapping.concat:
            parts = [F.nullif(raw(s), F.lit("")) for s in t.sources if s in present]
            if parts:
                _override(fields, t.target, F.concat_ws(t.separator, *parts))
        for t in mapping.split:
            if t.source in present:
                _override(fields, t.target, split_part(raw(t.source), t.separator, t.index))
        for t in mapping.template:
            _override(fields, t.target, fill_template(t.template, headers))
    return fields


def _override(fields: dict[str, Column], target: str, value: Column) -> None:
    fallback = fields.get(target, F.lit(""))
    fields[target] = F.coalesce(F.nullif(value, F.lit("")), fallback)


def split_part(c: Column, separator: str, index: int) -> Column:
    """The ``index``-th part (from 0), trimmed; '' beyond the end."""
    if not separator:
        return c if index == 0 else F.lit("")
    quoted = "".join("\\" + ch if not ch.isalnum() and ord(ch) < 128 else ch for ch in separator)
    return F.coalesce(F.trim(F.get(F.split(c, quoted), F.lit(index))), F.lit(""))


def fill_template(template: str, headers: list[str]) -> Column:
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        name, close, after = tail.partition("}")
        if brace and close and name in headers:
            parts += [F.lit(head), raw(name)]
            rest = after
        else:
            parts.append(F.lit(head + brace))
            rest = tail
    return F.concat(*parts) if parts else F.lit("")


def _last_place(headers: Column, name: Column) -> Column:
    """Place of a header, from 0; of equal ones, the last. Null if there is none."""
    back = F.array_position(F.reverse(headers), name)
    return F.when(back > 0, (F.size(headers) - back).cast("int"))


def _sources(mapping: ColumnMapping) -> list[str]:
    """Every header that a mapping names."""
    names = [*mapping.direct, *[s for t in mapping.concat for s in t.sources], *[t.source for t in mapping.split]]
    names += [n for t in mapping.template for n in _PLACEHOLDER.findall(t.template)]
    return sorted(set(names))


def _planned(mapping: ColumnMapping | str | None) -> bool:
    return isinstance(mapping, ColumnMapping) and not mapping.is_empty()


def file_positions(headers: Column, mapping: ColumnMapping | str | None = None) -> Column:
    """Struct of places in a file's rows: of target fields (auto, infer), or of the headers that a mapping names.

    It is a column of files, so that one plan serves files of any headers.
    """
    if _planned(mapping):
        return F.struct(*[_last_place(headers, F.lit(n)).alias(f"p{i}") for i, n in enumerate(_sources(mapping) or [""])])
    names = F.array_distinct(headers)
    if mapping == "infer":
        targets = infer_targets(names)
    else:
        known = F.create_map(*[F.lit(x) for h, t in _TARGET_OF.items() for x in (h, t)])
        targets = F.transform(names, lambda h: F.coalesce(F.try_element_at(known, normalized_header(h)), F.lit("")))
    found = lambda t: F.get(names, (F.nullif(F.array_position(targets, F.lit(t)), F.lit(0)) - 1).cast("int"))
    return F.struct(*[_last_place(headers, found(t)).alias(t) for t in TARGET_FIELDS])


def admin_positions(headers: Column) -> Column:
    """Places of the headers that speak of admins, by name."""
    names = F.array_sort(F.filter(F.array_distinct(headers), lambda h: F.contains(F.lower(h), F.lit("admin"))))
    return F.transform(names, lambda h: _last_place(headers, h))


def _cell(place: Column) -> Column:
    """The field at a place: blank if the row is short, null if the file has no such header."""
    return F.when(place.isNotNull(), F.coalesce(F.get("_fields", place), F.lit("")))


def placed_fields(mapping: ColumnMapping | str | None = None) -> dict[str, Column]:
    """{field: column} over rows with ``_fields`` and ``_pos`` (see ``file_positions``)."""
    if not _planned(mapping):
        return {t: _cell(F.col(f"_pos.{t}")) for t in TARGET_FIELDS}
    value = {n: _cell(F.col(f"_pos.p{i}")) for i, n in enumerate(_sources(mapping))}
    fields: dict[str, Column] = {t: F.coalesce(value[h], F.lit("")) for h, t in reversed(mapping.direct.items())}
    for t in mapping.concat:
        _override(fields, t.target, F.concat_ws(t.separator, *[F.nullif(value[s], F.lit("")) for s in t.sources]))
    for t in mapping.split:
        _override(fields, t.target, split_part(value[t.source], t.separator, t.index))
    for t in mapping.template:
        pieces = _PLACEHOLDER.split(t.template)
        filled = [F.lit(x) if i % 2 == 0 else F.coalesce(value[x], F.lit("{" + x + "}")) for i, x in enumerate(pieces)]
        _override(fields, t.target, F.concat(*filled))
    return fields


def admin_headers(headers: list[str]) -> list[str]:
    return sorted(h for h in headers if "admin" in h.lower())
