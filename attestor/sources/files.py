"""Export files: registry (hash, encoding, header, system), rows, warnings.

Registry rows are one per file. Files of every size are read line by line over many tasks, so
fingerprint, encoding and header don't depend on a file's size or on how it is split; one pass gives them all.

Rows of all files come from one scan, whatever their headers: a row is an array of fields, and a file's row of
the registry says at which places the wanted fields are.
""" 

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.session import write_through
from attestor.sources.mapping import ColumnMapping, admin_positions, file_positions, load_mapping, validate_mapping
from attestor.sources.normalize import place_accounts, place_identity
from attestor.sources.records import WIDE, decoded, fields, line_text, opens, raw_lines, read_records

# Trailing words dropped from a file name to get the system name.
EXPORT_WORDS = ("export", "users", "roles", "accounts", "access", "report", "data", "dump", "extract")
# Messages of unusable files.
NO_HEADER = "empty file: no header row found"
NO_ROWS = "file contains no data rows"

REGISTRY_COLUMNS = (
    "path", "uri", "unit", "name", "size", "hash", "encoding", "header", "headers", "system", "is_sot", "status", "error",
)

def system_name(file_name: Column) -> Column:
    stem = F.regexp_replace(file_name, r"\.[^.]+\z", "")
    cut = F.regexp_replace(stem, r"(?i)[_\s-]?(" + "|".join(EXPORT_WORDS) + r")\z", "")
    return F.coalesce(F.nullif(cut, F.lit("")), stem)


def _header_fields(text: Column) -> Column:
    return F.transform(fields(text), lambda h: F.regexp_replace(h, r"^[ \t\r\n]+|[ \t\r\n]+\z", ""))


def _facts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """uri, size, hash, encoding, head (first line that isn't empty), filled (number of these), from one pass.

    The fingerprint digests sums of 30-bit halves of each line's hash, plain and times its number: 120 bits that depend on
    content and order. A line's number is known within its task; both sums of a block are enough
    to shift it by the lines of earlier blocks, so the pass needs no numbering first. A UTF-8 byte order mark is dropped
    by the line reader, so a file with one is three bytes longer than its lines.
    """
    raw = raw_lines(spark, paths).withColumn("text", line_text())
    place = F.col("at").bitwiseAND(F.lit(2**33 - 1))
    whole = F.xxhash64("value")
    halves = {"a": whole.bitwiseAND(F.lit(2**30 - 1)), "b": F.shiftrightunsigned(whole, 34)}
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    filled = F.col("text") != ""
    blocks = raw.withColumns(halves).groupBy("uri", "size", "block").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n"),
        *[wide(F.col(h)).alias(h) for h in halves], *[wide(F.col(h) * place).alias(f"{h}_at") for h in halves],
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.every(F.is_valid_utf8(F.col("value").cast("string"))).alias("valid"),
        F.min_by(F.hex(F.substring("value", 1, 2)), "at").alias("start"), F.count_if(filled).alias("filled"),
        F.min_by(F.when(filled, F.col("text")), F.when(filled, F.col("at"))).alias("head"),
    )
    earlier = W.partitionBy("uri").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    moved = blocks.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    facts = moved.groupBy("uri", "size").agg(
        F.sum("n").alias("lines"), *[F.sum(h).alias(h) for h in halves],
        *[F.sum(F.col(f"{h}_at") + F.col(h) * F.col("shift")).cast("decimal(38,0)").alias(f"{h}_at") for h in halves],
        F.sum("bytes").alias("bytes"), F.every("valid").alias("valid"), F.min_by("start", "block").alias("start"),
        F.sum("filled").alias("filled"), F.min_by("head", F.when(F.col("head").isNotNull(), F.col("block"))).alias("head"),
    )
    encoding = (
        F.when(F.startswith("start", F.lit("FFFE")), F.lit("utf-16le")).when(F.startswith("start", F.lit("FEFF")), F.lit("utf-16be"))
        .when(~F.col("valid"), F.lit("latin-1")).when(F.col("bytes") < F.col("size"), F.lit("utf-8-bom")).otherwise(F.lit("utf-8"))
    )
    parts = [f"cast({c} as string)" for c in ("size", "lines", "a", "b", "a_at", "b_at")]
    digest = F.sha2(F.expr(f"concat_ws(',', {', '.join(parts)})"), 256)
    return write_through(facts.select("uri", "size", digest.alias("hash"), encoding.alias("encoding"), "head", "filled"), "file-facts")


def _probe(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Facts of each file. Files in UTF-16, or with line breaks in their header, are read as records for it."""
    facts = _facts(spark, paths).withColumn("path", F.url_decode(F.replace(F.col("uri"), F.lit("+"), F.lit("%2B"))))
    special = F.col("encoding").isin(*WIDE) | (F.coalesce(opens(F.col("head")), F.lit(0)) == 1)
    odd = [(r.path, r.encoding) for r in facts.where(special).select("path", "encoding").collect()]
    facts = facts.withColumns({"header": decoded(F.col("head"), F.col("encoding")), "records": F.col("filled")})
    if odd:
        records, counts = read_records(spark, odd)
        heads = records.where("rec = 1").join(counts, "uri").select("uri", F.col("text").alias("first"), F.col("n").alias("found"))
        facts = facts.join(heads, "uri", "left").withColumns({
            "header": F.coalesce(decoded(F.col("first"), F.col("encoding")), F.when(~special, F.col("header"))),
            "records": F.coalesce("found", F.when(~special, F.col("records")), F.lit(0)),
        })
    header = F.coalesce("header", F.lit(""))
    return facts.select(
        "path", "uri", "size", "hash", "encoding", header.alias("header"), _header_fields(header).alias("headers"),
        (F.col("records") > 1).alias("has_rows"),
    )


_FACTS = "path string, uri string, size long, hash string, encoding string, header string, headers array<string>, has_rows boolean"


def short_uri(uri: str) -> str:
    """``file:///x`` and ``file:/x`` name the same file."""
    return re.sub("^file:/+", "file:/", uri)


def probe_files(spark: SparkSession, paths: list[str], by_folder: bool = False) -> DataFrame:
    """Registry rows of the files found at ``paths`` (files, folders or globs).

    ``by_folder``: a folder of part files is one export; it names the system, its parts are
    numbered as one file, in path order, and its fingerprint is that of all parts.
    """
    loaded = spark.read.format("binaryFile").load(paths)
    listing = loaded.select(F.col("_metadata.file_path").alias("uri")).collect()
    # Spark's scans skip files without a byte; they are registered from the listing.
    seen = {short_uri(r.uri) for r in listing}
    empty = [u for u in map(short_uri, loaded.inputFiles()) if u not in seen]
    parts = [_probe(spark, paths)] if listing else []
    if empty:
        facts = [(unquote(u), u, 0, hashlib.sha256(b"").hexdigest(), "utf-8", "", [], False) for u in empty]
        parts.append(spark.createDataFrame(facts, _FACTS))
    if not parts:
        raise ValueError(f"no files at {paths}")
    df = _union(parts)
    name = F.element_at(F.split("path", "/"), -2 if by_folder else -1)
    unit = F.regexp_replace("uri", "/[^/]*\\z", "") if by_folder else F.col("uri")
    error = F.when(F.col("header") == "", F.lit(NO_HEADER)).when(~F.col("has_rows"), F.lit(NO_ROWS))
    df = df.withColumn("unit", unit)
    if by_folder:
        parts = df.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("path", "hash"))).alias("parts"))
        whole = parts.select("unit", F.sha2(F.array_join(F.transform("parts", lambda p: p["hash"]), ","), 256).alias("hash"))
        df = df.drop("hash").join(whole, "unit")
    registry = df.withColumns({
        "name": name,
        "system": system_name(name),
        "is_sot": F.lit(False),
        "status": F.when(error.isNull(), F.lit("pending")).otherwise(F.lit("error")),
        "error": error,
    }).select(*REGISTRY_COLUMNS)
    # Written at once: every later use would otherwise read and hash the files again.
    return write_through(registry, "registry")


def register(files: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Units (files, or folders of parts) not registered yet, one per content (also inside the same call)."""
    first = files.groupBy("hash").agg(F.min_by("unit", "path").alias("unit"))
    fresh = files.join(first, ["hash", "unit"], "left_semi")
    return fresh if registry is None else fresh.join(registry.select("hash"), "hash", "left_anti").select(*files.columns)


def designate_sot(registry: DataFrame, path: str) -> DataFrame:
    """Mark one file, or one folder of parts, as the employee list, unmarking any other."""
    return registry.withColumn("is_sot", (F.col("path") == path) | (F.col("unit") == path))


def check_sot(registry: DataFrame) -> DataFrame:
    """The single employee file, or its parts; satellites are optional."""
    n = registry.where("is_sot").agg(F.count_distinct("unit")).first()[0]
    if n != 1:
        raise ValueError(f"exactly one file must be the source of truth, found {n}")
    return registry.where("is_sot")


def file_errors(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("status") == "error").select("path", "name", "system", "error")


def read_rows(spark: SparkSession, registry: DataFrame, mapping: ColumnMapping | str | None = None) -> DataFrame | None:
    """Rows of all usable files by one scan; None without one (see ``read_parts``)."""
    found = read_parts(spark, registry, mapping)
    return found and found[0]


def read_parts(
    spark: SparkSession, registry: DataFrame, mapping: ColumnMapping | str | None = None
) -> tuple[DataFrame, DataFrame] | None:
    """(rows, parts) of all usable files by one scan; None without one.

    parts: unit, uri, hash, start (rows of the unit before this file), n (rows of the file). rows: _file, _row (position in the unit, from 1), _fields (array), _headers, _system, _hash, and where the mapping finds
    its fields: _pos, _admin. A registry row of each file comes to the driver: the reader takes paths.
    """
    usable = registry.where(F.col("status") != "error")
    files = [(r.path, r.encoding) for r in usable.select("path", "encoding").collect()]
    if not files:
        return None
    records, counts = read_records(spark, files)
    earlier = W.partitionBy("unit").orderBy("uri").rowsBetween(W.unboundedPreceding, -1)
    parts = usable.join(counts, "uri").select(
        "unit", "uri", "hash", F.coalesce(F.sum(F.col("n") - 1).over(earlier), F.lit(0)).alias("start"), (F.col("n") - 1).alias("n"))
    facts = usable.join(parts.select("uri", "start"), "uri").select(
        "uri", F.col("encoding").alias("_encoding"), F.col("headers").alias("_headers"), F.col("system").alias("_system"),
        F.col("hash").alias("_hash"), F.col("start").alias("_shift"),
        file_positions(F.col("headers"), mapping).alias("_pos"), admin_positions(F.col("headers")).alias("_admin"),
    )
    rows = records.where("rec > 1").join(facts, "uri").select(
        F.col("uri").alias("_file"), (F.col("_shift") + F.col("rec") - 1).alias("_row"),
        fields(decoded(F.col("text"), F.col("_encoding"))).alias("_fields"), "_headers", "_system", "_hash", "_pos", "_admin",
    )
    return rows, parts


def read_table(spark: SparkSession, registry: DataFrame) -> DataFrame:
    """Rows of files that share one header: a column per header (the last of equal ones), and the columns of ``read_rows``."""
    found = registry.where(F.col("status") != "error").select("headers").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("the files need one header in common" if found else "no usable file")
    last = {h: i for i, h in enumerate(found[0].headers)}
    cells = [F.coalesce(F.get("_fields", F.lit(i)), F.lit("")).alias(h) for h, i in last.items()]
    return read_rows(spark, registry).select(*cells, "_row", "_file", "_fields", "_headers")


def parse_warnings(rows: DataFrame) -> DataFrame:
    """(file, row, message) of padded and truncated rows of ``read_rows``; file row 1 is the header."""
    found, columns = F.size("_fields"), F.size("_headers")
    what = F.when(found < columns, F.lit("padding with empty values")).otherwise(F.lit("truncating extra columns"))
    return rows.where(found != columns).select(
        F.col("_file").alias("file"),
        (F.col("_row") + 1).alias("row"),
        F.concat(F.lit("row has "), found.cast("string"), F.lit(" columns, expected "), columns.cast("string"), F.lit("; "), what).alias("message"),
    )


@dataclass(frozen=True)
class Ingested:
    rows: DataFrame
    warnings: DataFrame
    parts: DataFrame | None = None


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _checked(mapping: ColumnMapping | str | None) -> ColumnMapping | str | None:
    """A mapping in JSON is loaded; one that names a field twice, or an unknown one, stops the run."""
    if isinstance(mapping, str) and mapping.lstrip().startswith("{"):
        mapping = load_mapping(mapping)
    if isinstance(mapping, ColumnMapping):
        validate_mapping(mapping)
    return mapping


def read_identity(spark: SparkSession, registry: DataFrame, mapping: ColumnMapping | str | None = None) -> Ingested:
    """The employee list; an unusable file stops the run."""
    mapping = _checked(mapping)
    one = check_sot(registry)
    bad = one.where(F.col("status") == "error").select("name", "error").first()
    if bad:
        raise ValueError(f"{bad.name}: {bad.error}")
    rows = read_rows(spark, one, mapping)
    return Ingested(place_identity(rows, mapping), parse_warnings(rows))


def read_accounts(
    spark: SparkSession,
    registry: DataFrame,
    mappings: dict[str, ColumnMapping | str] | None = None,
    default: ColumnMapping | str | None = None,
    id_fields: tuple[str, ...] = ("userId",),
) -> Ingested | None:
    """Accounts of all usable non-SoT files; ``mappings`` by system name, else ``default``.

    Returns None when no file is usable.
    """
    usable = registry.where(~F.col("is_sot") & (F.col("status") != "error"))
    mapped, default = {s: _checked(m) for s, m in (mappings or {}).items()}, _checked(default)
    groups = [(usable.where(F.col("system") == s), m) for s, m in mapped.items()]
    groups.append((usable.where(~F.col("system").isin(*mapped)) if mapped else usable, default))
    found = [(*read, mapping) for files, mapping in groups if (read := read_parts(spark, files, mapping)) is not None]
    if not found:
        return None
    return Ingested(
        _union([place_accounts(rows, mapping, id_fields) for rows, _, mapping in found]),
        _union([parse_warnings(rows) for rows, _, _ in found]),
        _union([parts for _, parts, _ in found]),
    )
