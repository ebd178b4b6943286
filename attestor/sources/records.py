"""Lines of export files as records, by a scan of quote states.

A line either starts a record or goes on inside a quoted field of the one before. What a line does to
that state is a function of two states (outside, inside); functions compose, so the state at any line is found as
a prefix of compositions: per block of a file, then over the blocks of a file (one row each), and then within the few
blocks that need it. Files are read by as many tasks as they have blocks, line breaks in quotes or not.

- A block without an opening quote, entered outside, has a record a line: its lines stay in their task.
- Lines of other blocks are numbered by a window per block, and those of one record are glued. Only these lines move.

Quotes are read leniently: a field is quoted if it starts with a quote; in it, two quotes stand for one, and a quote that
is followed by neither a comma nor the end of the line is a quote. In other fields quotes are text.
Empty lines between records are skipped. A quoted field that never ends takes the rest of the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.session import write_through

#: Content of a quoted field up to its closing quote; possessive, so that long fields need no stack.
_INSIDE = r'(?:[^"]++|""|"(?![",\n]|\z))*+'
_FIELD = rf'(?:"{_INSIDE}"|(?!")[^,]*+)'
_OPEN = rf'(?:{_FIELD},)*+"{_INSIDE}\z'
BROADCAST_BLOCKS = 200_000
WIDE = {"utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}


def _has_quote(text: Column) -> Column:
    return F.contains(text, F.lit('"'))


def opens(text: Column) -> Column:
    """1 if a line that starts a record ends inside a quoted field."""
    return (_has_quote(text) & text.rlike("^" + _OPEN)).cast("int")


def stays(text: Column) -> Column:
    """1 if a line that starts inside a quoted field ends inside one."""
    return (~_has_quote(text) | text.rlike(f'^{_INSIDE}(?:",{_OPEN})?\\z')).cast("int")


def fields(record: Column) -> Column:
    """The fields of a record."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf',("{_INSIDE}"|"{_INSIDE}\z|(?!")[^,]*+)'), F.lit(1))

    def bare(field: Column) -> Column:
        inside = F.replace(F.regexp_extract(field, f'^"({_INSIDE})', 1), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(field, F.lit('"')), inside).otherwise(field)

    return F.when(_has_quote(record), F.transform(quoted, bare)).otherwise(F.split(record, ","))


def raw_lines(spark: SparkSession, paths: list[str], encoding: str | None = None) -> DataFrame:
    """uri, size, block, at (grows with the line within a block), value (bytes up to the line feed).

    ``encoding``: UTF-16LE or UTF-16BE, whose line feeds are two bytes; files of it are split like others.
    """
    reader = spark.read.option("lineSep", "\n")
    if encoding:
        reader = reader.option("encoding", encoding)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("value"),
    )


def line_text(encoding: str | None = None) -> Column:
    """Text of ``value`` without a carriage return at its end; single-byte files keep their bytes."""
    if encoding:
        return F.regexp_replace(F.decode(F.col("value"), encoding), "^﻿|\r\\z", "")
    return F.expr("if(endswith(value, X'0D'), substring(value, 1, length(value) - 1), value)").cast("string")


def decoded(text: Column, encoding: Column) -> Column:
    return F.when(encoding == "latin-1", F.decode(text.cast("binary"), "ISO-8859-1")).otherwise(text)


def _lines(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """uri, block, at, text of files given as (path, encoding): one scan, and one for each kind of UTF-16 among them."""
    out = None
    for kind in (None, *WIDE.values()):
        paths = [p for p, e in files if WIDE.get(e) == kind]
        if paths:
            part = raw_lines(spark, paths, kind).select("uri", "block", "at", line_text(kind).alias("text"))
            out = part if out is None else out.unionByName(part)
    return out


def _after(constant: Column, swap: Column, start: Column, window) -> Column:
    """State after each row of a window: a row sets it (``constant`` 0 or 1), turns it (``swap`` 1) or leaves it.

    The state is that of the last row that sets it, turned as often as rows turn it since.
    """
    turned = F.sum(swap).over(window) % 2
    last = F.last(constant.bitwiseXOR(turned.cast("int")), ignorenulls=True).over(window)
    return F.coalesce(last, start).bitwiseXOR(turned.cast("int"))


def _upto(*keys: str, order: str):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)


def _block_states(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``entered`` (state before the first line). Only quote lines of blocks with an opening quote are ordered."""
    text = F.col("text")
    tricky = lines.join(blocks.where("opening").select("uri", "block"), ["uri", "block"], "left_semi").where(_has_quote(text))
    acts = tricky.select("uri", "block", "at", opens(text).alias("f0"), stays(text).alias("f1")).where("f0 = 1 or f1 = 0")
    sets, turns = F.when(F.col("f0") == F.col("f1"), F.col("f0")), (F.col("f0") > F.col("f1")).cast("int")
    w = _upto("uri", "block", order="at")
    ends = acts.select("uri", "block", "at", *[_after(sets, turns, F.lit(s), w).alias(f"from{s}") for s in (0, 1)]).groupBy("uri", "block").agg(
        F.max_by("from0", "at").alias("from0"), F.max_by("from1", "at").alias("from1"))
    whole = blocks.join(ends, ["uri", "block"], "left").withColumns({
        # Without an opening quote, a block either closes whatever was open or has no say.
        "from0": F.coalesce("from0", F.lit(0)), "from1": F.coalesce("from1", F.when(F.col("closing"), 0).otherwise(1)),
    })
    sets = F.when(F.col("from0") == F.col("from1"), F.col("from0"))
    turns = (F.col("from0") > F.col("from1")).cast("int")
    after = whole.withColumn("after", _after(sets, turns, F.lit(0), _upto("uri", order="block")))
    before = F.coalesce(F.lag("after").over(W.partitionBy("uri").orderBy("block")), F.lit(0))
    return after.withColumn("entered", before).drop("from0", "from1", "after")


def _near(table: DataFrame, count: int) -> DataFrame:
    return F.broadcast(table) if count <= BROADCAST_BLOCKS else table


def read_records(spark: SparkSession, files: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(records, counts): uri, rec (number of the record in its file, from 1: the header), text (see ``decoded``); uri, n.

    ``files``: (path, encoding). The lines are read for the counts of blocks and for the result; files with line breaks
    in quotes or empty lines once more.
    """
    lines = _lines(spark, files)
    text = F.col("text")
    quote = _has_quote(text)
    blocks = write_through(lines.groupBy("uri", "block").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.some(text == "").alias("gaps"),
        F.some(quote & (opens(text) == 1)).alias("opening"), F.some(quote & (opens(text) == 0) & (stays(text) == 0)).alias("closing"),
    ), "blocks")
    count, mixed = blocks.agg(F.count(F.lit(1)), F.some(F.expr("opening or gaps"))).first()
    earlier = W.partitionBy("uri").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    numbered = lambda b: b.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    if not mixed:
        whole = _near(numbered(blocks).select("uri", "block", (F.col("before") + 1 - F.col("first")).alias("shift")), count)
        rows = lines.join(whole, ["uri", "block"]).select("uri", (F.col("at") + F.col("shift")).alias("rec"), "text")
        return rows, blocks.groupBy("uri").agg(F.sum("n").alias("n"))
    states = write_through(_block_states(lines, blocks).withColumn("mixed", F.expr("opening or gaps or entered = 1")), "block-states")
    mixed = _near(states.where("mixed").select("uri", "block", "entered"), count)
    acted = lines.join(mixed, ["uri", "block"]).withColumns({"f0": opens(text), "f1": stays(text)})
    sets, turns = F.when(F.col("f0") == F.col("f1"), F.col("f0")), (F.col("f0") > F.col("f1")).cast("int")
    w = _upto("uri", "block", order="at")
    acted = acted.withColumn("after", _after(sets, turns, F.col("entered"), w))
    acted = acted.withColumn("inside", F.coalesce(F.lag("after").over(W.partitionBy("uri", "block").orderBy("at")), "entered") == 1)
    acted = acted.withColumn("starts", ~F.col("inside") & (text != "")).withColumn("k", F.count_if("starts").over(w))
    acted = write_through(acted.select("uri", "block", "at", "text", "k", "inside", "starts", (F.col("after") == 1).alias("open")), "mixed-blocks")
    found = acted.groupBy("uri", "block").agg(F.max("k").alias("found"))
    known = states.join(found, ["uri", "block"], "left").withColumn("n", F.coalesce("found", "n")).drop("found")
    known = write_through(numbered(known), "numbered-blocks")
    plain = lines.join(
        _near(known.where("not mixed").select("uri", "block", (F.col("before") + 1 - F.col("first")).alias("shift")), count), ["uri", "block"]
    ).select("uri", (F.col("at") + F.col("shift")).alias("rec"), "text")
    placed = acted.join(_near(known.select("uri", "block", "before"), count), ["uri", "block"]).withColumn("rec", F.col("before") + F.col("k"))
    single = placed.where("starts and not open").select("uri", "rec", "text")
    pieces = placed.where("inside or (starts and open)").groupBy("uri", "rec").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("lines"))
    glued = pieces.select("uri", "rec", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))
    return plain.unionByName(single).unionByName(glued), known.groupBy("uri").agg(F.sum("n").alias("n"))
