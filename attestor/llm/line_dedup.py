"""Line duplicates: three-line windows that repeat across documents.

Lines are the parts of a text between line feeds, compared byte by byte. Each run of WINDOW
consecutive lines of a document is hashed (128 bits); all windows are grouped by hash, and the
first occurrence in (document, line) order stays. A later occurrence covers its lines; the covered
positions of a document merge, and their lines go. Overlapping windows thus remove a repeated
passage of any length from its first to its last line, while single lines that many documents share stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, numbered, text_of, write_through

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """__place (of the document), at (first line, from 0), h1, h2: one row per window of each document."""
    rows = docs.select("__place", lines_of(text_of()).alias("_lines")).where(F.size("_lines") >= window)
    hashed = rows.select("__place", F.transform("_lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("_h"))
    w = hashed.select("__place", "_h", F.explode(F.sequence(F.lit(0), F.size("_h") - window)).alias("at"))
    cells = [F.col("_h")[F.col("at") + i] for i in range(window)]
    return w.select("__place", "at", F.xxhash64(*[c["a"] for c in cells]).alias("h1"), F.xxhash64(*[c["b"] for c in cells]).alias("h2"))


def later_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """__place, at: windows that also occur earlier. The smallest (__place, line) is the first.

    The repeated hashes are written before the join: beside an aggregate a hot window's partition wouldn't be split.
    """
    rows = write_through(windows(docs, window), "line-windows")
    place = F.struct(F.col("__place").alias("d"), F.col("at").alias("a"))
    repeated = rows.groupBy("h1", "h2").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    repeated = write_through(repeated.drop("_n"), "repeated-windows")
    return rows.join(repeated, ["h1", "h2"]).where(place > F.col("_first")).select("__place", "at")


def covered_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """__id (place of a document), __covered (sorted positions of the lines that go); only documents that lose lines."""
    starts = later_windows(docs, window).groupBy("__place").agg(F.sort_array(F.collect_set("at")).alias("_at"))
    reach = F.flatten(F.transform("_at", lambda a: F.sequence(a, a + (window - 1))))
    return starts.select(F.col("__place").alias("__id"), F.array_distinct(reach).alias("__covered"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` with the text cut, plus n_lines, n_removed and removed_spans.

    A null text counts as empty: one line, nothing removed. Texts of fewer lines than a window stay
    whole. Order is by doc_id, null ids last; rows that share an id, or have none, are documents of their
    own, ordered by a hash of the text. Columns named n_lines, n_removed or removed_spans are replaced;
    names that start with two underscores are taken.
    """
    rows = numbered(docs, "line-rows")
    joined = rows.join(covered_lines(rows, window), F.col("__place") == F.col("__id"), "left")
    joined = joined.withColumn("__lines", lines_of(text_of())).withColumn("__gone", F.coalesce("__covered", F.array().cast("array<int>")))
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.when(F.size("__gone") == 0, text_of()).otherwise(
        F.array_join(F.transform(keep, lambda i: F.col("__lines")[i]), "\n")
    )
    # A span starts at a covered line whose predecessor isn't covered; positions come sorted.
    starts = F.size(F.array_except(F.col("__gone"), F.transform("__gone", lambda i: i + 1)))
    out = joined.withColumns({
        "__text": text, "__n": F.size("__lines").cast("long"), "__r": F.size("__gone").cast("long"), "__s": starts.cast("long"),
    })
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_spans")]
    return out.select(
        *[F.col("__text").alias("text") if c == "text" else F.col(f"`{c}`") for c in rest],
        F.col("__n").alias("n_lines"), F.col("__r").alias("n_removed"), F.col("__s").alias("removed_spans"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(documents(spark, sf_dir))
    return cut.select("doc_id", "n_lines", "n_removed", "removed_spans", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
with l as (
  select row_number() over (order by doc_id nulls last, md5(coalesce(text, ''))) as place, doc_id,
    string_split(coalesce(text, ''), chr(10)) as x from documents
), w as (
  select place, a, list_slice(x, a + 1, a + 3) as w from (select place, x, unnest(range(0, len(x) - 2)) as a from l)
), r as (
  select place, a, row_number() over (partition by w order by place, a) as rn from w
), c as (
  select place, list_sort(list_distinct(flatten(list(range(a, a + 3))))) as gone from r where rn > 1 group by place
), k as (
  select l.doc_id, x, coalesce(gone, []) as gone from l left join c on l.place = c.place
)
select doc_id, len(x) as n_lines, len(gone) as n_removed,
  len(list_filter(gone, lambda i: not list_contains(gone, i - 1))) as removed_spans,
  sha256(array_to_string([x[i + 1] for i in range(0, len(x)) if not list_contains(gone, i)], chr(10))) as kept_sha256
from k
"""
