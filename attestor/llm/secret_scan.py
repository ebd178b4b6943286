"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds which
(blob, rule version) pairs were scanned, and what was found. A scan reads only pairs that the ledger lacks, each
distinct text once, and joins the findings back to all paths that hold the blob.

Base rules (fixed values, spans in code points, leftmost and not overlapping within a kind):
assign, access and hex. Rule version 2 adds two kinds: pem (a private key's header line) and jwt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, ship, text_of, write_through
from attestor.session import scratch_dir

ship(__name__)

#: kind, what every match must hold (lower case; a cheap test), pattern, group that is measured, least length
BASE_RULES = (
    ("assign", ("passw", "secret", "token", "api"),
     re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", (), re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
MORE_RULES = (
    ("pem", ("private key",), re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1),
    ("jwt", ("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
)
RULES = {1: BASE_RULES, 2: BASE_RULES + MORE_RULES}
VERSION = 2
FINDINGS = "blob string, kind string, kind_no int, span_start long, span_end long"


def find(text: str, rules: tuple = RULES[VERSION]) -> list[tuple[str, int, int, int]]:
    """(kind, its number, start, end) of all spans of a text."""
    low, out = text.lower(), []
    for no, (kind, needs, pattern, group, least) in enumerate(rules):
        if needs and not any(x in low for x in needs):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, no, m.start(), m.end()))
    return out


def blobs(docs: DataFrame) -> DataFrame:
    """doc_id, blob: the content address of each path's text (null counts as empty)."""
    return docs.select("doc_id", F.sha2(text_of(), 256).alias("blob"))


def _scan(version: int):
    rules = RULES[version]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (blob, *f) for blob, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in find(text or "", rules)
            ]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                ["blob", "kind", "kind_no", "span_start", "span_end"],
            )

    return run


class Ledger:
    """Scanned (blob, rule version) pairs and their findings, as tables below ``path``.

    Each run adds one ``run=K`` folder to both tables, findings first; a run that fails before its
    pairs are written leaves findings that are not read, and the next run scans these blobs again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, version int, run int")

    def findings(self) -> DataFrame:
        """Findings of finished runs."""
        found = self._read("findings", FINDINGS + ", version int, run int")
        runs = self.scanned().select("run").distinct()
        return found.join(runs, "run", "left_semi").drop("run")

    def scan(self, docs: DataFrame, version: int = VERSION) -> int:
        """Scans what is new in ``docs`` under a rule version; the number of the run."""
        seen = self.scanned()
        run = (seen.agg(F.max("run")).first()[0] or 0) + 1
        seen = seen.where(F.col("version") == version).select("blob")
        texts = docs.select(F.sha2(text_of(), 256).alias("blob"), text_of().alias("text"))
        if run > 1:
            texts = texts.join(seen, "blob", "left_anti")
        unseen = texts.groupBy("blob", "text").agg(F.lit(1).alias("_one"))
        unseen.select("blob", "text").mapInArrow(_scan(version), FINDINGS).withColumn("version", F.lit(version)).write.mode(
            "overwrite").parquet(f"{self.path}/findings/run={run}")
        new = blobs(docs).select("blob").distinct().join(seen, "blob", "left_anti")
        new.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{self.path}/scanned/run={run}")
        return run


def report(docs: DataFrame, ledger: Ledger, version: int = VERSION) -> DataFrame:
    """Per row of ``docs``: doc_id, blob, found (array of kind_no, kind, span_start, span_end by start, kind).

    Findings by blob are written before the join: beside an aggregate a hot blob's partition wouldn't be split.
    """
    found = ledger.findings().where(F.col("version") == version).groupBy("blob").agg(
        F.sort_array(F.collect_set(F.struct("span_start", "kind_no", "kind", "span_end"))).alias("found")
    )
    return blobs(docs).join(write_through(found, "blob-findings"), "blob", "left")


def scan_secrets(docs: DataFrame, path: str, version: int = VERSION) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``path`` is the ledger's folder, on storage that all executors reach. Null and empty texts have no spans.
    Rows that repeat a doc_id or a text each get their row; an empty table gives none.
    """
    ledger = Ledger(docs.sparkSession, path)
    ledger.scan(docs, version)
    rows = report(docs, ledger, version).withColumn("found", F.expr(
        "coalesce(found, cast(array() as array<struct<span_start: bigint, kind_no: int, kind: string, span_end: bigint>>))"))
    spell = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["span_start"], x["span_end"])), ",")
    base = F.filter("found", lambda x: x["kind_no"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *[count(r[0]).alias(f"n_{r[0]}") for r in BASE_RULES], F.sha2(spell(base), 256).alias("base_sha256"),
        spell(F.col("found")).alias("spans"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir), scratch_dir(spark, "blob-ledger"))
