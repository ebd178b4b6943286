"""Continuous intake: files dropped into a folder are matched and merged as they appear.

The stream carries file names only. Each micro-batch holds at most ``max_files`` of them;
their contents are read by the batch's own Spark jobs. The stream's checkpoint remembers the
files seen; content hashes keep copies out; a repeated batch overwrites its own version.
"""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.plans.review_run import add_files
from attestor.sinks.store import ReportStore
from attestor.sources.files import probe_files, register, short_uri

_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(
    spark: SparkSession,
    folder: str,
    store: ReportStore,
    checkpoint: str,
    max_files: int = 100,
    available_now: bool = False,
    mappings=None,
    default=None,
    by_folder: bool = False,
):
    """Start the streaming query and return it."""
    names = (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
        .select("path", "length")
    )

    def process(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.where(F.col("length") >= 0).select("path").collect()]
        if paths:
            intake(spark, store, paths, batch_id, mappings, default, by_folder)

    writer = names.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def intake(
    spark: SparkSession, store: ReportStore, paths: list[str], batch_id: int, mappings=None, default=None, by_folder=False
) -> list[str]:
    """One micro-batch; safe to repeat with the same ``batch_id``.

    ``by_folder``: a folder is read with all parts it holds now. A part that arrives after its export was read makes the
    export be read again as a whole: rows are numbered anew, and review state follows its account. A folder that stands as
    an earlier batch read it is not read again, so the parts of an export may fill any number of batches.
    """
    known = store.load_table("stream_files")
    if known is not None:
        known = known.where(F.col("batch_id") != batch_id)
    states = {}
    if by_folder:
        units = {p.rsplit("/", 1)[0] for p in paths}
        states, read = _states(spark, units), _read_states(store, batch_id)
        paths = sorted(f"{u}/*" for u in units if u not in states or read.get(u) != states[u])
        if not paths:
            return []
    found = probe_files(spark, paths, by_folder=by_folder)
    fresh = register(found, known)
    base = store.load_table("stream_base")
    offset = base.first()["version"] if base is not None else _set_base(store)
    systems = add_files(store, fresh, offset + batch_id, mappings, default, remember=False)
    fresh.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{store.root}/stream_files/part={batch_id}")
    if states:
        rows = [(unit, state, batch_id) for unit, state in states.items()]
        spark.createDataFrame(rows, "unit string, state string, batch_id long").coalesce(1).write.mode("overwrite").parquet(
            f"{store.root}/stream_units/part={batch_id}")
    return systems


def _states(spark: SparkSession, units: set[str]) -> dict[str, str]:
    """A digest per folder of its parts' names, sizes and times, taken before they are read: a later change shows."""
    loaded = spark.read.format("binaryFile").load(sorted(f"{u}/*" for u in units))
    parts = [(short_uri(r.path), f"{r.length} {r.modificationTime}") for r in loaded.select("path", "length", "modificationTime").collect()]
    # Scans skip parts without a byte: their names come from the listing.
    parts = sorted([*parts, *((short_uri(unquote(u)), "listed") for u in loaded.inputFiles())])
    found = {u: [" ".join(p) for p in parts if p[0].startswith(f"{short_uri(u)}/")] for u in units}
    return {u: hashlib.sha256("\n".join(lines).encode()).hexdigest() for u, lines in found.items() if lines}


def _read_states(store: ReportStore, batch_id: int) -> dict[str, str]:
    """The state each folder was last read in; at most a batch's folders a batch."""
    table = store.load_table("stream_units")
    if table is None:
        return {}
    last = table.where(F.col("batch_id") != batch_id).groupBy("unit").agg(F.max_by("state", "batch_id").alias("state"))
    return {r.unit: r.state for r in last.collect()}


def _set_base(store: ReportStore) -> int:
    version = store.next_version()
    store.save_table("stream_base", store.spark.createDataFrame([(version,)], "version long"))
    return version
