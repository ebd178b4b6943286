"""End-to-end runs: files → identity and accounts → matches → report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.risk import DORMANCY_DAYS
from attestor.operators.delta import rematch
from attestor.operators.fuzzy import FuzzyRules
from attestor.operators.incremental import append_report, leading_ids, moved_ids, renumber, renumber_log
from attestor.operators.match import match_accounts
from attestor.operators.name_index import NameIndex, source_of
from attestor.operators.report import dedupe, live_rows, policy_entries
from attestor.session import write_through
from attestor.sinks.store import ReportStore
from attestor.sources.files import (
    designate_sot, file_errors, probe_files, read_accounts, read_identity, register,
)


@dataclass(frozen=True)
class Review:
    """Outputs of a run; ``identity`` and ``matched`` are written tables, the rest is lazy."""

    registry: DataFrame
    identity: DataFrame
    matched: DataFrame | None
    report: DataFrame | None
    warnings: DataFrame
    errors: DataFrame


def live_report(accounts: DataFrame, identity: DataFrame, rules: FuzzyRules = FuzzyRules()) -> DataFrame:
    """The matches are written once; consolidation reads them more than once."""
    return dedupe(live_rows(write_through(match_accounts(accounts, identity, rules), "matched")))


def policy_report(
    accounts: DataFrame, identity: DataFrame, now_ms: int, dormancy_days: int = DORMANCY_DAYS, keywords=None
) -> DataFrame:
    matched = write_through(match_accounts(accounts, identity), "matched")
    return policy_entries(matched, identity, now_ms, dormancy_days, keywords)


def review_files(
    spark: SparkSession, paths: list[str], sot_path: str, sot_mapping=None, mappings=None, default=None, by_folder: bool = False
) -> Review:
    """Register, map, match and merge; a bad satellite file is listed in ``errors`` and skipped.

    Exactly one unit must be the employee list: the file at ``sot_path``, or with ``by_folder`` the folder of that URI.
    """
    registry = designate_sot(register(probe_files(spark, paths, by_folder)), sot_path)
    people = read_identity(spark, registry, sot_mapping)
    # The identity feeds six lookups and the matches feed every output: parse and match once.
    identity = write_through(people.rows, "identity")
    accounts = read_accounts(spark, registry, mappings, default)
    errors = file_errors(registry)
    if accounts is None:
        return Review(registry, identity, None, None, people.warnings, errors)
    matched = write_through(match_accounts(accounts.rows, identity), "matched")
    return Review(
        registry, identity, matched, dedupe(live_rows(matched)),
        people.warnings.unionByName(accounts.warnings), errors,
    )


def _index_of(store: ReportStore, rules: FuzzyRules) -> NameIndex:
    return NameIndex(store.spark, f"{store.root}/index-{rules.threshold}-{rules.hot_block}", rules)


def name_index(store: ReportStore, identity: DataFrame, rules: FuzzyRules = FuzzyRules()) -> NameIndex:
    """The stored index of the stored employee list; if the list was replaced, the index follows its changes first."""
    index, source = _index_of(store, rules), source_of(identity)
    if index.source() != source:
        index.update(identity, source)
    return index


def merge_version(
    store: ReportStore, accounts: DataFrame, version: int, systems: list[str], moved: DataFrame | None = None
) -> None:
    """Match new accounts of some systems and rebuild those systems' report rows.

    All matches of the systems are merged again (new files may repeat users of earlier ones);
    review state is kept by record, manual merges and name edits are replayed from the log.
    Only the partitions of these systems are read and written.

    ``moved`` (see ``ReportStore.save_parts``): units that have grown. Their rows are numbered as if all parts had been there
    from the start; report and review log follow, so that decisions stay with their accounts.
    """
    identity = store.load_table("identity")
    if identity is None:
        raise ValueError("no stored identity; store one before adding accounts")
    store.save_matched(match_accounts(accounts, name_index(store, identity).identity_index(identity)), version, systems)
    incoming = dedupe(live_rows(store.matched(systems, version)))
    current = store.report(systems, before=version)
    log = store.load_table("review_log")
    if moved is not None and current is not None:
        incoming = write_through(incoming, "incoming")
        for ids in (lambda: moved_ids(store.outdated(systems, moved, version)), lambda: leading_ids(current, incoming)):
            new = write_through(ids(), "moved-ids")
            current = write_through(renumber(current, new), "renumbered")
            log = log and renumber_log(log, new)
    if current is not None:
        incoming = append_report(current, store.with_ingest_order(incoming, version), log)
    store.commit(incoming, version, systems)
    if moved is not None and log is not None:
        store.move_log(log, version)


def change_identity(store: ReportStore, identity: DataFrame, rules: FuzzyRules = FuzzyRules()) -> list[str]:
    """Replace the employee list; returns the systems whose report changed.

    Only accounts that share a key or a similar name with an added, removed or changed employee are matched again. Systems
    without such an account are not touched. Decisions stay with records that keep their owner; an account that
    changes hands starts without. The list is replaced last, so that an interrupted change can be repeated.
    """
    version, systems = store.next_version(), store.systems()
    identity = write_through(identity, "identity")
    index, followed = _index_of(store, rules), bool(systems)
    if followed:
        index.update(identity)
        matched, again = rematch(store.matched(systems, version), store.load_table("identity"), identity, rules, index)
        systems = sorted(r.system for r in again.select("system").distinct().collect())
    if systems:
        store.save_rematched(matched.where(F.col("system").isin(systems)), version)
        incoming = write_through(dedupe(live_rows(store.matched(systems, version))), "incoming")
        current = store.report(systems, before=version)
        current = renumber(current, leading_ids(current, incoming)).join(incoming.select("record_id"), "record_id", "left_semi")
        store.commit(append_report(current.select(*incoming.columns), incoming, store.load_table("review_log")), version, systems)
    store.save_table("identity", identity)
    if followed:
        index.adopt(source_of(store.load_table("identity")))
    return systems


def add_files(
    store: ReportStore, files: DataFrame, version: int | None = None, mappings=None, default=None, remember: bool = True
) -> list[str]:
    """Match new registered files against the stored identity; returns the systems touched.

    ``remember``: the store keeps the fingerprints of what was added, and files it knows are skipped.
    They are kept after the commit, so a run that fails in between is repeated as a whole.
    """
    version = store.next_version() if version is None else version
    if remember:
        files = register(files, store.load_table("added_files"))
    accounts = read_accounts(store.spark, files, mappings, default)
    if accounts is None:
        return []
    usable = files.where(~F.col("is_sot") & (F.col("status") != "error"))
    systems = [r.system for r in usable.select("system").distinct().collect()]
    # Matching reads the accounts once per stage: lines are parsed for the first time only.
    rows = write_through(accounts.rows, "accounts")
    merge_version(store, rows, version, systems, store.save_parts(accounts.parts, version))
    if remember:
        store.append_table("added_files", usable)
    return systems
