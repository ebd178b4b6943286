"""Reviewer decisions: an append-only log folded into the report.

Log columns: ``seq`` (total order), ``review_id``, ``kind``, ``record_id``, ``role``,
``action``, ``note``, ``display_name``, ``batch_id``, ``target_batch``.

kinds: ``record`` sets action and note of a record and every role action it has; ``role``
sets one role (a blank note keeps the old one); ``note`` is a record event carrying the
action the record had; ``name`` edits the display name; ``merge`` joins ``record_id`` into
the record named by ``target_record``; ``undo``/``redo`` name a batch in ``target_batch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.functions.text import trim_blanks
from attestor.operators.skew import salted_lookup
from attestor.operators.tokens import group_token_union
from attestor.schema import REPORT_COLUMNS, ROLE_ACTIONS_TYPE, blank_to_null

LOG_SCHEMA = (
    "seq long, review_id string, kind string, record_id string, role string, action string, "
    "note string, display_name string, batch_id string, target_batch string, target_record string"
)
LOG_COLUMNS = tuple(f.strip().split(" ")[0] for f in LOG_SCHEMA.split(","))
HISTORY_LIMIT = 500


def log_rows(df: DataFrame) -> DataFrame:
    """Complete a partial log DataFrame to the log layout (absent columns are NULL)."""
    types = dict(f.strip().split(" ") for f in LOG_SCHEMA.split(","))
    return df.select(
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in LOG_COLUMNS]
    )


def bulk_action(selection: DataFrame, action: str | None, batch_id: str, first_seq: int, review_id: str = "") -> DataFrame:
    """One record event per selected id under one batch; like a click it clears the note.

    All events of a batch touch different records, so they share one sequence number.
    """
    return log_rows(
        selection.select(
            F.lit(first_seq).alias("seq"),
            F.lit(review_id).alias("review_id"),
            F.lit("record").alias("kind"),
            "record_id",
            F.lit(action).cast("string").alias("action"),
            F.lit("").alias("note"),
            F.lit(batch_id).alias("batch_id"),
        )
    )


def toggle_role(report: DataFrame, clicks: DataFrame) -> DataFrame:
    """Role events for clicks (seq, record_id, role, action): the same action again clears it."""
    now = report.select("record_id", "role_actions")
    current = F.try_element_at("role_actions", F.col("role"))
    j = clicks.join(now, "record_id")
    return log_rows(
        j.select(
            "seq", "record_id", "role",
            F.lit("role").alias("kind"),
            F.when(~current.eqNullSafe(F.col("action")), F.col("action")).alias("action"),
            F.lit("").alias("note"),
        )
    )


def note_edits(report: DataFrame, edits: DataFrame) -> DataFrame:
    """Note events for edits (seq, record_id, note), carrying the record's current action."""
    j = edits.join(report.select("record_id", F.col("review_action").alias("action")), "record_id")
    return log_rows(j.select("seq", "record_id", "action", "note", F.lit("note").alias("kind")))


def name_edits(report: DataFrame, edits: DataFrame) -> DataFrame:
    """Name events for edits (seq, record_id, display_name): non-blank and really changed."""
    new = trim_blanks(F.col("display_name"))
    j = edits.withColumn("display_name", new).join(
        report.select("record_id", F.col("display_name").alias("_old")), "record_id"
    )
    return log_rows(
        j.where((F.col("display_name") != "") & (F.col("display_name") != F.col("_old"))).select(
            "seq", "record_id", "display_name", F.lit("name").alias("kind")
        )
    )


def _batch() -> Column:
    return F.coalesce("batch_id", F.concat(F.lit("#"), F.col("seq").cast("string"), F.lit("#"), F.col("record_id")))


def _switches(log: DataFrame) -> DataFrame:
    return (
        log.where(F.col("kind").isin("undo", "redo"))
        .groupBy(F.col("target_batch").alias("batch"))
        .agg(F.max_by("kind", "seq").alias("state"), F.max("seq").alias("at"))
    )


def effective_log(log: DataFrame) -> DataFrame:
    """Events that still count: batches whose latest switch is an undo are left out."""
    return effective_events(log, _switches(log))


def effective_events(log: DataFrame, switches: DataFrame) -> DataFrame:
    """The log's events without those of batches that ``switches`` (batch, state, at) has as undone."""
    events = log.where(~F.col("kind").isin("undo", "redo")).withColumn("batch", _batch())
    undone = switches.where(F.col("state") == "undo").select("batch")
    return salted_lookup(events, undone, "batch", ["seq", "record_id"], "left_anti").drop("batch")


def _switch_row(row: DataFrame, kind: str, seq: int) -> DataFrame:
    return log_rows(
        row.where(F.col("batch").isNotNull()).select(
            F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.col("batch").alias("target_batch")
        )
    )


def undo_last(log: DataFrame, seq: int) -> DataFrame:
    """The undo event for the newest effective batch (no row when there is none)."""
    newest = effective_log(log).agg(F.max_by(_batch(), "seq").alias("batch"))
    return _switch_row(newest, "undo", seq)


def redo_last(log: DataFrame, seq: int) -> DataFrame:
    """The redo event for the newest undone batch; any later new action has cleared it."""
    last_event = log.where(~F.col("kind").isin("undo", "redo")).agg(F.max("seq"))
    newest = (
        _switches(log)
        .where((F.col("state") == "undo") & (F.col("at") > F.coalesce(last_event.scalar(), F.lit(-1))))
        .agg(F.max_by("batch", "at").alias("batch"))
    )
    return _switch_row(newest, "redo", seq)


def fold_state(log: DataFrame) -> DataFrame:
    """Per record the combined effect of its events, all from mergeable aggregates.

    First per (record, role) the latest event, then per record; only the distinct roles of a
    record are ever put together.
    """
    return fold_events(effective_log(log))


def fold_events(events: DataFrame) -> DataFrame:
    """``fold_state`` of events that all count."""
    is_record = F.col("kind").isin("record", "note")
    is_role = F.col("kind") == "role"
    latest = events.where(is_record | is_role | (F.col("kind") == "name")).groupBy(
        "record_id", F.when(is_role, F.col("role")).alias("role")
    ).agg(
        F.max_by(F.struct("seq", "action", "note"), F.when(is_record, F.col("seq"))).alias("rec"),
        F.max_by("display_name", F.when(F.col("kind") == "name", F.col("seq"))).alias("name"),
        F.max_by(F.struct("seq", "action"), F.when(is_role, F.col("seq"))).alias("last"),
        F.min(F.when(is_role, F.col("seq"))).alias("first_seq"),
        F.max_by(F.struct("seq", "note"), F.when(is_role & (F.col("note") != ""), F.col("seq"))).alias("role_note"),
    )
    return latest.groupBy("record_id").agg(
        F.first("rec", ignorenulls=True).alias("rec"),
        F.first("name", ignorenulls=True).alias("name"),
        F.max("last.seq").alias("last_role_seq"),
        F.max_by("role_note", "role_note.seq").alias("role_note"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("last").isNotNull(),
                    F.struct("first_seq", "role", F.col("last.seq").alias("seq"), F.col("last.action").alias("action")),
                )
            )
        ).alias("touched"),
    )


def apply_reviews(report: DataFrame, log: DataFrame) -> DataFrame:
    """The report after all effective events, in log order."""
    return apply_state(report, fold_state(log))


def apply_state(report: DataFrame, state: DataFrame) -> DataFrame:
    """The report after the events that ``state`` was folded from."""
    st = report.join(state, "record_id", "left")
    rec_seq = F.coalesce("rec.seq", F.lit(-1))
    has_rec = F.col("rec").isNotNull()
    pair = "array<struct<role:string,action:string>>"
    base = F.coalesce(
        F.transform(
            F.map_entries("role_actions"), lambda e: F.struct(e["key"].alias("role"), e["value"].alias("action"))
        ),
        F.array().cast(pair),
    )
    touched = F.coalesce("touched", F.array())

    def now(t):
        return F.when(t["seq"] > rec_seq, t["action"]).otherwise(F.col("rec.action"))

    def in_place(b):
        own = F.filter(touched, lambda t: t["role"] == b["role"])
        kept = F.when(has_rec, F.col("rec.action")).otherwise(b["action"])
        return F.struct(b["role"].alias("role"), F.when(F.size(own) > 0, now(F.get(own, F.lit(0)))).otherwise(kept).alias("action"))

    # Roles with an action keep their place; new ones follow in the order of their first action.
    new_roles = F.filter(touched, lambda t: ~F.exists(base, lambda b: b["role"] == t["role"]))
    added = F.transform(new_roles, lambda t: F.struct(t["role"].alias("role"), now(t).alias("action")))
    st = st.withColumn("_roles", F.concat(F.transform(base, in_place), added))
    role_after = F.coalesce(F.col("last_role_seq") > rec_seq, F.lit(False))
    first_action = F.get(F.col("_roles.action"), F.lit(0))
    agreed = F.when(F.forall("_roles", lambda r: r["action"] == first_action), first_action)
    note_after = F.coalesce(F.col("role_note.seq") > rec_seq, F.lit(False))
    new = {
        "display_name": F.coalesce("name", "display_name"),
        "review_action": F.when(role_after, agreed)
        .when(has_rec, F.col("rec.action"))
        .otherwise(F.col("review_action")),
        "review_note": F.when(note_after, F.col("role_note.note"))
        .when(has_rec, F.coalesce("rec.note", F.lit("")))
        .otherwise(F.col("review_note")),
        "role_actions": F.when(
            (F.size("_roles") > 0) | F.col("role_actions").isNotNull(), F.map_from_entries("_roles")
        ).otherwise(F.lit(None).cast(ROLE_ACTIONS_TYPE)),
    }
    return st.select(*[new[c].alias(c) if c in new else F.col(c) for c in report.columns])


def role_action_text() -> Column:
    """``role:action; …`` of roles with an action, else the record's action, else blank."""
    set_roles = F.filter(F.map_entries("role_actions"), lambda e: e["value"].isNotNull())
    text = F.array_join(
        F.transform(set_roles, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "; "
    )
    return F.coalesce(F.nullif(text, F.lit("")), F.col("review_action"), F.lit(""))


def retain_history(log: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest ``limit`` events per review, a batch cut by the limit going as a whole.

    ``row_number() <= n`` is applied per task before the shuffle (window group limit), so even
    a review holding most of the log moves only ``limit + 1`` rows per task.
    """
    newest = W.partitionBy("review_id").orderBy(F.desc("seq"), F.desc("record_id"))
    top = log.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= limit + 1)
    review = W.partitionBy("review_id")
    edge = F.max(F.when(F.col("_rn") == limit + 1, F.col("batch_id"))).over(review)
    inside = F.col("_rn") <= limit
    # Oldest retained row that is not part of the cut batch; rows older than it go with the batch.
    oldest_other = F.max(F.when(inside & ~F.col("batch_id").eqNullSafe(F.col("_edge")), F.col("_rn"))).over(review)
    keep = F.when(F.col("_edge").isNull(), inside).otherwise(inside & (F.col("_rn") <= F.col("_oldest")))
    return (
        top.withColumn("_edge", edge)
        .withColumn("_oldest", F.coalesce(oldest_other, F.lit(0)))
        .where(keep)
        .drop("_rn", "_edge", "_oldest")
    )


def manual_merge(report: DataFrame, groups: DataFrame) -> DataFrame:
    """Merge chosen rows; ``groups``: record_id (unique), primary_id.

    Roles and entitlements are united, primary first; the highest risk and the latest login
    win; review state stays the primary's; the other rows go. Groups without their primary or
    with fewer than two rows present change nothing.
    """
    members = report.join(groups.select("record_id", F.col("primary_id").alias("_primary")), "record_id")
    order = F.struct(
        F.col("record_id") != F.col("_primary"), F.col("system"), F.col("source_row"), F.col("record_id")
    )
    merged = members.groupBy("_primary").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("record_id") == F.col("_primary")).alias("present"),
        F.min_by(F.struct(*REPORT_COLUMNS), order).alias("first"),
        F.min_by(F.struct("risk_level", "risk_score"), F.struct(-F.col("risk_score"), order)).alias("risk"),
        F.max(blank_to_null("last_login")).alias("login"),
    ).where((F.col("n") > 1) & F.col("present"))
    united = group_token_union(members, "_primary", order, ["role", "entitlement"])
    new = {
        "role": F.coalesce("role_union", F.lit("")),
        "entitlement": F.coalesce("entitlement_union", F.lit("")),
        "risk_level": F.col("risk.risk_level"),
        "risk_score": F.col("risk.risk_score"),
        "last_login": F.coalesce("login", F.lit("")),
    }
    primaries = merged.join(united, "_primary", "left").select(
        *[new.get(c, F.col(f"first.{c}")).alias(c) for c in REPORT_COLUMNS]
    )
    gone = groups.join(merged.select(F.col("_primary").alias("primary_id")), "primary_id", "left_semi")
    return report.select(*REPORT_COLUMNS).join(gone.select("record_id"), "record_id", "left_anti").unionByName(primaries)


def replay(report: DataFrame, log: DataFrame) -> DataFrame:
    """Manual merges and name edits again, after a re-merge has rebuilt the rows.

    Decisions are not replayed: the upsert keeps them, and a newer automatic flag must stand.
    """
    merges = (
        effective_log(log).where(F.col("kind") == "merge")
        .groupBy("record_id").agg(F.max_by("target_record", "seq").alias("primary_id"))
    )
    return apply_reviews(manual_merge(report, merges), log.where(F.col("kind").isin("name", "undo", "redo")))
