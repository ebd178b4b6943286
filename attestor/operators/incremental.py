"""Keeping a report current: upsert by record, consolidation across batches, new-file checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import split_tokens
from attestor.operators.report import identity_key, live_rows
from attestor.operators.skew import salted_lookup
from attestor.operators.tokens import group_token_union
from attestor.schema import REPORT_COLUMNS, ROLE_ACTIONS_TYPE, blank_to_null
from attestor.session import write_through

REVIEW_STATE = ("review_action", "review_note", "role_actions")
DUPLICATE_NOTE = "Duplicate entries found with different roles"


def unprocessed(files: DataFrame, registry: DataFrame, key: str = "hash") -> DataFrame:
    """Files whose content is not registered yet."""
    return files.join(registry.select(key), key, "left_anti")


def upsert(report: DataFrame, incoming: DataFrame) -> DataFrame:
    """New data wins by record id; the review state of a known record stays, even if empty.

    Of rows that share an id in ``incoming``, that of the file read last wins: by ``ingest_ord`` where there is
    such a column, then by fingerprint. Adds ``batch_ord``: 0 for known records, 1 for new ones (the order of the report).
    """
    order = [c for c in ("ingest_ord", "file_hash", "source_row") if c in incoming.columns]
    new = incoming.groupBy("record_id").agg(F.max_by(F.struct(*REPORT_COLUMNS), F.struct(*order)).alias("new"))
    old = report.select("record_id", F.struct(*REPORT_COLUMNS).alias("old"))
    both = old.join(new, "record_id", "full_outer")

    def pick(c: str) -> Column:
        prefer, other = ("old", "new") if c in REVIEW_STATE else ("new", "old")
        return F.when(F.col(prefer).isNotNull(), F.col(f"{prefer}.{c}")).otherwise(F.col(f"{other}.{c}"))

    return both.select(
        *[pick(c).alias(c) for c in REPORT_COLUMNS],
        F.when(F.col("old").isNotNull(), F.lit(0)).otherwise(F.lit(1)).alias("batch_ord"),
    )


def consolidate(rows: DataFrame) -> DataFrame:
    """Merge rows of the same user and system across batches, in report order.

    The merge is an ordered fold: a row with a strictly higher risk takes over, roles unite, a
    row whose role set differs from the united set so far flags the result, review state is
    taken from the leading row or else the other.

    A fold over a whole group would gather it in one task. Only few rows can change its
    outcome: the first row of each risk score and of each role value, the first and last row of
    each role count, and the first with an action, a note or role actions. They are picked with
    mergeable aggregates, so the fold sees no more rows than the united role list is long
    (plus a constant), whatever the group's size.
    """
    order = F.struct("batch_ord", "system", "source_row", "file_hash", "record_id")
    rows = rows.select(*REPORT_COLUMNS, "batch_ord").withColumns({"_key": identity_key(), "_ord": order})
    packed = F.struct(
        *[F.col(c) if c != "role_actions" else F.map_entries(c).alias(c) for c in REPORT_COLUMNS]
    )
    groups = rows.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(packed, "_ord").alias("row"),
        F.max(blank_to_null("last_login")).alias("login"),
    )
    groups = write_through(groups, "groups")
    single = groups.where("n = 1").select("row.*")
    several = groups.where("n > 1").select("_key")
    members = salted_lookup(rows, several, "_key", ["record_id"], "left_semi").withColumn(
        "_roles", F.array_distinct(F.transform(split_tokens(F.col("role")), F.lower))
    )

    def tag(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    def tag_if(kind: str, cond: Column) -> Column:
        return F.when(cond, tag(kind, F.lit("")))

    tags = F.concat(
        F.array_compact(
            F.array(
                tag("score", F.col("risk_score")),
                tag("count", F.size("_roles")),
                tag_if("action", F.col("review_action").isNotNull()),
                tag_if("note", F.col("review_note") != ""),
                tag_if("roles", F.col("role_actions").isNotNull()),
            )
        ),
        F.transform("_roles", lambda r: tag("role", r)),
    )
    # Places of the rows first: whole rows are not copied per tag, only those picked are fetched.
    ends = members.select("_key", "_ord", F.explode(tags).alias("tag")).groupBy("_key", "tag").agg(
        F.min("_ord").alias("first"), F.max("_ord").alias("last")
    )
    places = ends.select(
        "_key",
        F.explode(
            F.when(F.col("tag.kind") == "count", F.array("first", "last")).otherwise(F.array("first"))
        ).alias("_ord"),
    ).distinct()
    item = F.struct(F.col("_ord").alias("ord"), F.col("_roles").alias("roles"), packed.alias("row"))
    picked = members.join(places.hint("merge"), ["_key", "_ord"], "left_semi").select("_key", item.alias("item"))
    folded = picked.groupBy("_key").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        "_key", _fold(F.col("items")).alias("s")
    )
    united = group_token_union(members, "_key", F.col("_ord"), ["role", "entitlement"])
    logins = groups.where("n > 1").select("_key", "login")
    new = {
        "role": F.coalesce("role_union", F.lit("")),
        "entitlement": F.coalesce("entitlement_union", F.lit("")),
        "last_login": F.coalesce("login", F.lit("")),
        "review_action": F.col("s.action"),
        "review_note": F.col("s.note"),
        "role_actions": F.col("s.role_actions"),
    }
    merged = folded.join(united, "_key", "left").join(logins, "_key").select(
        *[new.get(c, F.col(f"s.row.{c}")).alias(c) for c in REPORT_COLUMNS]
    )
    out = single.unionByName(merged)
    return out.withColumn("role_actions", F.map_from_entries("role_actions").cast(ROLE_ACTIONS_TYPE))


def _fold(items: Column) -> Column:
    first = F.get(items, F.lit(0))

    def state(row: Column, roles: Column, action: Column, note: Column, role_actions: Column) -> Column:
        return F.struct(
            row.alias("row"), roles.alias("roles"), action.alias("action"), note.alias("note"),
            role_actions.alias("role_actions"),
        )

    start = state(
        first["row"], first["roles"], first["row"]["review_action"], first["row"]["review_note"],
        first["row"]["role_actions"],
    )

    def step(acc: Column, item: Column) -> Column:
        row = item["row"]
        keep = acc["row"]["risk_score"] >= row["risk_score"]
        differ = (F.size(acc["roles"]) != F.size(item["roles"])) | (
            F.size(F.array_except(item["roles"], acc["roles"])) > 0
        )

        def lead(mine: Column, other: Column) -> Column:
            return F.when(keep, mine).otherwise(other)

        action_1 = lead(acc["action"], row["review_action"])
        action_2 = lead(row["review_action"], acc["action"])
        note_1 = lead(acc["note"], row["review_note"])
        note_2 = F.when(differ, F.lit(DUPLICATE_NOTE)).otherwise(lead(row["review_note"], acc["note"]))
        actions_1 = lead(acc["role_actions"], row["role_actions"])
        actions_2 = lead(row["role_actions"], acc["role_actions"])
        return state(
            lead(acc["row"], row),
            F.array_union(acc["roles"], item["roles"]),
            F.when(differ, F.lit("flag")).otherwise(F.coalesce(action_1, action_2)),
            F.when(note_1 != "", note_1).otherwise(note_2),
            F.coalesce(actions_1, actions_2),
        )

    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def moved_ids(outdated: DataFrame) -> DataFrame:
    """(old_id, new_id, new_row) of the accounts of grown units; ``outdated``: their earlier matches with ``by``."""
    rows = live_rows(outdated).select("record_id", "source_row", "file_hash", "system")
    by = outdated.select("system", "source_row", "file_hash", "by").distinct()
    new_row = F.col("source_row") + F.col("by")
    return rows.join(by, ["system", "source_row", "file_hash"]).select(
        F.col("record_id").alias("old_id"),
        F.concat(F.regexp_replace("record_id", "::[0-9]+\\z", "::"), new_row.cast("string")).alias("new_id"), new_row.alias("new_row"),
    ).dropDuplicates(["old_id"])


def renumber(report: DataFrame, ids: DataFrame) -> DataFrame:
    """``report`` under the new ids and row numbers of ``moved_ids``; other rows stay."""
    new = {"record_id": F.coalesce("new_id", "record_id"), "source_row": F.coalesce("new_row", "source_row")}
    return report.join(ids.withColumnRenamed("old_id", "record_id"), "record_id", "left").select(
        *[new.get(c, F.col(c)).alias(c) for c in REPORT_COLUMNS])


def leading_ids(report: DataFrame, incoming: DataFrame) -> DataFrame:
    """(old_id, new_id, new_row) of users whose first row is another one now."""
    first = incoming.select(identity_key().alias("_key"), F.col("record_id").alias("new_id"), F.col("source_row").alias("new_row"))
    return report.select(identity_key().alias("_key"), F.col("record_id").alias("old_id")).join(
        first.dropDuplicates(["_key"]), "_key").where(F.col("old_id") != F.col("new_id")).drop("_key")


def renumber_log(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The review log under new ids."""
    out = log
    for c in ("record_id", "target_record"):
        out = out.join(ids.select(F.col("old_id").alias(c), "new_id"), c, "left").withColumn(c, F.coalesce("new_id", c)).drop("new_id")
    return out.select(*log.columns)


def append_report(report: DataFrame, incoming: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Upsert, consolidate and (with a log) replay manual merges and name edits."""
    from attestor.operators.review import replay

    out = consolidate(upsert(report, incoming))
    return out if log is None else replay(out, log)
