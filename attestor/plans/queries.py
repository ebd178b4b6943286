"""The registered queries: every operator on the benchmark tables, whole tables throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import risk as R
from attestor.functions import text as X
from attestor.functions.dates import is_dormant, parse_login
from attestor.operators import incremental as U
from attestor.operators import match as M
from attestor.operators import report as P
from attestor.operators import review as V
from attestor.operators import rollups as A
from attestor.operators import views as Q
from attestor.operators.delta import rematch
from attestor.operators.folded_log import FoldedLog
from attestor.operators.fuzzy import candidate_pairs, decide, resolve_names
from attestor.operators.identity import build_index, distinct_people, index_stats
from attestor.operators.name_index import NameIndex
from attestor.operators.partials import Rollups
from attestor.operators.text_index import TextIndex
from attestor.operators.tokens import group_token_union
from attestor.plans import derived as D
from attestor.schema import IDENTITY_COLUMNS
from attestor.session import scratch_dir
from attestor.sinks import sheets as S
from attestor.sources import mapping as C

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_STORED: dict[tuple[str, str, str], str] = {}

REPORT_VIEW = (
    "record_id", "employee_id", "display_name", "email", "employment_status", "system", "role",
    "entitlement", "last_login", "account_status", "match_type", "risk_level", "risk_score", "source_row",
)


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    from attestor.plans import file_queries  # registers the file-based queries

    assert file_queries
    return dict(_QUERIES)


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per application to the shared folder, then read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_dir(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "matches", lambda: M.match_accounts(D.accounts(spark, sf_dir), D.identity(spark, sf_dir))
    )


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "report", lambda: P.dedupe(P.live_rows(matches(spark, sf_dir))))


# Matching -----------------------------------------------------------------------------------


@query
def match_cascade(spark, sf_dir):
    m = M.match_accounts(D.okta(spark, sf_dir), D.identity(spark, sf_dir))
    return m.select(
        "source_row", "match_type",
        F.coalesce("sot.canonical_id", F.lit("")).alias("canonical_id"),
        F.size("conflicts").cast("long").alias("n_conflicts"),
    )


@query
def exact_email_join(spark, sf_dir):
    m = M.email_matches(D.accounts(spark, sf_dir), D.identity(spark, sf_dir))
    return m.select("system", "source_row", F.col("sot.employee_id").alias("employee_id"))


@query
def exact_id_join(spark, sf_dir):
    m = M.id_matches(D.accounts(spark, sf_dir), D.identity(spark, sf_dir))
    return m.select("system", "source_row", F.col("sot.employee_id").alias("employee_id"))


def _names(spark, sf_dir):
    o = D.okta(spark, sf_dir).select(X.normalize_name(F.col("display_name")).alias("name_key"))
    return o.where(F.col("name_key") != "").groupBy("name_key").agg(F.count(F.lit(1)).alias("rows"))


@query
def exact_name_lookup(spark, sf_dir):
    names = build_index(D.identity(spark, sf_dir)).by_name
    return _names(spark, sf_dir).join(names, "name_key").select(
        "name_key", "holders", F.col("sot.employee_id").alias("first_holder")
    )


def _pairs(spark, sf_dir):
    names = build_index(D.identity(spark, sf_dir)).by_name
    names = names.select("name_key", "holders", F.col("sot.sot_ord").alias("sot_ord"))
    return candidate_pairs(_names(spark, sf_dir).withColumnRenamed("name_key", "probe"), names)


@query
def fuzzy_broad_join(spark, sf_dir):
    return _pairs(spark, sf_dir).select("probe", "name_key", F.round("score", 9).alias("score"))


@query
def name_index_update(spark, sf_dir):
    """The similar names out of a stored index that followed three employee lists: hires and leavers, then the present one."""
    people = D.identity(spark, sf_dir)
    index = NameIndex(spark, scratch_dir(spark, "name-index"))
    staff = D.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{D.person_name('s_suppkey + 7')} as person")
    former = staff.select(*[
        F.col("s_suppkey").alias(c) if c == "sot_ord" else F.col("person").alias(c) if c == "display_name"
        else X.normalize_name(F.col("person")).alias(c) if c == "normalized_name" else F.lit("").alias(c) for c in IDENTITY_COLUMNS])
    for staff in (former.unionByName(people.where("sot_ord % 3 = 0")), people.where("sot_ord % 3 <> 1"), people):
        index.update(staff)
    pairs = index.candidates(_names(spark, sf_dir).withColumnRenamed("name_key", "probe"))
    return pairs.select("probe", "name_key", "holders", F.round("score", 9).alias("score"))


@query
def fuzzy_top2_decision(spark, sf_dir):
    return decide(_pairs(spark, sf_dir)).select("probe", "name_key", F.round("score", 9).alias("score"), "match_type")


@query
def name_resolution(spark, sf_dir):
    r = resolve_names(_names(spark, sf_dir), build_index(D.identity(spark, sf_dir)))
    return r.select("name_key", "match_type", F.col("sot.employee_id").alias("employee_id"))


@query
def orphans(spark, sf_dir):
    return S.orphan_sheet(matches(spark, sf_dir)).select(
        F.col("Source File").alias("source_file"), F.col("Account Status").alias("account_status"), F.col("Last Login").alias("last_login"),
        F.col("Source System").alias("source_system"), F.col("User ID").alias("user_id"),
        F.col("Display Name").alias("display_name"), F.col("Role").alias("role"),
        F.col("Attempted Match Keys").alias("attempted_keys"),
    )


@query
def match_all_systems(spark, sf_dir):
    """The cascade's outcome for the accounts of all systems."""
    return matches(spark, sf_dir).select(
        "system", "source_row", "match_type", F.coalesce("sot.canonical_id", F.lit("")).alias("canonical_id"),
        F.size("conflicts").cast("long").alias("n_conflicts"))


@query
def identity_update(spark, sf_dir):
    """Matches after employees left and others came: only accounts with a touched key or a similar name are matched again."""
    people = D.identity(spark, sf_dir)
    before, after = people.where("sot_ord % 37 != 3"), people.where("sot_ord % 41 != 5")
    old = stored(spark, sf_dir, "matches-before", lambda: M.match_accounts(D.accounts(spark, sf_dir), before))
    now, _ = rematch(old, before, after)
    return now.select(
        "system", "source_row", "match_type", F.coalesce("sot.canonical_id", F.lit("")).alias("canonical_id"),
        F.array_join("attempted", "; ").alias("attempted"), F.size("conflicts").cast("long").alias("n_conflicts"))


@query
def no_access_users(spark, sf_dir):
    """Employees without an account in the one system that few have."""
    identity = D.identity(spark, sf_dir)
    none = M.no_access(M.match_accounts(D.sap(spark, sf_dir), identity), identity)
    return none.select("canonical_id", "employee_id", "display_name", "email")


@query
def attempted_keys(spark, sf_dir):
    return matches(spark, sf_dir).select("system", "source_row", F.array_join("attempted", "; ").alias("attempted"))


@query
def field_conflicts(spark, sf_dir):
    s = S.conflict_sheet(matches(spark, sf_dir))
    return s.select(*[F.col(c).alias(c.lower().replace(" ", "_")) for c in s.columns])


@query
def similarity(spark, sf_dir):
    """Similarity of every account name to its employee's name."""
    m = matches(spark, sf_dir).where("match_type <> 'orphan'")
    a, b = F.lower("display_name"), F.lower("sot.display_name")
    return m.select("system", "source_row", F.round(X.similarity(a, b), 9).alias("score"))


@query
def join_stats(spark, sf_dir):
    return M.join_stats(matches(spark, sf_dir))


# Identity -----------------------------------------------------------------------------------


def _crowded_identity(spark, sf_dir):
    """Identities with repeated e-mails, ids and blank keys."""
    return D.identity(spark, sf_dir).withColumns({
        "email": F.when(F.col("sot_ord") % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("d"), (F.col("sot_ord") % 97).cast("string"), F.lit("@acme.com"))
        ),
        "employee_id": F.when(F.col("sot_ord") % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit("E"), F.floor(F.col("sot_ord") / 2).cast("string"))
        ),
        "normalized_name": F.when(F.col("sot_ord") % 2 == 0, F.lit("")).otherwise(F.col("normalized_name")),
    }).withColumn("canonical_id", F.coalesce(F.nullif("email", F.lit("")), "employee_id"))


@query
def identity_first_wins(spark, sf_dir):
    index = build_index(_crowded_identity(spark, sf_dir))
    mail = index.by_email.select(F.lit("email").alias("kind"), F.col("email").alias("key"), F.col("sot.sot_ord").alias("winner"))
    ids = index.by_id.select(F.lit("id").alias("kind"), F.col("user_id").alias("key"), F.col("sot.sot_ord").alias("winner"))
    return mail.unionByName(ids)


@query
def people_reachable(spark, sf_dir):
    return distinct_people(_crowded_identity(spark, sf_dir)).select("canonical_id", "sot_ord")


@query
def identity_stats(spark, sf_dir):
    return index_stats(D.identity(spark, sf_dir))


# Risk ---------------------------------------------------------------------------------------


@query
def risk_live(spark, sf_dir):
    return P.live_rows(matches(spark, sf_dir)).select("system", "source_row", "match_type", "risk_level", "risk_score")


@query
def risk_policy(spark, sf_dir):
    e = P.policy_entries(matches(spark, sf_dir), D.identity(spark, sf_dir), D.NOW_MS)
    return e.select("canonical_id", "system", "source_row", "match_type", "risk_level", "risk_score")


@query
def dormant_accounts(spark, sf_dir):
    a = D.accounts(spark, sf_dir)
    return a.where(is_dormant(F.col("last_login"), D.NOW_MS)).select("system", "source_row", "last_login")


LOGIN_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy",
    "dd-MMM-yyyy", "yyyyMMdd", "'never'",
)


def _login_texts(spark, sf_dir):
    at = F.col("o_orderdate")
    text = F.when(F.lit(False), F.lit(""))
    for i, f in enumerate(LOGIN_FORMATS):
        text = text.when(F.col("o_orderkey") % len(LOGIN_FORMATS) == i, F.date_format(at, f))
    return D.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("login"))


@query
def parse_login_formats(spark, sf_dir):
    seconds = F.unix_timestamp(parse_login(F.col("login")))
    return _login_texts(spark, sf_dir).select("o_orderkey", "login", F.coalesce(seconds, F.lit(-1)).alias("epoch"))


@query
def privileged_accounts(spark, sf_dir):
    a = D.accounts(spark, sf_dir)
    return a.where(R.is_privileged(F.col("role"), F.col("entitlement"))).select("system", "source_row", "role", "entitlement")


@query
def privileged_custom_keywords(spark, sf_dir):
    a = D.accounts(spark, sf_dir)
    words = ("URGENT", "purchase")
    return a.where(R.is_privileged(F.col("role"), F.col("entitlement"), words)).select("system", "source_row", "role")


# Text ---------------------------------------------------------------------------------------


@query
def normalize_name(spark, sf_dir):
    """Every sentence of the documents treated as a name."""
    d = D.table(spark, sf_dir, "documents")
    names = d.select("doc_id", F.posexplode(F.split("text", r"[.\n]")).alias("pos", "name"))
    return names.select("doc_id", F.col("pos").cast("long").alias("pos"), X.normalize_name(F.col("name")).alias("normalized"))


@query
def strip_diacritics(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    words = d.select(F.explode(F.split("text", r"[ \n]")).alias("word")).distinct()
    return words.select("word", X.strip_diacritics(F.col("word")).alias("stripped"))


@query
def token_union(spark, sf_dir):
    rows = D.aws(spark, sf_dir)
    u = group_token_union(rows, "user_id", F.col("source_row"), ["role", "entitlement"])
    return u.select("user_id", "role_union", "entitlement_union")


# Report -------------------------------------------------------------------------------------


@query
def live_report_rows(spark, sf_dir):
    return P.live_rows(matches(spark, sf_dir)).select(*REPORT_VIEW)


@query
def dedupe_identity(spark, sf_dir):
    r = P.dedupe(P.live_rows(matches(spark, sf_dir)))
    return r.select(*REPORT_VIEW, F.coalesce("review_action", F.lit("")).alias("review_action"), "review_note")


@query
def role_difference_flag(spark, sf_dir):
    return report(spark, sf_dir).where("review_action = 'flag'").select("record_id", "review_note")


@query
def policy_report(spark, sf_dir):
    e = P.policy_entries(matches(spark, sf_dir), D.identity(spark, sf_dir), D.NOW_MS)
    return e.select(*[c for c in P.POLICY_COLUMNS if c != "conflicts"], F.size("conflicts").cast("long").alias("n_conflicts"))


@query
def risk_summary(spark, sf_dir):
    return A.risk_summary(report(spark, sf_dir))


def _entries(spark, sf_dir):
    return stored(
        spark, sf_dir, "entries",
        lambda: P.policy_entries(matches(spark, sf_dir), D.identity(spark, sf_dir), D.NOW_MS),
    )


@query
def user_summary(spark, sf_dir):
    return A.user_summary(_entries(spark, sf_dir))


@query
def user_entries(spark, sf_dir):
    e = A.user_entries(_entries(spark, sf_dir), chunk_rows=50)
    return e.select("canonical_id", F.size("entries").alias("n")).groupBy("canonical_id").agg(F.sum("n").alias("entries"))


@query
def user_entry_rows(spark, sf_dir):
    """Every entry of every user, taken out of the chunks again."""
    e = A.user_entries(_entries(spark, sf_dir), chunk_rows=50).where("chunk < chunks").select("canonical_id", F.inline("entries"))
    return e.select(*[c for c in P.POLICY_COLUMNS if c != "conflicts"], F.size("conflicts").cast("long").alias("n_conflicts"))


@query
def report_totals(spark, sf_dir):
    return A.report_totals(_entries(spark, sf_dir))


def _rollups(spark, sf_dir):
    """Kept rollups after five steps: half of okta, the employee list, aws, sap, and okta anew as a whole."""
    key = (spark.sparkContext.applicationId, sf_dir, "rollups")
    if key not in _STORED:
        kept = Rollups(spark, scratch_dir(spark, "rollups"))
        accounts = _entries(spark, sf_dir).where("match_type <> 'no_access'")
        kept.add(accounts.where("system = 'okta' and source_row % 2 = 0"))
        kept.set_people(D.identity(spark, sf_dir))
        kept.add(accounts.where("system = 'aws'"))
        kept.add(accounts.where("system = 'sap'"))
        kept.add(accounts.where("system = 'okta'"), replace=["okta"])
        _STORED[key] = kept.root
    return Rollups(spark, _STORED[key])


@query
def kept_totals(spark, sf_dir):
    return _rollups(spark, sf_dir).totals()


@query
def kept_join_stats(spark, sf_dir):
    return _rollups(spark, sf_dir).join_stats()


@query
def kept_risk_summary(spark, sf_dir):
    return _rollups(spark, sf_dir).risk_summary()


@query
def kept_user_summary(spark, sf_dir):
    return _rollups(spark, sf_dir).user_summary()


@query
def export_totals(spark, sf_dir):
    t = A.export_totals(report(spark, sf_dir), matches(spark, sf_dir))
    return t.select("total_matched", "total_orphans", "critical_findings", F.col("total_conflicts").cast("long").alias("total_conflicts"))


@query
def systems(spark, sf_dir):
    return A.systems(report(spark, sf_dir))


@query
def admin_role_entries(spark, sf_dir):
    return A.admin_role_entries(report(spark, sf_dir)).select("email", "entry", "at.system", "at.source_row", "at.record_id")


@query
def admin_roles(spark, sf_dir):
    r = A.admin_roles(report(spark, sf_dir))
    return r.select("email", F.array_join("admin_roles", " | ").alias("admin_roles"))


@query
def access_matrix(spark, sf_dir):
    r = report(spark, sf_dir)
    return A.access_matrix(r, A.system_names(r), blank="-")


@query
def access_cells(spark, sf_dir):
    """The matrix in long form, which has no columns per system."""
    return A.access_cells(report(spark, sf_dir))


@query
def access_matrix_rows(spark, sf_dir):
    r = report(spark, sf_dir)
    return A.access_matrix_rows(r, A.system_names(r), blank="-")


@query
def filter_presets(spark, sf_dir):
    r = report(spark, sf_dir)
    return r.agg(*[F.count_if(Q.preset(p)).alias(p) for p in Q.PRESETS])


@query
def filter_admins(spark, sf_dir):
    return Q.filter_report(report(spark, sf_dir), "admins").select("record_id", "role", "entitlement")


@query
def search(spark, sf_dir):
    return Q.filter_report(report(spark, sf_dir), text="U12").select("record_id", "display_name", "email")


def _text_index(spark, sf_dir):
    """A stored index of the report that got okta first and then the other systems."""
    key = (spark.sparkContext.applicationId, sf_dir, "text-index")
    if key not in _STORED:
        index, rows = TextIndex(spark, scratch_dir(spark, "text-index")), report(spark, sf_dir)
        index.update(rows.where("system = 'okta'"))
        index.update(rows.where("system <> 'okta'"))
        _STORED[key] = index.root
    return TextIndex(spark, _STORED[key])


@query
def indexed_search(spark, sf_dir):
    return _text_index(spark, sf_dir).search("u12").select("record_id", "display_name", "email")


@query
def indexed_search_words(spark, sf_dir):
    return _text_index(spark, sf_dir).search("Billing Own").select("record_id", "display_name", "email")


@query
def filter_combined(spark, sf_dir):
    r = Q.filter_report(report(spark, sf_dir), "all", "reader", "HIGH", "okta")
    return r.select("record_id", "risk_level", "system")


@query
def sort_topk(spark, sf_dir):
    """The default sort: highest risk first, ties by record id; every record with its position."""
    return Q.positions(Q.sort_report(report(spark, sf_dir).select("record_id", "risk_score")))


@query
def sort_by_name(spark, sf_dir):
    """The locale sort by display name; every record with its position."""
    return Q.positions(Q.sort_report(report(spark, sf_dir).select("display_name", "record_id"), "display_name", descending=False))


@query
def select_filtered(spark, sf_dir):
    r = report(spark, sf_dir)
    excluded = r.where("source_row % 3 = 0").select("record_id")
    return Q.select_filtered(r, excluded, tab="orphans").select("record_id", "match_type")


@query
def select_by_ids(spark, sf_dir):
    r = report(spark, sf_dir)
    some = D.table(spark, sf_dir, "customer").where("c_nationkey = 3").selectExpr("'E' || c_custkey as employee_id")
    ids = r.join(some, "employee_id").select("record_id")
    return Q.select_by_ids(r, ids).select("record_id", "risk_level")


@query
def column_projection(spark, sf_dir):
    r = report(spark, sf_dir)
    out = Q.project(
        r, A.system_names(r), extra=("manager",), hidden=("review_note", "review_action"), with_admin_roles=True
    )
    return out.withColumns({
        "admin_roles": F.coalesce(F.array_join("admin_roles", " | "), F.lit("")),
        **{s: F.replace(F.col(s), F.lit("—"), F.lit("-")) for s in ("aws", "okta", "sap")},
    })


# Review -------------------------------------------------------------------------------------


def review_log(spark, sf_dir) -> DataFrame:
    """Events on records ``r<user_id>``: one per row of ``events``."""
    e = D.table(spark, sf_dir, "events")
    return V.log_rows(
        e.selectExpr(
            "event_id as seq",
            "cast(event_id % 7 as string) as review_id",
            "case when event_id % 5 < 2 then 'record' when event_id % 5 < 4 then 'role' else 'name' end as kind",
            "'r' || user_id as record_id",
            "case when event_id % 5 in (2, 3) then event_type end as role",
            "case event_id % 4 when 0 then 'approve' when 1 then 'revoke' when 2 then 'flag' end as action",
            "case when event_id % 3 = 0 then '' else 'n' || event_id end as note",
            "case when event_id % 5 = 4 then 'Name ' || event_id end as display_name",
            "case when event_id % 2 = 0 then 'b' || cast(floor(event_id / 20) as bigint) end as batch_id",
        )
    )


def _review_base(spark, sf_dir) -> DataFrame:
    """One blank report row per customer, record id ``r<key>``."""
    c = D.table(spark, sf_dir, "customer")
    return c.selectExpr(
        "'r' || c_custkey as record_id", "'E' || c_custkey as employee_id", "c_name as display_name",
        "'u' || c_custkey || '@acme.com' as email", "c_mktsegment as department", "'' as manager",
        "'active' as employment_status", "'crm' as system", "'A, b' as role", "'' as entitlement",
        "'' as last_login", "'active' as account_status", "cast(null as string) as review_action",
        "'' as review_note", "cast(null as map<string,string>) as role_actions", "'crm' as source_file",
        "c_custkey as source_row", "'exact_email' as match_type", "'INFO' as risk_level",
        "10 as risk_score", "'' as file_hash",
    )


def _map_text():
    return F.coalesce(
        F.array_join(
            F.array_sort(
                F.transform(
                    F.map_entries("role_actions"),
                    lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit("-"))),
                )
            ),
            "; ",
        ),
        F.lit(""),
    )


def _folded(spark, sf_dir, log):
    return _review_state(V.apply_reviews(_review_base(spark, sf_dir), log))


def _review_state(r):
    return r.select(
        "record_id", "display_name", F.coalesce("review_action", F.lit("")).alias("review_action"),
        "review_note", _map_text().alias("role_actions"),
    )


@query
def review_fold_record(spark, sf_dir):
    return _folded(spark, sf_dir, review_log(spark, sf_dir).where("kind <> 'role'"))


@query
def review_fold_role(spark, sf_dir):
    return _folded(spark, sf_dir, review_log(spark, sf_dir))


@query
def role_action_text(spark, sf_dir):
    r = V.apply_reviews(_review_base(spark, sf_dir), review_log(spark, sf_dir).where("kind = 'record' or role = 'click'"))
    return r.select("record_id", V.role_action_text().alias("review_action"))


@query
def bulk_action(spark, sf_dir):
    base = _review_base(spark, sf_dir)
    chosen = base.where("department = 'MACHINERY'")
    return _folded(spark, sf_dir, V.bulk_action(chosen, "approve", "bulk-1", 1))


def _switched_log(spark, sf_dir):
    log = review_log(spark, sf_dir)
    batches = log.where("batch_id is not null").select("batch_id", F.substring("batch_id", 2, 20).cast("long").alias("n")).distinct()
    switch = batches.where("n % 3 = 0").select(
        (F.col("n") + 10_000_000).alias("seq"), F.lit("undo").alias("kind"), F.col("batch_id").alias("target_batch")
    ).unionByName(
        batches.where("n % 9 = 0").select(
            (F.col("n") + 20_000_000).alias("seq"), F.lit("redo").alias("kind"), F.col("batch_id").alias("target_batch")
        )
    )
    return log.unionByName(V.log_rows(switch))


@query
def undo_batch(spark, sf_dir):
    """Every third batch is undone, every ninth redone."""
    return _folded(spark, sf_dir, _switched_log(spark, sf_dir))


@query
def folded_log(spark, sf_dir):
    """The same out of a stored fold that followed the log in four steps: half of the events, all, undos, redos."""
    log = _switched_log(spark, sf_dir)
    folded = FoldedLog(spark, scratch_dir(spark, "folded-log"))
    half = review_log(spark, sf_dir).agg(F.max("seq")).first()[0] // 2
    for upto in (half, 10_000_000 - 1, 20_000_000 - 1, None):
        folded.advance(log if upto is None else log.where(F.col("seq") <= upto))
    return _review_state(V.apply_state(_review_base(spark, sf_dir), folded.state()))


@query
def undo_redo_last(spark, sf_dir):
    """Two steps back and one forward again: the newest batch is undone, the one before it is back."""
    log = review_log(spark, sf_dir)
    for n, step in enumerate((V.undo_last, V.undo_last, V.redo_last)):
        log = log.unionByName(step(log, 30_000_000 + n))
    return _folded(spark, sf_dir, log)


@query
def toggle_role(spark, sf_dir):
    reviewed = V.apply_reviews(_review_base(spark, sf_dir), review_log(spark, sf_dir))
    clicks = D.table(spark, sf_dir, "customer").selectExpr(
        "20000000 + c_custkey as seq", "'r' || c_custkey as record_id", "'click' as role", "'approve' as action"
    )
    return V.toggle_role(reviewed, clicks).select("record_id", F.coalesce("action", F.lit("")).alias("action"))


@query
def note_edits(spark, sf_dir):
    log = review_log(spark, sf_dir).where("kind = 'record'")
    reviewed = V.apply_reviews(_review_base(spark, sf_dir), log)
    edits = D.table(spark, sf_dir, "customer").selectExpr(
        "20000000 + c_custkey as seq", "'r' || c_custkey as record_id", "'see ' || c_custkey as note"
    )
    return _folded(spark, sf_dir, log.unionByName(V.note_edits(reviewed, edits)))


@query
def name_edits(spark, sf_dir):
    base = _review_base(spark, sf_dir)
    edits = D.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as seq", "'r' || c_custkey as record_id",
        "case c_custkey % 3 when 0 then c_name when 1 then '  ' else ' New ' || c_custkey || ' ' end as display_name",
    )
    return _folded(spark, sf_dir, V.name_edits(base, edits))


@query
def history_retention(spark, sf_dir):
    return V.retain_history(review_log(spark, sf_dir), limit=100).select("review_id", "seq", "record_id")


def _rows_of_events(spark, sf_dir) -> DataFrame:
    """Report rows with review state, one per event: many rows per user and system."""
    risk = F.element_at(
        F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("s")) for a, b in (("INFO", 10), ("LOW", 25), ("MEDIUM", 50), ("HIGH", 70))]),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    e = D.table(spark, sf_dir, "events").withColumn("risk", risk)
    return e.selectExpr(
        "'e' || event_id as record_id", "'E' || user_id as employee_id", "'Person ' || user_id as display_name",
        "case when user_id % 9 = 8 then '' else 'u' || user_id || '@acme.com' end as email", "'' as department",
        "'' as manager", "'active' as employment_status", "case when event_id % 2 = 0 then 'aws' else 'gcp' end as system",
        "case when user_id % 4 = 0 then 'Viewer' when event_id % 7 = 0 then event_type || '; Root' else event_type end as role",
        "case when event_id % 5 = 0 then 'Billing, Owner' else '' end as entitlement",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as last_login", "'active' as account_status",
        "case when event_id % 11 = 0 then 'approve' when event_id % 13 = 0 then 'revoke' end as review_action",
        "case when event_id % 17 = 0 then 'note ' || event_id else '' end as review_note",
        "cast(null as map<string,string>) as role_actions",
        "'x' as source_file", "event_id as source_row", "'exact_email' as match_type",
        "risk.l as risk_level", "risk.s as risk_score", "'' as file_hash",
    )


@query
def manual_merge(spark, sf_dir):
    """All events of every even user are merged into the user's newest event."""
    rows = _rows_of_events(spark, sf_dir)
    e = D.table(spark, sf_dir, "events").where("user_id % 2 = 0").select("user_id", "event_id")
    newest = e.groupBy("user_id").agg(F.concat(F.lit("e"), F.max("event_id").cast("string")).alias("primary_id"))
    groups = e.join(newest, "user_id").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("record_id"), "primary_id")
    m = V.manual_merge(rows, groups)
    return m.select("record_id", "role", "entitlement", "last_login", "risk_level", "risk_score", F.coalesce("review_action", F.lit("")).alias("review_action"))


@query
def upsert_preserve_review(spark, sf_dir):
    rows = _rows_of_events(spark, sf_dir)
    old = rows.where("source_row % 3 <> 0").withColumn("role", F.lit("Old"))
    new = rows.where("source_row % 3 <> 1").withColumns({
        "review_action": F.lit(None).cast("string"), "review_note": F.lit(""), "account_status": F.lit("locked"),
    })
    return U.upsert(old, new).select(
        "record_id", "role", "account_status", F.coalesce("review_action", F.lit("")).alias("review_action"), "review_note"
    )


@query
def cross_batch_merge(spark, sf_dir):
    rows = _rows_of_events(spark, sf_dir)
    half = F.pmod(F.col("source_row"), F.lit(3)) == 0
    c = U.consolidate(rows.withColumn("batch_ord", F.when(half, F.lit(1)).otherwise(F.lit(0))))
    return c.select(
        "record_id", "role", "entitlement", "last_login", "risk_level", "risk_score",
        F.coalesce("review_action", F.lit("")).alias("review_action"), "review_note",
    )


@query
def unprocessed_files(spark, sf_dir):
    """Pages as files: those whose content is registered (every even page) are left out."""
    p = D.table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("hash"))
    return U.unprocessed(p, p.where("page_id % 2 = 0")).select("page_id", "hash")


# Mapping ------------------------------------------------------------------------------------


def _header_table(spark, sf_dir) -> DataFrame:
    """One 'file' per order with seven headers built from its line items."""
    words = (
        "Email Address", "user_id", "Full-Name", "emp_id", "last_login_date", "Group Name", "Status",
        "Access Level", "mail", "Dept", "Reports To", "notes", "Employee ID", "UPN", "name", "loginName",
        "EmpStatus", "memberOf", "lastlogon", "permissions",
    )
    pick = F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.col("l_partkey") * 7 + F.col("l_linenumber"), F.lit(len(words))) + 1).cast("int"))
    li = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pick.alias("header"))
    return li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "header"))).alias("h")
    ).select("l_orderkey", F.col("h.header").alias("headers"))


@query
def header_inference(spark, sf_dir):
    t = _header_table(spark, sf_dir)
    return t.select(
        "l_orderkey", F.array_join("headers", "|").alias("headers"),
        F.array_join(C.infer_targets(F.col("headers")), "|").alias("targets"),
    )


@query
def rejected_mappings(spark, sf_dir):
    """One mapping per order with an entry per line item: fields named twice, and unknown ones."""
    fields = [*C.TARGET_FIELDS, "salary"]
    entries = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("h"), "l_linenumber").alias("source"),
        F.element_at(F.array(*[F.lit(f) for f in fields]), (F.col("l_suppkey") % len(fields) + 1).cast("int")).alias("target"))
    return C.mapping_problems(entries).select("unit", F.col("pos").cast("long").alias("pos"), "source", "target", "problem")


@query
def concat_mapping(spark, sf_dir):
    mapping = C.ColumnMapping(
        direct={"c_name": "displayName", "c_mktsegment": "department"},
        concat=(C.Concat(("c_mktsegment", "blank", "c_name"), " - ", "displayName"),),
        split=(C.Split("c_name", "#", 1, "employeeId"),),
        template=(C.Template("{c_name}@{c_mktsegment}.example", "email"),),
    )
    raw = D.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", F.lit("").alias("blank")
    )
    f = C.mapped_fields(raw.columns, mapping)
    return raw.select("c_custkey", *[f[t].alias(n) for t, n in (("displayName", "display_name"), ("department", "department"), ("employeeId", "employee_id"), ("email", "email"))])


@query
def auto_mapping(spark, sf_dir):
    """Supplier columns under messy headers through the dictionary mapping and both normalisers."""
    from attestor.sources.normalize import normalize_accounts

    raw = D.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("  U"), F.col("s_suppkey").cast("string"), F.lit("@ACME.com ")).alias("Email Address"),
        F.col("s_name").alias("Full Name"),
        F.col("s_suppkey").cast("string").alias("PersonnelNumber"),
        F.lit("Clerk").alias("Role"),
        F.when(F.col("s_nationkey") < 5, F.lit(" Root ")).otherwise(F.lit("")).alias("Z Admin"),
        F.when(F.col("s_nationkey") < 9, F.lit("Ops")).otherwise(F.lit("")).alias("admin group"),
        F.lit("ENABLED").alias("Status"),
        F.lit("erp").alias("_system"), (F.col("s_suppkey") + 1).alias("_row"), F.lit("").alias("_hash"),
    )
    headers = raw.columns[:7]
    return normalize_accounts(raw, headers).select("email", "user_id", "display_name", "role", "account_status", "source_row")


@query
def system_name(spark, sf_dir):
    from attestor.sources.files import system_name as of

    p = D.table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(
            F.element_at(F.split("url", "[/.]"), -2),
            F.element_at(F.array(*[F.lit(x) for x in ("_export", " Users", "-ROLES", "_feed", "accounts", "")]), (F.col("page_id") % 6 + 1).cast("int")),
            F.lit(".csv"),
        ).alias("file_name"),
    )
    return p.select("page_id", "file_name", of(F.col("file_name")).alias("system"))
