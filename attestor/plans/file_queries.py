"""Queries over files Spark writes from the benchmark tables: ingestion, sinks, store, stream."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from attestor.operators import rollups as A
from attestor.plans import derived as D
from attestor.plans import review_run
from attestor.plans.queries import REPORT_VIEW, matches, query, report
from attestor.session import scratch_dir
from attestor.sinks import sheets as S
from attestor.sinks.store import ReportStore
from attestor.sources import files as I
from attestor.sources.normalize import place_identity
from attestor.streaming import drop_folder


def _in_task():
    """Position of a row in its task, from 0."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))



def _write_export(accounts, folder: str) -> None:
    """Part files under messy headers, with each row's place in its part file."""
    accounts.select(
        F.col("user_id").alias("login"), F.upper("email").alias("Email Address"),
        F.col("display_name").alias("Full Name"), F.col("account_status").alias("status"),
        F.col("role").alias("Group"), F.col("last_login").alias("lastLogin"),
        F.col("entitlement").alias("Access Level"), F.col("source_row").alias("ref"),
        (_in_task() + 1).alias("place"),
    ).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)


@query
def csv_ingest(spark, sf_dir):
    """Accounts of three systems through CSV files; rows keep content and place in their file."""
    root = scratch_dir(spark, "csv")
    for name, rows in (("okta_export", D.okta), ("aws_users", D.aws), ("sap", D.sap)):
        _write_export(rows(spark, sf_dir), f"{root}/{name}")
    registry = I.probe_files(spark, [f"{root}/{n}/*.csv" for n in ("okta_export", "aws_users", "sap")], by_folder=True)
    rows = I.read_accounts(spark, registry).rows
    return rows.select("system", "email", "user_id", "display_name", "role", "entitlement", "last_login", "account_status")


@query
def row_numbers(spark, sf_dir):
    """Position of every row inside its own part file."""
    root = scratch_dir(spark, "rows")
    _write_export(D.okta(spark, sf_dir), f"{root}/okta")
    registry = I.probe_files(spark, [f"{root}/okta/*.csv"])
    raw = I.read_table(spark, registry)
    return raw.select(F.col("ref").cast("long").alias("ref"), (F.col("place").cast("long") == F.col("_row")).alias("in_place"))


@query
def ragged_rows(spark, sf_dir):
    """Every third line is too short, every fifth too long (some quoted); padded, cut and reported."""
    root = scratch_dir(spark, "ragged")
    line = (
        F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit(","), F.col("s_suppkey").cast("string")))
        .when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit('"a, '), "s_name", F.lit('",'), F.col("s_suppkey").cast("string"), F.lit(",x,y,z")))
        .otherwise(F.concat("s_name", F.lit(","), F.col("s_suppkey").cast("string"), F.lit(",x")))
    )
    first = F.when(_in_task() == 0, F.lit("name,uid,role\n")).otherwise(F.lit(""))
    D.table(spark, sf_dir, "supplier").select(F.concat(first, line).alias("value")).write.text(f"{root}/sap")
    registry = I.probe_files(spark, [f"{root}/sap/*.txt"], by_folder=True)
    raw = I.read_table(spark, registry)
    notes = I.parse_warnings(raw).select((F.col("row") - 1).alias("_row"), "message")
    return raw.join(notes, "_row", "left").select(
        F.col("name"), F.col("uid"), F.col("role"), F.coalesce("message", F.lit("")).alias("message")
    )


@query
def lenient_quotes(spark, sf_dir):
    """Bare quotes in header and rows, line breaks in quotes, quotes inside quoted fields: no row or file is lost."""
    root = scratch_dir(spark, "quotes")
    key = F.col("c_custkey").cast("string")
    size = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('5" disk '), key)).otherwise(F.concat(F.lit('"5"" disk '), key, F.lit('"')))
    note = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"first line of '), key, F.lit('\nsecond, with 6" and ""seven""\n"')))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('"a "bare" quote, '), key, F.lit('"'))).otherwise(F.lit("plain"))
    )
    first = F.when(_in_task() == 0, F.lit('key,Disk 5" size,"note ""n""",last\n')).otherwise(F.lit(""))
    D.table(spark, sf_dir, "customer").select(
        F.concat(first, F.concat_ws(",", key, size, note, F.lit("end"))).alias("value")
    ).write.text(f"{root}/disks")
    registry = I.probe_files(spark, [f"{root}/disks/*.txt"], by_folder=True)
    return I.read_table(spark, registry).select(
        F.col("key").cast("long").alias("key"), F.col('Disk 5" size').alias("size"), F.col('note "n"').alias("note"), "last")


LAYOUTS = 300


@query
def many_layouts(spark, sf_dir):
    """Hundreds of exports, each with a header of its own, by one scan and one mapping plan."""
    root = scratch_dir(spark, "layouts")
    c = D.table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % LAYOUTS).cast("int").alias("unit"), F.lit(1).alias("at"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    heads = c.select("unit").distinct().select("unit", F.lit(0).alias("at"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("string").alias("name"))
    rows = c.unionByName(heads)
    own = F.concat(F.lit("x"), F.col("unit").cast("string"))
    mail = F.concat(F.lit("U"), F.col("k"), F.lit("@Acme.com"))
    cell = lambda h, v: F.coalesce(v, h if not isinstance(h, str) else F.lit(h))
    login, email, shown, extra = cell("login", F.col("k").cast("string")), cell("E-Mail", mail), cell("Full Name", F.col("name")), cell(own, F.when(F.col("k").isNotNull(), F.lit("-")))
    role = cell(F.concat(own, F.lit(" admin")), F.when(F.col("k") % 2 == 0, F.lit("Root")).when(F.col("k").isNotNull(), F.lit("")))
    line = F.when(F.col("unit") % 3 == 0, F.concat_ws(",", login, email, shown, extra, role)).when(
        F.col("unit") % 3 == 1, F.concat_ws(",", extra, role, email, shown, login)).otherwise(F.concat_ws(",", shown, extra, login, role, email))
    rows.select("unit", "at", line.alias("line")).repartition("unit").sortWithinPartitions("unit", "at").drop("at").write.partitionBy("unit").text(root)
    registry = I.probe_files(spark, [f"{root}/*/*.txt"], by_folder=True)
    return I.read_accounts(spark, registry).rows.select("system", "user_id", "email", "display_name", "role")


@query
def encoding_routing(spark, sf_dir):
    """Whole documents (quoted line breaks included) through four encodings and back."""
    d = D.table(spark, sf_dir, "documents").select("doc_id", "text")
    narrow = F.col("text").rlike(r"^[\x00-\xff]*\z")
    kind = F.when((F.col("doc_id") % 3 == 0) & narrow, "ISO-8859-1").when(F.col("doc_id") % 3 == 1, "UTF-16").otherwise("UTF-8")
    root = scratch_dir(spark, "enc")
    for name in ("ISO-8859-1", "UTF-16", "UTF-8"):
        d.where(kind == name).write.option("header", True).option("escape", '"').option("encoding", name).option(
            "ignoreLeadingWhiteSpace", False
        ).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/{name}")
    registry = I.probe_files(spark, [f"{root}/*/*.csv"])
    return I.read_table(spark, registry).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("md5"), F.char_length("text").cast("long").alias("chars")
    )


@query
def file_fingerprint(spark, sf_dir):
    """Six exports, each thrice: as it is, as a copy, and with its rows in reverse order.

    Which are of equal content, and which are registered; a second registration adds nothing.
    """
    root = scratch_dir(spark, "hash")
    rows = D.table(spark, sf_dir, "orders").withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        F.concat_ws("-", F.col("o_custkey") % 6, F.col("c")).alias("unit"), "o_orderkey", "o_totalprice",
        F.when(F.col("c") == 2, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("place"),
    )
    rows.repartition("unit").sortWithinPartitions("unit", "place").drop("place").write.partitionBy("unit").option("header", True).csv(root)
    files = I.probe_files(spark, [f"{root}/*/*.csv"], by_folder=True)
    fresh = I.register(files)
    again = I.register(files, fresh).select(F.col("name").alias("name")).withColumn("twice", F.lit(True))
    first = files.groupBy("hash").agg(F.min("name").alias("first_name"))
    return files.join(first, "hash").join(fresh.select("name", F.lit(True).alias("once")), "name", "left").join(again, "name", "left").select(
        "name", "first_name", (F.col("once").isNotNull() & F.col("twice").isNull()).alias("registered")
    )


@query
def employee_file(spark, sf_dir):
    """The employee list through a CSV export and its normaliser."""
    root = scratch_dir(spark, "staff")
    people = D.identity(spark, sf_dir)
    people.select(
        F.concat(F.lit(" "), "employee_id").alias("employee_id"), F.col("display_name").alias("full_name"),
        F.upper("email").alias("email_address"), "department", "manager", F.upper("employment_status").alias("employment_status"),
        F.col("admin_info").alias("Admin Info"),
    ).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{root}/hr_feed")
    registry = I.probe_files(spark, [f"{root}/hr_feed/*.csv"], by_folder=True)
    rows = place_identity(I.read_rows(spark, registry))
    return rows.select(
        "canonical_id", "employee_id", "display_name", "email", "department", "manager", "employment_status", "admin_info", "normalized_name"
    )


@query
def json_mapping(spark, sf_dir):
    """Accounts through files and a mapping kept as JSON, checked before it is used."""
    root = scratch_dir(spark, "json")
    D.table(spark, sf_dir, "supplier").select(
        F.concat_ws("|", "s_suppkey", "s_nationkey").alias("ids"), F.col("s_name").alias("who"), F.lit("x").alias("dept")
    ).write.option("header", True).csv(f"{root}/crm_users")
    registry = I.probe_files(spark, [f"{root}/crm_users/*.csv"], by_folder=True)
    mapping = json.dumps({
        "direct": {"who": "displayName"},
        "concat": [{"sourceColumns": ["dept", "who"], "separator": "/", "targetField": "role"}],
        "split": [{"sourceColumn": "ids", "separator": "|", "index": 0, "targetField": "userId"}],
        "template": [{"template": "{who}@{dept}.example", "targetField": "email"}],
    })
    rows = I.read_accounts(spark, registry, mappings={"crm": mapping}).rows
    return rows.select("system", "user_id", "display_name", "role", "email")


@query
def file_errors(spark, sf_dir):
    """One file per nation: those of odd ones have a header and no rows. They are listed, the rest is read."""
    root = scratch_dir(spark, "nations")
    n = D.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_name")
    lines = n.where("nation % 2 = 0").select("nation", F.lit(1).alias("at"), F.concat_ws(",", "s_suppkey", "s_name").alias("line"))
    heads = n.select("nation").distinct().select("nation", F.lit(0).alias("at"), F.lit("login,displayName").alias("line"))
    heads.unionByName(lines).repartition("nation").sortWithinPartitions("nation", "at").drop("at").write.partitionBy("nation").text(root)
    registry = I.probe_files(spark, [f"{root}/*/*.txt"], by_folder=True)
    read = I.read_accounts(spark, registry).rows.groupBy("system").agg(F.count(F.lit(1)).alias("rows_read"))
    return registry.select("name", "system", "status", F.coalesce("error", F.lit("")).alias("error")).join(read, "system", "left").select(
        "name", "status", "error", F.coalesce("rows_read", F.lit(0)).alias("rows_read")
    )


@query
def snapshot_round_trip(spark, sf_dir):
    """The report saved as a snapshot, saved again and loaded."""
    store = ReportStore(spark, scratch_dir(spark, "snapshot"))
    assert store.load_table("snapshot") is None
    for rows in (report(spark, sf_dir).limit(0), report(spark, sf_dir)):
        store.save_table("snapshot", rows)
    return store.load_table("snapshot").select("record_id", "system", "role", "risk_level", "risk_score", "source_row")


@query
def snapshot_clear(spark, sf_dir):
    """A snapshot that is cleared is gone; what is saved after it stands alone."""
    store = ReportStore(spark, scratch_dir(spark, "snapshot"))
    store.save_table("snapshot", report(spark, sf_dir))
    store.clear_table("snapshot")
    assert store.load_table("snapshot") is None
    store.save_table("snapshot", report(spark, sf_dir).where("risk_level = 'HIGH'"))
    return store.load_table("snapshot").select("record_id", "system", "role", "risk_level", "risk_score", "source_row")


@query
def review_folders(spark, sf_dir):
    """Folders of parts to the report: one is the employee list, designated after another one was."""
    root = scratch_dir(spark, "review")
    D.identity(spark, sf_dir).orderBy("sot_ord").select(
        "employee_id", "display_name", "email", "department", "manager", F.col("employment_status").alias("Emp Status"), F.col("admin_info").alias("Admin")
    ).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{root}/staff")
    for name, rows in (("okta", D.okta), ("aws", D.aws), ("sap", D.sap)):
        _write_export(rows(spark, sf_dir).orderBy("source_row"), f"{root}/{name}")
    paths = [f"{root}/*/*.csv"]
    folders = {r.name: r.unit for r in I.probe_files(spark, paths, by_folder=True).select("name", "unit").distinct().collect()}
    run = review_run.review_files(spark, paths, folders["staff"], by_folder=True)
    assert I.check_sot(I.designate_sot(I.designate_sot(run.registry, folders["sap"]), folders["staff"])).first().name == "staff"
    return run.report.select(*[c for c in REPORT_VIEW if c not in ("record_id", "source_row")])


@query
def file_sheet(spark, sf_dir):
    """The sheet of files: every page as a file, every tenth as an employee list."""
    pages = D.table(spark, sf_dir, "pages").select(
        F.col("url").alias("name"), (F.col("page_id") % 10 == 0).alias("is_sot"), F.sha2("html", 256).alias("hash"))
    _, files = S.metadata_sheet(report(spark, sf_dir), matches(spark, sf_dir), D.identity(spark, sf_dir), pages, D.NOW_MS)
    return files.select(F.col("File Name").alias("name"), F.col("Type").alias("type"), F.col("SHA-256 Hash").alias("hash"))


@query
def master_csv(spark, sf_dir):
    """The master report written as CSV and read back."""
    root = scratch_dir(spark, "master")
    S.write_csv(S.master_sheet(report(spark, sf_dir)), f"{root}/report")
    registry = I.probe_files(spark, [f"{root}/report/*.csv"], by_folder=True)
    raw = I.read_table(spark, registry)
    number = {"risk_score": "int", "source_row": "long"}
    names = {h: c or "review_action" for h, c in S.MASTER_COLUMNS.items()}
    return raw.select(*[F.col(h).cast(number.get(c, "string")).alias(c) for h, c in names.items()])


def _store_with(spark, sf_dir, rows) -> ReportStore:
    """A store holding the identity and the report of one system."""
    store = ReportStore(spark, scratch_dir(spark, "store"))
    store.save_table("identity", D.identity(spark, sf_dir))
    review_run.merge_version(store, rows, 0, ["okta"])
    return store


@query
def incremental_add(spark, sf_dir):
    """A stored report gains a second system from new files; the first is not touched."""
    store = _store_with(spark, sf_dir, D.okta(spark, sf_dir))
    folder = scratch_dir(spark, "more")
    _write_export(D.aws(spark, sf_dir), f"{folder}/aws_export")
    review_run.add_files(store, I.register(I.probe_files(spark, [f"{folder}/aws_export/*.csv"], by_folder=True)))
    return store.report().select(*REPORT_VIEW)


@query
def stream_ingest(spark, sf_dir):
    """The same intake as a streaming query over a drop folder, run to completion."""
    store = _store_with(spark, sf_dir, D.okta(spark, sf_dir))
    folder = scratch_dir(spark, "drop")
    _write_export(D.aws(spark, sf_dir), f"{folder}/aws_export")
    q = drop_folder.watch_folder(
        spark, f"{folder}/aws_export", store, scratch_dir(spark, "stream-state"), available_now=True, by_folder=True
    )
    q.awaitTermination()
    return store.report().select(*REPORT_VIEW)


@query
def run_metadata(spark, sf_dir):
    run, _ = S.metadata_sheet(
        report(spark, sf_dir), matches(spark, sf_dir), D.identity(spark, sf_dir),
        D.table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.lit(False).alias("is_sot"), F.sha2("html", 256).alias("hash")),
        D.NOW_MS,
    )
    return run.select("total_sot_users", "total_matched", "total_orphans", "critical_findings", F.col("total_conflicts").cast("long").alias("total_conflicts"))


@query
def live_pipeline(spark, sf_dir):
    """The flagship: accounts of three systems to the risk summary in one plan."""
    return A.risk_summary(review_run.live_report(D.accounts(spark, sf_dir), D.identity(spark, sf_dir)))
