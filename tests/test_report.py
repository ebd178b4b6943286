import random

from pyspark.sql import functions as F

from attestor.operators import report as P
from attestor.operators import rollups as A
from attestor.operators import views as Q
from attestor.operators.match import match_accounts
from attestor.sinks import sheets as S

from helpers import accounts, identity, key_of, report, tokens, united

LEVELS = {10: "INFO", 25: "LOW", 50: "MEDIUM", 70: "HIGH", 75: "HIGH", 95: "CRITICAL"}


def random_rows(rng, n):
    rows = []
    for i in range(n):
        score = rng.choice(list(LEVELS))
        rows.append({
            "record_id": f"r{i}", "email": rng.choice(["", "", "a@x.com", "A@x.com", "b@x.com"]),
            "display_name": rng.choice(["", "", "", "Zed"]), "system": rng.choice(["s1", "s2"]),
            "role": rng.choice(["A, b", "b;a", "c", "", "A, b, c", ", ,"]), "entitlement": rng.choice(["", "x, Y", "y"]),
            "last_login": rng.choice(["", "2026-01-01", "2026-02-01"]), "source_row": i + 1,
            "risk_score": score, "risk_level": LEVELS[score],
        })
    return rows


def merge_model(rows):
    groups = {}
    for r in rows:
        groups.setdefault(key_of(r), []).append(r)
    out = {}
    for g in groups.values():
        first = g[0]
        if len(g) == 1:
            out[first["record_id"]] = (first["role"], first["entitlement"], first["last_login"], first["risk_score"], None, "")
            continue
        differ = len({frozenset(t.lower() for t in tokens(r["role"])) for r in g}) > 1
        out[first["record_id"]] = (
            united(r["role"] for r in g), united(r["entitlement"] for r in g), max(r["last_login"] for r in g),
            max(r["risk_score"] for r in g), "flag" if differ else None,
            f"Duplicate entries found with different roles ({len(g)} rows merged)" if differ else "",
        )
    return out


def merged(df):
    cols = ("role", "entitlement", "last_login", "risk_score", "review_action", "review_note")
    return {r.record_id: tuple(r[c] for c in cols) for r in df.collect()}


def test_dedupe_equals_model_with_a_large_nameless_group(spark):
    rows = random_rows(random.Random(1), 300)
    df = P.dedupe(report(spark, rows).repartition(5))
    assert merged(df) == merge_model(rows)
    assert merged(P.dedupe(df)) == merged(df)


def test_singles_keep_raw_text(spark):
    rows = [{"record_id": "x", "email": "q@x.com", "role": "B;a, a", "source_row": 1}]
    assert P.dedupe(report(spark, rows)).first().role == "B;a, a"


def test_name_filled_from_account_and_admin_info(spark):
    people = identity(spark, [("E1", "", "a@x.com", "active"), ("E2", "Bo", "b@x.com", "active")]).withColumn(
        "admin_info", F.when(F.col("employee_id") == "E2", "Root").otherwise("")
    )
    m = match_accounts(accounts(spark, [{"email": "a@x.com", "display_name": "Ann", "role": "R"}, {"email": "b@x.com", "display_name": "Bo"}]), people)
    a, b = P.live_rows(m).orderBy("source_row").collect()
    assert (a.display_name, a.review_action, a.role) == ("Ann", "flag", "R")
    assert a.review_note == "Display name sourced from satellite (sys), not present in SoT"
    assert (b.display_name, b.review_action, b.role, b.review_note) == ("Bo", None, "Root", "")
    assert {r.match_type for r in P.policy_entries(m, people, 0).collect()} == {"exact_email"}


def test_rollups_and_views(spark):
    rows = [
        {"record_id": "1", "email": "A@x.com", "display_name": "Ann", "system": "crm", "role": "Sales Admin, Root; sales admin", "source_row": 2, "risk_score": 50, "risk_level": "MEDIUM"},
        {"record_id": "2", "email": "a@x.com", "display_name": "Ann", "system": "aws", "role": "Dev", "entitlement": "Owner", "source_row": 1},
        {"record_id": "3", "email": "", "display_name": "100%_x", "system": "aws", "role": "system op", "match_type": "orphan", "source_row": 2, "risk_score": 75, "risk_level": "HIGH"},
        {"record_id": "4", "email": "", "display_name": "b", "system": "aws", "role": "", "match_type": "fuzzy_ambiguous", "employment_status": "terminated", "source_row": 3},
    ]
    r = report(spark, rows)

    def ids(df):
        return sorted(x.record_id for x in df.collect())

    assert [x.system for x in A.systems(r).collect()] == ["aws", "crm"]
    assert {x.email: x.admin_roles for x in A.admin_roles(r).collect()} == {
        "a@x.com": ["crm: Sales Admin", "crm: Root", "crm: sales admin"], "": ["aws: system op"],
    }
    matrix = {x.user: (x.aws, x.crm) for x in A.access_matrix(r, ["aws", "crm"]).collect()}
    assert matrix["a@x.com"] == ("Dev (Owner)", "Sales Admin, Root; sales admin") and matrix["name:100%_x"] == ("system op", "—")
    assert ids(Q.filter_report(r, "admins")) == ["1", "2", "3"]
    assert ids(Q.filter_report(r, "orphans")) == ["3"] and ids(Q.filter_report(r, "conflicts")) == ["4"]
    assert ids(Q.filter_report(r, "terminated_active")) == ["4"]
    assert ids(Q.filter_report(r, text="%_")) == ["3"] and len(ids(Q.filter_report(r, text="  "))) == 4
    assert ids(Q.filter_report(r, text="SALES", risk_level="MEDIUM", system="crm")) == ["1"]
    assert [x.record_id for x in Q.sort_report(r).collect()] == ["3", "1", "2", "4"]
    assert [x.display_name for x in Q.sort_report(r, "display_name", False).collect()] == ["100%_x", "Ann", "Ann", "b"]
    shown = Q.project(r, ["aws", "crm"], extra=("manager",), hidden=("review_note",), with_admin_roles=True)
    assert shown.columns == ["record_id", "display_name", "email", "admin_roles", "department", "employment_status", "aws", "crm", "risk_level", "risk_score", "review_action", "manager"]
    assert {x.record_id: x.admin_roles for x in shown.collect()}["4"] == ["aws: system op"]
    assert ids(Q.select_filtered(r, r.where("record_id = '1'").select("record_id"), tab="admins")) == ["2", "3"]


def test_user_entries_are_chunked(spark):
    rows = spark.range(25).select(
        F.lit("u").alias("canonical_id"), F.lit("s").alias("system"), F.col("id").alias("source_row"), F.lit("exact_email").alias("match_type")
    ).unionByName(spark.createDataFrame([("v", "s", 1, "exact_id"), ("", "s", 2, "orphan")], "canonical_id string, system string, source_row long, match_type string"))
    got = A.user_entries(rows, chunk_rows=10).collect()
    assert {r.canonical_id for r in got} == {"u", "v"} and sum(len(r.entries) for r in got) == 26
    assert {r.chunks for r in got if r.canonical_id == "u"} == {3}


def test_sheets_and_csv_text(spark, tmp_path):
    rows = [{"record_id": "1", "display_name": 'A "q", b', "role": " x ", "review_action": "approve", "role_actions": {"p": "revoke", "n": None}}]
    sheet = S.master_sheet(report(spark, rows)).coalesce(1)
    assert len(sheet.columns) == 19 and sheet.first()["Review Action"] == "p:revoke"
    S.write_csv(sheet, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_bytes().decode()
    assert text.startswith("Canonical ID,Employee ID,") and text.endswith("\r\n") and text.count("\r\n") == 2
    assert '1,,"A ""q"", b",,,,active,sys, x ,,,active,exact_email,INFO,10,p:revoke,,,0\r\n' in text


def test_positions_follow_the_order(spark):
    from attestor.operators import views

    rows = spark.range(500).selectExpr("id % 7 as k", "concat('r', id) as record_id").repartition(9)
    out = views.positions(rows.orderBy("k", "record_id")).orderBy("position").collect()
    assert [r.position for r in out] == list(range(1, 501)) and [(r.k, r.record_id) for r in out] == sorted((r.k, r.record_id) for r in out)


def test_groups_and_lookups_are_put_together_once(spark):
    """What is counted and then looked up is written, so the plan that follows holds no aggregation of whole rows."""
    from attestor.operators import incremental, rollups, views

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = report(spark, [{"record_id": f"r{i}", "email": f"u{i % 3}@x.com", "role": f"Admin {i}", "source_row": i} for i in range(6)])
    assert "min_by" not in plan(P.dedupe(rows))
    merged = plan(incremental.consolidate(rows.withColumn("batch_ord", F.lit(0))))
    assert "min_by" not in merged and "max_by" not in merged
    assert "collect_list" not in plan(views.project(rows, ["sys"], with_admin_roles=True))
    entries = rows.selectExpr("email as canonical_id", "system", "source_row", "match_type", "role")
    assert "count(1)" not in plan(rollups.user_entries(entries, 1))


def test_united_roles_are_not_broadcast(spark, tmp_path):
    """There are as many as groups whose rows differ, so they must not pass through the driver."""
    rows = report(spark, [{"email": "a@x.com", "role": r, "source_row": i} for i, r in enumerate(("A", "B"))])
    rows.write.parquet(str(tmp_path / "rows"))
    plan = P.dedupe(spark.read.parquet(str(tmp_path / "rows")))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "LeftOuter, BuildRight" not in plan


def test_a_login_is_parsed_once_per_entry(spark, tmp_path):
    people = identity(spark, [("E1", "Ann Lee", "a@x.com", "active")])
    rows = [{"email": "a@x.com", "role": r, "last_login": at, "account_status": "active"} for r in ("root", "user", None) for at in ("1990-01-01", "")]
    match_accounts(accounts(spark, rows), people).write.parquet(str(tmp_path / "m"))
    entries = P.policy_entries(spark.read.parquet(str(tmp_path / "m")), people, 883_612_800_000)
    got = [(r.risk_level, r.risk_score) for r in entries.orderBy("source_row").collect()]
    assert got == [("HIGH", 80), ("MEDIUM", 50), ("MEDIUM", 50), ("INFO", 0), ("MEDIUM", 50), ("INFO", 0)]
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("= terminated") == 1
