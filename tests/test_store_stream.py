import os

import pytest
from pyspark.sql import functions as F

from attestor.operators.report import dedupe, live_rows
from attestor.operators.match import match_accounts
from attestor.operators.review import log_rows
from attestor.plans import review_run
from attestor.plans.review_run import add_files, change_identity
from attestor.session import write_through
from attestor.sinks.store import ReportStore
from attestor.sources.files import probe_files, register
from attestor.streaming import drop_folder
from attestor.streaming.drop_folder import intake, watch_folder

from helpers import identity

HEAD = "login,email,displayName,status,group\n"
STAFF = [("P1", "Ann Lee", "ann@x.com", "active"), ("P2", "Bo Ray", "bo@x.com", "terminated")]


def rows(df):
    return sorted((r.record_id, r.role, r.risk_level, r.review_action) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    s = ReportStore(spark, str(tmp_path / "store"))
    s.save_table("identity", identity(spark, STAFF))
    return s


def drop(folder, name, body):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEAD + body)
    return str(folder / name)


def test_stream_equals_batch_and_repeats_safely(spark, tmp_path, store):
    folder = tmp_path / "in"
    a = drop(folder, "crm.csv", "a,ann@x.com,Ann Lee,active,Dev\n")
    drop(folder, "007.csv", "b,bo@x.com,Bo Ray,active,Ops\n")

    def run():
        q = watch_folder(spark, str(folder), store, str(tmp_path / "state"), available_now=True)
        q.awaitTermination()
        assert q.exception() is None

    run()
    first = rows(store.report())
    assert first == [("ann@x.com::crm::1", "Dev", "INFO", None), ("bo@x.com::007::1", "Ops", "CRITICAL", None)]
    drop(folder, "crm_export.csv", "x,ann@x.com,Ann Lee,active,Sales\nz,zed@x.com,Zed,active,Ops\n")
    drop(folder, "copy.csv", "a,ann@x.com,Ann Lee,active,Dev\n")
    run()
    second = rows(store.report())
    assert [r for r in second if "007" in r[0]] == [r for r in first if "007" in r[0]]
    assert ("orphan::crm::2", "Ops", "HIGH", None) in second and len(second) == 3
    merged = [r for r in second if r[0] == "ann@x.com::crm::1"][0]
    # A known record keeps its review state, even an empty one.
    assert sorted(merged[1].split(", ")) == ["Dev", "Sales"] and merged[3] is None
    # The same micro-batch again (as after a crash) changes nothing.
    intake(spark, store, [str(folder / "crm_export.csv"), str(folder / "copy.csv")], 1)
    assert rows(store.report()) == second
    # An uncommitted newer version is invisible.
    dedupe(live_rows(match_accounts(store.matched(["crm"], 99).limit(0), store.load_table("identity"))))
    store.report().write.parquet(f"{store.root}/report/version=99/part=s-crm")
    assert rows(store.report()) == second
    assert rows(store.report(["007"])) == [r for r in second if "007" in r[0]]
    assert a


def test_add_files_needs_identity_and_skips_bad_files(spark, tmp_path, store):
    empty = ReportStore(spark, str(tmp_path / "none"))
    good = drop(tmp_path / "f", "hr_users.csv", "a,ann@x.com,Ann Lee,active,Dev\n")
    bad = drop(tmp_path / "f", "bad.csv", "")
    with pytest.raises(ValueError, match="no stored identity"):
        add_files(empty, register(probe_files(spark, [good])))
    assert add_files(store, register(probe_files(spark, [bad]))) == []
    assert add_files(store, register(probe_files(spark, [good, bad]))) == ["hr"]
    assert store.next_version() == 1


def test_parts_in_any_order_equal_one_batch(spark, tmp_path, store):
    """Parts come late and in any order; numbers, merged rows and decisions are as if all had been there at once."""
    people = ["ann@x.com,Ann Lee", "bo@x.com,Bo Ray", "u1@x.com,User One", "ann@x.com,Ann Lee", ",Nameless One", "u3@x.com,User Three"]
    roles = ["Dev", "Ops", "Sales", "Boss", "Temp", "Dev"]
    folder = tmp_path / "crm_export"
    part = lambda i: drop(folder, f"part-{i}.csv", f"a{i},{people[i]},active,{roles[i]}\nb{i},b{i}@y.com,Extra {i},active,Dev\n")

    def run():
        q = watch_folder(spark, str(folder), store, str(tmp_path / "state"), max_files=50, available_now=True, by_folder=True)
        q.awaitTermination()
        assert q.exception() is None

    for i in (3, 1, 4):
        part(i)
    run()
    by_row = {r.source_row: r for r in store.report().collect()}
    assert sorted(by_row) == [1, 2, 3, 4, 5, 6] and by_row[5].display_name == "Nameless One"
    # A decision on a user whose first row will change, and a new name for one who has no e-mail.
    decided = store.report().withColumn("review_action", F.when(F.col("email") == "ann@x.com", "approve").otherwise(F.col("review_action")))
    decided = write_through(decided.withColumn("display_name", F.when(F.col("source_row") == 5, "Known Now").otherwise(F.col("display_name"))), "decided")
    store.commit(decided, 900, ["crm"])
    store.save_table("review_log", log_rows(spark.createDataFrame([(1, "name", by_row[5].record_id, "Known Now")], "seq long, kind string, record_id string, display_name string")))
    store.save_table("stream_base", spark.createDataFrame([(901,)], "version long"))
    for late in ((5, 0, 2),):
        for i in late:
            part(i)
        run()
    got = {r.source_row: r for r in store.report().collect()}
    once = ReportStore(spark, str(tmp_path / "once"))
    once.save_table("identity", store.load_table("identity"))
    add_files(once, register(probe_files(spark, [f"{folder}/*.csv"], by_folder=True)))
    want = {r.source_row: r for r in once.report().collect()}
    assert set(got) == set(want) and len(want) == 11
    for row, r in want.items():
        assert (got[row].record_id, got[row].email, got[row].risk_level) == (r.record_id, r.email, r.risk_level)
        assert sorted(got[row].role.split(", ")) == sorted(r.role.split(", "))
    ann = next(r for r in got.values() if r.email == "ann@x.com")
    assert (ann.source_row, ann.review_action) == (1, "approve")
    assert got[9].display_name == "Known Now" and want[9].display_name == "Nameless One"
    assert store.load_table("review_log").first().record_id == "orphan::crm::9"
    assert store.load_table("stream_files").where("status = 'error'").count() == 0


def test_a_file_added_twice_is_merged_once(spark, tmp_path, store):
    path = drop(tmp_path / "f", "crm.csv", "a,ann@x.com,Ann Lee,active,Dev\n")
    assert add_files(store, probe_files(spark, [path])) == ["crm"]
    assert add_files(store, probe_files(spark, [path])) == []
    assert store.report().count() == 1 and store.next_version() == 1


def test_of_rows_that_share_an_id_the_later_file_wins(spark, tmp_path, store):
    """Two accounts without an owner at the same row of two files of one system: the file read later stands."""
    for run, names in enumerate((["zoe", "abe"], ["kim"])):
        for k, name in enumerate(names):
            drop(tmp_path / f"f{run}{k}", "crm.csv", f"{name},{name}@y.com,{name.title()},active,Dev\n")
    first = [str(tmp_path / f / "crm.csv") for f in ("f00", "f01")]
    add_files(store, probe_files(spark, [drop(tmp_path / "f", "crm.csv", "a,ann@x.com,Ann Lee,active,Dev\n")]))
    for paths, last in ((first, "abe@y.com"), ([str(tmp_path / "f10" / "crm.csv")], "kim@y.com")):
        add_files(store, probe_files(spark, paths))
        assert {r.record_id: r.email for r in store.report().collect()} == {"ann@x.com::crm::1": "ann@x.com", "orphan::crm::1": last}


def test_a_changed_employee_list_rebuilds_touched_systems(spark, tmp_path, store):
    """One leaves, one comes: the report equals that of a new store, and a system without touched accounts stays as it is."""
    files = [drop(tmp_path / "f", n, b) for n, b in (
        ("crm.csv", "a,ann@x.com,Ann Lee,active,Dev\nz,zed@x.com,Zed,active,Ops\n"), ("erp.csv", "b,bo@x.com,Bo Ray,active,Ops\n"))]
    add_files(store, probe_files(spark, files))
    approved = write_through(store.report().withColumn("review_action", F.when(F.col("email") == "ann@x.com", "approve").otherwise(F.col("review_action"))), "approved")
    store.commit(approved.where("system = 'crm'"), store.next_version(), ["crm"])
    new = identity(spark, [STAFF[0], ("", "", "", ""), ("P3", "Zed", "zed@x.com", "active")]).where("sot_ord <> 1")
    new = write_through(new.unionByName(identity(spark, STAFF).where("sot_ord = 1")), "staff")
    assert change_identity(store, new) == ["crm"] and store.load_table("identity").count() == 3
    got = {r.record_id: (r.email, r.match_type, r.review_action) for r in store.report().collect()}
    assert got == {"ann@x.com::crm::1": ("ann@x.com", "exact_email", "approve"), "zed@x.com::crm::2": ("zed@x.com", "exact_email", None),
                   "bo@x.com::erp::1": ("bo@x.com", "exact_email", None)}
    assert change_identity(store, new) == []


def test_lines_are_parsed_once_before_the_stages_read_them(spark, tmp_path, store, monkeypatch):
    """The cascade reads the accounts of new files once per stage: from a written table, not from the files."""
    read = []
    monkeypatch.setattr(review_run, "match_accounts", lambda accounts, *a: read.extend(accounts.inputFiles()) or match_accounts(accounts, *a))
    add_files(store, probe_files(spark, [drop(tmp_path / "f", "crm.csv", "a,ann@x.com,Ann Lee,active,Dev\n")]))
    assert read and not [f for f in read if f.endswith(".csv")]
    assert rows(store.report()) == [("ann@x.com::crm::1", "Dev", "INFO", None)]


def test_one_system_is_written_into_its_folder(spark, store):
    """Without a sort by system; a repeated batch leaves nothing of the systems of its first run."""
    path = f"{store.root}/matched/version=7"
    table = spark.createDataFrame([("crm", 1), ("erp", 2)], "system string, n int")
    store.save_matched(table.where("system = 'crm'"), 7, ["crm"])
    assert os.listdir(path) == ["part=s-crm"]
    store.save_matched(table.where("system = 'erp'"), 7, ["erp"])
    assert [(r.system, r.n, r.part) for r in spark.read.parquet(path).collect()] == [("erp", 2, "s-erp")]
    for version, name in ((8, "a b=c/d%"), (9, "007"), (10, "")):
        store.save_matched(spark.createDataFrame([(name, version)], "system string, n int"), version, [name])
        assert [r.n for r in store._read("matched").where((F.col("part") == f"s-{name}") & (F.col("version") == version)).collect()] == [version]


def test_parts_that_fill_several_batches_are_read_once(spark, tmp_path, store, monkeypatch):
    """Three batches name the five parts of a folder; before, each of them read the whole folder."""
    probed, probe = [], drop_folder.probe_files
    monkeypatch.setattr(drop_folder, "probe_files", lambda s, paths, **o: probed.append(list(paths)) or probe(s, paths, **o))
    monkeypatch.setattr(drop_folder, "add_files", lambda store, fresh, *a, **o: sorted({r.system for r in fresh.collect()}))
    folder = tmp_path / "crm"
    for i in range(5):
        drop(folder, f"part-{i}.csv", f"u{i},zed{i}@x.com,Zed,active,Ops\n")
    path = lambda i: f"file:{folder}/part-{i}.csv"
    assert intake(spark, store, [path(0), path(1)], 0, by_folder=True) == ["crm"]
    assert [intake(spark, store, [path(2 * n), path(2 * n + 1)], n, by_folder=True) for n in (1, 2)] == [[], []]
    assert probed == [[f"file:{folder}/*"]]
    # A repeated batch reads its folder again, and so does one that finds a part changed, even to the same size.
    assert intake(spark, store, [path(0), path(1)], 0, by_folder=True) == ["crm"] and len(probed) == 2
    drop(folder, "part-4.csv", "u4,zed4@x.com,Zed,active,Dev\n")
    os.utime(folder / "part-4.csv", (1, 1))
    assert intake(spark, store, [path(4)], 3, by_folder=True) == ["crm"] and len(probed) == 3
