import pytest
from pyspark.sql import functions as F

from attestor.plans.review_run import review_files
from attestor.operators.rollups import risk_summary
from attestor.sources import files as I
from attestor.sources import mapping as C
from attestor.sources.normalize import normalize_accounts, normalize_identity

STAFF = (
    "employee_id,full_name,email_address,department,manager,employment_status\r\n"
    "P1,Ann Lee,ann@x.com,Eng,Bo,active\r\nP2,Bo Ray,bo@x.com,Eng,Cy,terminated\r\n"
)
EXPORT = "login,email,displayName,status,group,lastLogin\n"


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def read(spark, paths, **kw):
    registry = I.probe_files(spark, paths, **kw)
    return registry, I.read_table(spark, registry)


def rows_of(df, *cols):
    return [tuple(r) for r in df.orderBy("_file", "_row").select(*cols).collect()]


def test_encodings_and_headers(spark, tmp_path):
    body = "Name , Code\nJosé,1\n\"a,\"\"b\"\"\nc\",2\n"
    put(tmp_path, "a.csv", body)
    put(tmp_path, "b.csv", b"\xef\xbb\xbf" + body.encode())
    put(tmp_path, "c.csv", body.encode("latin-1"))
    put(tmp_path, "d.csv", b"\xff\xfe" + body.encode("utf-16-le"))
    put(tmp_path, "e.csv", b"\xfe\xff" + body.encode("utf-16-be"))
    registry, rows = read(spark, [str(tmp_path)])
    enc = {r.name: r.encoding for r in registry.collect()}
    assert enc == {"a.csv": "utf-8", "b.csv": "utf-8-bom", "c.csv": "latin-1", "d.csv": "utf-16le", "e.csv": "utf-16be"}
    assert all(r.headers == ["Name", "Code"] for r in registry.collect())
    assert rows_of(rows, "Name", "Code", "_row") == [("José", "1", 1), ('a,"b"\nc', "2", 2)] * 5


def test_ragged_duplicate_headers_blank_lines(spark, tmp_path):
    put(tmp_path, "x.csv", 'a,b,a\n1,2,3\n\n4,5\n6,7,8,9\n"p,q",r\n')
    registry, rows = read(spark, [str(tmp_path)])
    assert registry.first().headers == ["a", "b", "a"]
    assert rows_of(rows, "a", "b", "_row") == [("3", "2", 1), ("", "5", 2), ("8", "7", 3), ("", "r", 4)]
    notes = I.parse_warnings(rows).orderBy("row").collect()
    assert [(n.row, n.message) for n in notes] == [
        (3, "row has 2 columns, expected 3; padding with empty values"),
        (4, "row has 4 columns, expected 3; truncating extra columns"),
        (5, "row has 2 columns, expected 3; padding with empty values"),
    ]


def test_row_numbers_over_many_blocks(spark, tmp_path):
    put(tmp_path, "big.csv", "n,pad\n" + "".join(f"{i},{'x' * (i % 50)}\n" for i in range(1, 3001)))
    put(tmp_path, "big2.csv", "n,pad\n" + "".join(f"{i},y\n" for i in range(1, 500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
    try:
        _, rows = read(spark, [str(tmp_path)])
        assert rows.where(F.col("n").cast("long") != F.col("_row")).count() == 0
        assert rows.count() == 3499 and rows.select(F.spark_partition_id()).distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_folder_of_parts_is_one_export(spark, tmp_path):
    (tmp_path / "okta_export").mkdir()
    put(tmp_path / "okta_export", "part-0.csv", "n\n1\n2\n")
    put(tmp_path / "okta_export", "part-1.csv", "n\né3\n".encode("latin-1"))
    put(tmp_path / "okta_export", "part-2.csv", "n\n4\n")
    registry, rows = read(spark, [str(tmp_path / "*" / "*.csv")], by_folder=True)
    assert {r.system for r in registry.collect()} == {"okta"}
    got = sorted((r._row, r.n) for r in rows.collect())
    assert got == [(1, "1"), (2, "2"), (3, "é3"), (4, "4")]


def test_registry_errors_hashes_and_duplicates(spark, tmp_path):
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "head.csv", "a,b\n\n")
    put(tmp_path, "one.csv", "a\n1\n")
    put(tmp_path, "copy.csv", "a\n1\n")
    files = I.probe_files(spark, [str(tmp_path)])
    assert {(r.name, r.error) for r in I.file_errors(files).collect()} == {("empty.csv", I.NO_HEADER), ("head.csv", I.NO_ROWS)}
    fresh = I.register(files)
    assert sorted(r.name for r in fresh.collect()) == ["copy.csv", "empty.csv", "head.csv"]
    assert I.register(files, fresh).count() == 0
    hashes = {r.name: r.hash for r in files.collect()}
    assert hashes["one.csv"] == hashes["copy.csv"] and len(set(hashes.values())) == 3
    with pytest.raises(ValueError):
        I.check_sot(files)


def split_small(spark, size="64b"):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return old


def test_facts_do_not_depend_on_splits(spark, tmp_path):
    put(tmp_path, "a.csv", "x y,z\n1,é\n\"2\n\",3\n" + "7,8\n" * 40)
    put(tmp_path, "b.csv", ("x y,z\n1,é\n" + "5,6\n" * 40).encode("latin-1"))
    put(tmp_path, "c d+e.csv", b"\xef\xbb\xbfx,z\n1,2\n" + b"3,4\n" * 40)
    put(tmp_path, "u.csv", b"\xff\xfe" + ("p,q\n" + "1,2\n" * 40).encode("utf-16-le"))
    put(tmp_path, "n.csv", "x,z\n1,2")
    whole = sorted(map(str, I.probe_files(spark, [str(tmp_path)]).collect()))
    old = split_small(spark)
    try:
        assert sorted(map(str, I.probe_files(spark, [str(tmp_path)]).collect())) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {r.name: (r.encoding, r.header) for r in I.probe_files(spark, [str(tmp_path)]).collect()}
    assert got["c d+e.csv"] == ("utf-8-bom", "x,z") and got["u.csv"] == ("utf-16le", "p,q") and got["n.csv"] == ("utf-8", "x,z")


def test_order_counts_and_equal_parts_stay(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    put(one, "a.csv", "n\n1\n2\n")
    put(one, "b.csv", "n\n2\n1\n")
    assert I.register(I.probe_files(spark, [str(one)])).count() == 2
    two.mkdir()
    for i, text in enumerate(("n\n1\n", "n\n1\n", "n\n5\n")):
        put(two, f"part-{i}.csv", text)
    parts = I.register(I.probe_files(spark, [f"{two}/*.csv"], by_folder=True))
    assert parts.count() == 3 and parts.select("hash").distinct().count() == 1
    assert I.register(I.probe_files(spark, [f"{two}/*.csv"], by_folder=True), parts).count() == 0


def test_very_wide_and_quoted_headers(spark, tmp_path):
    names = [f"column number {i}" for i in range(6_000)]
    put(tmp_path, "wide.csv", ",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    put(tmp_path, "quoted.csv", '"a\nb","c ""d""",e\n1,2,3\n')
    found = {len(x.headers): x.headers for x in I.probe_files(spark, [str(tmp_path)]).collect()}
    assert found[6_000] == names and found[3] == ["a\nb", 'c "d"', "e"]


def test_system_names(spark):
    want = {
        "okta_export.csv": "okta", "AWS IAM Users.csv": "AWS IAM", "hr_feed.csv": "hr_feed", "Export.csv": "Export",
        "a.b-DUMP.txt": "a.b", "x_roles_report.csv": "x_roles", "noext": "noext",
    }
    df = spark.createDataFrame([(k,) for k in want], "n string").select("n", I.system_name(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == want


def test_mapping_plans(spark):
    assert C.auto_mapping(["Mail", "EMAIL", "user-name", "x"]) == {"Mail": "email", "user-name": "userId"}
    heads = ["emp_id", "last_login_date", "E-Mail", "email2", "Name", "first name", "status", "emp status", "zzz"]
    want = {
        "emp_id": "employeeId", "last_login_date": "userId", "E-Mail": "email", "Name": "displayName",
        "status": "accountStatus", "emp status": "employmentStatus",
    }
    assert C.infer_mapping(heads) == want
    df = spark.createDataFrame([(heads,)], "h array<string>").select(C.infer_targets(F.col("h")).alias("t"))
    assert df.first().t == [want.get(h, "") for h in heads]
    assert C.load_mapping("nonsense").is_empty() and C.load_mapping("").is_empty() and C.load_mapping("[1]").is_empty()
    loaded = C.load_mapping('{"direct":{"a":"email"},"concat":[{"sourceColumns":["f","l"],"separator":" ","targetField":"displayName"}]}')
    assert loaded.direct == {"a": "email"} and loaded.concat[0].sources == ("f", "l")
    with pytest.raises(ValueError, match="already mapped"):
        C.validate_mapping(C.ColumnMapping(direct={"a": "email", "b": "email"}))
    with pytest.raises(ValueError, match="unknown field"):
        C.validate_mapping(C.ColumnMapping(direct={"a": "salary"}))


def test_mapping_transforms_and_normalisation(spark):
    raw = spark.createDataFrame(
        [("Ann", "Lee", " A@X.com ", "x|y|z", "Boss", "", 1), ("", "", "", "q", "", " Root ", 2)],
        "first string, last string, m string, parts string, `B Admin` string, `a.admin` string, _row long",
    ).withColumns({"_system": F.lit("s"), "_hash": F.lit("h")})
    m = C.ColumnMapping(
        direct={"m": "email", "first": "displayName", "gone": "role"},
        concat=(C.Concat(("first", "last"), " ", "displayName"),),
        split=(C.Split("parts", "|", 1, "userId"),),
        template=(C.Template("{first}/{last}-{nope}", "entitlement"),),
    )
    headers = raw.columns[:6]
    got = [tuple(r) for r in normalize_accounts(raw, headers, m).orderBy("source_row").select("email", "display_name", "user_id", "entitlement", "role").collect()]
    assert got == [("a@x.com", "Ann Lee", "y", "Ann/Lee-{nope}", "Boss"), ("", "", "", "/-{nope}", "Root")]
    people = normalize_identity(raw, headers, C.ColumnMapping(direct={"first": "displayName", "parts": "employeeId"}))
    assert [r.admin_info for r in people.orderBy("sot_ord").collect()] == ["Boss", "Root"]
    assert people.orderBy("sot_ord").first().canonical_id == "x|y|z"


def test_end_to_end_files(spark, tmp_path):
    sot = put(tmp_path, "staff.csv", STAFF)
    crm = put(tmp_path, "crm_users.csv", EXPORT + 'al,ann@x.com,Ann Lee,ACTIVE,"Sales Admin, Ops",2026-01-01\nbr,BO@x.com,Ray Bo,ACTIVE,Dev,\n'
              "gh,ghost@x.com,Ghost,ACTIVE,IT-Admin,\nal,ann@x.com,Ann Lee,ACTIVE,ops;Extra,2026-02-01\n")
    bad = put(tmp_path, "bad.csv", "a,b\n")
    r = review_files(spark, [sot, crm, bad], "file:" + sot)
    rep = {x.email: x for x in r.report.collect()}
    assert len(rep) == 3
    ann = rep["ann@x.com"]
    assert (ann.role, ann.last_login, ann.source_row, ann.review_action) == ("Sales Admin, Ops, Extra", "2026-02-01", 1, "flag")
    assert ann.review_note == "Duplicate entries found with different roles (2 rows merged)"
    assert ann.record_id == "ann@x.com::crm::1" and rep["ghost@x.com"].record_id == "orphan::crm::3"
    assert {x.risk_level: x.records for x in risk_summary(r.report).collect()} == {"CRITICAL": 1, "HIGH": 1, "MEDIUM": 0, "LOW": 0, "INFO": 1}
    assert [e.name for e in r.errors.collect()] == ["bad.csv"]
    with pytest.raises(ValueError, match="no data rows"):
        review_files(spark, [bad, crm], "file:" + bad)
    alone = review_files(spark, [sot], "file:" + sot)
    assert alone.report is None and alone.identity.count() == 2
