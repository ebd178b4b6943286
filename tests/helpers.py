"""Small builders and plain-Python models the Spark results are compared with."""

from attestor.functions.text import normalize_name
from attestor.schema import ACCOUNT_COLUMNS, IDENTITY_COLUMNS
from pyspark.sql import functions as F


def identity(spark, rows):
    """rows: (employee_id, display_name, email, status)."""
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "sot_ord long, employee_id string, display_name string, email string, employment_status string",
    )
    return df.withColumns({
        "canonical_id": F.coalesce(F.nullif("email", F.lit("")), "employee_id"),
        "normalized_name": normalize_name(F.col("display_name")),
        "department": F.lit(""), "manager": F.lit(""), "admin_info": F.lit(""),
    }).select(*IDENTITY_COLUMNS)


def accounts(spark, rows, system="sys"):
    """rows: dicts of account fields."""
    text = ("email", "user_id", "display_name", "role", "entitlement", "last_login", "account_status")
    data = [(*[r.get(c, "") for c in text], r.get("system", system), i + 1, r.get("file_hash", "")) for i, r in enumerate(rows)]
    schema = ", ".join(f"{c} string" for c in text) + ", system string, source_row long, file_hash string"
    return spark.createDataFrame(data, schema).select(*ACCOUNT_COLUMNS)


REPORT_SCHEMA = (
    "record_id string, employee_id string, display_name string, email string, department string, manager string,"
    "employment_status string, system string, role string, entitlement string, last_login string,"
    "account_status string, review_action string, review_note string, role_actions map<string,string>,"
    "source_file string, source_row long, match_type string, risk_level string, risk_score int, file_hash string"
)


def report(spark, rows, extra=""):
    names = [c.strip().split(" ")[0] for c in REPORT_SCHEMA.replace("map<string,string>", "map").split(",")]
    more = [c.strip().split(" ")[0] for c in extra.split(",") if c.strip()]
    base = {
        "review_action": None, "role_actions": None, "source_row": 0, "risk_score": 10, "risk_level": "INFO",
        "match_type": "exact_email", "system": "sys", "employment_status": "active", "account_status": "active",
    }
    data = [tuple(r.get(c, base.get(c, "")) for c in names + more) for r in rows]
    return spark.createDataFrame(data, REPORT_SCHEMA + (", " + extra if extra else ""))


def tokens(s):
    return [t.strip() for t in s.replace(";", ",").split(",") if t.strip()]


def united(values):
    seen, out = set(), []
    for v in values:
        for t in tokens(v):
            if t.lower() not in seen:
                seen.add(t.lower())
                out.append(t)
    return ", ".join(out)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    return 1.0 if a == b else 1.0 - edit_distance(a, b) / max(len(a), len(b))


def key_of(row):
    return (row["email"].lower() if row["email"] else "name:" + row["display_name"].lower()) + "::" + row["system"]
