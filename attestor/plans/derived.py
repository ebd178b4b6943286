"""Identity and account tables derived from the benchmark's star schema.

``customer`` plays the employee list; ``orders``, ``events`` and ``supplier`` play exports of
three systems. Everything is a projection of its table, so the work grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.text import normalize_name
from attestor.operators.skew import estimated_bytes
from attestor.schema import ACCOUNT_COLUMNS, IDENTITY_COLUMNS

NOW_MS = 883_612_800_000  # 1998-01-01T00:00:00Z


NARROW_BYTES = 4 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table. One small file is one task, however many cores there are, so tables
    below NARROW_BYTES per core are spread by their key; larger ones are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    if NARROW_BYTES // 4 < size < NARROW_BYTES * cores:
        return df.repartition(cores, df.columns[0])
    return df


def _word(prefix: str, key: str, size: int) -> str:
    letters = f"translate(substr(md5('{prefix}' || cast({key} as string)), 1, {size}), '0123456789', 'ghijklmnop')"
    return f"upper(substr({letters}, 1, 1)) || substr({letters}, 2)"


def person_name(key: str) -> str:
    """SQL text of the display name of person number ``key``; some pairs share a name."""
    k = f"(case when {key} % 40 = 7 then {key} - 1 else {key} end)"
    return f"{_word('f', k, 6)} || ' ' || {_word('l', k, 9)}"


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("*", f"{person_name('c_custkey')} as person").selectExpr(
        "c_custkey as sot_ord",
        "'E' || c_custkey as employee_id",
        "person as display_name",
        "case when c_custkey % 17 = 0 then '' else 'u' || c_custkey || '@acme.com' end as email",
        "c_mktsegment as department",
        "'E' || cast(floor(c_custkey / 10) as bigint) as manager",
        "case c_custkey % 20 when 0 then 'terminated' when 1 then 'contractor' "
        "when 2 then 'leave' else 'active' end as employment_status",
        "case when c_custkey % 23 = 0 then 'Domain Admin' else '' end as admin_info",
    )
    return c.select(
        F.coalesce(F.nullif(F.col("email"), F.lit("")), "employee_id").alias("canonical_id"),
        "*",
        normalize_name(F.col("display_name")).alias("normalized_name"),
    ).select(*IDENTITY_COLUMNS)


def okta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("*", f"{person_name('o_custkey')} as person").selectExpr(
        "case when o_orderkey % 10 < 7 then 'u' || o_custkey || '@acme.com' "
        "when o_orderkey % 10 = 9 then 'x' || o_orderkey || '@other.org' else '' end as email",
        "case when o_orderkey % 10 = 7 then 'E' || o_custkey else '' end as user_id",
        "case when o_orderkey % 50 = 9 then 'Ghost Account' when o_orderkey % 3 = 0 then person "
        "when o_orderkey % 3 = 1 then person || 'q' "
        "else substr(person, 1, 3) || 'z' || substr(person, 5) end as display_name",
        "o_orderpriority as role",
        "case when o_orderkey % 11 = 0 then 'Admin Console' when o_orderkey % 13 = 0 then 'Reader, Writer' "
        "else 'Reader' end as entitlement",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as last_login",
        "case o_orderstatus when 'O' then 'active' when 'F' then 'disabled' else 'locked' end as account_status",
        "'okta' as system",
        "o_orderkey + 1 as source_row",
        "'' as file_hash",
    ).select(*ACCOUNT_COLUMNS)


def aws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "case when user_id % 9 = 8 then '' else 'u' || user_id || '@acme.com' end as email",
        "'E' || user_id as user_id",
        f"{person_name('user_id')} as display_name",
        "case when event_id % 7 = 0 then event_type || '; Root, ' || upper(event_type) else event_type end as role",
        "case when event_id % 5 = 0 then 'Billing Owner' else '' end as entitlement",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as last_login",
        "case when event_id % 4 = 0 then 'active' else 'true' end as account_status",
        "'aws' as system",
        "event_id + 1 as source_row",
        "'' as file_hash",
    ).select(*ACCOUNT_COLUMNS)


def sap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "'' as email",
        "case when s_suppkey % 2 = 0 then 'E' || s_suppkey else '' end as user_id",
        "s_name as display_name",
        "case when s_nationkey < 5 then 'System Owner' else 'Clerk' end as role",
        "'' as entitlement",
        "'' as last_login",
        "'' as account_status",
        "'sap' as system",
        "s_suppkey + 1 as source_row",
        "'' as file_hash",
    ).select(*ACCOUNT_COLUMNS)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return okta(spark, sf_dir).unionByName(aws(spark, sf_dir)).unionByName(sap(spark, sf_dir))
