import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; extra columns of these names must not matter.
CLASHING = ["id", "key", "a", "b", "start", "size", "h", "doc", "score", "kind", "rep", "block", "covered", "digest", "norm", "part", "_copy", "_text"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edge_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, and short texts."""
    rng = random.Random(5)
    base, long_text = words(rng, 80), words(rng, 30_000)
    near = base.split()
    near[3] = "changed"
    return [
        (1, base, "en", "a", len(base)), (2, base.upper(), "en", "a", None), (3, " ".join(near), "en", "b", 1), (4, None, None, None, None),
        (5, "", "en", "b", 0), (6, " \t\n ", "de", None, 4), (7, "one", "en", "c", 3), (8, "one", "en", "c", 3), (9, long_text, "en", "a", None),
        (10, long_text + " tail", "fr", "a", None), (11, "two words", None, "b", 9), (11, "two words", None, "b", 9), (None, base, "en", "a", 1),
        (None, None, None, None, None), (12, "ümlaut ſharp K \U0001f600 " * 30, "de", "d", 5), (13, "=" * 500, "xx", "d", 500),
        (14, "l1\nl2\nl3\nl4\n" * 3 + base, "en", "e", 5), (15, "x\nl1\nl2\nl3\nl4\nend", "en", "e", 5),
    ]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """The edge rows as a table with extra columns of clashing names."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("edge") / "docs")
    spark.createDataFrame(edge_rows(), SCHEMA).withColumns({c: F.lit(f"x{c}") for c in CLASHING}).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "docs")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, partitions=3):
        return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).repartition(partitions)

    return make


@pytest.fixture
def skew_splits(spark):
    """How many joins of a query split a skewed partition, where broadcasts are off and few rows make one."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)

    def count(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("skew=true")

    yield count
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
