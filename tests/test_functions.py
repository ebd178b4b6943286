import datetime as dt
import random
import unicodedata

from pyspark.sql import functions as F

from attestor.functions import risk as R
from attestor.functions import text as X
from attestor.functions.dates import is_dormant, parse_login

from helpers import similar, united


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def test_normalize_name_golden(spark):
    golden = {
        "Muller, Thomas": "thomas muller",
        "John Q. Smith Jr": "john smith",
        "J. Smith": "smith",
        "José García-López": "jose garcia-lopez",
        "Smith, Jr": "smith,",
        "Jane Doe PhD MD": "jane doe phd",
        "Jane Doe MD PhD": "jane doe",
        "  ": "",
        "Ann  B C\tLee": "ann lee",
        ", Ann": ", ann",
        "x,jr": "x",
        "김철수": unicodedata.normalize("NFD", "김철수"),
    }
    assert dict(zip(golden, column(spark, list(golden), X.normalize_name))) == golden


def test_strip_diacritics_equals_decomposition_without_marks(spark):
    chars = [chr(c) for c in (*range(0xA0, 0xD800, 3), *range(0xF900, 0xFB00), *range(0x1D15E, 0x1D165), *range(0x2F800, 0x2F820))]
    words = ["a" + "".join(chars[i : i + 40]) for i in range(0, len(chars), 40)]
    want = ["".join(x for x in unicodedata.normalize("NFD", w) if unicodedata.category(x) != "Mn") for w in words]

    def same_letters(s):  # mark reordering aside, compare as decomposed text
        return unicodedata.normalize("NFD", s)

    got = column(spark, words, X.strip_diacritics)
    assert [same_letters(g) for g in got] == [same_letters(w) for w in want]


def test_similarity_counts_characters(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abé𝔸", k=rng.randint(1, 9))), "".join(rng.choices("abé𝔸", k=rng.randint(1, 9)))) for _ in range(100)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", X.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == similar(r.a, r.b)
    three_of_twenty = spark.range(1).select(X.similarity(F.lit("a" * 20), F.lit("a" * 17 + "bcd")).alias("s"))
    assert three_of_twenty.first().s >= 0.85


def test_token_union_and_sets(spark):
    texts = ["A, b;a ,C", "", " ; ,", "x", "B;A"]
    assert column(spark, texts, X.union_tokens) == [united([t]) for t in texts]
    assert column(spark, ["B, a", "A;b;B", "c"], X.token_set) == ["a,b", "a,b", "c"]


def test_login_formats(spark):
    good = {
        "2026-02-01T10:00:00Z": (2026, 2, 1, 10), "2026-02-01T10:00:00+02:00": (2026, 2, 1, 8),
        "2026-02-01T10:00:00.123456789Z": (2026, 2, 1, 10), "2026-02-01T10:00:00": (2026, 2, 1, 10),
        "2026-02-01 10:00:00": (2026, 2, 1, 10), "2026-02-01": (2026, 2, 1, 0), "02/01/2026": (2026, 2, 1, 0),
        "2/1/2026": (2026, 2, 1, 0), "Feb 1, 2026": (2026, 2, 1, 0), "february 01, 2026": (2026, 2, 1, 0),
        "01-Feb-2026": (2026, 2, 1, 0),
    }
    bad = ["", "never", "2026-02-30", "13/01/2026", "1-Feb-2026", "2026-2-1", "Febr 1, 2026", "2026-02-01 10:00:00Z", "2026"]
    got = column(spark, [*good, *bad], lambda c: F.unix_timestamp(parse_login(c)))
    want = [int(dt.datetime(*v, tzinfo=dt.timezone.utc).timestamp()) for v in good.values()]
    assert got == want + [None] * len(bad)


def test_dormancy_is_strict_and_defaults_to_90_days(spark):
    now = int(dt.datetime(2026, 4, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    texts = ["2026-01-01", "2025-12-31T23:59:59Z", "", "junk"]
    assert column(spark, texts, lambda c: is_dormant(c, now)) == [False, True, False, False]
    assert column(spark, ["2026-03-30"], lambda c: is_dormant(c, now, 1)) == [True]
    assert column(spark, texts, lambda c: is_dormant(c, now, 0)) == [False, True, False, False]


def test_risk_models(spark):
    now = int(dt.datetime(2026, 4, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    rows = [
        # status, account, role, entitlement, login, match → policy, live
        ("", "active", "Admin", "", "2020-01-01", "orphan", ("HIGH", 80), ("HIGH", 75)),
        ("terminated", "active", "", "", "", "exact_email", ("CRITICAL", 100), ("CRITICAL", 95)),
        ("terminated", "", "", "", "", "exact_email", ("CRITICAL", 100), ("INFO", 10)),
        ("terminated", "true", "", "", "", "exact_id", ("INFO", 0), ("LOW", 25)),
        ("active", "active", "Root", "", "2020-01-01", "exact_email", ("HIGH", 80), ("INFO", 10)),
        ("active", "active", "", "owner", "", "fuzzy_name", ("MEDIUM", 50), ("MEDIUM", 50)),
        ("contractor", "active", "", "", "2020-01-01", "fuzzy_ambiguous", ("MEDIUM", 50), ("HIGH", 70)),
        ("active", "active", "", "", "", "fuzzy_ambiguous", ("LOW", 20), ("HIGH", 70)),
        ("active", "active", "", "", "", "other", ("INFO", 0), ("MEDIUM", 50)),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "e string, a string, r string, t string, l string, m string")
    policy = R.policy_risk(*[F.col(c) for c in "eartlm"], now)
    live = R.live_risk(F.col("e"), F.col("a"), F.col("m"))
    got = [(tuple(x.p), tuple(x.v)) for x in df.select(policy.alias("p"), live.alias("v")).collect()]
    assert got == [(r[6], r[7]) for r in rows]
    words = df.select(R.is_privileged(F.col("r"), F.col("t"), ["OOT"]).alias("x")).collect()
    assert [w.x for w in words] == [False] * 4 + [True] + [False] * 4
    assert not any(w.x for w in df.select(R.is_privileged(F.col("r"), F.col("t"), []).alias("x")).collect())


def test_single_values_equal_lists_of_one(spark):
    """Values without a delimiter take a path of their own."""
    texts = [None, "", "  ", " a ", "A", "a;b", "b, A ;a;;", "\u00a0x\u2003", ";", "x,", "\u0130"]
    split = column(spark, texts, X.split_tokens)
    tagged = lambda c: X.when_single(c, lambda v: v, X.split_tokens(c))
    assert column(spark, texts, tagged) == split
    assert column(spark, texts, X.token_set)[1:] == [",".join(sorted({v.lower() for v in s})) if t != "\u0130" else "i\u0307" for t, s in zip(texts[1:], split[1:])]
    assert column(spark, texts[:1], X.token_set) == [None]
