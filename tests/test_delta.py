"""Matches under a changed employee list against a full run."""

import random

from pyspark.sql import functions as F

from attestor.operators.delta import identity_changes, rematch
from attestor.operators.match import match_accounts
from attestor.session import write_through

from helpers import accounts, identity


def staff(rng, n):
    first, last = ["anna", "bert", "carla", "dieter", "emil"], ["smithson", "smithsen", "jonesbury", "jonesburg", "millerman"]
    return [(f"P{i}" if i % 5 else "", f"{rng.choice(first)} {rng.choice(last)}", f"u{i % 25}@x.com" if i % 3 else "", rng.choice(["active", "terminated"])) for i in range(n)]


def key(r):
    return (r.system, r.source_row)


def shown(df):
    return {key(r): (r.match_type, r.sot and tuple(r.sot), tuple(map(tuple, r.conflicts)), tuple(r.attempted)) for r in df.collect()}


def test_hires_leavers_and_changes_equal_a_full_run(spark):
    rng = random.Random(3)
    people = staff(rng, 40)
    old = identity(spark, people)
    # Leavers go, one changes e-mail and one name, hires come last; the others keep their place.
    changed = {7: ("P7", "emil jonesburg", "new7@x.com", "active"), 9: ("P9", "carla smithsonn", people[9][2], "active")}
    rows = [(i, changed.get(i, p)) for i, p in enumerate(people) if i not in (4, 11, 20)] + [(40 + i, p) for i, p in enumerate(staff(rng, 4))]
    new = identity(spark, [p for _, p in rows]).withColumnRenamed("sot_ord", "at")
    places = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(rows)], "at long, sot_ord long")
    new = write_through(new.join(places, "at").select(*old.columns), "new-staff")
    names = sorted({p[1] for p in people}) + ["carla smithsonn", "emil jonesburgh", "zoe unlike", ""]
    acc = accounts(spark, [
        {"email": rng.choice(["", "U%d@x.com" % rng.randint(0, 30), "new7@x.com"]), "user_id": rng.choice(["", "P%d" % rng.randint(0, 45)]),
         "display_name": rng.choice(names).title()} for _ in range(150)])
    matched = write_through(match_accounts(acc, old), "old-matches")
    assert identity_changes(old, new).groupBy("change").count().count() == 2
    for limit in (64 << 20, 1):
        got, again = rematch(matched, old, new, broadcast_limit=limit)
        want = shown(match_accounts(acc, new))
        assert shown(got) == want and got.count() == 150
        touched = {key(r) for r in again.collect()}
        before = shown(matched)
        assert {k for k in want if want[k] != before[k]} <= touched and 0 < len(touched) < 150


def test_no_change_matches_nothing(spark):
    people = identity(spark, [("P1", "Ann Lee", "ann@x.com", "active")])
    matched = match_accounts(accounts(spark, [{"email": "ann@x.com"}, {"display_name": "Ann Lee"}]), people)
    got, again = rematch(matched, people, people.orderBy(F.desc("sot_ord")))
    assert again.count() == 0 and shown(got) == shown(matched)
