"""Kept rollups against a recount of all entries."""

import random

from pyspark.sql import functions as F

from attestor.operators import match as M
from attestor.operators import rollups as A
from attestor.operators.identity import distinct_people
from attestor.operators.partials import Rollups
from attestor.session import write_through

from helpers import identity

SCHEMA = ("canonical_id string, display_name string, email string, system string, match_type string, risk_level string, risk_score int,"
          "conflicts array<int>, source_row long")
LEVELS = {"CRITICAL": 90, "HIGH": 70, "MEDIUM": 50, "LOW": 30, "INFO": 10}


def entries(spark, rng, systems, n, first=0):
    out = []
    for i in range(first, first + n):
        kind = rng.choice(["exact_email", "exact_id", "fuzzy_name", "fuzzy_ambiguous", "orphan"])
        level = rng.choice(list(LEVELS))
        who = "" if kind == "orphan" else f"p{rng.randrange(25)}@x"
        out.append((who, rng.choice(["", f"N{i}"]), rng.choice(["", who]), rng.choice(systems), kind, level, LEVELS[level], [1] * rng.randrange(3), i))
    return write_through(spark.createDataFrame(out, SCHEMA), "entries")


def people(spark, n):
    return identity(spark, [(f"E{i}", f"Person {i}", f"p{i}@x", "active") for i in range(n)])


def same(kept, rows, listed):
    idle = distinct_people(listed).join(rows.where("match_type <> 'orphan'").select("canonical_id"), "canonical_id", "left_anti")
    idle = idle.select("canonical_id", F.lit("no_access").alias("match_type"))
    for got, want in (
        (kept.totals(), A.report_totals(rows.select("canonical_id", "match_type").unionByName(idle))),
        (kept.join_stats(), M.join_stats(rows)),
        (kept.risk_summary(), A.risk_summary(rows)),
        (kept.user_summary(), A.user_summary(rows)),
    ):
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_batches_equal_a_recount(spark, tmp_path):
    rng, kept, listed = random.Random(1), Rollups(spark, str(tmp_path / "kept")), people(spark, 40)
    a, b = entries(spark, rng, ["a", "b"], 60), entries(spark, rng, ["b", "c"], 50, 100)
    kept.add(a)
    kept.set_people(listed)
    kept.add(b)
    same(kept, a.unionByName(b), listed)
    anew = entries(spark, rng, ["b"], 30, 300)
    kept.add(anew, replace=["b"])
    now = write_through(a.unionByName(b).where("system <> 'b'").unionByName(anew), "now")
    same(kept, now, listed)
    kept.compact()
    same(kept, now, listed)
    again = entries(spark, rng, ["a"], 10, 400)
    kept.add(again)
    kept.set_people(people(spark, 8))
    same(kept, write_through(now.unionByName(again), "now"), people(spark, 8))


def test_an_uncommitted_step_is_repeated(spark, tmp_path):
    rng, kept, listed = random.Random(3), Rollups(spark, str(tmp_path / "kept")), people(spark, 5)
    a, b = entries(spark, rng, ["a"], 20), entries(spark, rng, ["b"], 20, 50)
    kept.add(a)
    broken = Rollups(spark, kept.root)
    broken._commit = lambda version, kind: version
    broken.add(entries(spark, rng, ["c"], 20, 90))
    same(kept, a, listed.limit(0))
    kept.add(b)
    kept.set_people(listed)
    same(kept, a.unionByName(b), listed)
    numbers = spark.read.parquet(f"{kept.root}/numbers").groupBy().agg(F.count("number"), F.count_distinct("number"), F.count_distinct("canonical_id")).first()
    assert len(set(numbers)) == 1


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    rng, kept = random.Random(4), Rollups(spark, str(tmp_path / "kept"))
    kept.add(entries(spark, rng, ["a"], 200))
    one = entries(spark, rng, ["a"], 40).where("canonical_id = 'p3@x' or match_type = 'orphan'")
    kept.add(one)
    written = lambda t: spark.read.parquet(f"{kept.root}/{t}/version=1").count()
    assert written("users") == one.where("match_type <> 'orphan'").select("canonical_id").distinct().count() and written("bits") <= 1
    assert written("numbers") == 0


def test_nothing_kept(spark, tmp_path):
    kept = Rollups(spark, str(tmp_path / "kept"))
    assert tuple(kept.totals().first()) == (0, 0, 0, 0) and kept.user_summary().count() == 0
    assert {r.records for r in kept.risk_summary().collect()} == {0}
