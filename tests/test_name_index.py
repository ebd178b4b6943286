"""The stored name index against a search that cuts all names anew."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.operators.fuzzy import FuzzyRules, candidate_pairs
from attestor.operators.identity import build_index
from attestor.operators.match import match_accounts
from attestor.operators.name_index import NameIndex
from attestor.plans.review_run import change_identity, name_index
from attestor.session import write_through
from attestor.sinks.store import ReportStore

from helpers import accounts, identity
from test_match import brute, mutated


def people(spark, names):
    return identity(spark, [(f"P{i}", n, f"u{i}@x.com", "active") for i, n in enumerate(names)])


def pairs(df):
    return {(r.probe, r.name_key): (r.holders, r.sot_ord, r.score) for r in df.collect()}


def cut(spark, index, version):
    return spark.read.parquet(f"{index.root}/pieces/version={version}").select("name_key").distinct().count()


def test_hires_leavers_and_returns_equal_a_fresh_search(spark, tmp_path):
    rng = random.Random(9)
    rules = FuzzyRules(hot_block=4)
    index = NameIndex(spark, str(tmp_path / "index"), rules)
    pool = sorted({f"user account {rng.randrange(10**4):04d}" for _ in range(70)} | {"".join(rng.choices("xyz", k=12)) for _ in range(60)})
    rng.shuffle(pool)
    # Growing lists make blocks crowded late; one name is held twice, most of the first names leave and some come back.
    lists = [pool[:8], pool[:60] + pool[:1], pool[30:] + pool[30:33], pool[:50] + pool[60:], pool[40:]]
    probes = sorted({mutated(rng, rng.choice(pool), "0123xyz ") for _ in range(160)})
    sought = write_through(spark.createDataFrame([(p,) for p in probes], "probe string"), "sought")
    seen: set[str] = set()
    for version, names in enumerate(lists):
        staff = people(spark, names)
        assert index.update(staff, f"list {version}") == version
        assert cut(spark, index, version) == len(set(names) - seen)
        seen |= set(names)
        got = pairs(index.candidates(sought))
        assert {k: v[2] for k, v in got.items()} == brute(probes, set(names))
        table = write_through(build_index(staff).by_name.select("name_key", "holders", F.col("sot.sot_ord").alias("sot_ord")), "fresh")
        assert got == pairs(candidate_pairs(sought, table, rules)) and len(got) > (20 if version else 0)
    assert spark.read.parquet(f"{index.root}/triples/version=1").count() > 0
    assert index.update(staff, "again") == 5 and cut(spark, index, 5) == 0
    assert spark.read.parquet(f"{index.root}/names/version=5").count() == 0
    before = pairs(index.candidates(sought))
    assert index.compact() == 6 and index._versions() == [6] and index.source() == "again"
    assert pairs(index.candidates(sought)) == before and cut(spark, index, 6) == len(set(lists[-1]))
    index.update(people(spark, pool), "all")
    assert {k: v[2] for k, v in pairs(index.candidates(sought)).items()} == brute(probes, pool)


def test_an_interrupted_update_counts_only_when_repeated(spark, tmp_path, monkeypatch):
    index = NameIndex(spark, str(tmp_path / "index"))
    index.update(people(spark, ["annabel leeson"]), "one")
    probes = spark.createDataFrame([("annabel leesen",), ("robert raymond",)], "probe string")
    write = index._write

    def broken(name, version, df):
        if name == "triples":
            raise OSError("lost")
        return write(name, version, df)

    monkeypatch.setattr(index, "_write", broken)
    with pytest.raises(OSError):
        index.update(people(spark, ["robert raymund"]), "two")
    monkeypatch.undo()
    assert index.source() == "one" and set(pairs(index.candidates(probes))) == {("annabel leesen", "annabel leeson")}
    assert index.update(people(spark, ["robert raymund"]), "two") == 1
    assert set(pairs(index.candidates(probes))) == {("robert raymond", "robert raymund")}


def test_an_empty_list_and_other_rules(spark, tmp_path):
    index = NameIndex(spark, str(tmp_path / "index"))
    probes = spark.createDataFrame([("annabel leesen",)], "probe string")
    index.update(people(spark, []))
    assert index.candidates(probes).count() == 0
    index.update(people(spark, ["annabel leeson", ""]))
    assert index.candidates(probes).count() == 1
    with pytest.raises(ValueError, match="other rules"):
        NameIndex(spark, index.root, FuzzyRules(threshold=0.7)).candidates(probes)
    with pytest.raises(ValueError, match="threshold"):
        match_accounts(accounts(spark, [{}]), index.identity_index(people(spark, [])), FuzzyRules(threshold=0.7))


def test_the_cascade_on_a_stored_index(spark, tmp_path):
    names = ["anna smithson", "anna smithsen", "bert jonesbury", "carla millerman"]
    staff = people(spark, names)
    index = NameIndex(spark, str(tmp_path / "index"))
    index.update(people(spark, names[:2]))
    index.update(staff)
    acc = accounts(spark, [
        {"email": "U2@x.com"}, {"user_id": "P3"}, {"display_name": "Carla Milerman"}, {"display_name": "Anna Smithsan"},
        {"display_name": "bert jonesbury"}, {"display_name": "Nobody"}, {}])

    def shown(df):
        return sorted((r.source_row, r.match_type, r.sot and r.sot.sot_ord, r.attempted) for r in df.collect())

    for limit in (64 << 20, 1):
        assert shown(match_accounts(acc, index.identity_index(staff), broadcast_limit=limit)) == shown(match_accounts(acc, staff))


def test_a_store_keeps_its_index_with_the_list(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path / "store"))
    store.save_table("identity", people(spark, ["annabel leeson"]))
    index = name_index(store, store.load_table("identity"))
    assert name_index(store, store.load_table("identity"))._versions() == [0]
    # A list saved past the index is followed when it is next asked for.
    change_identity(store, people(spark, ["annabel leeson", "robert raymund"]))
    assert name_index(store, store.load_table("identity"))._versions() == [0, 1]
    assert cut(spark, index, 1) == 1 and index.names().count() == 2
