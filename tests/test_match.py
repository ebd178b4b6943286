import random

from pyspark.sql import functions as F

from attestor.operators.fuzzy import FuzzyRules, candidate_pairs, decide
from attestor.operators.identity import distinct_people, index_stats
from attestor.operators.match import join_stats, match_accounts, no_access
from attestor.operators.skew import hot_keys, salted_lookup

from helpers import accounts, identity, similar

STAFF = [
    ("E1", "Alice Chen", "alice@x.com", "active"),
    ("E2", "Bob Martinez", "bob@x.com", "terminated"),
    ("E3", "Carolina Whitefield", "", "leave"),
    ("E4", "Same Name", "same1@x.com", "active"),
    ("E5", "Same Name", "same2@x.com", "active"),
    ("E6", "Dana Christopherson", "dana1@x.com", "active"),
    ("E7", "Dana Christophersen", "dana2@x.com", "active"),
    ("E1", "Alice Copy", "alice@x.com", "active"),
    *[(f"H{i}", "Many Holders", f"h{i}@x.com", "active") for i in range(11)],
]
ROWS = [
    {"email": "ALICE@x.com", "display_name": "alice chen"},
    {"email": "nobody@x.com", "user_id": "E3", "display_name": "Whitefield, Carolina"},
    {"user_id": "e3", "display_name": "Carolina Whitefeld"},
    {"display_name": "Same Name"},
    {"display_name": "Dana Christophersan"},
    {"display_name": "many HOLDERS Jr"},
    {"display_name": "Nobody Atall", "email": "n@x.com", "user_id": "Z"},
    {},
    {"display_name": "Bob Martínez"},
]
WANT = [
    ("exact_email", 0), ("exact_id", 2), ("fuzzy_name", 2), ("fuzzy_ambiguous", 3), ("fuzzy_ambiguous", 5),
    ("fuzzy_ambiguous", 8), ("orphan", None), ("orphan", None), ("fuzzy_name", 1),
]


def outcome(m):
    return [(r.match_type, r.o) for r in m.orderBy("source_row").select("match_type", F.col("sot.sot_ord").alias("o")).collect()]


def test_cascade_in_both_plans_and_with_hot_keys_salted(spark):
    people, sats = identity(spark, STAFF), accounts(spark, ROWS)
    m = match_accounts(sats, people)
    assert outcome(m) == WANT
    staged = match_accounts(sats.repartition(3), people, rows_per_split=1, broadcast_limit=-1)
    assert outcome(staged) == WANT
    rows = {r.source_row: r for r in m.collect()}
    assert rows[7].attempted == ["email:n@x.com", "employeeId:Z", "name:nobody atall"]
    assert rows[8].attempted == [] and rows[1].conflicts == []
    assert [c.satellite_value for c in rows[2].conflicts] == ["Whitefield, Carolina"]
    s = join_stats(m).first()
    assert (s.total_processed, s.exact_email, s.exact_id, s.fuzzy_name, s.ambiguous, s.orphans) == (9, 1, 1, 2, 3, 2)
    idle = {r.employee_id for r in no_access(m, people).collect()}
    assert "E5" in idle and "E1" not in idle and len(idle) == 12


def test_stages_move_accounts_once_and_leave_blank_and_null_keys_open(spark):
    """What a stage finds is written, so hits and misses are read instead of joined again."""
    people, sats = identity(spark, STAFF), accounts(spark, [*ROWS, {"email": None, "user_id": None}, {"email": None, "user_id": "E3"}])
    staged = match_accounts(sats, people, broadcast_limit=-1)
    plan = staged._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Join LeftAnti" not in plan
    assert outcome(staged) == outcome(match_accounts(sats, people)) == [*WANT, ("orphan", None), ("exact_id", 2)]


def test_index_stats_and_reachable_people(spark):
    people = identity(spark, STAFF + [("", "", "", "active"), ("E1", "", "alice@x.com", "")])
    s = index_stats(people).first()
    assert (s.total_records, s.terminated_count, s.active_count, s.unique_emails) == (21, 1, 20, 17)
    found = {r.canonical_id: r.sot_ord for r in distinct_people(people).collect()}
    assert found["alice@x.com"] == 0 and "" not in found and found["E3"] == 2


def test_salted_lookup_keeps_every_row(spark):
    left = spark.range(1000).select(
        F.when(F.col("id") < 400, "hot").when(F.col("id") < 700, "").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id"
    )
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3)], "k string, v int")
    plain = left.join(right, "k", "left")
    for how in ("left", "inner", "left_anti"):
        got = salted_lookup(left, right, "k", ["id"], how, rows_per_split=50, broadcast_limit=-1)
        want = left.where("k <> ''").join(right, "k", how)
        if how != "inner":
            want = want.unionByName(left.where("k = ''").join(right, "k", how))
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert plain.count() == 1000
    assert [(r.k, r._splits) for r in hot_keys(left, "k", rows_per_split=50)["k"].collect()] == [("hot", 8)]


def brute(probes, names):
    return {(p, n): similar(p, n) for p in probes for n in names if p != n and similar(p, n) >= 0.85}


def name_table(spark, names):
    return spark.createDataFrame([(n, 1 + i % 2, i) for i, n in enumerate(names)], "name_key string, holders long, sot_ord long")


def mutated(rng, word, letters):
    w = list(word)
    for _ in range(rng.randint(1, 4)):
        i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        if kind == 0:
            w.insert(i, rng.choice(letters))
        elif i < len(w) and len(w) > 1:
            if kind == 1:
                w[i] = rng.choice(letters)
            else:
                del w[i]
    return "".join(w)


def test_blocked_search_finds_exactly_the_similar_pairs(spark):
    rng = random.Random(11)
    letters = "abcdé "
    names = list({"".join(rng.choices(letters, k=rng.randint(1, 34))) for _ in range(250)})
    probes = list({mutated(rng, rng.choice(names), letters) for _ in range(500)} - {""})
    df = spark.createDataFrame([(p,) for p in probes], "probe string")
    got = {(r.probe, r.name_key): r.score for r in candidate_pairs(df, name_table(spark, names)).collect()}
    assert got == brute(probes, names) and len(got) > 100


def test_crowded_blocks_are_cut_finer_without_losing_pairs(spark):
    rng = random.Random(5)
    names = list({f"user account {rng.randrange(10**6):06d}" for _ in range(150)} | {"".join(rng.choices("xyz", k=12)) for _ in range(80)})
    probes = list({mutated(rng, rng.choice(names), "0123xyz ") for _ in range(200)})
    df = spark.createDataFrame([(p,) for p in probes], "probe string")
    rules = FuzzyRules(hot_block=5)
    got = {(r.probe, r.name_key): r.score for r in candidate_pairs(df, name_table(spark, names), rules).collect()}
    assert got == brute(probes, names) and len(got) > 80


def test_pieces_are_joined_without_a_broadcast(spark, tmp_path):
    """A name has tens of pieces, so a small file of names is no small table of pieces."""
    spark.range(3000).selectExpr("'name ' || md5(cast(id as string)) as probe").write.parquet(str(tmp_path / "probes"))
    probes = spark.read.parquet(str(tmp_path / "probes"))
    names = probes.selectExpr("probe || 'q' as name_key", "1L as holders", "1L as sot_ord")
    for hot_block in (5, 10**6):
        plan = candidate_pairs(probes, names, FuzzyRules(hot_block=hot_block))._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin [block" in x]


def test_only_probes_that_hold_a_piece_of_a_crowded_name_are_cut_in_threes(spark):
    from attestor.operators import fuzzy

    names = name_table(spark, [f"user account {i:06d}" for i in range(20)] + ["someone else entirely"])
    probes = spark.createDataFrame([("user account 00000x",), ("someone else entirelx",)], "probe string")
    blocks = fuzzy._indexed_blocks(names, FuzzyRules()).where("name_key like 'user%'")
    near = fuzzy.near_crowded(fuzzy._probe_blocks(probes, FuzzyRules()), blocks)
    assert [r.probe for r in near.collect()] == ["user account 00000x"]


def test_top_two_decision(spark):
    rows = [
        ("one", "n1", 1, 5, 0.9), ("clear", "n1", 1, 5, 0.97), ("clear", "n2", 1, 1, 0.86),
        ("close", "n1", 1, 5, 0.95), ("close", "n2", 1, 1, 0.86), ("twins", "n3", 2, 4, 0.9),
        ("tie", "n1", 1, 5, 0.9), ("tie", "n2", 1, 1, 0.9),
    ]
    pairs = spark.createDataFrame(rows, "probe string, name_key string, holders long, sot_ord long, score double")
    got = {r.probe: (r.name_key, r.match_type) for r in decide(pairs).collect()}
    assert got == {
        "one": ("n1", "fuzzy_name"), "clear": ("n1", "fuzzy_name"), "close": ("n1", "fuzzy_ambiguous"),
        "twins": ("n3", "fuzzy_ambiguous"), "tie": ("n2", "fuzzy_ambiguous"),
    }


def test_a_blank_key_matches_nothing_however_the_join_runs(spark):
    left = spark.createDataFrame([(1, ""), (2, "a"), (3, "b")], "id long, k string")
    right = spark.createDataFrame([("", "blank"), ("a", "A")], "k string, v string")
    want = {"left": {(1, None), (2, "A"), (3, None)}, "inner": {(2, "A")}, "left_semi": {(2,)}, "left_anti": {(1,), (3,)}}
    for how, rows in want.items():
        for limit in (-1, 1 << 30):
            out = salted_lookup(left, right, "k", ["id"], how, broadcast_limit=limit)
            assert {tuple(r) for r in out.select(*(["id", "v"] if how in ("left", "inner") else ["id"])).collect()} == rows


def test_crowded_candidates_grow_slowly(spark):
    """Names of 60 first names: candidates per probe must not follow the number of names."""
    from attestor.operators import fuzzy

    rules, seen = FuzzyRules(hot_block=100), []
    for n in (3_000, 12_000):
        last = "substr(translate(md5(cast(id as string)), '0123456789', 'ghijklmnop'), 1, 8)"
        first = "substr(translate(md5(concat('f', cast(id % 60 as string))), '0123456789', 'ghijklmnop'), 1, 6)"
        names = spark.range(n).selectExpr(f"concat({first}, ' ', {last}) name_key", "1L holders", "id sot_ord")
        probes = spark.range(0, n, n // 100).selectExpr(f"concat({first}, ' z', substr({last}, 2)) probe")
        found = fuzzy._probe_triples(probes, rules).join(fuzzy._indexed_triples(names, rules), "block").count()
        seen.append(found / 100)
    assert seen[1] < 10 and seen[1] < 2 * seen[0] + 2


def test_broadcasts_go_by_counted_rows(spark, tmp_path):
    """Repeated values take next to no room in a file, but do in a broadcast table."""
    from attestor.operators.skew import counted_bytes, fits_broadcast, fits_counted

    spark.range(200_000).selectExpr("concat('k', id) as k", "repeat('x', 200) as v").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert fits_broadcast(table) and counted_bytes(table) > 10_000_000 and not fits_counted(table, 10_000_000)
    left = spark.range(10).selectExpr("id", "concat('k', id) as k")
    out = salted_lookup(left, table, "k", ["id"], broadcast_limit=10_000_000)
    assert "SortMergeJoin" in out._jdf.queryExecution().sparkPlan().toString()
    assert out.where("v is not null").count() == 10
