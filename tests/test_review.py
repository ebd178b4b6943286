import random

from attestor.operators import incremental as U
from attestor.operators import review as V

from helpers import key_of, report, tokens, united

NOTE = "Duplicate entries found with different roles"


def log(spark, rows):
    cols = V.LOG_COLUMNS
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], V.LOG_SCHEMA)


def fold_model(base, events):
    state = {b["record_id"]: dict(name=b["display_name"], action=b.get("review_action"), note=b.get("review_note", ""), roles=dict(b["role_actions"]) if b.get("role_actions") else None) for b in base}
    for e in sorted(events, key=lambda x: x["seq"]):
        s = state.get(e["record_id"])
        if s is None:
            continue
        if e["kind"] == "name":
            s["name"] = e["display_name"]
        elif e["kind"] == "role":
            s["roles"] = {**(s["roles"] or {}), e["role"]: e["action"]}
            vals = list(s["roles"].values())
            s["action"] = vals[0] if all(v is not None and v == vals[0] for v in vals) else None
            s["note"] = e["note"] or s["note"]
        else:
            s["action"], s["note"] = e["action"], e["note"]
            if s["roles"]:
                s["roles"] = {k: e["action"] for k in s["roles"]}
    return {k: (s["name"], s["action"], s["note"], s["roles"]) for k, s in state.items()}


def folded(spark, base, events):
    df = V.apply_reviews(report(spark, base), log(spark, events))
    return {r.record_id: (r.display_name, r.review_action, r.review_note, r.role_actions) for r in df.collect()}


def random_events(rng, n, records):
    out = []
    for seq in range(n):
        kind = rng.choice(["record", "role", "role", "role", "note", "name"])
        out.append({
            "seq": seq, "kind": kind, "record_id": rng.choice(records), "role": rng.choice("ABC") if kind == "role" else None,
            "action": rng.choice(["approve", "revoke", None]), "note": rng.choice(["", f"n{seq}"]),
            "display_name": f"N{seq}" if kind == "name" else None, "batch_id": None,
        })
    return out


def test_fold_equals_model(spark):
    rng = random.Random(2)
    records = [f"r{i}" for i in range(40)]
    base = [{"record_id": r, "display_name": r, "review_note": "old", "review_action": "flag", "role_actions": rng.choice([None, {"A": "approve"}, {"Z": None, "A": "revoke"}])} for r in records]
    events = random_events(rng, 160, [*records, "gone"])
    assert folded(spark, base, events) == fold_model(base, events)


def test_undo_redo_and_clearing(spark):
    base = [{"record_id": "a", "display_name": "a"}]
    e1 = {"seq": 1, "kind": "role", "record_id": "a", "role": "R", "action": "approve", "note": "", "batch_id": "b1"}
    e2 = {"seq": 2, "kind": "record", "record_id": "a", "action": "revoke", "note": "", "batch_id": "b2"}
    events = [e1, e2]

    def step(fn, seq):
        row = fn(log(spark, events), seq).collect()
        events.extend(r.asDict() for r in row)
        return [r.target_batch for r in row]

    assert step(V.undo_last, 3) == ["b2"]
    assert folded(spark, base, events)["a"] == ("a", "approve", "", {"R": "approve"})
    assert step(V.undo_last, 4) == ["b1"] and step(V.undo_last, 5) == []
    assert folded(spark, base, events)["a"] == ("a", None, "", None)
    assert step(V.redo_last, 6) == ["b1"] and step(V.redo_last, 7) == ["b2"] and step(V.redo_last, 8) == []
    assert folded(spark, base, events)["a"] == ("a", "revoke", "", {"R": "revoke"})
    assert step(V.undo_last, 9) == ["b2"]
    events.append({"seq": 10, "kind": "note", "record_id": "a", "action": "approve", "note": "x", "batch_id": "b3"})
    assert step(V.redo_last, 11) == []


def retention_model(batches, limit):
    cut = len(batches) - limit
    if cut <= 0:
        return list(range(len(batches)))
    edge = batches[cut - 1]
    while edge and cut < len(batches) and batches[cut] == edge:
        cut += 1
    return list(range(cut, len(batches)))


def test_retention_equals_model(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for review in ("p", "q", "r", "all-one"):
        batches = []
        while len(batches) < 30:
            batches += [rng.choice([None, f"b{len(batches)}"])] * rng.randint(1, 6)
        if review == "all-one":
            batches = ["b"] * 30
        want[review] = retention_model(batches, 12)
        rows += [{"seq": i, "review_id": review, "kind": "record", "record_id": "x", "batch_id": b} for i, b in enumerate(batches)]
    got = {k: [] for k in want}
    for r in V.retain_history(log(spark, rows), 12).collect():
        got[r.review_id].append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_manual_merge(spark):
    rows = [
        {"record_id": "p", "role": "B", "source_row": 9, "risk_score": 10, "review_action": "approve", "last_login": "2026-01-01"},
        {"record_id": "s1", "role": "a; b", "source_row": 1, "risk_score": 70, "risk_level": "HIGH", "last_login": "2026-03-01"},
        {"record_id": "s2", "role": "C", "source_row": 2, "risk_score": 70, "risk_level": "HIGH", "entitlement": "e"},
        {"record_id": "lone", "role": "x;y"}, {"record_id": "o1", "role": "1"}, {"record_id": "o2", "role": "2"},
    ]
    groups = spark.createDataFrame(
        [("p", "p"), ("s1", "p"), ("s2", "p"), ("lone", "lone"), ("o1", "absent"), ("o2", "absent")], "record_id string, primary_id string"
    )
    got = {r.record_id: r for r in V.manual_merge(report(spark, rows), groups).collect()}
    assert sorted(got) == ["lone", "o1", "o2", "p"] and got["lone"].role == "x;y"
    p = got["p"]
    assert (p.role, p.entitlement, p.risk_level, p.last_login, p.review_action) == ("B, a, C", "e", "HIGH", "2026-03-01", "approve")


def consolidate_model(rows):
    out = {}
    for r in rows:
        k = key_of(r)
        if k not in out:
            out[k] = dict(r)
            continue
        e = out[k]
        keep = e["risk_score"] >= r["risk_score"]
        p, s = (e, r) if keep else (r, e)
        a, b = ({t.lower() for t in tokens(x["role"])} for x in (e, r))
        out[k] = {
            **p, "role": united([e["role"], r["role"]]), "entitlement": united([e["entitlement"], r["entitlement"]]),
            "last_login": max(p["last_login"], s["last_login"]),
            "review_action": "flag" if a != b else (p["review_action"] if p["review_action"] is not None else s["review_action"]),
            "review_note": (p["review_note"] or NOTE) if a != b else (p["review_note"] or s["review_note"]),
            "role_actions": p["role_actions"] if p["role_actions"] is not None else s["role_actions"],
        }
    return out


def test_consolidate_equals_ordered_fold(spark):
    rng = random.Random(8)
    rows = []
    for i in range(700):
        score = rng.choice([10, 25, 50, 70, 95])
        group = rng.choice(["", "a@x.com", "b@x.com", *[f"u{j}@x.com" for j in range(60)]])
        few = group < "c"
        rows.append({
            "record_id": f"r{i:04d}", "email": group, "system": "s", "source_row": i, "batch_ord": 0, "display_name": "",
            "role": rng.choice(["A", "a", "A, b", "b;a", "C"]) if few else rng.choice(["A", "a; A"]),
            "entitlement": rng.choice(["", "x", "Y, x"]), "last_login": rng.choice(["", "2026-01-01", "2026-05-01"]),
            "risk_score": score, "risk_level": str(score),
            "review_action": rng.choice([None, None, "approve", "revoke"]), "review_note": rng.choice(["", "", f"n{i}"]),
            "role_actions": rng.choice([None, None, {"k": f"v{i}"}]),
        })
    for i, r in enumerate(rows):
        r["batch_ord"] = 0 if i < 350 else 1
    df = U.consolidate(report(spark, rows, "batch_ord int").repartition(6))
    cols = ("role", "entitlement", "last_login", "risk_score", "review_action", "review_note", "role_actions")
    got = {r.record_id: tuple(r[c] for c in cols) for r in df.collect()}
    want = {r["record_id"]: tuple(r[c] for c in cols) for r in consolidate_model(rows).values()}
    assert got == want


def test_append_preserves_review_and_replays_edits(spark):
    old = [
        {"record_id": "a::s::1", "email": "a@x.com", "role": "Old", "review_action": "approve", "review_note": "ok", "role_actions": {"Old": "approve"}},
        {"record_id": "b::s::2", "email": "b@x.com", "role": "R", "display_name": "Edited"},
    ]
    new = [
        {"record_id": "a::s::1", "email": "a@x.com", "role": "New", "review_action": "flag"},
        {"record_id": "b::s::2", "email": "b@x.com", "role": "R", "display_name": "Raw"},
        {"record_id": "c::s::3", "email": "c@x.com", "role": "Q", "risk_score": 70, "risk_level": "HIGH"},
    ]
    events = [
        {"seq": 1, "kind": "name", "record_id": "b::s::2", "display_name": "Edited"},
        {"seq": 2, "kind": "merge", "record_id": "b::s::2", "target_record": "b::s::2"},
        {"seq": 2, "kind": "merge", "record_id": "c::s::3", "target_record": "b::s::2"},
        {"seq": 3, "kind": "record", "record_id": "a::s::1", "action": "revoke", "note": ""},
    ]
    got = {r.record_id: r for r in U.append_report(report(spark, old), report(spark, new), log(spark, events)).collect()}
    assert sorted(got) == ["a::s::1", "b::s::2"]
    a, b = got["a::s::1"], got["b::s::2"]
    assert (a.role, a.review_action, a.review_note, a.role_actions) == ("New", "approve", "ok", {"Old": "approve"})
    assert (b.display_name, b.role, b.risk_level) == ("Edited", "R, Q", "HIGH")


def test_a_second_fold_keeps_the_place_of_roles(spark):
    base = [{"record_id": "r", "display_name": "r", "role_actions": {"A": "approve", "B": "revoke"}}]
    touch = lambda role, action, seq: {"seq": seq, "kind": "role", "record_id": "r", "role": role, "action": action, "note": ""}
    roles = folded(spark, base, [touch("C", "approve", 1), touch("A", "revoke", 2)])["r"][3]
    assert list(roles.items()) == [("A", "revoke"), ("B", "revoke"), ("C", "approve")]
