"""The stored fold of the review log against the fold of the whole log."""

import random

import pytest

from attestor.operators import review as V
from attestor.operators.folded_log import FoldedLog
from attestor.session import write_through

from helpers import report
from test_review import log, random_events

RECORDS = [f"r{i}" for i in range(30)]


def shown(df):
    return {r.record_id: (r.display_name, r.review_action, r.review_note, r.role_actions and list(r.role_actions.items())) for r in df.collect()}


def base(spark, rng):
    return write_through(report(spark, [
        {"record_id": r, "display_name": r, "review_note": "old", "review_action": "flag", "role_actions": rng.choice([None, {"A": "approve"}, {"Z": None, "A": "revoke"}])}
        for r in RECORDS]), "base")


def with_switches(rng, n):
    """Random events, some in batches, with undos and redos of batches before and after them."""
    out = random_events(rng, n, [*RECORDS, "gone"])
    for e in out:
        e["batch_id"] = rng.choice([None, f"b{e['seq'] // 4}"])
        if e["seq"] > 8 and rng.random() < 0.3:
            target = f"b{rng.randrange(e['seq'] // 4 + 2)}"
            if rng.random() < 0.2:
                past = out[rng.randrange(e["seq"])]
                target = past["batch_id"] or f"#{past['seq']}#{past['record_id']}"
            e.update(kind=rng.choice(["undo", "undo", "redo"]), record_id=None, role=None, batch_id=None, target_batch=target)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_equal_the_whole_fold(spark, tmp_path, seed):
    rng = random.Random(seed)
    events, rows = with_switches(rng, 140), base(spark, rng)
    folded, reached = FoldedLog(spark, str(tmp_path / "fold")), 0
    for version, upto in enumerate((50, 90, 100, 140)):
        so_far = write_through(log(spark, events[:upto]), "log")
        assert folded.advance(so_far) == version and folded.watermark() == upto - 1
        want = shown(V.apply_reviews(rows, so_far))
        assert shown(V.apply_state(rows, folded.state())) == want
        if version:
            reached += spark.read.parquet(f"{folded.root}/again/version={version}").count()
    assert reached > 0
    assert folded.advance(so_far) is None


def test_only_touched_records_are_written(spark, tmp_path):
    event = lambda seq, record, batch: {"seq": seq, "kind": "record", "record_id": record, "action": "approve", "note": "", "batch_id": batch}
    events = [event(i, r, f"b{i // 10}") for i, r in enumerate(RECORDS)]
    folded = FoldedLog(spark, str(tmp_path / "fold"))
    folded.advance(log(spark, events))
    events += [event(40, "r3", "b9"), {"seq": 41, "kind": "undo", "target_batch": "b2"}]
    folded.advance(log(spark, events))
    written = {r.record_id: r.rec and r.rec.seq for r in spark.read.parquet(f"{folded.root}/state/version=1").collect()}
    assert written == {"r3": 40} | {f"r{i}": None for i in range(20, 30)}
    state = {r.record_id: r.rec and r.rec.seq for r in folded.state().collect()}
    assert state == {r: i for i, r in enumerate(RECORDS)} | written


def test_an_empty_log_folds_to_nothing(spark, tmp_path):
    folded = FoldedLog(spark, str(tmp_path / "fold"))
    assert folded.advance(log(spark, [])) is None and folded.watermark() is None
