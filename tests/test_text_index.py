"""Indexed substring search against the scan."""

import random

from pyspark.sql import functions as F

from attestor.operators.text_index import TextIndex
from attestor.operators.views import SEARCH_FIELDS, search
from attestor.session import write_through

from helpers import report

WORDS = ["admin", "Reader", "billing owner", "ÄÖ", "root", "ops;dev", "Zürich", "100%", "a_b", ""]


def rows(spark, rng, ids):
    field = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3)))
    return write_through(report(spark, [
        {"record_id": f"r{i}", "display_name": f"Name {i}", "email": rng.choice(["", f"u{i}@x.com"]), "role": field(), "entitlement": field(),
         "system": rng.choice(["okta", "AWS"])} for i in ids]), "rows")


def found(df):
    return sorted(map(tuple, df.select("record_id", *SEARCH_FIELDS).collect()))


TEXTS = ["admin", "READER", "u1", "x", "ing own", "zür", "äö", "100%", "a_b", "name 2", "owner r", "nowhere", " ", "Name 11", "okta", "com"]


def test_search_equals_the_scan(spark, tmp_path):
    rng, index = random.Random(1), TextIndex(spark, str(tmp_path / "index"), blocks=4)
    assert found(index.search("admin")) == []
    first = rows(spark, rng, range(30))
    index.update(first)
    changed, gone = rows(spark, rng, range(20, 40)), spark.createDataFrame([("r3",), ("r11",)], "record_id string")
    index.update(changed, gone)
    now = first.join(changed, "record_id", "left_anti").join(gone, "record_id", "left_anti").unionByName(changed)
    now = write_through(now, "now")
    for text in TEXTS:
        assert found(index.search(text)) == found(now.where(search(text))), text


def test_few_rows_are_verified(spark, tmp_path):
    rng, index = random.Random(2), TextIndex(spark, str(tmp_path / "index"), blocks=4)
    all_rows = rows(spark, rng, range(200))
    index.update(all_rows)
    hits = all_rows.where(search("name 17")).count()
    assert hits == 11
    # The grams of one field decide: " 17" is rare, "nam" is in every row.
    assert index.rarest("name 17")[0] == (" 17", hits)
    assert index.to_verify("name 17").count() == hits
    assert index.to_verify("nowhere").count() == 0
    assert index.candidates(["adm", "min"]).count() == all_rows.where(
        F.contains(F.lower("role"), F.lit("admin")) | F.contains(F.lower("entitlement"), F.lit("admin"))).count()


def test_uncommitted_updates_do_not_count(spark, tmp_path):
    rng, index = random.Random(3), TextIndex(spark, str(tmp_path / "index"), blocks=2)
    index.update(rows(spark, rng, range(5)))
    before = found(index.search("name"))
    rows(spark, rng, range(5, 9)).select("record_id").write.parquet(f"{index.root}/rows/version=1")
    assert found(index.search("name")) == before
    index.update(rows(spark, rng, range(5, 7)))
    assert len(found(index.search("name"))) == 7


def test_postings_stay_with_their_block(spark, tmp_path):
    """Postings are made where the rows of a block lie: one folder a block, each sorted by gram, nothing shuffled."""
    index = TextIndex(spark, str(tmp_path / "index"), blocks=4)
    index.update(rows(spark, random.Random(3), range(60)))
    folders = sorted(p.name for p in (tmp_path / "index" / "postings" / "version=0").iterdir() if p.is_dir())
    assert folders == [f"block={n}" for n in range(4)]
    for name in folders:
        grams = [r.gram for r in spark.read.parquet(str(tmp_path / "index" / "postings" / "version=0" / name)).collect()]
        assert grams == sorted(grams) and grams
