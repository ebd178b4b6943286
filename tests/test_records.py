"""Records from lines against a plain reader that goes character by character."""

import os
import random

import pytest
from pyspark.sql import functions as F

from attestor.sources import files as I
from attestor.sources import records as R


def plain(data):
    """Records as lists of fields: quotes read leniently, one line after the other."""
    lines = data.split("\n")
    if lines[-1] == "":
        lines.pop()
    lines = [x[:-1] if x.endswith("\r") else x for x in lines]
    out, i = [], 0
    while i < len(lines):
        if not lines[i]:
            i += 1
            continue
        record, field, state, at = [], "", "start", 0
        while True:
            line = lines[i]
            if at == len(line):
                if state == "quoted" and i + 1 < len(lines):
                    field, at, i = field + "\n", 0, i + 1
                    continue
                record.append(field)
                break
            c, after, at = line[at], line[at + 1:at + 2], at + 1
            if state == "quoted":
                if c == '"' and after == '"':
                    field, at = field + '"', at + 1
                elif c == '"' and after in ("", ","):
                    state = "closed"
                else:
                    field += c
            elif c == ",":
                record.append(field)
                field, state = "", "start"
            elif c == '"' and state == "start":
                state = "quoted"
            else:
                field, state = field + c, "plain"
        out.append(record)
        i += 1
    return out


@pytest.fixture
def blocks_of(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def size(n):
        spark.conf.set(keys[0], f"{n}b")
        spark.conf.set(keys[1], "1")

    yield size
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def read(spark, files):
    rows, counts = R.read_records(spark, files)
    got = {}
    for r in rows.select("uri", "rec", R.fields(F.col("text")).alias("f")).collect():
        got.setdefault(os.path.basename(r.uri), []).append((r.rec, list(r.f)))
    return {k: sorted(v) for k, v in got.items()}, {os.path.basename(r.uri): r.n for r in counts.collect()}


def numbered(records):
    return [(i + 1, r) for i, r in enumerate(records)]


@pytest.mark.parametrize("block", [24, 300, 1 << 27])
def test_any_quotes_over_any_blocks(spark, tmp_path, blocks_of, block):
    rng, files, want = random.Random(block), [], {}
    for f in range(50):
        parts = ["a", "b", ",", '"', '"', "\n", '""', '",', '"\n', ',"', "\r\n"] if f % 3 else ["a", "é", ",", ",", "\n", "\r\n"]
        data = "x" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 150)))
        path = tmp_path / f"f{f}.csv"
        path.write_bytes(data.encode())
        files.append((str(path), "utf-8"))
        want[path.name] = plain(data)
    blocks_of(block)
    got, counts = read(spark, files)
    assert got == {k: numbered(v) for k, v in want.items()}
    assert counts == {k: len(v) for k, v in want.items()}


def test_wide_files_over_many_blocks(spark, tmp_path, blocks_of):
    data = 'Näme,Code\n"a\nb",1\n\nc,"x ""y"" 5" z"\r\n' * 20
    files = []
    for e in ("utf-16le", "utf-16be"):
        path = tmp_path / f"{e}.csv"
        path.write_bytes(("﻿" + data).encode(e[:6] + "-" + e[6:]))
        files.append((str(path), e))
    blocks_of(128)
    got, _ = read(spark, files)
    assert got["utf-16le.csv"] == got["utf-16be.csv"] == numbered(plain(data))
    assert R._lines(spark, files).select(F.spark_partition_id()).distinct().count() > 10


def test_a_long_field_and_one_that_never_ends(spark, tmp_path, blocks_of):
    long = "word, \"\" " * 200_000
    path = tmp_path / "long.csv"
    path.write_text(f'a,b\n"{long}",1\n2,"rest\nof, all\n')
    got, _ = read(spark, [(str(path), "utf-8")])
    assert got["long.csv"] == numbered([["a", "b"], [long.replace('""', '"'), "1"], ["2", "rest\nof, all"]])


def test_one_line_records_stay_in_their_task(spark, tmp_path):
    """Quotes without line breaks in them move no line."""
    path = tmp_path / "q.csv"
    path.write_text("a,b\n" + '"x, ""y""",5" disk\n' * 50)
    rows, _ = R.read_records(spark, [(str(path), "utf-8")])
    assert rows.count() == 51
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "mixed-blocks" not in plan and "SortMergeJoin" not in plan


def test_a_bare_quote_loses_no_file(spark, tmp_path, blocks_of):
    (tmp_path / "a_export.csv").write_text('email,Disk 5" size,role\nann@x.com,3" x,"Dev ""x"""\nbo@x.com,"7" y",Ops\n')
    (tmp_path / "b_export.csv").write_text('"e\nmail",email\n1,zed@x.com\n')
    for size in (1 << 27, 40):
        blocks_of(size)
        registry = I.probe_files(spark, [str(tmp_path)])
        assert {r.name: (r.status, r.headers) for r in registry.collect()} == {
            "a_export.csv": ("pending", ["email", 'Disk 5" size', "role"]), "b_export.csv": ("pending", ["e\nmail", "email"])}
        got = I.read_accounts(spark, registry)
        assert sorted((r.system, r.email, r.role, r.source_row) for r in got.rows.collect()) == [
            ("a", "ann@x.com", 'Dev "x"', 1), ("a", "bo@x.com", "Ops", 2), ("b", "zed@x.com", "", 1)]
        assert got.warnings.count() == 0


def test_plan_does_not_grow_with_headers(spark, tmp_path):
    sizes = []
    for n in (3, 120):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            heads = ["login", f"c{i}", "mail"] if i % 2 else ["mail", f"c{i}", f"d{i}", "login"]
            (folder / f"s{i}_export.csv").write_text(",".join(heads) + "\n" + ",".join(h + "1" for h in heads) + "\n")
        rows = I.read_accounts(spark, I.probe_files(spark, [str(folder)])).rows
        assert {(r.email, r.user_id) for r in rows.collect()} == {("mail1", "login1")} and rows.count() == n
        sizes.append(rows._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert sizes[0] == sizes[1]


def test_named_headers_of_files_that_differ(spark, tmp_path):
    from attestor.sources.mapping import ColumnMapping, Concat, Split, Template

    (tmp_path / "x.csv").write_text("f,l,ids\nAnn,Lee,1|2\n")
    (tmp_path / "y.csv").write_text("ids,f\n3|4,Bo\n")
    mapping = ColumnMapping(
        direct={"f": "displayName"}, concat=(Concat(("f", "l"), " ", "role"),), split=(Split("ids", "|", 1, "userId"),),
        template=(Template("{f}.{l}@{nope}", "email"),))
    rows = I.read_accounts(spark, I.probe_files(spark, [str(tmp_path)]), default=mapping).rows
    assert sorted((r.system, r.display_name, r.role, r.user_id, r.email) for r in rows.collect()) == [
        ("x", "Ann", "Ann Lee", "2", "ann.lee@{nope}"), ("y", "Bo", "Bo", "4", "bo.{l}@{nope}")]
