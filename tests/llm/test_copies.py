"""Exact, near, line and byte copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import exact_dedup, line_dedup, near_dedup, repeats
from attestor.llm.components import components
from attestor.llm.textops import Powers
from tests.llm import plain
from tests.llm.conftest import edge_rows, words


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# exact -------------------------------------------------------------------------------------------


def test_exact_edges(edge):
    out = exact_dedup.exact_dedup(edge).collect()
    assert len(out) == len(edge_rows())
    got = {(r.doc_id, r.text_sha256): r for r in out}
    by_text = {}
    for d, t, *_ in edge_rows():
        by_text.setdefault(plain.lower(t), []).append(d)
    for d, t, *_ in edge_rows():
        ids = by_text[plain.lower(t)]
        keep = max((i for i in ids if i is not None), default=None)
        r = next(v for k, v in got.items() if k[0] == d and v.group_size == len(ids) and v.keep_id == keep)
        assert r.kept == (d == keep)


def test_exact_compares_content_where_digests_collide(frame):
    rows = [(i, f"text {i % 3}") for i in range(12)]
    out = exact_dedup.exact_dedup(frame(rows), digest=lambda t: F.lit(b"same"))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out.collect()} == {(i, 9 + i % 3, 4) for i in range(12)}


def test_exact_salts_hot_texts(frame):
    rows = [(i, "hot" if i % 3 else f"cold {i}") for i in range(300)]
    a = rows_of(exact_dedup.exact_dedup(frame(rows), salts=4, share=10), "doc_id", "keep_id", "group_size", "kept")
    assert a == rows_of(exact_dedup.exact_dedup(frame(rows), share=1), "doc_id", "keep_id", "group_size", "kept")
    assert sum(k[3] for k in a) == 101


@pytest.mark.parametrize("operator", [
    exact_dedup.exact_dedup, near_dedup.near_dedup, line_dedup.dedup_lines, repeats.cut_repeats, near_dedup.drop_near_duplicates,
])
def test_empty_tables(none, operator):
    assert operator(none).count() == 0


# near --------------------------------------------------------------------------------------------


def near_corpus():
    rng = random.Random(1)
    base = words(rng, 120).split()
    rows = []
    for i in range(60):
        x = base[:]
        for j in rng.sample(range(120), i % 12):
            x[j] = f"w{i}x{j}"
        rows.append((i, " ".join(x)))
    rows += [(100 + i, words(rng, 40)) for i in range(10)] + [(200, rows[0][1].upper()), (201, ""), (202, "a b"), (203, "A B"), (204, None)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"block": 5}])
def test_near_equals_all_pairs(frame, settings):
    rows = near_corpus()
    classes = near_dedup.near_classes(frame(rows), shingle=4, **settings)
    assert len(classes) == 3
    if settings:  # the blocks themselves: links as without them
        links = {(r.node, r.component) for r in classes[2].collect()}
        want = {(d, c) for d, (n, c) in plain.near(rows, 4, 80).items()}
        assert links <= want
        return
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(frame(rows), shingle=4).collect()}
    assert out == plain.near(rows, 4, 80)


def test_near_edges(edge):
    out = near_dedup.near_dedup(edge, shingle=4).collect()
    assert len(out) == len(edge_rows())
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    assert got[2].component_id == 1 and not got[2].kept
    assert got[4].n_shingles == 0 and got[4].kept and got[6].n_shingles == 0
    assert got[8].component_id == 7 and got[7].n_shingles == 1
    assert got[10].component_id == 9
    assert sorted((r.n_shingles, r.component_id) for r in out if r.doc_id is None and r.n_shingles) == [(got[1].n_shingles, 1)]


def test_near_stage_keeps_one_of_each(edge):
    out = near_dedup.drop_near_duplicates(edge)
    assert out.columns == edge.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15] or len(ids) == len(set(ids)) + 1


def test_near_stage_tells_rows_of_one_id_apart(frame):
    import corpus_pipeline

    a, b, c, d = (words(random.Random(i), 40) for i in range(4))
    rows = [(1, a), (1, b), (2, b.upper()), (3, ""), (3, ""), (None, a), (None, c), (None, c), (None, d), (None, None)]
    out = corpus_pipeline.drop_near_copies(None, frame(rows), "")
    want = [(1, a), (1, b), (3, ""), (None, c), (None, d), (None, None)]
    assert plain.counted((r.doc_id, r.text) for r in out.collect()) == plain.counted(want)


def test_least_matches_bound():
    n = near_dedup.least_matches(288, 0.8, 1e-6)
    assert 180 < n < 230 and near_dedup.least_matches(32, 0.8, 1e-6) < 20


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    rng.shuffle(links)
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}


# lines -------------------------------------------------------------------------------------------


def test_lines_equal_plain(frame):
    rng = random.Random(2)
    lines = [f"line {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for i in range(60)] + [(99, None)]
    out = line_dedup.dedup_lines(frame(rows)).collect()
    want = plain.line_windows(rows)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out} == want


def test_lines_edges(edge):
    out = line_dedup.dedup_lines(edge)
    assert [c for c in out.columns if c in edge.columns] == edge.columns
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(edge_rows())
    assert got[14].n_removed == 8 and got[14].removed_spans == 1 and got[15].n_removed == 4 and got[15].text == "x\nend"
    assert got[4].text == "" and got[4].n_removed == 0


def test_lines_tell_rows_of_one_id_apart(frame):
    rows = [(1, "a\nb\nc"), (5, "1\na\nb\nc"), (5, "p\nq\nr\ns"), (None, "a\nb\nc\n2"), (None, "t\nu\nv\nw"), (None, "x\ny\nz"), (None, "x\ny\nz")]
    out = line_dedup.dedup_lines(frame(rows)).collect()
    want = [(1, "a\nb\nc"), (5, "1"), rows[2], (None, "2"), rows[4], rows[5], (None, "")]
    assert plain.counted((r.doc_id, r.text) for r in out) == plain.counted(want)


def test_line_sql_tells_rows_of_one_id_apart(spark, tmp_path):
    import duckdb

    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3, 4]), "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for _ in range(40)] + [(3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(line_dedup.SQL)
    got = rows_of(line_dedup.op6_line_dedup(spark, str(tmp_path)), *[c[0] for c in cur.description])
    assert got == sorted(cur.fetchall(), key=repr)


def test_a_hot_window_is_split(spark, frame, skew_splits):
    docs = frame([(i, "a\nb\nc" if i % 10 else f"x{i}\ny\nz") for i in range(4000)], 8).withColumn("__place", F.col("doc_id"))
    later = line_dedup.later_windows(docs)
    assert skew_splits(later) > 0 and later.count() == 3599


# bytes -------------------------------------------------------------------------------------------


def byte_corpus():
    rng = random.Random(4)
    shared = [words(rng, 40) for _ in range(3)]
    rows = []
    for i in range(80):
        parts = [words(rng, rng.randint(0, 30)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randint(0, 3), shared[i % 3][rng.randint(0, 60):rng.randint(100, 240)])
        rows.append((i, " ".join(parts)))
    return rows + [(200, "=" * 333), (201, "ab" * 200), (202, "é" * 90), (203, rows[1][1]), (204, None), (205, "short"), (206, "=" * 150)]


@pytest.mark.parametrize("settings", [{}, {"hot_least": 2, "hot_sample": 1}])
def test_repeats_equal_plain(frame, settings):
    rows = byte_corpus()
    out = repeats.cut_repeats(frame(rows), **settings).collect()
    want = plain.repeats(rows, 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == want
    texts = dict(rows)
    for r in out:
        b = (texts[r.doc_id] or "").encode()
        kept = b"".join(b[s:e] for s, e in zip([0] + [x[1] for x in r.spans], [x[0] for x in r.spans] + [len(b)]))
        assert bytes(r.kept) == kept


def test_repeats_edges(edge):
    out = repeats.cut_repeats(edge, with_text=False)
    assert out.count() == len(edge_rows())
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert got[1].n_removed == 0 and got[9].n_removed == 0 and got[10].n_removed >= len(edge_rows()[8][1])
    assert got[11].n_removed == 0 and got[13].n_removed == 499 - 0 or got[13].n_removed == 500 or got[13].n_removed > 398


def test_repeats_tell_rows_of_one_id_apart(frame):
    rng = random.Random(6)
    passage, clean, other, twice = words(rng, 60), words(rng, 80), words(rng, 80), words(rng, 70)
    rows = [(1, passage), (5, passage + "#"), (5, other), (None, passage + "+"), (None, clean), (None, twice), (None, twice)]
    out = repeats.cut_repeats(frame(rows), hot_least=2, hot_sample=1).collect()
    want = [(1, passage), (5, "#"), (5, other), (None, "+"), (None, clean), (None, twice), (None, "")]
    assert plain.counted((r.doc_id, bytes(r.kept).decode()) for r in out) == plain.counted(want)


@pytest.mark.parametrize("letters, n", [(b"ab", 60), (b"a", 30), (b"abc\x00\xff", 90), (b"", 0)])
def test_longest_previous_factors_equal_plain(letters, n):
    """Factors of every suffix of one text, by comparing each with all earlier ones."""
    rng = random.Random(n)
    text = bytes(rng.choice(letters) for _ in range(n))

    def shared(i, j):
        k = 0
        while j + k < n and text[i + k] == text[j + k]:
            k += 1
        return k

    order = sorted(range(n), key=lambda i: text[i:])
    lcp = [0] + [shared(min(a, b), max(a, b)) for a, b in zip(order, order[1:])]
    factor = repeats.previous_factors(np.array(lcp[:n], np.int64), np.array(order, np.int64))
    want = {j: max((shared(i, j) for i in range(j)), default=0) for j in range(n)}
    assert dict(zip(order, factor.tolist())) == want


def test_suffixes_reach_where_their_bytes_stand_earlier():
    rng = random.Random(4)
    length, docs = 8, [bytes(rng.choice(b"ab\x00") for _ in range(40)) for _ in range(12)]
    docs[7] = docs[2][5:] + docs[3][:5]
    data = np.frombuffer(b"".join(docs), np.uint8)
    places = [(d, a) for d in range(12) for a in range(40 - length + 1)]
    # Out of order, some places twice.
    places += rng.sample(places, 30)
    rng.shuffle(places)
    doc, at = (np.array(x, np.int64) for x in zip(*places))
    got = repeats.factor_reaches(data, doc * 40 + at, doc, at, length, Powers())
    first = {}
    for d, a in sorted(places):
        first.setdefault(docs[d][a:a + length], (d, a))
    assert got.tolist() == [first[docs[d][a:a + length]] != (d, a) for d, a in places] and 10 < got.sum() < len(places)


def test_common_prefixes():
    rows = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 0], [0, 2, 0]], np.uint8)
    assert repeats.common_prefixes(rows).tolist() == [0, 3, 2, 0] and repeats.common_prefixes(rows[:1]).tolist() == [0]
