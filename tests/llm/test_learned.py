"""Toxicity, token files, decontamination, the registered queries and the pipeline."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from attestor.llm import decontamination, queries, token_files, toxicity
from attestor.llm.textops import LOWER, Powers, chunks, shingles, text_bytes, word_hashes
from tests.llm import plain
from tests.llm.conftest import edge_rows, words

SF = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
has_tokenizer = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="tokenizer files not present")


# words -------------------------------------------------------------------------------------------


def test_word_hashes_and_shingles():
    texts = ["The the\tTHE cat", "", None, "a b", " x  y\n", "É é the"]
    data, offs = text_bytes(pa.array(texts))
    hashes, counts = word_hashes(data, offs, Powers())
    assert counts.tolist() == [4, 0, 0, 2, 2, 3]
    assert hashes[0] == hashes[1] == hashes[2] == hashes[10] != hashes[3] and hashes[8] != hashes[9]
    runs, n = shingles(hashes, counts, 3)
    assert n.tolist() == [2, 0, 0, 1, 1, 1] and len(set(runs.tolist())) == 5
    assert [(i, j) for i, j, _, _ in chunks(data, offs, 5)][0] == (0, 1)
    assert LOWER[ord("Q")] == ord("q")


# toxicity ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    insults = ["zorb", "quix", "blag"]
    rows, labels = [], []
    for i in range(1200):
        text, toxic = words(rng, rng.randint(5, 60)), i % 8 == 0
        if toxic:
            text += " " + " ".join(rng.choice(insults) for _ in range(2)) + ", " + words(rng, 3)
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, 0, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows)


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, rows = labelled
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == len(rows)
    for d, _ in rows:
        assert out[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and out[d].predicted == int(out[d].score >= 0.5)
    held = [d for d, _ in rows if out[d].held_out]
    assert np.mean([out[d].predicted == int(d % 8 == 0) for d in held]) > 0.97


def test_held_out_labels_are_not_read(labelled):
    docs, labels, _ = labelled
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_risk_stays_non_negative():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 40)) < 0.3).astype(np.float32)
    kind = np.array([1] * 40 + [0] * 260)
    x[kind == 1, 0] = 1
    w = toxicity.fit_nnpu(x, kind, 0.1)
    f = np.hstack([x, np.ones((300, 1))]) @ w
    negative = np.logaddexp(0, f[kind == 0]).mean() - 0.1 * np.logaddexp(0, f[kind == 1]).mean()
    assert negative > -0.01 and w[0] == w[:-1].max()


def test_toxicity_edges(edge, none, labelled, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(edge, labels).count() == len(edge_rows())
    assert toxicity.toxicity(none, labels).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(edge, empty).collect()} == {0}
    kept = toxicity.drop_toxic(edge, toxicity.fit(edge, labels))
    assert kept.columns == edge.columns and kept.count() == len(edge_rows())


# tokens ------------------------------------------------------------------------------------------

ALPHABET = [
    "a", "B", "É", "é", "ß", "×", "÷", "'s", "'", "<", "<|endoftext|>", "<|startoftext|>", " ", "\n", "\t", " ", "́", "İ", "Σ", "ς", "1",
    "42", ".", "!?", "_", "\x00", "\x1c", "\U0001f600", "中", "ﬁ", "K", "ſ", "I", "don't", "ÿ", "Þ", "\x85", " ", "-", "ö", "º", "½",
]


@has_tokenizer
def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", None, " ", words(rng, 3000)]
    encoder = token_files.Encoder(token_files.tokenizer_path(), cache=300)
    library = Tokenizer.from_file(token_files.tokenizer_path())
    data, offs = text_bytes(pa.array(texts))
    got = []
    for _, _, d, o in chunks(data, offs, 4_000):
        ids, n = encoder.encode(d, o, 1)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


@has_tokenizer
def test_token_files_round_trip(spark, edge, none, tmp_path):
    from tokenizers import Tokenizer

    path = str(tmp_path / "tokens")
    out = token_files.encode_documents(edge, path).collect()
    library, start = Tokenizer.from_file(token_files.tokenizer_path()), 0
    rows = sorted(((d, t) for d, t, *_ in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted(out, key=lambda r: r.start)
    assert len(got) == len(rows)
    for r, (d, t) in zip(got, rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_tokens(spark, path).where("doc_id = 10").count() == 1
    assert token_files.encode_documents(none, str(tmp_path / "none")).count() == 0


@has_tokenizer
def test_token_files_have_indexes(spark, edge, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(edge, path)
    names = [f for f in os.listdir(path) if f.endswith(".orc")]
    assert names and all(f.endswith(".zstd.orc") for f in names)
    assert any(b"doc_id" in open(f"{path}/{f}", "rb").read() for f in names)


# decontamination ---------------------------------------------------------------------------------


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 40))] for _ in range(2))
        assert decontamination.common(len(a), decontamination.masks(a), b) == plain.subsequence(a, b)


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(6)
    subject = [words(rng, 1) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(subject) for _ in range(n))
    items = [(i, f"{say(rng.randint(8, 30))}. {say(rng.randint(4, 20))}.") for i in range(30)]
    rows, want = [], set()
    for i in range(300):
        text = say(rng.randint(0, 300))
        if i % 6 == 0:
            k = rng.randrange(30)
            w = items[k][1].upper().split() if i % 4 else items[k][1].split()
            if i % 12 == 0:  # reworded: every seventh word is another, and one is put in
                w = [rng.choice(subject) if j % 7 == 3 and j < len(w) - 4 else x for j, x in enumerate(w)]
                w.insert(2, rng.choice(subject))
            cut = rng.randint(0, len(text.split()))
            text = " ".join(text.split()[:cut] + w + text.split()[cut:])
            want.add((i, k))
        rows.append((i, text))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), want


def test_leaks_are_found_and_nothing_else(leaks):
    docs, items, want = leaks
    assert {(r.doc_id, r.item_id) for r in decontamination.find_contamination(docs, items).collect()} == want


def test_benchmark_in_parts(leaks, monkeypatch):
    docs, items, want = leaks
    monkeypatch.setattr(decontamination, "PART_BYTES", 2_000)
    assert {(r.doc_id, r.item_id) for r in decontamination.find_contamination(docs, items).collect()} == want


def test_leak_edges(edge, none, spark):
    items = spark.createDataFrame([(1, edge_rows()[0][1]), (2, None), (3, ""), (None, "!!")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(edge, items).collect()}
    assert {(1, 1), (2, 1), (3, 1), (14, 1), (None, 1)} == found
    assert decontamination.find_contamination(none, items).count() == 0
    assert decontamination.find_contamination(edge, items.where("item_id = 3")).count() == 0
    kept = decontamination.drop_contaminated(edge, items)
    assert kept.columns == edge.columns and {1, 2, 3, 14} & {r.doc_id for r in kept.collect()} == set()


def test_leak_stage_tells_rows_of_one_id_apart(spark):
    leak, clean = edge_rows()[0][1], "nothing of the benchmark stands in this text"
    docs = spark.createDataFrame([(1, leak), (1, clean), (None, leak), (None, clean)], "doc_id long, text string")
    kept = decontamination.drop_contaminated(docs, spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == [(1, clean), (None, clean)]


# registered --------------------------------------------------------------------------------------


@has_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(map(tuple, cur.fetchall()), key=repr)


@has_tables
def test_queries_equal_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op2_near_dedup"](spark, SF).collect()}
    assert near == plain.near(docs, 4, 80)
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op8_suffix_repeats"](spark, SF).collect()}
    assert cut == plain.repeats(docs, 100)
    leaks = {(r.doc_id, r.item_id) for r in queries.QUERIES["op9_decontamination"](spark, SF).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {(d, i) for d, t in docs for i, x in items if x in (t or "")} <= leaks


@has_tables
@has_tokenizer
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = P.write_through(stage(spark, docs, SF), f"test-{name}")
        now = {r.doc_id for r in docs.collect()}
        assert now <= ids and docs.count() == len(now)
        if name == "near_dedup":
            groups = plain.near(before, 5, 80)
            assert now == {c for _, c in groups.values()}
        if name == "token_files":
            assert now == ids
        else:
            assert docs.columns == columns
        ids = now
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
